import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import structure, text
from corpusloom.sources import readers, writers
from corpusloom.streaming import streams


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1}\nnot json\n\n{"k": 2}\n')
    assert sorted(r["k"] for r in readers.json_lines(spark, str(p), "k int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p), "k int").collect()
    got = readers.directory_as_column(spark, str(tmp_path), "k int").where("k IS NOT NULL").collect()
    assert {r["domain"] for r in got} == {"a"}


def test_recursive_and_array(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "train.jsonl").write_text('{"k": 1}\n')
    (tmp_path / "x" / "valid.jsonl").write_text('{"k": 2}\n')
    (tmp_path / "x" / "list.json").write_text(json.dumps([{"k": 5}, {"k": 6}]))
    assert [r["k"] for r in readers.recursive(spark, str(tmp_path), "k int").collect()] == [1]
    assert readers.json_array(spark, str(tmp_path / "x" / "list.json"), "k int").count() == 2


def test_manifests(spark, tmp_path):
    keyed, listed = tmp_path / "k.json", tmp_path / "l.json"
    keyed.write_text(json.dumps({"domains": {"a": {"license": "MIT"}, "b": {}}}))
    listed.write_text(json.dumps([{"domain": "a", "access_date": "2026-01-02T10:00"}, {"domain": "a", "access_date": "2026-03-04"}]))
    got = readers.keyed_manifest(spark, str(keyed), "license: string", defaults={"license": "unknown"})
    assert {r["domain"]: r["license"] for r in got.collect()} == {"a": "MIT", "b": "unknown"}
    assert [tuple(r) for r in readers.listed_manifest(spark, str(listed), "domain string, access_date string").collect()] == [("a", "2026-03-04")]


def test_csv_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h1", 3, "D1"), (" ", 4, "D1"), ("h2", 5, "D2")], "dedup_hash string, size int, split string")
    writers.csv_manifest(df, str(tmp_path / "m"), ["dedup_hash", "size"])
    assert {r[0] for r in readers.known_hashes(spark, str(tmp_path / "m"), "dedup_hash string, size int").collect()} == {"h1", "h2"}
    writers.json_by_split(df.withColumn("domain", F.lit("d")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).groupBy("split").count().count() == 2
    same = [writers.content_digest(x).first()["digest"] for x in (df, df.orderBy(F.desc("size")), df.limit(1))]
    assert same[0] == same[1] != same[2]
    audit = spark.createDataFrame([("a", None), ("b", "t")], "event_type string, timestamp string")
    writers.append_audit(audit, str(tmp_path / "audit"))
    writers.append_audit(audit, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).where("timestamp IS NOT NULL").count() == 4


def test_content_addressed(spark):
    a, b = "11111111-2222-3333-4444-555555555555", "99999999-2222-3333-4444-555555555555"
    df = spark.createDataFrame([(f"(uuid {a})",), (f"(uuid {b})",), ("other",)], "text string")
    out = writers.content_addressed(df, "text")
    assert out.count() == 2
    assert writers.content_addressed(df, "text", out.limit(1)).count() == 1
    assert writers.sse_chunks(df.withColumn("s", F.lit(1)), "text", "s").first()["chunk"].startswith('data: {"id":1,"choices":[{"delta"')


def test_binary_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" plain ")
    (tmp_path / "b.html").write_text("<script>x</script><p>A &amp; B</p><p>C</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.png").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"PK")
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["text"]) for r in readers.binary_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ok", "plain"), "b.html": ("ok", "A & B\nC"), "c.pdf": ("damaged", None), "d.png": ("unavailable", None), "e.docx": ("damaged", None)}
    assert readers.source_tree(spark, str(tmp_path), "*.txt").first()["text"] == " plain "


def test_fallbacks(spark):
    empty = spark.createDataFrame([], "k int")
    assert readers.primary_or_fallback(empty, lambda: spark.range(3)).count() == 3
    assert readers.or_empty(spark, lambda: spark.read.parquet("/no/such/path"), "k int").count() == 0


def test_training_log(spark):
    log = "PHASE 1\nIter 10: Train loss 2.5\nPHASE 2\nIter 340: Train loss 1.25\nVal loss 0.412\n12.5 min\n3 min"
    r = readers.training_log(spark.createDataFrame([(log,), ("",)], "text string")).collect()
    assert (r[0]["phase"], r[0]["iter"], r[0]["train_loss"], r[0]["val_loss"], r[0]["minutes"]) == (2, 340, 1.25, 0.412, 12.5)
    assert (r[1]["phase"], r[1]["iter"], r[1]["val_loss"]) == (0, 0, None)


def test_structure(spark):
    call = 'Looking it up now: {"name":"fetch_row","arguments":{"table":"t1"}} ok'
    assert structure.tool_call(call) == ("Looking it up now:", "fetch_row", '{"table": "t1"}')
    assert structure.tool_call('[TOOL_CALLS]f[ARGS]{"a": "}\\""}')[1:] == ("f", '{"a": "}\\""}')
    assert structure.tool_call("plain {x}") == ("plain {x}", None, None)
    assert structure.top_level('(pcb (a "(") (b (c)))') == ['(a "(")', "(b (c))"]
    assert structure.without_block("(x (lib_symbols (y)) z)") == "(x (lib_symbols) z)"
    assert structure.without_block("(x (lib_symbols (y)") is None
    urls = ["data:image/png;base64,QUI=", "data:image/png;base64,*", "data:;base64,", "image;base64,QUI=", "data:a;base64,QQ", None, "data:x;base64,QUJD\n", "data:x;base64," + "QUJD" * 50_000]
    got = [tuple(r.d) for r in spark.createDataFrame([(u,) for u in urls], "t string").select(structure.data_url("t").alias("d")).collect()]
    assert got[:7] == [("image/png", b"AB"), (None, None), ("", b""), (None, None), (None, None), (None, None), (None, None)] and got[7] == ("x", b"ABC" * 50_000)
    df = spark.createDataFrame([(call,), (None,)], "t string")
    assert [r["c"]["name"] for r in df.select(structure.tool_call_udf("t").alias("c")).collect()] == ["fetch_row", None]
    for key in ("s", "k" * 100, "ü"):
        got = [r.x for r in spark.createDataFrame([("a",), ("é",), (None,)], "t string").select(structure.keyed_hash("t", key).alias("x")).collect()]
        assert got == [hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in ("a", "é")] + [None]


def test_text_rules(spark):
    rows = spark.createDataFrame([("<think>x</think> a [[7.5]]",), ("why?",), (None,)], "t string")
    got = rows.select(text.without_thinking(F.col("t")).alias("a"), text.rating(F.col("t")).alias("r"), text.complexity(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("a [[7.5]]", 7.5, "simple"), ("why?", None, "complex"), (None, None, "simple")]


def run_stream(spark, tmp_path, parts, schema, transform, name):
    folder = tmp_path / name
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = transform(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").toPandas()


def test_sse_stream(spark, tmp_path):
    schema = "stream_id string, seq long, chunk string"
    parts = [[("s", 1, "data: a\n\nda")], [("s", 2, "ta: b\n"), ("s", 3, "\nrest")], [("s", 4, "[DONE]")]]
    got = run_stream(spark, tmp_path, parts, schema, streams.sse_frames, "frames")
    assert sorted(got["frame"]) == ["data: a", "data: b", "rest"]


def test_marker_stream(spark, tmp_path):
    schema = "stream_id string, seq long, kind string, text string"
    parts = [[("s", 1, "word", "a"), ("s", 2, "word", "b")], [("s", 3, "marker", ""), ("s", 4, "word", "c")]]
    got = run_stream(spark, tmp_path, parts, schema, streams.marker_windows, "windows")
    assert got["window"].tolist() == [0, 0, 0, 1]
    assert [tuple(r) for r in streams.window_texts(spark.createDataFrame(got)).collect()] == [("s", 3, "a b")]


def test_watermark_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double, event_id long"
    t = datetime(2024, 1, 1)
    parts = [[(t, "a", 1.0, 1), (t, "a", 1.0, 1)], [(t + timedelta(hours=9), "a", 2.0, 2)], [(t + timedelta(hours=30), "b", 2.0, 3)]]
    got = run_stream(spark, tmp_path, parts, schema, streams.windowed_counts, "counts")
    assert got["n"].sum() >= 2
    got = run_stream(spark, tmp_path, parts, schema, lambda s: streams.first_seen(s, "event_id"), "seen")
    assert len(got) == 3
