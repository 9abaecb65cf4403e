"""Paged sources, versions of tables, followed logs."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import paged, snapshots
from corpusloom.streaming import logs, streams


def pages(tmp_path, total=95, limit=10, told=True):
    for o in range(0, total, limit):
        items = [{"uid": f"u{o + k}", "n": o + k} for k in range(min(limit, total - o))]
        (tmp_path / f"page-{o}.json").write_text(json.dumps({"total": total, "items": items} if told else {"items": items}))
    return f"file://{tmp_path}"


def read(spark, path, schema="offset long, uid string, n long, other string, error string"):
    paged.register(spark)
    return spark.read.format("paged").schema(schema).option("limit", 10).option("pagesPerTask", 3).load(path)


def test_all_pages_by_ranges(spark, tmp_path):
    df = read(spark, pages(tmp_path))
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(k, f"u{k}", k, None, None) for k in range(95)]
    assert df.rdd.getNumPartitions() == 4
    assert read(spark, f"file://{tmp_path}", "uid string").count() == 95


def test_broken_page_ends_its_range(spark, tmp_path):
    path = pages(tmp_path)
    (tmp_path / "page-40.json").write_text("{broken")
    rows = read(spark, path).collect()
    assert sorted(r.n for r in rows if r.error is None) == [*range(40), *range(60, 95)]
    assert [(r.offset, r.error) for r in rows if r.error] == [(40, "JSONDecodeError")]


def test_without_total_until_an_empty_page(spark, tmp_path):
    path = pages(tmp_path, told=False)
    (tmp_path / "page-100.json").write_text('{"items": []}')
    assert read(spark, path).where("error IS NULL").count() == 95
    assert [r.error for r in read(spark, f"file://{tmp_path}/none").collect()] == ["FileNotFoundError"]


def test_pushed_filter_reads_fewer_pages(tmp_path, monkeypatch):
    path, seen = pages(tmp_path), []
    keep = paged.PagedReader.page
    monkeypatch.setattr(paged.PagedReader, "page", lambda self, o: seen.append(o) or keep(self, o))

    class Field:
        def __init__(self, name):
            self.name = name

    class Schema:
        fields = [Field("offset"), Field("n")]

    reader = paged.PagedReader(Schema, {"path": path, "limit": "10", "pagespertask": "3"})
    left = list(reader.pushFilters([paged.GreaterThanOrEqual(("offset",), 70), paged.LessThan(("offset",), 75), paged.EqualTo(("n",), 3)]))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(left) == 3 and [r[0] for r in rows] == list(range(70, 80)) and seen == [0, 70]


SCHEMA = "a long"


def ids(df):
    return sorted(r.a for r in df.collect())


def rows(spark, *n):
    return spark.createDataFrame([(k,) for k in n], SCHEMA)


def test_versions(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and ids(t.read(SCHEMA)) == []
    assert t.commit(rows(spark, 1, 2), after=0) == 1
    assert t.commit(t.read(SCHEMA).union(rows(spark, 3)), after=1) == 2
    assert ids(t.read(SCHEMA)) == [1, 2, 3] and ids(t.read(SCHEMA, 1)) == [1, 2]
    with pytest.raises(ValueError):
        t.read(SCHEMA, 9)


def test_two_writers_on_one_version(spark, tmp_path, monkeypatch):
    t = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t")
    t.commit(rows(spark, 1), after=0)
    with pytest.raises(snapshots.Conflict):
        t.commit(rows(spark, 5), after=0)
    # Both have seen version 1, and the other is faster between the check and the pointer.
    other = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t")
    keep = t._point

    def late(n, folder):
        monkeypatch.setattr(t, "_point", keep)
        other.commit(rows(spark, 2), after=1)
        keep(n, folder)

    monkeypatch.setattr(t, "_point", late)
    with pytest.raises(snapshots.Conflict):
        t.commit(rows(spark, 3), after=1)
    assert ids(t.read(SCHEMA)) == [2]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2 and not list((tmp_path / "t" / "pointers").glob("draft*"))
    monkeypatch.setattr(t, "_point", late)
    monkeypatch.setattr(other, "commit", lambda df, after: snapshots.SnapshotTable(spark, f"file://{tmp_path}/t").commit(df, after + 1))
    assert snapshots.changed(t, SCHEMA, lambda old: old.union(rows(spark, 7))) == 4
    assert ids(t.read(SCHEMA)) == [2, 7]


def test_killed_writer_and_damaged_pointer(spark, tmp_path, monkeypatch):
    t = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t")
    t.commit(rows(spark, 1), after=0)
    monkeypatch.setattr(t, "_point", lambda n, folder: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.commit(rows(spark, 2), after=1)
    t = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 1 and ids(t.read(SCHEMA)) == [1]
    t.commit(rows(spark, 3), after=1)
    pointer = tmp_path / "t" / "pointers" / "version-000000000002.json"
    whole = pointer.read_text()
    for crc in (True, False):
        if not crc:
            pointer.with_name("." + pointer.name + ".crc").unlink()
        for bad in ("", "{", "[]", whole.replace("data/", "data/x"), whole.replace('"version": 2', '"version": 7')):
            pointer.write_text(bad)
            assert t.version() == 1 and ids(t.read(SCHEMA)) == [1]
    assert t.commit(rows(spark, 4), after=1) == 3 and ids(t.read(SCHEMA)) == [4]


def lines(spark):
    t = datetime(2024, 1, 1)
    at = [(1, 0, "Iter 5: x"), (1, 10, "noise"), (1, 20, "PHASE 2"), (1, 500, "Val loss 1.5, saved"), (2, 5, "Iter 9 PHASE 1"), (2, 6, None), (3, 0, "nothing"), (1, 505, "Iter 6"), (2, 900, "Iter 10"), (3, 2000, "Iter 1")]
    return spark.createDataFrame([(r, k, t + timedelta(seconds=s), x, s) for k, (r, s, x) in enumerate(at)], "run long, event_id long, ts timestamp, line string, s int").repartition(3)


@pytest.mark.parametrize("cuts", [[], [15], [15, 501, 800, 1500]])
def test_log_tail_with_and_without_restarts(spark, tmp_path, cuts):
    bounds = [-1, *cuts, 9999]
    parts = [f"s >= {a} AND s < {b}" for a, b in zip(bounds, bounds[1:])]
    found = streams.replay(lines(spark), f"file://{tmp_path}/log", parts, lambda s: logs.tail(s, "run", silent_seconds=100, late="10 seconds"), logs.SETTINGS)
    t0 = int(lines(spark).agg(F.unix_micros(F.min("ts"))).first()[0])
    got = sorted((r.run, r.kind, (r.micros - t0) // 1_000_000, r.iter, r.phase, r.val_loss) for r in found.collect())
    assert got == sorted([(1, "progress", 0, 5, 0, None), (1, "progress", 20, 5, 2, None), (1, "silent", 120, 5, 2, None), (1, "progress", 500, 5, 2, 1.5), (1, "progress", 505, 6, 2, 1.5), (1, "silent", 605, 6, 2, 1.5), (2, "progress", 5, 9, 1, None), (2, "silent", 106, 9, 1, None), (2, "progress", 900, 10, 1, None), (2, "silent", 1000, 10, 1, None), (3, "silent", 100, 0, 0, None), (3, "progress", 2000, 1, 0, None)])


def test_batches_have_as_many_files_as_the_table(spark, tmp_path):
    df = lines(spark)
    streams.replay(df.select("run", F.lit("s").alias("stream_id"), F.col("event_id").alias("seq"), F.lit("word").alias("kind"), F.lit("x").alias("text"), "s"), f"file://{tmp_path}/w", ["s < 100", "s >= 100"], lambda s: streams.marker_windows(s.select("stream_id", "seq", "kind", "text")))
    files = [f for f in (tmp_path / "w" / "in").iterdir() if re.match("part-.*parquet$", f.name)]
    assert len(files) > 2
