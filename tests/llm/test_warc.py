import base64
import gzip
import hashlib

from corpusloom.llm import warc


def rows():
    out = [(k, f"https://{'abc'[k % 3]}.example.com/p/{k % 17}?q={k}", f"<p>{k % 13}</p>" * (k % 5)) for k in range(200)]
    return out + [(500, None, "x"), (501, "no scheme\r\n", "x"), (502, "http://é.org/ü z", None), (503, "http://h", ""), (3, "https://again", "<p>3</p>" * 3), (None, "http://n", "x"), (None, "http://m", "only nulls"), (None, "http://k", "only nulls"), (7, "http://dup", "dup"), (7, "http://dup", "dup"), (9, "http://dup", "dup")]


def want(least=0):
    first = {}
    for i, _, h in rows():
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows():
        p = (h or "").encode()
        f = first.get(h or "") if len(p) >= least else None
        again = f is not None and i != f
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "page_id long, url string, html string, n int")
    for least in (0, 9):
        got = warc.round_trip(df, least_bytes=least)
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want(least)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_look_up(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    captures = warc.write_archives(df, out)
    files = warc.write_index(captures, out, block_lines=3, file_captures=40)
    assert files.count() > 3
    urls = [r[1] for r in rows()] + ["http://absent.example", "zz", ""]
    for url in urls[::9] + urls[-14:]:
        got = sorted(r["page_id"] for r in warc.look_up(files, spark.createDataFrame([(url,)], "url string")).collect())
        assert got == sorted(str(r[0]).replace("None", "null") for r in rows() if warc.url_key(r[1]) == warc.url_key(url))
    one = captures.where("page_id = '12'").first()
    with open(one["path"].removeprefix("file://"), "rb") as f:
        f.seek(one["offset"])
        assert gzip.decompress(f.read(one["length"])).endswith(b"<p>12</p><p>12</p>\r\n\r\n")
    held = warc.read_records(captures.where("page_id = '12'"), payloads=True).first()
    assert bytes(held["payload"]) == b"<p>12</p><p>12</p>"


def test_url_key():
    assert warc.url_key("https://U@WWW.Example.com:80/A?b#c") == "com,example,www:80)/A?b#c"
    assert warc.url_key("http://x.org") == "org,x)/"
    assert warc.url_key(None) == ")"


def test_key_of_a_quoted_url():
    from urllib.parse import quote

    for url in ("http://münchen.de", "http://MÜNCHEN.DE/Ä", "http://m%c3%bcnchen.de", "http://M%C3%9CNCHEN.de:8/", "http://a b.org", "http://a%zz.org%", "http://%FF.org", "http://x:٣/", "http://%4é.org"):
        assert warc.url_key(url) == warc.url_key(quote(url, safe="%/?#=&:,;@!$'()*+~[]")), url
    assert warc.url_key("http://MÜNCHEN.de") == warc.url_key("http://m%C3%BCnchen.de") == "de,m%C3%BCnchen)/"


def test_first_capture_with_an_odd_host(spark):
    urls = ["http://münchen.de", "http://M%C3%9Cnchen.de/x", "http://a b.org/ü"]
    df = spark.createDataFrame([(10 * k + j, u if j == 0 else f"http://copy{j}.org", f"<p>{k}</p>") for k, u in enumerate(urls) for j in range(3)], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == [(10 * k + j, 8, "revisit" if j else "response", 10 * k if j else None) for k in range(3) for j in range(3)]


def test_look_up_deals_out_a_large_key(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(2000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("p"), F.col("id") % 500).alias("html"))
    out = f"file://{tmp_path}/w"
    files = warc.write_index(warc.write_archives(df, out), out, block_lines=16, file_captures=700)
    urls = spark.createDataFrame([(None,), ("",), (None,)], "url string")
    found = warc.look_up(files, urls).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.collect_list("page_id").alias("ids")).collect()
    assert sorted(int(i) for r in found for i in r["ids"]) == list(range(2000))
    assert max(r["n"] for r in found) < 2000 / 4
    assert sorted(r["page_id"] for r in warc.round_trip(df).where("payload_bytes IS NOT NULL").collect()) == list(range(2000))
