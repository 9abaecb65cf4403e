"""Files listed and opened by tasks, against Spark's own reader."""

import gzip

import pytest

from pyspark.sql import functions as F

from corpusloom.plans import formats
from corpusloom.sources import listing, readers

FILES = {"a.docx": b"one", "b c%20d+ä.docx": b"two", "sub/empty.docx": b"", "sub/x=1/deep.pdf": b"\x00\xff", "_x=2/e.docx": b"e", "_hidden/f.docx": b"f", "sub/.g.docx": b"g", "sub/_h.docx": b"h", "i._COPYING_": b"i"}


@pytest.fixture
def folder(tmp_path):
    for name, raw in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "bare").mkdir()
    return str(tmp_path)


def by_spark(spark, folder, pattern="*"):
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return sorted((r.path, r.length, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("pattern", ["*", "*.docx", "*.p?f"])
def test_the_same_files_as_spark_lists(spark, folder, pattern):
    want = by_spark(spark, folder, pattern)
    assert len(want) >= 1
    for root in (folder, f"file://{folder}"):
        assert sorted(tuple(r) for r in listing.listed(spark, root, pattern).collect() if r.length) == [w[:2] for w in want]
        assert sorted((r.path, listing.body(r.path)) for r in listing.files(spark, root, pattern).collect()) == [(w[0], w[2]) for w in want]


def test_a_file_is_read_up_to_its_bound(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 100)
    assert listing.body(f"file:{tmp_path}/a", 10) == b"x" * 11 and listing.body(f"file:{tmp_path}/a", 100) == b"x" * 100


def test_files_are_dealt_out(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"f{k}.txt").write_bytes(b"x")
    monkeypatch.setattr(listing, "FILES_A_TASK", 10)
    monkeypatch.setattr(listing, "LIST_ROWS", 7)
    assert listing.files(spark, str(tmp_path)).rdd.getNumPartitions() == 30 and listing.files(spark, str(tmp_path)).distinct().count() == 300


def test_office_files_are_not_listed_on_the_driver(spark):
    """A scan's files are what the driver keeps: those of the listing, not one a document."""
    df = formats.s21_text_documents(spark, "/root/testdata/sf0.001")
    assert len(df.inputFiles()) < 50 and df.count() == 200


@pytest.mark.parametrize("query", ["s19_pdf_pages", "s19_pdf_methods"])
def test_pdfs_are_not_listed_on_the_driver(spark, query):
    assert len(getattr(formats, query)(spark, "/root/testdata/sf0.001").inputFiles()) < 50


def test_trees_are_read_as_spark_reads_them(spark, folder, tmp_path, monkeypatch):
    (tmp_path / "sub" / "g [1]#2?.docx.gz").write_bytes(gzip.compress("gepackt ä".encode()))
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx*").text(folder, wholetext=True)
    want = sorted(map(tuple, df.select(F.col("_metadata.file_path"), "value").collect()))
    assert len(want) == 4
    for most in (listing.BATCH_BYTES, 1):
        monkeypatch.setattr(listing, "BATCH_BYTES", most)
        assert sorted(map(tuple, readers.source_tree(spark, folder, "*.docx*").collect())) == want


def test_a_tree_is_not_listed_on_the_driver(spark, tmp_path):
    """What the batch of PDFs counts its written texts by."""
    for k in range(200):
        (tmp_path / f"f{k}.txt").write_text("x")
    read = readers.source_tree(spark, str(tmp_path), "*.txt")
    assert len(read.inputFiles()) < 50 and read.count() == 200
