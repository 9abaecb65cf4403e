"""The join that deals hot keys out, and the run's folder."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, packing

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("kind", ["string", "long", "binary"])
@pytest.mark.parametrize("hot_keys", [1, 3, 1000])
def test_left_join_hot(spark, monkeypatch, kind, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    keys = [None if k % 11 == 0 else 1 if k % 3 == 0 else k % 20 for k in range(300)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key long").withColumn("key", F.col("key").cast("string").cast(kind))
    known = {k: (k * 10, keys.count(k)) for k in set(keys) if k is not None and k != 7}
    table = spark.createDataFrame([(k, v, n) for k, (v, n) in known.items()], "key long, v long, n long").withColumn("key", F.col("key").cast("string").cast(kind))
    got = common.left_join_hot(rows, table, "key", len(keys), F.col("id"), F.col("id") != 4)
    assert got.columns == ["id", "key", "v"]
    assert sorted((r["id"], r["v"]) for r in got.collect()) == sorted(((i, known[k][0] if k in known and i != 4 else None) for i, k in enumerate(keys)))


def test_hot_rows_are_dealt_out(spark):
    rows = spark.range(4000).select(F.col("id"), F.lit("same").alias("key"))
    table = spark.createDataFrame([("same", 5, 4000), ("other", 6, 1)], "key string, v int, n long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = common.left_join_hot(rows, table, "key", 4000, F.col("id"))
        tasks = joined.groupBy(F.spark_partition_id().alias("t")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in tasks) == 4000 and max(r["count"] for r in tasks) < 2000


def test_offsets_of_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "FILE_CHUNKS", 2)
    counts = {(length, chunk): (length * 7 + chunk * 3) % 5 + 1 for length in (1, 3, 8) for chunk in (0, 1, 2, 5) if (length, chunk) != (3, 1)}
    sums = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "length long, chunk long, n long")
    out = f"file://{tmp_path}/offsets"
    packing.write_offsets(sums, 8, out)
    assert sorted(os.listdir(tmp_path / "offsets")) == ["0.offsets", "1.offsets", "2.offsets"]
    for (length, chunk), _ in counts.items():
        want = sum(n for (a, b), n in counts.items() if a == length and b < chunk)
        assert packing.offsets_of(out, chunk, 8)[length] == want


def test_folder_of_a_run_ends_with_it(tmp_path):
    ask = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from corpusloom.llm.common import staged
from corpusloom.sources.scratch import scratch
staged(spark.range(3), "rows").count()
spark.range(3).write.json(scratch(spark, "rows"))
import os
print("folders", len([x for x in os.listdir("{tmp_path}") if x.startswith("corpusloom")]))
"""
    said = subprocess.run([sys.executable, "-c", ask], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert "folders 2" in said.stdout, said.stderr[-500:]
    assert not [x for x in os.listdir(tmp_path) if x.startswith("corpusloom")]
