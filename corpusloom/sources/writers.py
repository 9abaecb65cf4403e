"""Sinks: JSON lines by domain and split, CSV manifests, digests, content-addressed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import file_system

#: Rows whose bodies are in Python at a time.
FEW_ROWS = 64
#: Rows of one Arrow batch while files are written.
BATCH_ROWS = 256


def json_by_split(df: DataFrame, path: str, by: tuple[str, ...] = ("domain", "split")) -> None:
    """A folder for each domain and split, overwritten."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def csv_manifest(df: DataFrame, path: str, columns: list[str], split: str = "split") -> None:
    """Fixed columns, a folder for each split, with a header."""
    df.select(*columns, split).write.mode("overwrite").option("header", True).partitionBy(split).csv(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Rows with a time where they lack one, appended; Spark's commit makes each append whole."""
    df.withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))).write.mode("append").json(path)


def content_digest(df: DataFrame) -> DataFrame:
    """One hash of all rows, whatever their order, and their number.

    The rows' hashes are added up as numbers, by partial sums: nothing is collected.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(parts)])
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(8)]), 256).alias("digest"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """name and lowercase sha256 of the bytes of every file of a folder."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"))


def verified(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """The manifest's files (name, digest) with status verified, changed or missing."""
    there = now.select("name", F.col("digest").alias("_now"))
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("digest"), "verified").otherwise("changed")
    return manifest.join(there, "name", "left").select("name", "digest", status.alias("status"))


def sse_chunks(df: DataFrame, content: str, stream: str) -> DataFrame:
    """A data line for each piece of content."""
    body = F.to_json(F.struct(F.col(stream).alias("id"), F.array(F.struct(F.struct(F.col(content).alias("content")).alias("delta"))).alias("choices")))
    return df.select(stream, F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("chunk"))


def sse_finish(reason: Column, tokens: Column) -> Column:
    """The chunks that end a stream: why, what was used, and the mark of the end."""
    body = F.to_json(F.struct(F.array(F.struct(F.struct().alias("delta"), reason.alias("finish_reason"))).alias("choices"), F.struct(tokens.alias("completion_tokens")).alias("usage")))
    return F.concat(F.lit("data: "), body, F.lit("\n\ndata: [DONE]\n\n"))


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, FEW_ROWS at a time, so that a step's Python values are bounded by these."""
    for b in batches:
        yield from (b.slice(k, FEW_ROWS) for k in range(0, b.num_rows, FEW_ROWS))


def row_files(df: DataFrame, out: str, name: Column, body: Column) -> int:
    """Write each row as a file ``out``/``name``; how many were written.

    A task that is run again writes the same files anew.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = file_system(out)
        there: set[str] = set()
        for b in few_rows(batches):
            for path, raw in zip(b.column("name").to_pylist(), b.column("body").to_pylist(), strict=True):
                folder = f"{at}/{path}".rpartition("/")[0]
                if folder not in there:
                    store.create_dir(folder, recursive=True)
                    there.add(folder)
                with store.open_output_stream(f"{at}/{path}", compression=None) as f:
                    f.write(raw)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    rows = df.select(name.alias("name"), body.cast("binary").alias("body"))
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    try:
        # The work is done here, so the smaller batches are for it alone.
        conf.set(key, BATCH_ROWS)
        return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        conf.set(key, before)


def content_addressed(df: DataFrame, text: str, known: DataFrame | None = None) -> DataFrame:
    """Rows by the hash of their text without identifiers; what is known is not written again."""
    uuid = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    h = F.sha2(F.encode(F.regexp_replace(text, uuid, "00000000-0000-0000-0000-000000000000"), "utf-8"), 256)
    out = df.withColumn("hash", h).dropDuplicates(["hash"])
    return out if known is None else out.join(known.select("hash").distinct(), "hash", "left_anti")
