"""Scans: JSON lines, keyed and listed manifests, CSV, whole files, binary files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object per line; a bad line raises, or, if not ``strict``, is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def directory_as_column(spark: SparkSession, folder: str, schema: str, column: str = "domain") -> DataFrame:
    """All ``*.jsonl`` of a folder; the file's stem becomes a column."""
    df = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(folder)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.withColumn(column, F.regexp_extract(path, r"([^/]+)\.jsonl$", 1))


def recursive(spark: SparkSession, folder: str, schema: str, name: str = "train.jsonl") -> DataFrame:
    """Every file of a name below a folder, with its path."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
    return df.withColumn("path", F.col("_metadata.file_path"))


def sampled(df: DataFrame, group: str, ident: str, limit: int = 500) -> DataFrame:
    """At most ``limit`` rows of each group by seeded hash, with the count of all."""
    from ..operators.ranking import first_rows

    totals = df.groupBy(group).agg(F.count("*").alias("total"))
    return first_rows(df, [group], [X.seeded(ident)], limit).join(totals, group)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole file is one array of rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_manifest(spark: SparkSession, path: str, fields: str, key: str = "domain", under: str = "domains", defaults: dict[str, str] | None = None) -> DataFrame:
    """An object of entries by key becomes rows; fields that lack a value get a default."""
    df = spark.read.schema(f"{under} map<string,struct<{fields}>>").option("multiLine", True).json(path)
    rows = df.select(F.explode(under).alias(key, "v")).select(key, "v.*")
    return rows.fillna(defaults or {})


def listed_manifest(spark: SparkSession, path: str, schema: str, key: str = "domain", date: str = "access_date") -> DataFrame:
    """A list of entries by key, the last of equal ones; dates are cut to the day."""
    df = json_array(spark, path, schema).withColumn("_at", F.monotonically_increasing_id())
    rest = [f.name for f in T.StructType.fromDDL(schema).fields if f.name != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("v")).select(key, "v.*")
    return last.withColumn(date, F.split_part(date, F.lit("T"), F.lit(1)))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def known_hashes(spark: SparkSession, path: str, schema: str, column: str = "dedup_hash") -> DataFrame:
    """The distinct values of a column that are not blank."""
    v = F.trim(column).alias(column)
    return csv_rows(spark, path, schema).select(v).where(F.col(column) != "").distinct()


def xml_pages(spark: SparkSession, path: str, schema: str, row: str = "page") -> DataFrame:
    """The elements of a name in an XML dump."""
    return spark.read.format("xml").schema(schema).option("rowTag", row).load(path)


def yaml_map(spark: SparkSession, path: str, under: str, key: str, value: str) -> DataFrame:
    """The ``name: value`` lines one level below a top-level key of a plain YAML file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("k", "line"))
    top = F.max_by(F.when(F.col("line").rlike(r"^\S.*:"), F.regexp_extract("line", r"^([\w-]+):", 1)), F.when(F.col("line").rlike(r"^\S.*:"), F.col("k")))
    # A configuration file is one task's work: its lines are read in order.
    named = lines.withColumn("top", top.over(Window.partitionBy(F.lit(1)).orderBy("k")))
    pair = r"^  ([\w-]+):\s*(\S.*?)\s*$"
    return named.where((F.col("top") == under) & F.col("line").rlike(pair)).select(F.regexp_extract("line", pair, 1).alias(key), F.regexp_extract("line", pair, 2).alias(value))


def source_tree(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Whole files below a folder: path and text. Files are listed and opened by tasks; the driver keeps none of their names."""
    from .listing import files, whole

    found = files(spark, folder, pattern).mapInArrow(whole, "path string, content binary")
    return found.select("path", F.col("content").cast("string").alias("text"))


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The path of the greatest name that a glob matches, found by listing; no file is opened. None without a match."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return max((f.getPath().toString() for f in found or []), key=lambda p: p.rpartition("/")[2], default=None)


def binary_documents(spark: SparkSession, folder: str, most: int = 25 << 20, cut: int = 200_000) -> DataFrame:
    """Files as text by format; too large ones and unknown formats keep a status instead.

    Plain text and HTML are read by column functions, office files as blocks, PDFs as pages; pictures
    would need text recognition and are reported as unavailable. Longer texts are cut: truncated says
    so, original_chars is the whole length.
    """
    from . import office, pdf

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("txt", "md", "csv", "log"), "text").when(ext.isin("html", "htm"), "html").when(ext.isin("pdf", "docx", "xlsx", "pptx"), ext).when(ext.isin("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"), "unavailable").otherwise("unknown")
    sized = raw.select("path", kind.alias("format"), F.when(F.col("length") > most, "too_large").when(kind.isin("unavailable", "unknown"), kind).otherwise("ok").alias("status"), "content")
    whole, packed = F.col("status") == "ok", ["docx", "xlsx", "pptx"]
    body = F.decode("content", "utf-8")
    plain = sized.where(~whole | F.col("format").isin("text", "html"))
    read = plain.select("path", "format", "status", F.when(whole, F.when(F.col("format") == "text", X.strip(body)).otherwise(X.html_to_text(body))).alias("text"))
    named = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format")
    for found in (office.texts(office.blocks(sized.where(whole & F.col("format").isin(packed)), most_bytes=most)), pdf.by_file(pdf.pages(sized.where(whole & (F.col("format") == "pdf"))))):
        read = read.unionByName(found.select("path", named, "status", F.when(F.col("status") == "ok", F.col("text")).alias("text")))
    cut_off = F.coalesce(F.length("text") > cut, F.lit(False))
    return read.select("path", "format", "status", F.substring("text", 1, cut).alias("text"), cut_off.alias("truncated"), F.length("text").alias("original_chars"))


def primary_or_fallback(primary: DataFrame, fallback: Callable[[], DataFrame]) -> DataFrame:
    """The fallback where the primary source has no row."""
    return fallback() if primary.isEmpty() else primary


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """A source that cannot be read gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def training_log(df: DataFrame, text: str = "text") -> DataFrame:
    """Progress of a log: the last match of each figure counts, the first of the minutes."""
    last = lambda p: F.element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), -1)
    number = lambda p: F.when(F.regexp_like(text, F.lit(p)), last(p)).cast("double")
    return df.withColumns(
        {
            "train_loss": number(r"Train loss ([0-9.]+)"),
            "val_loss": number(r"Val loss ([0-9.]+)"),
            "iter": F.coalesce(number(r"Iter (\d+)").cast("int"), F.lit(0)),
            "phase": F.coalesce(number(r"PHASE (\d+)").cast("int"), F.lit(0)),
            "minutes": F.nullif(F.regexp_extract(text, r"([0-9.]+) min", 1), F.lit("")).cast("double"),
        }
    )
