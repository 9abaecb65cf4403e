"""Operators on ordered parts: packing, overlap, islands, sections, state replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_bins(parts: Column, budget: int, separator: int = 0, between: str = "\n") -> Column:
    """Parts joined in order until the next would overflow the budget; a bin has one part at least.

    ``separator`` is what a join counts towards the budget.
    """
    start = F.struct(F.array().cast("array<string>").alias("bins"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def fold(acc: Column, part: Column) -> Column:
        size = F.length(part)
        full = acc["cur"].isNotNull() & (acc["n"] + size + separator > budget)
        return F.struct(
            F.when(full, F.array_append(acc["bins"], acc["cur"])).otherwise(acc["bins"]).alias("bins"),
            F.when(full | acc["cur"].isNull(), part).otherwise(F.concat(acc["cur"], F.lit(between), part)).alias("cur"),
            F.when(full | acc["cur"].isNull(), size).otherwise(acc["n"] + size + separator).alias("n"),
        )

    return F.aggregate(parts, start, fold, lambda a: F.when(a["cur"].isNull(), a["bins"]).otherwise(F.array_append(a["bins"], a["cur"])))


def numbered(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """A row per chunk, with its number from 1 and how many there are."""
    return df.withColumn("_c", chunks).select(*keep, F.size("_c").alias("split_total"), F.posexplode("_c").alias("part", "chunk")).withColumn("part", F.col("part") + 1)


def with_overlap(df: DataFrame, key: str, lines: int = 10, mark: str = "// ... (continued from previous part)\n") -> DataFrame:
    """Each chunk after the first begins with the last lines of the one before."""
    before = F.lag("chunk").over(Window.partitionBy(key).orderBy("part"))
    tail = F.split(before, "\n")
    last = F.array_join(F.slice(tail, F.greatest(F.size(tail) - (lines - 1), F.lit(1)), F.lit(lines)), "\n")
    return df.withColumn("chunk", F.when(before.isNull(), F.col("chunk")).otherwise(F.concat(F.lit(mark), last, F.lit("\n\n"), F.col("chunk"))))


def islands(df: DataFrame, key: str, order: str, same_as_before: Column) -> DataFrame:
    """Number the runs of rows that ``same_as_before`` (on columns _prev_*) ties together."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("island", F.sum(F.when(same_as_before, 0).otherwise(1)).over(w))


def merge_roles(turns: DataFrame, barrier: Column | None = None) -> DataFrame:
    """Neighbouring turns (conv_id, turn, role, text) of one role become one, texts parted by a blank line."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    wall = F.lit(False) if barrier is None else barrier
    df = turns.withColumns({"_prev": F.lag("role").over(w), "_wall": wall}).withColumn("_prev_wall", F.lag("_wall").over(w))
    tied = F.coalesce((F.col("role") == F.col("_prev")) & ~F.col("_wall") & ~F.col("_prev_wall"), F.lit(False))
    runs = islands(df, "conv_id", "turn", tied)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return runs.groupBy("conv_id", "island").agg(F.min("turn").alias("turn"), F.first("role").alias("role"), F.array_join(texts, "\n\n").alias("text"), F.count("*").alias("n_merged"))


def sections(df: DataFrame, key: str, heading: Column, least: int = 200, most: int = 4000) -> DataFrame:
    """Text between headings (a condition on column ``line``): title, start line and content.

    Sections shorter than ``least`` go, longer ones are cut to ``most``. A text without any
    heading is one section, "Document Content".
    """
    lines = df.select(key, F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("h", heading)
    part = lines.withColumn("section", F.sum(F.col("h").cast("int")).over(Window.partitionBy(key).orderBy("k")))
    part = part.withColumn("last", F.max("section").over(Window.partitionBy(key)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("k", "line")))), lambda x: x["line"]), "\n")
    title = F.when(F.col("section") == 0, "Document Content").otherwise(F.min_by("line", "k"))
    g = part.where("section > 0 OR last = 0").groupBy(key, "section").agg(title.alias("title"), F.min("k").alias("start_line"), body.alias("content"))
    content = F.when(F.col("section") == 0, F.col("content")).otherwise(F.regexp_replace("content", r"^\s+|\s+$", ""))
    return g.withColumn("content", content).where(F.length("content") >= least).withColumn("content", F.substring("content", 1, most))


def first_success(events: DataFrame, key: str, order: list[str], ok: Column, retries: int) -> DataFrame:
    """Attempts until the first success among ``retries`` + 1: attempts made and how it ended."""
    w = Window.partitionBy(key).orderBy(*order)
    tried = events.withColumns({"attempt": F.row_number().over(w), "ok": ok}).where(F.col("attempt") <= retries + 1)
    g = tried.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"), F.max("attempt").alias("made"))
    return g.select(key, F.coalesce("won", "made").alias("attempts"), F.when(F.col("won").isNotNull(), "ok").when(F.col("made") > retries, "exhausted").otherwise("error").alias("status"))


def labelled_parts(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Texts cut into parts of ``size`` characters; each of several says which it is."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    parts = df.select(key, F.col(text).alias("_text"), n.alias("split_total")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("split_total"))))
    cut = F.substring("_text", (F.col("part") - 1) * size + 1, F.lit(size))
    head = F.concat(F.lit("[Part "), F.col("part").cast("string"), F.lit("/"), F.col("split_total").cast("string"), F.lit("]\n"))
    return parts.withColumn("chunk", F.when(F.col("split_total") > 1, F.concat(head, cut)).otherwise(F.col("_text"))).drop("_text")
