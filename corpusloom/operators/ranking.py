"""Row numbers inside groups of any size.

Rows are ordered by a seeded hash, so they fall evenly into buckets of its first digits.
A row's number is its number in its bucket and the sizes of the buckets before: a group
with a third of all rows is numbered by as many tasks as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded

#: Hexadecimal digits of the hash that make a bucket: 4096 buckets, so ten billion rows of one group are some millions in each.
DIGITS = 3


def hash_ranked(df: DataFrame, groups: list[str], ident: str | Column, seed: int = 42) -> DataFrame:
    """Add rn (from 1, by seeded hash, inside ``groups``) and n (rows of the group)."""
    df = df.withColumn("_h", seeded(ident, seed=seed)).withColumn("_b", F.substring("_h", 1, DIGITS))
    sizes = df.groupBy(*groups, "_b").agg(F.count("*").alias("_m"))
    by = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    sizes = sizes.withColumns({"_before": F.sum("_m").over(by.orderBy("_b")) - F.col("_m"), "n": F.sum("_m").over(by)}).drop("_m")
    inside = df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h")))
    joined = inside.join(sizes, [*groups, "_b"])
    return joined.withColumn("rn", (F.col("_before") + F.col("_k")).cast("long")).drop("_h", "_b", "_k", "_before")


def first_rows(df: DataFrame, groups: list, order: list, limit: int = 1) -> DataFrame:
    """The first rows of each group. Spark keeps no more than ``limit`` of a group before the
    shuffle, so large groups are no burden."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def numbered_in_order(df: DataFrame, groups: list[str], ident: str, to: str, span: int = 1 << 16) -> DataFrame:
    """Number the rows of each group from 0 by an integral id: its number in its range of ``span``
    ids and the sizes of the ranges before. A group of any size is numbered by as many tasks as it
    has ranges."""
    df = df.withColumn("_b", F.floor(F.col(ident) / span))
    sizes = df.groupBy(*groups, "_b").agg(F.count("*").alias("_m"))
    sizes = sizes.withColumn("_before", F.sum("_m").over(Window.partitionBy(*groups).orderBy("_b")) - F.col("_m")).drop("_m")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*groups, "_b")]
    inside = df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(ident)))
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = inside.alias("l").join(sizes.alias("r"), on).select("l.*", "r._before")
    return joined.withColumn(to, (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_b", "_k", "_before")
