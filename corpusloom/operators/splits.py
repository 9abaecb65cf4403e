"""Caps, splits and mixes by seeded hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded
from .ranking import first_rows, hash_ranked


def cap(df: DataFrame, group: str, ident: str, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows of each group."""
    return first_rows(df, [group], [seeded(ident, seed=seed)], limit)


def split_by_share(df: DataFrame, groups: list[str], ident: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """valid: at least one row, else the share of the group, halves to even; train: the rest."""
    r = hash_ranked(df, groups, ident, seed)
    return r.withColumn("split", F.when(F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("n") * share)), "valid").otherwise("train"))


def split_at_floor(df: DataFrame, groups: list[str], ident: str, shares: list[tuple[str, float]], rest: str, least: int = 1) -> DataFrame:
    """Slices of at least ``least`` rows and ``floor(n * share)``, in order; then the rest."""
    r = hash_ranked(df, groups, ident)
    label, edge = F.lit(rest), F.lit(0)
    edges: list[tuple[str, Column]] = []
    for name, share in shares:
        edge = edge + F.greatest(F.lit(least), F.floor(F.col("n") * share))
        edges.append((name, edge))
    for name, upto in reversed(edges):
        label = F.when(F.col("rn") <= upto, name).otherwise(label)
    return r.withColumn("split", label)


def balanced(df: DataFrame, group: str, ident: str, total: int) -> DataFrame:
    """``total // groups`` rows of each group, at least one, then the first ``total`` of all."""
    k = df.agg(F.count_distinct(group)).first()[0]
    each = max(1, total // max(1, k))
    picked = cap(df, group, ident, each)
    return picked.orderBy(seeded(ident)).limit(total)


def fill_to_target(df: DataFrame, group: str, priority: Column, ident: str, target: int) -> DataFrame:
    """From the sources in order of priority, until the group has ``target`` rows."""
    return first_rows(df.withColumn("prio", priority), [group], ["prio", ident], target)
