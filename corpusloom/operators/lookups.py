"""Lookups: by priority, through aliases, to the nearest ancestor or neighbour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """Of each key the row from the first table that has it. Tables have the same columns."""
    rest = [c for c in tables[0].columns if c != key]
    every = None
    for k, one in enumerate(tables):
        one = one.select(key, F.struct(*rest).alias("v"), F.lit(k).alias("prio"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min_by("v", "prio").alias("v")).select(key, "v.*")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def nearest_ancestor(paths: DataFrame, known: DataFrame, path: str, value: str) -> DataFrame:
    """The value of the longest known beginning of a path, by whole parts; null if none.

    Each path meets its own ancestors alone: an equi-join on exploded beginnings.
    """
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = paths.select(path, F.explode(heads).alias("_head"))
    hit = up.join(known.select(F.col(path).alias("_head"), value), "_head")
    best = hit.groupBy(path).agg(F.max_by(value, F.length("_head")).alias(value))
    return paths.join(best, path, "left")


def earlier_neighbour(vectors: DataFrame, ident: str, vector: str, window: int, least: float) -> DataFrame:
    """Of each vector the most alike one among the ``window`` ids before it, if alike enough.

    Distinct ids are dealt into blocks of ``window``; a vector goes to its own block and, as a
    candidate, to the next. A block is one product of two small matrices.
    """
    block = F.floor(F.col(ident) / window)
    here = F.explode(F.array(F.struct(block.alias("k"), F.lit(True).alias("own")), F.struct((block + 1).alias("k"), F.lit(False).alias("own")))).alias("at")
    dealt = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"), here).select("id", "v", "at.k", "at.own")

    def best(rows: pa.Table) -> pa.Table:
        ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy()
        flat = np.array(rows.column("v").to_pylist(), float).reshape(len(ids), -1)
        size = np.sqrt((flat * flat).sum(1))
        order = np.argsort(ids, kind="stable")
        mine = np.flatnonzero(own)
        cos = flat[mine] @ flat[order].T / (np.outer(size[mine], size[order]) + 1e-9)
        near = (ids[order] < ids[mine, None]) & (ids[order] >= ids[mine, None] - window)
        cos = np.where(near, np.round(cos, 5), -2.0)
        at = cos.argmax(1) if len(mine) and len(order) else np.zeros(0, int)
        top = cos[np.arange(len(mine)), at]
        keep = top >= max(least, -1.0)
        return pa.table({"a": ids[mine][keep], "b": ids[order][at][keep], "cos": top[keep]})

    return dealt.groupBy("k").applyInArrow(best, "a long, b long, cos double")


def in_order(groups: list[str], order: list) -> Window:
    return Window.partitionBy(*groups).orderBy(*order)


#: Distinct words of the items up to which they are broadcast; beyond, they are shuffled.
BROADCAST_WORDS = 200_000


def contains_scores(items: DataFrame, texts: DataFrame, item: str, ident: str, distinct: Column, least: float) -> DataFrame:
    """Of an item's distinct words (item, w) the share that a text has (``distinct``: an array of its
    words), where it is ``least`` or more, and the sorted words that are missing.

    Of a text only the words that any item has are moved. A text needs ``least`` of an item's n words,
    rounded up. The half of so many words that most items have fetch no texts: common words would fetch
    all. Of the others a text must have the needed ones less that half; those pairs are then verified on
    all words.
    """
    vocabulary = items.select("w").distinct()
    few = vocabulary.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    each = texts.select(ident, F.explode(distinct).alias("w")).join(F.broadcast(vocabulary) if few else vocabulary, "w", "left_semi")
    own = each.groupBy(ident).agg(F.collect_set("w").alias("_own"))
    words = items.groupBy(item).agg(F.collect_set("w").alias("_all"))
    need = F.ceil(F.size("_all") * least)
    words = words.select(item, "_all", need.alias("_need"), F.floor(need / 2).alias("_left"))
    counts = items.groupBy("w").agg(F.count("*").alias("_items"))
    order = Window.partitionBy(item).orderBy("_items", F.desc(F.length("w")), "w")
    ranked = items.join(counts, "w").withColumn("_rank", F.row_number().over(order)).join(words, item)
    probe = ranked.where(F.col("_rank") <= F.size("_all") - F.col("_left")).select(item, "w")
    pairs = own.select(ident, F.explode("_own").alias("w")).join(probe, "w").groupBy(item, ident).agg(F.count("*").alias("_hits"))
    both = pairs.join(words, item).where(F.col("_hits") >= F.col("_need") - F.col("_left")).join(own, ident)
    score = F.size(F.array_intersect("_own", "_all")) / F.size("_all")
    return both.select(item, ident, score.alias("score"), F.array_sort(F.array_except("_all", "_own")).alias("missing")).where(F.col("score") >= least)
