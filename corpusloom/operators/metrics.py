"""Aggregations over predictions, runs and token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Rows by key and their share in percent, to two places."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(key, "n", F.bround(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def confusion(df: DataFrame, target: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def hundredths(c: str) -> Column:
    """Amounts of two decimals as whole numbers: their sum doesn't depend on the order of the rows."""
    return F.round(F.col(c) * 100).cast("long")


def mean_of_hundredths(c: str) -> Column:
    return F.sum(hundredths(c)) / (F.count(c) * 100)


def rounded_mean(c: str, places: int) -> Column:
    """The mean of amounts of two decimals, halves to even. What is rounded is a whole number or a
    half exactly where the mean lies halfway, so it doesn't depend on how a mean is held in binary."""
    return F.bround(F.sum(hundredths(c)) * 10 ** (places - 2) / F.count(c)) / 10**places


def per_label(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label from confusion counts; 0 where nothing is to divide by.

    Each count is dealt to its two roles, so the counts are made once.
    """
    hit, none = F.col("target") == F.col("predicted"), F.lit(0).cast("long")
    n_hit, n_miss = F.when(hit, F.col("n")).otherwise(none), F.when(hit, none).otherwise(F.col("n"))
    role = lambda label, tp, fp, fn, support: F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), support.alias("support"))
    roles = F.array(role("target", n_hit, none, n_miss, F.col("n")), role("predicted", none, n_miss, none, none))
    s = counts.select(F.explode(roles).alias("r")).select("r.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    s = s.withColumns({"precision": p, "recall": r})
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def floor_percentiles(df: DataFrame, group: str, value: Column, shares: tuple[float, ...]) -> DataFrame:
    """The value at place floor(n * p) from 0, at most the last.

    From counts by value: a group's rows are never gathered in one task.
    """
    counts = df.groupBy(group, value.alias("v")).agg(F.count("*").alias("m"))
    running = counts.selectExpr(group, "v", f"sum(m) OVER (PARTITION BY {group} ORDER BY v) AS upto", f"sum(m) OVER (PARTITION BY {group}) AS n")
    at = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares]
    return running.groupBy(group).agg(*at, F.max("v").alias("max"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def weighted_mean(rate: str, n: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(rate) * F.col(n)), F.sum(n)), F.lit(0.0))


def pair_separation(df: DataFrame) -> DataFrame:
    """Number of pairs and mean dot product of all pairs of rows (embedding, label) with and without a common label.

    The dots of a set's pairs add up to half of |sum v|^2 - sum |v|^2, so no pairs are made.
    Pairs with a null label have a row of their own, whose ``same`` is null.
    """
    long = df.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    axes = long.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sizes = df.groupBy("label").agg(F.count("*").alias("n"))

    def dots(s: DataFrame, name: str) -> DataFrame:
        return s.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0)).alias(f"{name}_dot"))

    def pairs(s: DataFrame, name: str) -> DataFrame:
        return s.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).cast("long").alias(f"{name}_n"))

    def whole(s: DataFrame, *names: str) -> DataFrame:
        return s.groupBy(*(c for c in s.columns if c == "i")).agg(*(F.sum(c).alias(c) for c in names))

    known, counted = axes.where("label IS NOT NULL"), sizes.where("label IS NOT NULL")
    parts = [dots(known, "same"), pairs(counted, "same"), dots(whole(known, "s", "q"), "known"), pairs(whole(counted, "n"), "known"), dots(whole(axes, "s", "q"), "every"), pairs(whole(sizes, "n"), "every")]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)
    rows = [("true", "same_n", "same_dot"), ("false", "known_n - same_n", "known_dot - same_dot"), ("cast(null as boolean)", "every_n - known_n", "every_dot - known_dot")]
    told = one.select(F.explode(F.array(*(F.expr(f"named_struct('same', {a}, 'pairs', {n}, 'dot', {d})") for a, n, d in rows))).alias("r")).select("r.*")
    return told.where("pairs > 0").select("same", "pairs", F.bround(F.col("dot") / F.col("pairs"), 5).alias("mean"))
