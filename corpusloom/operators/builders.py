"""Operators that build corpora out of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def chat_records(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """Rows whose sides both hold something, as JSON of two messages."""
    sides = [F.struct(F.lit(role).alias("role"), T.strip(c).alias("content")) for role, c in (("user", question), ("assistant", answer))]
    return df.where((T.strip(question) != "") & (T.strip(answer) != "")).select(key, F.to_json(F.array(*sides)).alias("messages"))


def fan_out(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each domain whose rule holds: one scan for all domains."""
    domains = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("domain", F.explode(domains))


def manifest(rows: DataFrame, group: str, ident: str, cap: int, share: float = 0.05) -> DataFrame:
    """Of each group how many rows there are, are used, and go to either side of the split."""
    used = F.least(F.count(ident), F.lit(cap))
    valid = F.greatest(F.lit(1), F.bround(used * share)).cast("long")
    return rows.groupBy(group).agg(F.count(ident).alias("n_source"), used.cast("long").alias("n_used"), (used - valid).cast("long").alias("n_train"), valid.alias("n_valid"))


def first_level(df: DataFrame, rules: list[Column]) -> DataFrame:
    """The rows of the first rule that any row fits, with its number. Rows may fit several rules."""
    levels = F.array_compact(F.array(*[F.when(rule, F.lit(k)) for k, rule in enumerate(rules)]))
    fitting = df.withColumn("level", F.explode(levels))
    low = fitting.agg(F.min("level").alias("level"))
    return fitting.join(F.broadcast(low), "level")


def project_records(files: DataFrame) -> DataFrame:
    """Records of projects that have a configuration (project, k, kind, body): one for the whole, with
    the first README and two sources, and one for each source."""
    of = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("body")), F.when(F.col("kind") == kind, F.col("k")))
    projects = files.groupBy("project").agg(of("config").alias("config"), of("readme").alias("readme")).where("config IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("project").orderBy("k"))
    two = files.where("kind = 'source'").withColumn("rn", rank).where("rn <= 2").groupBy("project").agg(F.array_sort(F.collect_list(F.struct("k", "body"))).alias("s"))
    told = F.array_join(F.transform("s", lambda x: x["body"]), "+")
    whole = projects.join(two, "project", "left").select("project", F.lit("project").alias("kind"), F.concat_ws("|", "config", F.coalesce("readme", F.lit("")), F.coalesce(told, F.lit(""))).alias("body"))
    single = files.where("kind = 'source'").join(projects, "project", "left_semi").select("project", F.lit("file").alias("kind"), "body")
    return whole.unionByName(single)


def first_comments(lines: Column, mark: str, most: int, between: str) -> Column:
    """The first lines that begin with a mark, joined; null if there is none."""
    found = F.slice(F.filter(lines, lambda x: x.startswith(mark)), 1, most)
    return F.when(F.size(found) > 0, F.array_join(found, between))


def leading_comments(lines: Column, mark: str, most: int) -> Column:
    """The comment lines that a text begins with, without their mark, joined by blanks."""
    head = F.slice(lines, 1, most)
    firsts = F.filter(head, lambda x, k: F.forall(F.slice(head, 1, k + 1), lambda y: y.startswith(mark)))
    return F.array_join(F.transform(firsts, lambda x: F.substring(x, len(mark) + 1, 1 << 20)), " ")


def combinations(df: DataFrame, axes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each row once for every combination of the axes' values."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def from_registry(read: Callable[[str], DataFrame], sources: dict[str, tuple]) -> DataFrame:
    """name, id and prompt of all sources; each is (table, id, prompt, condition, limit)."""
    every = None
    for name, (source, ident, prompt, condition, limit) in sources.items():
        one = read(source).where(condition).select(F.lit(name).alias("name"), ident.cast("long").alias("id"), prompt.alias("prompt")).orderBy("id").limit(limit)
        every = one if every is None else every.unionByName(one)
    return every
