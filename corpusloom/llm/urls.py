"""URL filter: pattern rules behind an index of their rarest literal token.

A rule is a regular expression over ``host || path`` and the literal tokens that
every match must hold as whole URL tokens. Each rule is filed under the one of its
tokens that is rarest in the corpus. The tokens of a URL fetch the rules filed under
them, and only those run their regular expression.

Everything is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Index entries up to which the index is a literal of the plan, without a shuffle.
INLINE_RULES = 256

# Words of host names that mark link farms and adverts.
SPAM_HOST_WORDS = ("spam", "pills", "viagra", "casino", "bets", "betting", "porn", "xxx", "payday", "replica")


@dataclass(frozen=True)
class UrlRule:
    """``named`` rules are reported and beat the others; among equals the longest wins."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    named: bool = True


def prefix_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule for a host with its subdomains and a prefix of the path.

    The last path token may go on in the URL, so it is no literal token unless a
    separator follows it.
    """
    tokens = [t for t in re.split(r"[^a-z0-9]+", host) if t]
    head = path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path).group())]
    tokens += [t for t in re.split(r"[^a-z0-9]+", head.translate(str.maketrans(UPPER, LOWER))) if t]
    return UrlRule(host + path, action, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(path) if path else '(?:/|$)'}", tuple(tokens))


def spam_rules() -> list[UrlRule]:
    """The method's own rules: a marked word as a whole part of the host name."""
    return [UrlRule(f"host:{w}", "block", rf"^[^/]*(?<![a-z0-9]){w}(?![a-z0-9])", (w,), named=False) for w in SPAM_HOST_WORDS]


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def url_tokens(host_path: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(ascii_lower(host_path), "[^a-z0-9]+")), "")


def token_counts(pages: DataFrame, rules: list[UrlRule], url: str = "url") -> dict[str, int]:
    """In how many rows each rule token occurs. As many rows as rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    hits = F.array_intersect(url_tokens(F.concat(url_host(F.col(url)), url_path(F.col(url)))), F.array(*map(F.lit, wanted)))
    found = pages.select(F.explode(hits).alias("token")).groupBy("token").count()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in found.collect()}


def index_rules(rules: list[UrlRule], counts: dict[str, int]) -> list[tuple[str, UrlRule]]:
    """Each rule with the token it is filed under: the rarest, then the longest."""
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token")
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), r) for r in rules]


def _entry(r: UrlRule) -> Column:
    return F.struct(F.lit(r.named).alias("named"), F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))


def filter_urls(pages: DataFrame, rules: list[UrlRule], url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """Add host, path, rule and verdict to the rows of ``pages``.

    rule: the name of the named rule that decided, else null. verdict: the action of
    the rule that decided, else ``allow``. Columns of these names are replaced; other
    columns stay. A null URL, or one without ``://``, has an empty host and path and
    is allowed. No two rows affect each other, so ties and repeated rows are judged alike.

    Up to ``inline`` rules the index is a literal of the plan and nothing is shuffled.
    Beyond that it is a table: tokens are joined with it and the best rule of each
    distinct URL is joined back.
    """
    entries = index_rules(rules, token_counts(pages, rules, url))
    # The rows' own columns go along as one, so none of them clashes with those of the work.
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    df = pages.select(F.struct(*own).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    target = F.concat("host", "path")
    if len(entries) <= inline:
        df = df.withColumn("_best", _best_inline(target, entries))
    else:
        df = _best_joined(df.withColumn("_key", target), entries)
    rule = F.when(F.col("_best.named"), F.col("_best.name"))
    return df.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(F.col("_best.action"), F.lit("allow")).alias("verdict"))


def _best_inline(target: Column, entries: list[tuple[str, UrlRule]]) -> Column:
    filed: dict[str, list[UrlRule]] = {}
    for token, r in entries:
        filed.setdefault(token, []).append(r)
    if not filed:
        return F.lit(None).cast("struct<named:boolean,size:int,name:string,action:string,regex:string>")
    index = F.create_map(*[c for t, rs in filed.items() for c in (F.lit(t), F.array(*map(_entry, rs)))])
    known = F.array(*map(F.lit, filed))
    fetched = F.flatten(F.transform(F.array_intersect(url_tokens(target), known), lambda t: F.element_at(index, t)))
    return F.array_max(F.filter(fetched, lambda r: F.call_function("rlike", target, r["regex"])))


def _best_joined(df: DataFrame, entries: list[tuple[str, UrlRule]]) -> DataFrame:
    spark = df.sparkSession
    rows = [(t, r.named, len(r.name), r.name, r.action, r.regex) for t, r in entries]
    index = spark.createDataFrame(rows, "token string, named boolean, size int, name string, action string, regex string")
    keys = df.select("_key").distinct()
    tokens = keys.select("_key", F.explode(url_tokens(F.col("_key"))).alias("token"))
    hits = tokens.join(index, "token").where(F.expr("_key rlike regex"))
    best = hits.groupBy("_key").agg(F.max(F.struct("named", "size", "name", "action", "regex")).alias("_best"))
    return df.join(best, "_key", "left")
