"""Operators on records and messages: blocks, headers, defaults, robots rules, model output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def provenance(source: Column, license_: Column, tag: Column, extra: Column) -> Column:
    return F.struct(source.alias("source"), license_.alias("license"), tag.alias("domain_tag"), extra.alias("extra"))


def prefixed(df: DataFrame, prefix: str) -> Column:
    """The columns of a prefix as a map without it and without nulls."""
    pairs = [x for c in df.columns if c.startswith(prefix) for x in (F.lit(c[len(prefix) :]), F.col(c))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def flat_metrics(df: DataFrame, column: str) -> DataFrame:
    """Entries of a map of maps as task.metric; what is no number goes."""
    one = df.select(F.explode(column).alias("task", "metrics")).select("task", F.explode("metrics").alias("metric", "v"))
    return one.select(F.concat_ws(".", "task", "metric").alias("name"), F.col("v").try_cast("double").alias("value")).where("value IS NOT NULL")


def block_text(blocks: str) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def has_block(blocks: str, *kinds: str) -> Column:
    return F.exists(blocks, lambda b: b["type"].isin(*kinds))


def files_as_text(blocks: str, most: int) -> Column:
    """Blocks with files as texts that name them; ``truncated`` says of a file if it was cut."""

    def one(b: Column) -> Column:
        told = F.concat(F.lit("Attached file: "), b["filename"], F.lit("\n"), F.substring(b["text"], 1, most))
        is_file = b["type"] == "input_file"
        return F.struct(F.when(is_file, "text").otherwise(b["type"]).alias("type"), F.when(is_file, told).otherwise(b["text"]).alias("text"), F.when(is_file, F.length(b["text"]) > most).alias("truncated"))

    return F.transform(blocks, one)


def staged_images(blocks: Column, base: str) -> Column:
    """Data URLs of images replaced by a URL with their hash."""

    def one(b: Column) -> Column:
        staged = (b["type"] == "image_url") & b["url"].startswith("data:")
        return F.struct(b["type"].alias("type"), b["text"].alias("text"), F.when(staged, F.concat(F.lit(base), F.substring(F.sha2(b["url"], 256), 1, 16))).otherwise(b["url"]).alias("url"))

    return F.transform(blocks, one)


def routed_alias(alias: Column, has_images: Column, seeing: tuple[str, ...], to: str) -> Column:
    return F.when(has_images & ~alias.isin(*seeing, to), F.lit(to)).otherwise(alias)


def client_ip(headers: Column, peer: Column) -> Column:
    """The address from a map of headers in any case, by trust; then the peer, then ``anon``."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    value = lambda k: F.nullif(F.trim(F.element_at(low, k)), F.lit(""))
    forwarded = F.trim(F.split_part(value("x-forwarded-for"), F.lit(","), F.lit(1)))
    return F.coalesce(value("cf-connecting-ip"), value("x-real-ip"), forwarded, F.nullif(peer, F.lit("")), F.lit("anon"))


def with_defaults(body: DataFrame, fields: dict[str, tuple], stop: tuple[str, ...], kwargs: dict[str, str]) -> DataFrame:
    """``fields``: name to (the schema's default, which counts as not set, the alias's default)."""
    set_ = {c: F.coalesce(F.nullif(F.col(c), F.lit(schema)), F.lit(default)) for c, (schema, default) in fields.items()}
    mine = F.map_filter(F.create_map(*[F.lit(x) for kv in kwargs.items() for x in kv]), lambda k, _: ~F.coalesce(F.map_contains_key("kwargs", k), F.lit(False)))
    stops = F.array_union(F.coalesce("stop", F.array().cast("array<string>")), F.array(*map(F.lit, stop)))
    given = F.coalesce("kwargs", F.create_map().cast("map<string,string>"))
    return body.withColumns({**set_, "stop": stops, "kwargs": F.map_concat(given, mine)})


def macro_license(text: Column, restrictive: str, permissive: str) -> Column:
    """By the field ``__License__``, else by the first 1500 characters; null where it restricts."""
    field = r"__License__\s*=\s*['\"]([^'\"]+)"
    named, head = F.trim(F.regexp_extract(text, field, 1)), F.substring(text, 1, 1500)
    blocks = lambda c: c.rlike(restrictive) & ~c.rlike("(?i)LGPL")
    community = F.lit("community-contributed")
    by_field = F.when((named == "") | (F.lower(named) == "none"), community).when(~blocks(named), named)
    by_head = F.when(blocks(head), F.lit(None)).when(head.rlike(permissive), F.regexp_extract(head, permissive, 1)).otherwise(community)
    return F.when(text.rlike(field), by_field).otherwise(by_head)


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """A row for each field of a row that breaks its rule: the key and the field."""
    broken = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("field"))


def assert_clean(bad: DataFrame, shown: int = 5) -> None:
    """Raise with the first violations, if there is any."""
    first = bad.limit(shown).collect()
    if first:
        raise ValueError("; ".join(str(tuple(r)) for r in first))


def opted_out(x_robots: Column, reservation: Column) -> Column:
    low = F.lower(F.coalesce(x_robots, F.lit("")))
    return F.contains(low, F.lit("noai")) | F.contains(low, F.lit("noml")) | (F.coalesce(reservation, F.lit("")) != "")


def robots_allows(body: Column, agent: str, path: str) -> Column:
    """If a robots.txt lets an agent have a path: the first rule of its group whose path begins it
    decides; the group of ``*`` holds where no group names the agent."""
    start = F.struct(F.lit("").alias("group"), F.lit(False).alias("in_rules"), F.lit(None).cast("boolean").alias("mine"), F.lit(None).cast("boolean").alias("any"), F.lit(False).alias("named"))

    def fold(s: Column, line: Column) -> Column:
        name = F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1))))
        value = F.trim(F.regexp_extract(line, r"^[^:]*:([^#]*)", 1))
        is_agent, is_rule = name == "user-agent", name.isin("allow", "disallow")
        who = F.when(F.lower(value) == agent, "mine").when(value == "*", "any").otherwise("other")
        group = F.when(is_agent, F.when(s["in_rules"] | (s["group"] == ""), who).when(s["group"] == "mine", "mine").otherwise(who)).otherwise(s["group"])
        # An empty Disallow allows all.
        allows = (name == "allow") | (value == "")
        applies = is_rule & F.lit(path).startswith(value)
        hit = lambda g, old: F.when(old.isNull() & applies & (s["group"] == g), allows).otherwise(old)
        return F.struct(group.alias("group"), F.when(is_agent, F.lit(False)).when(is_rule, F.lit(True)).otherwise(s["in_rules"]).alias("in_rules"), hit("mine", s["mine"]).alias("mine"), hit("any", s["any"]).alias("any"), (s["named"] | (is_agent & (F.lower(value) == agent))).alias("named"))

    rules = F.aggregate(F.split(body, "\n"), start, fold)
    return F.when(rules["named"], F.coalesce(rules["mine"], F.lit(True))).otherwise(F.coalesce(rules["any"], F.lit(True)))


def robots_status(code: str, body: str, x_robots: str, reservation: str, agent: str, path: str) -> Column:
    """ERROR, BLOCKED or ALLOWED: no answer, an opt-out, then the rules for the agent and for all."""
    out = opted_out(F.col(x_robots), F.col(reservation))
    allowed = robots_allows(F.col(body), agent, path) | robots_allows(F.col(body), "*", path)
    return F.when(F.col(code) == 0, "ERROR").when(out, "BLOCKED").when(F.col(code) == 404, "ALLOWED").when(allowed, "ALLOWED").otherwise("BLOCKED")


def judge_choice(out: Column, n: int) -> Column:
    """The ``choice`` of an object in prose, if it is one of ``n``; else 0."""
    found = F.regexp_extract(out, r'\{[^{}]*"choice"\s*:\s*(\d+)[^{}]*\}', 1).try_cast("int")
    return F.coalesce(F.when(found < n, found), F.lit(0))


def plan_steps(out: str, most: int) -> Column:
    """The strings of the outermost array in prose, else lines without bullets and numbers."""
    array = F.from_json(F.regexp_extract(out, r"(?s)\[.*\]", 0), "array<string>")
    tidy = lambda xs: F.filter(F.transform(xs, T.strip), lambda x: x != "")
    steps = tidy(F.coalesce(array, F.array().cast("array<string>")))
    lines = tidy(F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(x, r"^[\s\-\*0-9\.\)]+", "")))
    return F.slice(F.when(F.size(steps) > 0, steps).otherwise(lines), 1, most)


def drawn(name: str, ident: str, low: float, high: float, seed: int = 42) -> Column:
    """A value between bounds from a hash of seed, name and id; whole bounds give whole numbers."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{name}:"), F.col(ident).cast("string")), 256), 1, 7), 16, 10).cast("long")
    if isinstance(low, int) and isinstance(high, int):
        return F.lit(low) + h % (high - low + 1)
    return F.bround(F.lit(low) + (h % (round((high - low) * 1000) + 1)) / 1000.0, 3)


def page_answer(text: Column, kind: Column, question: Column) -> Column:
    cleaned = T.cut(T.strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " ")), 3000, "...")
    asks = lambda *words: reduce(lambda a, b: a | b, [F.contains(F.lower(question), F.lit(w)) for w in words])
    # How an answer begins.
    head = (
        F.when(asks("components", "bill of materials"), "Based on the page content, the following components and specifications are described:")
        .when(asks("purpose"), F.concat(F.lit("This "), kind, F.lit(" shows the following technical content:")))
        .when(asks("design considerations", "critical"), "The key design considerations described on this page include:")
        .when(asks("extract", "data", "parameters"), "The technical data shown includes:")
        .when(asks("summarize", "key"), "The key technical points are:")
        .otherwise("This page contains the following technical content:")
    )
    return F.when(F.length(cleaned) < 50, "").otherwise(F.concat(head, F.lit("\n\n"), cleaned))


_DELTA = "choices array<struct<delta: struct<content: string, reasoning: string>>>"


def rewritten_event(event: Column) -> Column:
    """A data line with each delta's reasoning promoted and marks gone; others as they are."""
    parsed = F.from_json(F.regexp_extract(event, r"^data:\s*(\{.*)$", 1), _DELTA)
    new = F.transform(parsed["choices"], lambda c: F.struct(F.struct(T.promoted(c["delta"]["content"], c["delta"]["reasoning"]).alias("content")).alias("delta")))
    return F.coalesce(F.when(parsed["choices"].isNotNull(), F.concat(F.lit("data: "), F.to_json(F.struct(new.alias("choices"))))), event)


def stream_text(lines: DataFrame, stream: str, order: str, line: str) -> DataFrame:
    """The content of a stream's deltas before its end, joined, and their number."""
    done = F.max((F.col(line) == "data: [DONE]").cast("int")).over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    content = F.get_json_object(F.regexp_extract(line, r"^data:\s*(\{.*)$", 1), "$.choices[0].delta.content")
    kept = lines.withColumns({"_done": done, "_content": content}).where("_done = 0 AND _content IS NOT NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "_content"))), lambda x: x["_content"])
    return kept.groupBy(stream).agg(F.array_join(parts, "").alias("said"), F.count("*").alias("deltas"))
