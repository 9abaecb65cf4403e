"""Queries on documents: filters, scalar rules, deduplication, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import dedup, ranking, splits
from .registry import ORACLES, QUERIES, query, table

SQL_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
SQL_WORDS = r"CASE WHEN regexp_replace({c}, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+')) END"
STRIP, WORDS = SQL_STRIP.format(c="text"), SQL_WORDS.format(c="text")
HASH = "sha256('42:' || doc_id)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def sql_count(c: str, words) -> str:
    return "(" + " + ".join(f"contains({c}, {q(w)})::int" for w in words) + ")"


S_CPP, S_JAVA, S_PY, S_CS = (sql_count("text", m) for m in (R.CPP_MARKERS, R.JAVA_MARKERS, R.PYTHON_MARKERS, R.CSHARP_MARKERS))
CHAT_WORDS = ("le ", "la ", "les ", "des ")
EU = ("fr", "de", "es", "it", "pt", "nl", "pl")

#: Predicates: which documents pass.
PREDICATES = {
    "f01_char_bounds": (lambda t: F.length(T.strip(t)).between(8, 600), f"length({STRIP}) BETWEEN 8 AND 600"),
    "f02_word_bounds": (lambda t: T.word_count(t).between(3, 400), f"{WORDS} BETWEEN 3 AND 400"),
    "f03_non_empty": (lambda t: (T.strip(t) != "") & (T.strip("source") != ""), f"{STRIP} <> '' AND trim(source) <> ''"),
    "f04_keyword_any": (lambda t: T.any_of(F.lower(t), CHAT_WORDS), sql_any("lower(text)", CHAT_WORDS)),
    "f05_include_exclude_regex": (lambda t: F.substring(t, 1, 500).rlike("(?i)licen[cs]e") & ~F.substring(t, 1, 500).rlike("(?i)apache") & (F.length(t) >= 30), "regexp_matches(substr(text, 1, 500), '(?i)licen[cs]e') AND NOT regexp_matches(substr(text, 1, 500), '(?i)apache') AND length(text) >= 30"),
    "f06_min_markers": (lambda t: T.found_count(t, ("The", "the ", "of ", " is ", "MIT", "License")) >= 2, sql_count("text", ("The", "the ", "of ", " is ", "MIT", "License")) + " >= 2"),
    "f07_keyword_count_bits": (lambda t: T.found_count(t, ("tion", "ing")) + t.rlike(r"\d+ ?<< ?\d+|&&").cast("int") >= 2, sql_count("text", ("tion", "ing")) + r" + regexp_matches(text, '\d+ ?<< ?\d+|&&')::int >= 2"),
    "f08_component_count": (lambda t: T.found_count(F.lower(t), ("led", "can", "heat", "ment")) >= 1, sql_count("lower(text)", ("led", "can", "heat", "ment")) + " >= 1"),
    "f09_java_contaminated": (lambda t: T.found_count(t, R.JAVA_MARKERS) >= 2, f"{S_JAVA} >= 2"),
    "f10_python_contaminated": (lambda t: (T.found_count(t, R.PYTHON_MARKERS) >= 2) & (T.found_count(t, R.CPP_MARKERS) < 2), f"{S_PY} >= 2 AND {S_CPP} < 2"),
    "f11_csharp_contaminated": (lambda t: ((T.found_count(t, R.CSHARP_MARKERS) >= 2) & ~F.contains(t, F.lit("#include"))) | (T.found_count(t, R.CSHARP_MARKERS) >= 3), f"({S_CS} >= 2 AND NOT contains(text, '#include')) OR {S_CS} >= 3"),
    "f12_contaminated": (lambda t: (T.found_count(t, R.JAVA_MARKERS) >= 2) | (T.found_count(t, R.CSHARP_MARKERS) >= 2) | ((T.found_count(t, R.PYTHON_MARKERS) >= 2) & (T.found_count(t, R.CPP_MARKERS) < 2)), f"{S_JAVA} >= 2 OR {S_CS} >= 2 OR ({S_PY} >= 2 AND {S_CPP} < 2)"),
    "f13_language_in_set": (lambda t: F.col("lang").isin(*EU), "lang IN ('fr', 'de', 'es', 'it', 'pt', 'nl', 'pl')"),
    "f14_ascii_ratio": (lambda t: T.ascii_share_above(t, 0.97), r"length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0.97 * length(regexp_replace(text, '[^\p{L}]', '', 'g'))"),
    "f15_template_leak": (lambda t: ~t.rlike(R.LEAK_PATTERN), f"NOT regexp_matches(text, {q(R.LEAK_PATTERN)})"),
    "f16_mojibake": (lambda t: T.any_of(t, R.CORRUPT_MARKERS), sql_any("text", R.CORRUPT_MARKERS)),
    "f17_line_bounds": (lambda t: T.line_count(t).between(10, 400), r"len(string_split(text, chr(10))) BETWEEN 10 AND 400"),
    "f18_spdx_allowed": (lambda t: F.upper(F.regexp_extract(t, r"(MIT|Apache|GNU|CC BY-NC)", 1)).isin("MIT", "APACHE"), "upper(regexp_extract(text, '(MIT|Apache|GNU|CC BY-NC)', 1)) IN ('MIT', 'APACHE')"),
    "f25_html_or_css": (lambda t: T.any_of(t, ("<html", "<div", "</p>")) | ((T.found_count(t, ("color", "margin", "px")) >= 2) & F.contains(t, F.lit("{"))), sql_any("text", ("<html", "<div", "</p>")) + " OR (" + sql_count("text", ("color", "margin", "px")) + " >= 2 AND contains(text, '{'))"),
    "f26_import_patterns": (lambda t: t.rlike("(?m)^import ").cast("int") + t.rlike("(?m)^from .* import").cast("int") + t.rlike("Licen[sc]e").cast("int") >= 1, "regexp_matches(text, '(?m)^import ')::int + regexp_matches(text, '(?m)^from .* import')::int + regexp_matches(text, 'Licen[sc]e')::int >= 1"),
    "f27_seed_markers": (lambda t: F.col("source").isin("src1", "src2") | T.any_of(t, ("#!/bin", "idiot", "scum")), "source IN ('src1', 'src2') OR " + sql_any("text", ("#!/bin", "idiot", "scum"))),
    "f43_word_list_regex": (lambda t: t.rlike(r"(?i)(^|[^a-z])(license|licensed|released)([^a-z]|$)"), "regexp_matches(text, '(?i)(^|[^a-z])(license|licensed|released)([^a-z]|$)')"),
    "f44_length_window": (lambda t: F.length(t).between(20, 8000), "length(text) BETWEEN 20 AND 8000"),
    "f35_page_skip": (lambda t: (F.length(T.strip(t)) >= 50) & (F.col("n_chars") >= 60), f"length({STRIP}) >= 50 AND n_chars >= 60"),
    "f39_quarantine": (lambda t: ~F.col("source").isin("src3", "src7"), "source NOT IN ('src3', 'src7')"),
    "f40_blocked_alias": (lambda t: F.col("source") == "src9", "source = 'src9'"),
}


def _passing(condition):
    return lambda spark, sf: table(spark, sf, "documents").where(condition(F.col("text"))).select("doc_id")


for _name, (_condition, _sql) in PREDICATES.items():
    QUERIES[_name] = _passing(_condition)
    ORACLES[_name] = f"SELECT doc_id FROM documents WHERE {_sql}"

_PLATFORM = "CASE WHEN contains(lower(text), 'esp') THEN 'ESP32' WHEN contains(lower(text), 'stm32') OR contains(lower(text), 'hal_') THEN 'STM32' WHEN contains(lower(text), 'arduino') OR contains(lower(text), '.ino') THEN 'Arduino/AVR' ELSE 'generic' END"
_PERIPHERAL = "CASE " + " ".join(f"WHEN contains(lower(substr(text, 1, 600)), {q(k)}) THEN {q(v)}" for k, v in R.PERIPHERALS) + " ELSE 'misc' END"
_GUESS = "lower(substr(text, 1, 3000))"
_N = {k: sql_count(_GUESS, v) for k, v in R.LANGUAGE_WORDS.items()}
SQL_GUESS = f"CASE WHEN {_N['fr']} > {_N['en']} AND {_N['fr']} > {_N['de']} THEN 'fr' WHEN {_N['de']} > {_N['en']} THEN 'de' ELSE 'en' END"
SQL_COMPLEX = lambda c: f"CASE WHEN {c} IS NULL OR ({SQL_WORDS.format(c=c)} < 15 AND NOT regexp_matches({c}, {q(R.REASONING_PATTERN)}) AND NOT regexp_matches({c}, {q(R.CODE_PATTERN)})) THEN 'simple' WHEN {SQL_WORDS.format(c=c)} > 100 OR regexp_matches({c}, {q(R.REASONING_PATTERN)}) THEN 'complex' ELSE 'medium' END"

#: Scalar rules: a value for each document.
VALUES = {
    "p10_content_hash": (lambda t: T.short_hash(t), "substr(sha256(text), 1, 16)"),
    "p11_fingerprint": (lambda t: T.strip(F.substring(t, 1, 200)), SQL_STRIP.format(c="substr(text, 1, 200)")),
    "p12_token_estimate": (lambda t: T.token_estimate(t), "floor(length(text) / 3.5)::bigint"),
    "p16_context_snippet": (lambda t: F.when(F.instr(t, "MIT") > 0, F.concat(F.when(F.instr(t, "MIT") > 41, "...").otherwise(""), F.expr("substring(text, greatest(1, instr(text, 'MIT') - 40), least(40, instr(text, 'MIT') - 1))"), F.lit("[MIT]"), F.expr("substring(text, instr(text, 'MIT') + 3, 40)"), F.when(F.length(t) > F.instr(t, "MIT") + 42, "...").otherwise(""))), "CASE WHEN strpos(text, 'MIT') > 0 THEN (CASE WHEN strpos(text, 'MIT') > 41 THEN '...' ELSE '' END) || substr(text, greatest(1, strpos(text, 'MIT') - 40)::bigint, least(40, strpos(text, 'MIT') - 1)::bigint) || '[MIT]' || substr(text, strpos(text, 'MIT') + 3, 40) || (CASE WHEN length(text) > strpos(text, 'MIT') + 42 THEN '...' ELSE '' END) END"),
    "p17_head_and_tail": (lambda t: T.head_and_tail(t), "CASE WHEN length(text) > 1000 THEN left(text, 256) || ' ... ' || right(text, 256) ELSE text END"),
    "p19_title_template": (lambda t: T.first_rule(F.lower(F.substring(t, 1, 80)), tuple((k, v) for ks, v in R.TITLE_RULES for k in ks), "topic"), "CASE " + " ".join(f"WHEN contains(lower(substr(text, 1, 80)), {q(k)}) THEN {q(v)}" for ks, v in R.TITLE_RULES for k in ks) + " ELSE 'topic' END"),
    "p18_instruction_merge": (lambda t: F.concat(F.lit("Read "), F.col("source"), F.when(T.strip(t) != "", F.concat(F.lit("\n\n"), t)).otherwise("")), f"'Read ' || source || CASE WHEN {STRIP} <> '' THEN chr(10) || chr(10) || text ELSE '' END"),
    "p20_change_template": (lambda t: F.when(F.length(t) > 10, F.concat(F.lit("Modify this "), F.col("lang"), F.lit(" text:\n"), F.substring(t, 1, 2000))).otherwise(F.concat(F.lit("Write "), F.col("lang"))), "CASE WHEN length(text) > 10 THEN 'Modify this ' || lang || ' text:' || chr(10) || substr(text, 1, 2000) ELSE 'Write ' || lang END"),
    "p21_context_prefix": (lambda t: F.when(F.length(t) > 20, F.concat(F.lit("Context:\n"), t, F.lit("\n\nQuestion: "), F.col("source"))).otherwise(F.col("source")), "CASE WHEN length(text) > 20 THEN 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source ELSE source END"),
    "p22_cut_with_mark": (lambda t: T.cut(t, 500, "..."), "CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END"),
    "x01_page_clean": (lambda t: T.clean_pages(t), r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^(?:(?:Page\s+)?\d+(?:\s+of\s+\d+)?|AN\d+|Rev\.?\s*\d+|Doc\s*ID\s*\d+|www\.\S+)\s*$', '', 'g'), '(\w)-\n(\w)', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')"),
    "x02_language_guess": (lambda t: T.guess_language(t), SQL_GUESS),
    "x03_wiki_clean": (lambda t: F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"), r"\{\{[^}]*\}\}", ""), "<[^>]+>", ""), 1, 3000), r"substr(regexp_replace(regexp_replace(regexp_replace(text, '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '\{\{[^}]*\}\}', '', 'g'), '<[^>]+>', '', 'g'), 1, 3000)"),
    "x05_readme_strip": (lambda t: T.cut(T.strip(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"!?\[[^\]]*\]\([^)]*\)", "")), 2000, "..."), r"CASE WHEN length(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '!?\[[^\]]*\]\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g')) > 2000 THEN substr(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '!?\[[^\]]*\]\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 2000) || '...' ELSE regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '!?\[[^\]]*\]\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g') END"),
    "x08_platform_class": (lambda t: F.when(F.contains(F.lower(t), F.lit("esp")), "ESP32").when(T.any_of(F.lower(t), ("stm32", "hal_")), "STM32").when(T.any_of(F.lower(t), ("arduino", ".ino")), "Arduino/AVR").otherwise("generic"), _PLATFORM),
    "x09_peripheral_class": (lambda t: T.first_rule(F.lower(F.substring(t, 1, 600)), R.PERIPHERALS, "misc"), _PERIPHERAL),
    "x12_dominant_type": (lambda t: F.expr("CASE WHEN greatest(regexp_count(text, '(?i)the'), regexp_count(text, '(?i)der'), regexp_count(text, '(?i)que')) = 0 THEN 'mixed' WHEN array_sort(array(regexp_count(text, '(?i)the'), regexp_count(text, '(?i)der'), regexp_count(text, '(?i)que')))[1] >= 0.6 * greatest(regexp_count(text, '(?i)the'), regexp_count(text, '(?i)der'), regexp_count(text, '(?i)que')) THEN 'mixed' WHEN regexp_count(text, '(?i)the') > regexp_count(text, '(?i)der') AND regexp_count(text, '(?i)the') > regexp_count(text, '(?i)que') THEN 'the' WHEN regexp_count(text, '(?i)der') > regexp_count(text, '(?i)que') THEN 'der' ELSE 'que' END"), "(WITH c AS (SELECT len(regexp_extract_all(text, '(?i)the')) AS a, len(regexp_extract_all(text, '(?i)der')) AS b, len(regexp_extract_all(text, '(?i)que')) AS e) SELECT CASE WHEN greatest(a, b, e) = 0 THEN 'mixed' WHEN list_sort([a, b, e])[2] >= 0.6 * greatest(a, b, e) THEN 'mixed' WHEN a > b AND a > e THEN 'the' WHEN b > e THEN 'der' ELSE 'que' END FROM c)"),
    "x13_page_type": (lambda t: F.when((F.length(T.strip(t)) < 50) & (T.line_count(t) < 3), "cover").when(T.line_count(t) >= 30, F.when(F.expr("regexp_count(text, '[|]')") > 0.6 * T.line_count(t), "table").otherwise("schematic")).when(T.line_count(t) > 10, "diagram").when(F.length(T.strip(t)) >= 200, "text").otherwise("sparse"), rf"CASE WHEN length({STRIP}) < 50 AND len(string_split(text, chr(10))) < 3 THEN 'cover' WHEN len(string_split(text, chr(10))) >= 30 THEN (CASE WHEN len(regexp_extract_all(text, '[|]')) > 0.6 * len(string_split(text, chr(10))) THEN 'table' ELSE 'schematic' END) WHEN len(string_split(text, chr(10))) > 10 THEN 'diagram' WHEN length({STRIP}) >= 200 THEN 'text' ELSE 'sparse' END"),
    "x16_complexity": (lambda t: T.complexity(t), SQL_COMPLEX("text")),
    "x50_name_sanitise": (lambda t: F.regexp_replace(t, r"[^A-Za-z0-9._-]", "_"), "regexp_replace(text, '[^A-Za-z0-9._-]', '_', 'g')"),
    "x54_word_tokens": (lambda t: T.word_count(t), WORDS),
    "x28_syntax_check": (lambda t: F.expr("(length(text) - length(replace(text, '(', ''))) >= 5 AND length(replace(text, '(', '')) = length(replace(text, ')', ''))") | t.rlike(r"(?m)^\s*[RCLQDM][A-Z0-9_]*\s+\S+\s+\S+"), r"((length(text) - length(replace(text, '(', ''))) >= 5 AND length(replace(text, '(', '')) = length(replace(text, ')', ''))) OR regexp_matches(text, '(?m)^\s*[RCLQDM][A-Z0-9_]*\s+\S+\s+\S+')"),
}


def _valued(c):
    return lambda spark, sf: table(spark, sf, "documents").select("doc_id", c(F.col("text")).alias("value"))


for _name, (_c, _sql) in VALUES.items():
    QUERIES[_name] = _valued(_c)
    ORACLES[_name] = f"SELECT doc_id, {_sql} AS value FROM documents"


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(sha256(text), 1, 16) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def w11_dedup_hash(spark, sf):
    return dedup.keep_first(_docs(spark, sf), [T.short_hash("text")], "doc_id").select("doc_id")


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, lower({STRIP}) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def w12_dedup_label_text(spark, sf):
    return dedup.keep_first(_docs(spark, sf), ["lang", T.same_text(F.lower(T.strip("text")))], "doc_id").select("doc_id", "lang")


@query(f"SELECT doc_id, n - 1 AS duplicates FROM (SELECT doc_id, row_number() OVER (PARTITION BY {SQL_STRIP.format(c='substr(text, 1, 200)')} ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY {SQL_STRIP.format(c='substr(text, 1, 200)')}) AS n FROM documents) WHERE rn = 1")
def w13_dedup_prefix(spark, sf):
    """Keep the first of a 200-character beginning; count the rest by a pre-aggregated group."""
    prefix = T.strip(F.substring("text", 1, 200))
    return _docs(spark, sf).groupBy(prefix.alias("k")).agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("duplicates")).drop("k")


@query("SELECT doc_id FROM (SELECT d.doc_id, row_number() OVER (PARTITION BY sha256(d.text) ORDER BY d.doc_id) AS rn FROM documents d WHERE sha256(d.text) NOT IN (SELECT sha256(text) FROM benchmark) AND d.text NOT IN (SELECT text FROM documents WHERE doc_id < 50)) WHERE rn = 1")
def w14_dedup_preseeded(spark, sf):
    d = _docs(spark, sf).withColumn("k", F.sha2(F.encode("text", "utf-8"), 256))
    known = table(spark, sf, "benchmark").select(F.sha2(F.encode("text", "utf-8"), 256).alias("k")).union(d.where("doc_id < 50").select("k"))
    return dedup.keep_first(dedup.not_known(d, known, ["k"]), ["k"], "doc_id").select("doc_id")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {HASH}) AS rn FROM documents) WHERE rn <= 20")
def w01_source_cap(spark, sf):
    return splits.cap(_docs(spark, sf), "source", "doc_id", 20).select("doc_id", "source")


@query(f"SELECT doc_id, lang, CASE WHEN rn <= greatest(1, round_even(n * 0.05, 0)) THEN 'valid' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {HASH}) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def w02_split_95_5(spark, sf):
    return splits.split_by_share(_docs(spark, sf), ["lang"], "doc_id").select("doc_id", "lang", "split")


@query(f"SELECT doc_id, lang, CASE WHEN rn <= greatest(5, n // 10) THEN 'test' WHEN rn <= 2 * greatest(5, n // 10) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {HASH}) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def w03_split_min5(spark, sf):
    return splits.split_at_floor(_docs(spark, sf), ["lang"], "doc_id", [("test", 0.1), ("val", 0.1)], "train", least=5).select("doc_id", "lang", "split")


@query(f"SELECT doc_id, source, CASE WHEN rn <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN rn <= greatest(1, floor(n * 0.8)) + greatest(1, floor(n * 0.1)) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {HASH}) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def w04_split_80_10_10(spark, sf):
    return splits.split_at_floor(_docs(spark, sf), ["source"], "doc_id", [("train", 0.8), ("valid", 0.1)], "test").select("doc_id", "source", "split")


@query(f"SELECT doc_id, source, CASE WHEN rn <= greatest(1, floor(n * 0.8)) THEN 'train' ELSE 'valid' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {HASH}) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def w05_split_80_20(spark, sf):
    return splits.split_at_floor(_docs(spark, sf), ["source"], "doc_id", [("train", 0.8)], "valid").select("doc_id", "source", "split")


@query(f"SELECT doc_id, CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'valid' END AS split FROM (SELECT *, row_number() OVER (ORDER BY {HASH}) AS rn, count(*) OVER () AS n FROM documents)")
def w06_split_90_10(spark, sf):
    return splits.split_at_floor(_docs(spark, sf), [], "doc_id", [("train", 0.9)], "valid", least=0).select("doc_id", "split")


@query(f"SELECT doc_id, CASE WHEN rn <= 500 THEN 'train' ELSE 'valid' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {HASH}) AS rn FROM documents) WHERE rn <= 650")
def w07_fixed_split(spark, sf):
    r = ranking.hash_ranked(_docs(spark, sf).select("doc_id"), [], "doc_id").where("rn <= 650")
    return r.select("doc_id", F.when(F.col("rn") <= 500, "train").otherwise("valid").alias("split"))


@query(f"WITH k AS (SELECT count(DISTINCT source) AS k FROM documents), p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH}) AS rn FROM documents) SELECT doc_id, source FROM p, k WHERE rn <= greatest(1, 120 // k) ORDER BY {HASH} LIMIT 120")
def w08_balanced_pick(spark, sf):
    return splits.balanced(_docs(spark, sf), "source", "doc_id", 120).select("doc_id", "source")


@query(f"WITH a AS (SELECT doc_id, 'en' AS part FROM documents WHERE lang = 'en' ORDER BY {HASH} LIMIT 50), b AS (SELECT doc_id, 'other' AS part FROM documents WHERE lang <> 'en' ORDER BY {HASH} LIMIT 50) SELECT * FROM a UNION ALL SELECT * FROM b")
def w09_half_mix(spark, sf):
    d = _docs(spark, sf)
    take = lambda c, name: d.where(c).orderBy(T.seeded("doc_id")).limit(50).select("doc_id", F.lit(name).alias("part"))
    return take("lang = 'en'", "en").unionByName(take("lang <> 'en'", "other"))


@query(f"WITH a AS (SELECT doc_id, true AS english FROM documents WHERE lang = 'en' ORDER BY {HASH} LIMIT 210), b AS (SELECT doc_id, false AS english FROM documents WHERE lang <> 'en' ORDER BY {HASH} LIMIT (SELECT 300 - count(*) FROM a)) SELECT * FROM a UNION ALL SELECT * FROM b")
def w10_ratio_cap(spark, sf):
    """At most 70 % of the target from one side, the other fills up."""
    d, target = _docs(spark, sf), 300
    n = min(int(target * 0.7), d.where("lang = 'en'").count())
    take = lambda c, k, flag: d.where(c).orderBy(T.seeded("doc_id")).limit(k).select("doc_id", F.lit(flag).alias("english"))
    return take("lang = 'en'", n, True).unionByName(take("lang <> 'en'", target - n, False))


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END, doc_id) AS rn FROM documents) WHERE rn <= 40")
def w15_fill_to_target(spark, sf):
    prio = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).otherwise(2)
    return splits.fill_to_target(_docs(spark, sf), "lang", prio, "doc_id", 40).select("doc_id", "source", "lang")


@query("SELECT doc_id FROM documents ORDER BY CASE WHEN source IN ('src1', 'src2') THEN 0 WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 2 ELSE 3 END, doc_id LIMIT 300")
def w16_priority_top(spark, sf):
    prio = F.when(F.col("source").isin("src1", "src2"), 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return _docs(spark, sf).orderBy(prio, "doc_id").limit(300).select("doc_id")


@query("SELECT doc_id, text, lang FROM (SELECT doc_id, text, lang FROM documents UNION ALL SELECT -item_id - 1, text, 'bench' FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text))")
def w30_inject(spark, sf):
    """Curated rows that are not there yet are added."""
    d = _docs(spark, sf).select("doc_id", "text", "lang")
    new = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), "text", F.lit("bench").alias("lang"))
    return d.unionByName(dedup.not_known(new, d, ["text"]).select("doc_id", "text", "lang"))


@query(f"""WITH ok AS (SELECT doc_id, lang, lower({STRIP}) AS k FROM documents WHERE length({STRIP}) BETWEEN 8 AND 6000 AND {WORDS} BETWEEN 3 AND 400 AND NOT {sql_any('text', R.CORRUPT_MARKERS)}),
  u AS (SELECT lang, min(doc_id) AS doc_id FROM ok GROUP BY lang, k),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {HASH}) AS r FROM u) WHERE r <= 300),
  s AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH}) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM c)
  SELECT lang, count(*) AS total, count_if(rn > 2 * greatest(5, n // 10)) AS train, count_if(rn > greatest(5, n // 10) AND rn <= 2 * greatest(5, n // 10)) AS val, count_if(rn <= greatest(5, n // 10)) AS test FROM s GROUP BY lang""")
def corpus_curate(spark, sf):
    """Filter, deduplicate, cap and split a corpus; count what each language gets."""
    ok = _docs(spark, sf).where(F.length(T.strip("text")).between(8, 6000) & T.word_count("text").between(3, 400) & ~T.any_of(F.col("text"), R.CORRUPT_MARKERS))
    unique = ok.groupBy("lang", T.same_text(F.lower(T.strip("text"))).alias("k")).agg(F.min("doc_id").alias("doc_id")).drop("k")
    capped = splits.cap(unique, "lang", "doc_id", 300).drop("rn")
    split = splits.split_at_floor(capped, ["lang"], "doc_id", [("test", 0.1), ("val", 0.1)], "train", least=5)
    parts = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    return split.groupBy("lang").agg(F.count("*").alias("total"), *parts)
