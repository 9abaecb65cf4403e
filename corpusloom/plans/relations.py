"""Queries that join, sort and combine tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import dedup
from ..operators import lookups as L
from ..operators import metrics as M
from .corpus import SQL_COMPLEX
from .registry import query, table


@query("SELECT o_orderkey, o_orderpriority, l.n, CASE WHEN l.rate IS NOT NULL THEN round_even(l.rate - 5, 2)::double END AS lift FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(round(l_discount * 100)::bigint) / count(*) AS rate FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON o_orderkey = l_orderkey")
def j02_left_overlay(spark, sf):
    rate = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), (F.sum(M.hundredths("l_discount")) / F.count("*")).alias("rate"))
    return table(spark, sf, "orders").join(rate, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", "n", F.bround(F.col("rate") - 5, 2).alias("lift"))


@query("SELECT c_custkey, coalesce(a.v, b.v) AS axis FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey")
def j03_preference_overlay(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda s, v: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias(v))
    return table(spark, sf, "customer").join(side("F", "a"), "c_custkey", "left").join(side("O", "b"), "c_custkey", "left").select("c_custkey", F.coalesce("a", "b").alias("axis"))


_MANIFESTS = [[("src1", "MIT", "2026-01-02T10:00"), ("src2", "GPL-3.0", "2026-01-03")], [("src2", "Apache-2.0", "2026-02-02T00:00"), ("src3", "CC0-1.0", "2026-02-03")], [("src1", "unknown", "2026-03-01"), ("src4", "MIT", "2026-03-04T09:30"), ("src3", "GPL-3.0", "2026-03-05")]]
_M_SQL = " UNION ALL ".join(f"SELECT '{s}' AS source, '{lic}' AS license, '{d}' AS day, {k} AS prio" for k, rows in enumerate(_MANIFESTS) for s, lic, d in rows)


@query(f"WITH m AS ({_M_SQL}), b AS (SELECT source, arg_min(license, prio) AS license, arg_min(day, prio) AS day FROM m GROUP BY source) SELECT doc_id, coalesce(license, 'unknown') AS license, split_part(coalesce(day, '2026-04-28'), 'T', 1) AS day FROM documents LEFT JOIN b USING (source)")
def j04_priority_lookup(spark, sf):
    """Manifests by priority (S09), dates cut to the day (X23), defaults for the rest."""
    tables = [spark.createDataFrame(rows, "source string, license string, day string") for rows in _MANIFESTS]
    best = L.by_priority(tables, "source")
    day = F.split_part(F.coalesce("day", F.lit("2026-04-28")), F.lit("T"), F.lit(1))
    return table(spark, sf, "documents").join(best, "source", "left").select("doc_id", F.coalesce("license", F.lit("unknown")).alias("license"), day.alias("day"))


@query("SELECT page_id, coalesce(d.source, '') AS source, coalesce(sha256(d.text), '') AS sha FROM pages p LEFT JOIN documents d ON d.doc_id = try_cast(regexp_extract(url, '/(\\d+)', 1) AS bigint)".replace("\\\\", "\\"))
def j05_stem_lookup(spark, sf):
    stem = F.regexp_extract("url", r"/(\d+)", 1).try_cast("bigint")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("stem"), "source", F.sha2(F.encode("text", "utf-8"), 256).alias("sha"))
    return table(spark, sf, "pages").withColumn("stem", stem).join(d, "stem", "left").select("page_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("sha", F.lit("")).alias("sha"))


@query("SELECT q.conv_id, q.turn, q.text AS question, coalesce(a.text, '') AS answer FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'")
def j06_questions_answers(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j07_anti_join(spark, sf):
    return dedup.not_known(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents WHERE source = 'src1' INTERSECT SELECT lang FROM documents WHERE source = 'src2')")
def j08_shared_labels(spark, sf):
    """Rows whose label both sides have."""
    d = table(spark, sf, "documents")
    shared = d.where("source = 'src1'").select("lang").intersect(d.where("source = 'src2'").select("lang"))
    return d.join(shared, "lang", "left_semi").select("doc_id", "lang")


@query("WITH g AS (SELECT * FROM (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT c_mktsegment FROM customer)) SELECT event_type, c_mktsegment, event_type || '-' || c_mktsegment NOT IN ('click-BUILDING', 'view-MACHINERY') AS runnable FROM g")
def j09_cell_grid(spark, sf):
    """Models by domains, both short lists, with the cells that have no adapter marked."""
    models = table(spark, sf, "events").select("event_type").distinct()
    domains = table(spark, sf, "customer").select("c_mktsegment").distinct()
    missing = spark.createDataFrame([("click", "BUILDING"), ("view", "MACHINERY")], "event_type string, c_mktsegment string").withColumn("no", F.lit(True))
    return models.crossJoin(domains).join(F.broadcast(missing), ["event_type", "c_mktsegment"], "left").select("event_type", "c_mktsegment", F.col("no").isNull().alias("runnable"))


@query("SELECT event_type, compiler, seed, prompts * samples AS n FROM (SELECT event_type, count(DISTINCT user_id % 5) AS prompts FROM events GROUP BY 1), (SELECT unnest(['skidl', 'atopile', 'tscircuit']) AS compiler), (SELECT unnest([1, 2, 3]) AS seed, 4 AS samples)")
def j10_four_way_grid(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct(F.col("user_id") % 5).alias("prompts"))
    grid = m.select("event_type", "prompts", F.explode(F.array(*map(F.lit, ("skidl", "atopile", "tscircuit")))).alias("compiler"))
    return grid.select("event_type", "compiler", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed"), (F.col("prompts") * 4).alias("n"))


@query("SELECT d.doc_id, s AS seed, b.item_id AS reference FROM documents d CROSS JOIN (SELECT unnest([0, 1, 2]) AS s) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def j11_file_seed_grid(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed"))
    return d.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("reference")), "doc_id", "left")


@query("WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round_even(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-9), 5)::double AS cos FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND b.vec_id >= a.vec_id - 256) SELECT a, arg_max(b, (cos, -b)) AS b, max(cos) AS cos FROM p GROUP BY a HAVING max(cos) >= 0.3")
def j12_earlier_neighbour(spark, sf):
    """The nearest of the 256 vectors before (W26), by cosine."""
    return L.earlier_neighbour(table(spark, sf, "embeddings"), "vec_id", "embedding", 256, 0.3)


_ALIASES = (("src1", "alpha"), ("src2", "beta"))
_PORTS = (("alpha", 8500), ("beta", 9360), ("src3", 9361))


@query("SELECT doc_id, p.port FROM documents LEFT JOIN (SELECT * FROM (VALUES " + ", ".join(map(str, _ALIASES)) + ") t(source, canonical)) a USING (source) LEFT JOIN (SELECT * FROM (VALUES " + ", ".join(map(str, _PORTS)) + ") t(name, port)) p ON p.name = coalesce(a.canonical, source)")
def j13_alias_lookup(spark, sf):
    a = spark.createDataFrame(_ALIASES, "source string, canonical string")
    p = spark.createDataFrame(_PORTS, "name string, port int")
    d = table(spark, sf, "documents").join(F.broadcast(a), "source", "left").withColumn("name", F.coalesce("canonical", "source"))
    return d.join(F.broadcast(p), "name", "left").select("doc_id", "port")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(a.canonical, source) WHEN doc_id % 3 = 1 THEN coalesce('base-' || lang, source) ELSE source END AS served FROM documents LEFT JOIN (SELECT * FROM (VALUES " + ", ".join(map(str, _ALIASES)) + ") t(source, canonical)) a USING (source)")
def j14_layered_override(spark, sf):
    """Which map is read depends on the family; what is found in none is itself."""
    a = spark.createDataFrame(_ALIASES, "source string, canonical string")
    k = F.col("doc_id") % 3
    served = F.when(k == 0, F.coalesce("canonical", "source")).when(k == 1, F.coalesce(F.concat(F.lit("base-"), F.col("lang")), "source")).otherwise(F.col("source"))
    return table(spark, sf, "documents").join(F.broadcast(a), "source", "left").select("doc_id", served.alias("served"))


@query("WITH a AS (SELECT s_nationkey AS k, sum(round(s_acctbal * 100)::bigint) / (count(*) * 100) AS v FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, sum(round(c_acctbal * 100)::bigint) / (count(*) * 100) AS v FROM customer GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'none' WHEN a.v < b.v THEN 'v1' WHEN a.v > b.v THEN 'v2' ELSE 'tie' END AS winner, round_even((b.v - a.v) / a.v * 100, 2)::double AS delta FROM a FULL JOIN b ON a.k = b.k")
def j17_version_comparison(spark, sf):
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(M.mean_of_hundredths("s_acctbal").alias("a"))
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(M.mean_of_hundredths("c_acctbal").alias("b"))
    x, y = F.col("a"), F.col("b")
    winner = F.when(x.isNull() | y.isNull(), "none").when(x < y, "v1").when(x > y, "v2").otherwise("tie")
    return a.join(b, "k", "full_outer").select("k", winner.alias("winner"), F.bround((y - x) / x * 100, 2).alias("delta"))


@query("SELECT n.n_name, a.v AS supplied, b.v AS held, r.r_name FROM nation n LEFT JOIN (SELECT s_nationkey AS k, round_even(sum(round(s_acctbal * 100)::bigint) * 1 / count(s_acctbal), 0)::double / 100 AS v FROM supplier GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, round_even(sum(round(c_acctbal * 100)::bigint) * 1 / count(c_acctbal), 0)::double / 100 AS v FROM customer GROUP BY 1) b ON b.k = n_nationkey LEFT JOIN region r ON r_regionkey = n_regionkey")
def j18_three_source_report(spark, sf):
    """Facts joined to one row per domain."""
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(M.rounded_mean("s_acctbal", 2).alias("supplied"))
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(M.rounded_mean("c_acctbal", 2).alias("held"))
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf, "nation").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").join(F.broadcast(r), "n_regionkey", "left").select("n_name", "supplied", "held", "r_name")


@query("WITH k AS (SELECT unnest(['http:', 'https:', 'http://', 'https://']) AS head), p AS (SELECT DISTINCT url FROM pages), h AS (SELECT DISTINCT regexp_extract(url, '^[^/]*//[^/]*/[^/]*', 0) AS head FROM pages WHERE url LIKE '%/fr/%') SELECT url, max_by(head, length(head)) AS readme FROM p LEFT JOIN (SELECT head FROM h UNION SELECT 'https:' UNION SELECT 'http:') k ON url = head OR starts_with(url, head || '/') GROUP BY url")
def j19_nearest_ancestor(spark, sf):
    """The closest directory above a path that has an entry."""
    p = table(spark, sf, "pages")
    known = p.where("url LIKE '%/fr/%'").select(F.regexp_extract("url", "^[^/]*//[^/]*/[^/]*", 0).alias("url")).union(spark.createDataFrame([("https:",), ("http:",)], "url string")).distinct()
    return L.nearest_ancestor(p.select("url").distinct(), known.withColumn("readme", F.col("url")), "url", "readme")


@query("SELECT item_id, d.lang FROM benchmark JOIN documents d ON d.doc_id = item_id")
def j22_positional_join(spark, sf):
    return table(spark, sf, "benchmark").join(table(spark, sf, "documents"), F.col("doc_id") == F.col("item_id")).select("item_id", "lang")


@query("SELECT doc_id, domain FROM documents JOIN (SELECT * FROM (VALUES ('en', 'shell'), ('en', 'docs'), ('fr', 'chat-fr'), ('de', 'docs')) t(lang, domain)) USING (lang)")
def j23_language_domains(spark, sf):
    """One row can feed several domains."""
    m = spark.createDataFrame([("en", ["shell", "docs"]), ("fr", ["chat-fr"]), ("de", ["docs"])], "lang string, domains array<string>")
    return table(spark, sf, "documents").join(F.broadcast(m), "lang").select("doc_id", F.explode("domains").alias("domain"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', sha256('42:' || event_id)) AS rn FROM events) WHERE rn = 1")
def j24_pick_healthy(spark, sf):
    from ..operators.ranking import first_rows

    return first_rows(table(spark, sf, "events"), ["user_id"], [F.col("event_type") == "error", T.seeded("event_id")]).select("user_id", "event_id")


@query("WITH h AS (SELECT l_suppkey AS port, bool_or(l_returnflag = 'A' AND l_quantity > 49) AS ok FROM lineitem GROUP BY 1), f AS (SELECT min(port) FILTER (WHERE ok) AS any_ok, bool_or(ok) FILTER (WHERE port = 4) AS four FROM h) SELECT port, CASE WHEN ok THEN port WHEN four THEN 4 ELSE any_ok END AS gated FROM h, f")
def j25_health_gate(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("port")).agg(F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 49)).alias("ok"))
    f = h.agg(F.min(F.when(F.col("ok"), F.col("port"))).alias("any_ok"), F.bool_or(F.when(F.col("port") == 4, F.col("ok"))).alias("four"))
    return h.crossJoin(F.broadcast(f)).select("port", F.when(F.col("ok"), F.col("port")).when(F.col("four"), F.lit(4)).otherwise(F.col("any_ok")).alias("gated"))


_SPLIT = "CASE doc_id % 3 WHEN 0 THEN 'D1' WHEN 1 THEN 'D2' ELSE 'D3' END"
_LIC = "CASE WHEN contains(text, 'MIT') THEN 'MIT' WHEN contains(text, 'Apache') THEN 'Apache-2.0' WHEN contains(text, 'CC BY-NC') THEN 'CC-BY-NC-4.0' ELSE '' END"
_ALLOW = " UNION ALL ".join(f"SELECT '{s}' AS split, '{f}' AS field, '{v}' AS value" for f, m in (("license_spdx", R.SPDX_ALLOWED), ("source_type", R.SOURCE_TYPE_ALLOWED)) for s, vs in m.items() for v in vs)


def _lineage(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id AS row_index", f"{_SPLIT} AS split", f"{_LIC} AS license_spdx", "CASE WHEN source = 'src1' THEN 'github_scrape' WHEN source = 'src2' THEN 'synth' ELSE 'mix' END AS source_type")


@query(f"WITH r AS (SELECT doc_id AS row_index, {_SPLIT} AS split, {_LIC} AS license_spdx, CASE WHEN source = 'src1' THEN 'github_scrape' WHEN source = 'src2' THEN 'synth' ELSE 'mix' END AS source_type FROM documents), u AS (SELECT row_index, split, 'license_spdx' AS field, license_spdx AS value FROM r UNION ALL SELECT row_index, split, 'source_type', source_type FROM r) SELECT row_index, field, value FROM u WHERE (split, field, value) NOT IN (SELECT * FROM ({_ALLOW}))")
def f22_lineage_violations(spark, sf):
    """What the rules of a split do not allow, a row for each field."""
    rows = [(s, f, v) for f, m in (("license_spdx", R.SPDX_ALLOWED), ("source_type", R.SOURCE_TYPE_ALLOWED)) for s, vs in m.items() for v in vs]
    allowed = spark.createDataFrame(rows, "split string, field string, value string")
    long = _lineage(spark, sf).unpivot(["row_index", "split"], ["license_spdx", "source_type"], "field", "value")
    return long.join(F.broadcast(allowed), ["split", "field", "value"], "left_anti").select("row_index", "field", "value")


@query(f"WITH r AS (SELECT {_SPLIT} AS split, {_LIC} AS v FROM documents) SELECT split, count_if(v = '') AS blank, count_if(v <> '') AS filled FROM r GROUP BY split")
def f24_row_constraints(spark, sf):
    return _lineage(spark, sf).groupBy("split").agg(F.count_if(F.col("license_spdx") == "").alias("blank"), F.count_if(F.col("license_spdx") != "").alias("filled"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(substr(text, 1, 1500), '(MIT|Apache License|GNU General Public License)', 1), ''), CASE WHEN regexp_matches(text, '(?i)creative commons') THEN 'CC' END, 'community') AS license FROM documents")
def f19_license_resolution(spark, sf):
    """By text, then by what it expects, then by a default."""
    text = F.regexp_extract(F.substring("text", 1, 1500), "(MIT|Apache License|GNU General Public License)", 1)
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif(text, F.lit("")), F.when(F.col("text").rlike("(?i)creative commons"), "CC"), F.lit("community")).alias("license"))


@query("SELECT s_name, CASE WHEN s_acctbal < -500 THEN 'ERROR' WHEN s_nationkey % 5 = 0 THEN 'BLOCKED' WHEN s_suppkey % 4 = 1 AND s_suppkey % 3 = 1 THEN 'BLOCKED' ELSE 'ALLOWED' END AS status FROM supplier")
def f32_robots_decision(spark, sf):
    """Failure, then the opt-out (F33), then both agents' rules."""
    return table(spark, sf, "supplier").select("s_name", F.when(F.col("s_acctbal") < -500, "ERROR").when(F.col("s_nationkey") % 5 == 0, "BLOCKED").when((F.col("s_suppkey") % 4 == 1) & (F.col("s_suppkey") % 3 == 1), "BLOCKED").otherwise("ALLOWED").alias("status"))


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('error') UNION SELECT 'auto'")
def f31_public_aliases(spark, sf):
    """Distinct aliases without the denied ones, the automatic one always."""
    denied = spark.createDataFrame([("error",)], "event_type string")
    names = table(spark, sf, "events").select("event_type").distinct().join(F.broadcast(denied), "event_type", "left_anti")
    return names.union(spark.createDataFrame([("auto",)], "event_type string")).distinct()


@query("SELECT conv_id, turn, floor(length(text) / 3.5)::bigint > 400 - least(4096 / 4, 100) AS reroute, coalesce(length(text) = 0, false) AS empty FROM conversations")
def f41_context_budget(spark, sf):
    """Prompts beyond the room that is left, and completions without content."""
    tok = T.token_estimate(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", (tok > 400 - F.least(F.lit(1024), F.lit(100))).alias("reroute"), F.coalesce(F.length("text") == 0, F.lit(False)).alias("empty"))


@query("SELECT source, lang, 'old' AS version FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY 1, 2 UNION ALL SELECT * FROM (VALUES ('src1', 'en', 'new'), ('src2', 'fr', 'new')) t(source, lang, version)")
def u06_upsert(spark, sf):
    """Manifest rows by key, new ones win."""
    old = table(spark, sf, "documents").select("source", "lang").distinct().withColumn("version", F.lit("old"))
    return dedup.upsert(old, spark.createDataFrame([("src1", "en", "new"), ("src2", "fr", "new")], "source string, lang string, version string"), ["source"])


@query("SELECT doc_id AS id, text FROM documents WHERE source = 'src1' UNION ALL SELECT page_id, url FROM pages")
def u01_union_all(spark, sf):
    return table(spark, sf, "documents").where("source = 'src1'").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02_key_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def u03_difference(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).subtract(table(spark, sf, "part").where("p_size > 10").select("p_partkey"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u04_intersection(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'O'").select("k"))


@query("WITH w AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2) SELECT doc_id, count(*)::int AS n_distinct, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id")
def u05_ordered_distinct(spark, sf):
    """The distinct words of each whole text, in the order of their first occurrence."""
    words = F.array_distinct(F.split("text", " "))
    return table(spark, sf, "documents").select("doc_id", F.size(words).alias("n_distinct"), F.array_join(words, " ").alias("words"))


@query("SELECT count(*) AS outside FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)")
def u07_subset_check(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left_anti").agg(F.count("*").alias("outside"))


@query("SELECT doc_id, floor(length(text) / 3.5)::bigint AS tok FROM documents ORDER BY tok, doc_id")
def t01_curriculum_order(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate("text").alias("tok")).orderBy("tok", "doc_id")


@query("SELECT conv_id, sum(floor(length(text) / 3.5))::bigint AS tok FROM conversations GROUP BY conv_id ORDER BY tok, conv_id")
def t02_curriculum_by_message(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(T.token_estimate("text")).alias("tok")).orderBy("tok", "conv_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def t03_top_k(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def t05_argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))


@query("SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 50")
def t06_limit(spark, sf):
    return table(spark, sf, "documents").where("lang = 'fr'").select("doc_id").orderBy("doc_id").limit(50)


@query("SELECT doc_id, sha256('42:' || doc_id) AS h FROM documents ORDER BY h")
def t07_seeded_shuffle(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.seeded("doc_id").alias("h")).orderBy("h")


@query("WITH f AS (SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1) SELECT event_id, event_type FROM events JOIN f USING (event_type) ORDER BY first_seen, event_id")
def t08_group_order(spark, sf):
    e = table(spark, sf, "events")
    first = e.groupBy("event_type").agg(F.min("event_id").alias("first_seen"))
    return e.join(F.broadcast(first), "event_type").orderBy("first_seen", "event_id").select("event_id", "event_type")


_CASCADE = (("simple", "_default", "small"), ("simple", "system", "tiny"), ("complex", "_default", "large"), ("complex", "user", "reasoning"))


@query(f"WITH c AS (SELECT conv_id, turn, role, {SQL_COMPLEX('text')} AS bucket FROM conversations), t AS (SELECT * FROM (VALUES {', '.join(map(str, _CASCADE))}) t(bucket, domain, alias)) SELECT conv_id, turn, c.bucket, coalesce(a.alias, d.alias) AS alias FROM c LEFT JOIN t a ON a.bucket = c.bucket AND a.domain = role LEFT JOIN t d ON d.bucket = c.bucket AND d.domain = '_default'")
def x17_cascade_pick(spark, sf):
    """Alias by complexity (X16) and domain, else by complexity alone."""
    t = spark.createDataFrame(_CASCADE, "bucket string, role string, alias string")
    c = table(spark, sf, "conversations").withColumn("bucket", T.complexity(F.col("text")))
    default = t.where("role = '_default'").select("bucket", F.col("alias").alias("other"))
    return c.join(F.broadcast(t), ["bucket", "role"], "left").join(F.broadcast(default), "bucket", "left").select("conv_id", "turn", "bucket", F.coalesce("alias", "other").alias("alias"))


@query("WITH w AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark), f AS (SELECT item_id, w FROM w WHERE length(w) >= 6), d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), n AS (SELECT item_id, count(*) AS n, list(w) AS every FROM f GROUP BY 1), p AS (SELECT item_id, doc_id, list(w) AS own FROM f JOIN d USING (w) GROUP BY 1, 2) SELECT item_id, doc_id, round_even(len(own) / n, 3)::double AS contains_score, len(own) / n >= 0.6 AS passed, array_to_string(list_sort([w FOR w IN every IF NOT list_contains(own, w)]), ',') AS missing FROM p JOIN n USING (item_id) WHERE len(own) / n >= 0.5")
def x29_contains_score(spark, sf):
    """Share of an item's words that a document has (X31), from the items' rarest words on."""
    distinct = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: F.length(w) >= 6)
    items = table(spark, sf, "benchmark").select("item_id", F.explode(distinct).alias("w"))
    texts = table(spark, sf, "documents").select("doc_id", "text")
    hits = L.contains_scores(items, texts, "item_id", "doc_id", distinct, 0.5)
    return hits.select("item_id", "doc_id", F.bround("score", 3).alias("contains_score"), (F.col("score") >= 0.6).alias("passed"), F.array_join("missing", ",").alias("missing"))
