"""Queries on evaluation runs: reports, scores, policies, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import metrics as M
from ..operators import sequences as S
from ..operators.ranking import first_rows, numbered_in_order
from ..sources.scratch import scratch
from .corpus import STRIP
from .metrics import _CELLS, _cells
from .registry import query, table


@query("SELECT 'events.' || event_type || '.' || m AS metric, printf('%.4f', v) AS value FROM (SELECT event_type, 'mean' AS m, round_even(sum(round(value * 100)::bigint) * 100 / count(value), 0)::double / 10000 AS v FROM events GROUP BY 1 UNION ALL SELECT event_type, 'max', max(value) FROM events GROUP BY 1)")
def k09_metric_report(spark, sf):
    """The metrics of all runs in long form, sorted, with four decimals."""
    g = table(spark, sf, "events").groupBy("event_type").agg(M.rounded_mean("value", 4).alias("mean"), F.max("value").alias("max"))
    long = g.unpivot("event_type", ["mean", "max"], "m", "v")
    return long.select(F.concat_ws(".", F.lit("events"), "event_type", "m").alias("metric"), F.format_string("%.4f", "v").alias("value")).orderBy("metric")


_RUNS = "SELECT event_type AS d, user_id % 2 + 1 AS v, round_even(sum(round(value * 100)::bigint) * 100 / count(value), 0)::double / 10000 AS loss, count(*) AS n, max(user_id) AS size FROM events GROUP BY 1, 2"


@query(f"WITH r AS ({_RUNS}), a AS (SELECT * FROM r WHERE v = 1), b AS (SELECT * FROM r WHERE v = 2) SELECT coalesce(a.d, b.d) AS domain, a.loss AS v1, b.loss AS v2, a.n AS n1, b.n AS n2, CASE WHEN a.loss IS NULL OR b.loss IS NULL THEN 'none' WHEN a.loss < b.loss THEN 'v1' WHEN b.loss < a.loss THEN 'v2' ELSE 'tie' END AS winner, coalesce(b.size, 0) - coalesce(a.size, 0) AS grown FROM a FULL JOIN b ON a.d = b.d")
def k11_evaluation_report(spark, sf):
    """Two versions side by side: loss, samples, size and who wins."""
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("domain"), (F.col("user_id") % 2 + 1).alias("v")).agg(M.rounded_mean("value", 4).alias("loss"), F.count("*").alias("n"), F.max("user_id").alias("size"))
    side = lambda k: r.where(F.col("v") == k).select("domain", F.col("loss").alias(f"v{k}"), F.col("n").alias(f"n{k}"), F.col("size").alias(f"s{k}"))
    both = side(1).join(side(2), "domain", "full_outer")
    grown = F.coalesce("s2", F.lit(0)) - F.coalesce("s1", F.lit(0))
    return both.select("domain", "v1", "v2", "n1", "n2", E.winner("v1", "v2").alias("winner"), grown.alias("grown"))


@query("SELECT source, lang, count(*) AS files, sum(n_chars)::bigint AS chars, count(*) FILTER (WHERE n_chars >= 200) AS pairs FROM documents GROUP BY ROLLUP (source, lang)")
def k12_compliance_report(spark, sf):
    """Files, sizes and pairs of each source and domain, with subtotals."""
    return table(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") >= 200).alias("pairs"))


_PAGE_TYPE = f"CASE WHEN length({STRIP}) < 50 AND len(string_split(text, chr(10))) < 3 THEN 'cover' WHEN len(string_split(text, chr(10))) >= 30 THEN (CASE WHEN len(regexp_extract_all(text, '[|]')) > 0.6 * len(string_split(text, chr(10))) THEN 'table' ELSE 'schematic' END) WHEN len(string_split(text, chr(10))) > 10 THEN 'diagram' WHEN length({STRIP}) >= 200 THEN 'text' ELSE 'sparse' END"


@query(f"SELECT source, type, grouping(source) AS all_files, count(*) AS pages, count_if(doc_id % 10 <> 0) AS ok, count_if(doc_id % 10 = 0) AS failed FROM (SELECT doc_id, source, {_PAGE_TYPE} AS type FROM documents WHERE text IS NOT NULL) GROUP BY GROUPING SETS ((source, type), (type))")
def k13_page_report(spark, sf):
    """Pages by type, of each file and of all, and how many failed."""
    p = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", E.page_type(F.col("text")).alias("type"))
    g = p.groupingSets([["source", "type"], ["type"]], "source", "type")
    return g.agg(F.grouping("source").cast("long").alias("all_files"), F.count("*").alias("pages"), F.count_if(F.col("doc_id") % 10 != 0).alias("ok"), F.count_if(F.col("doc_id") % 10 == 0).alias("failed"))


@query(f"WITH t AS (SELECT {_PAGE_TYPE} AS type FROM documents WHERE text IS NOT NULL) SELECT type, count(*) AS pages, count(*) * CASE type WHEN 'table' THEN 3 WHEN 'schematic' THEN 5 WHEN 'diagram' THEN 3 WHEN 'text' THEN 2 ELSE 1 END AS pairs FROM t WHERE type <> 'cover' GROUP BY type")
def a34_page_type_counts(spark, sf):
    """Pages and pairs by type: as many pairs as the type has questions."""
    p = table(spark, sf, "documents").where("text IS NOT NULL").select(E.page_type(F.col("text")).alias("type"))
    counted = p.groupBy("type").agg(F.count("*").alias("pages"))
    questions = E.questions(spark).groupBy("type").agg(F.count("*").alias("q"))
    return counted.join(F.broadcast(questions), "type").select("type", "pages", (F.col("pages") * F.col("q")).alias("pairs"))


@query(f"SELECT doc_id, k::int AS k FROM (SELECT doc_id, {_PAGE_TYPE} AS type FROM documents WHERE text IS NOT NULL), (SELECT unnest(range(5)) AS k) WHERE k < CASE type WHEN 'table' THEN 3 WHEN 'schematic' THEN 5 WHEN 'diagram' THEN 3 WHEN 'text' THEN 2 WHEN 'sparse' THEN 1 ELSE 0 END")
def d10_question_templates(spark, sf):
    """A row for each question that a page's type has."""
    p = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", E.page_type(F.col("text")).alias("type"))
    return p.join(F.broadcast(E.questions(spark)), "type").select("doc_id", "k")


@query(f"{_CELLS}, j AS (SELECT b.m, b.d, ln(base) - ln(tuned) AS lift, (SELECT count(*) FROM lineitem x WHERE x.l_returnflag = b.m AND x.l_linestatus = b.d) % 20 - 10 AS validator FROM b JOIN c ON b.m = c.m AND b.d = c.d) SELECT m, d, lift > 0.001 AND validator < -2 AS forgotten FROM j")
def a13_silent_forgetting(spark, sf):
    """Cells whose loss got better while their validator got worse."""
    validator = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("d")).agg((F.count("*") % 20 - 10).alias("validator"))
    cells = _cells(spark, sf).where("base > 0 AND tuned > 0").join(validator, ["m", "d"])
    return cells.select("m", "d", ((F.log("base") - F.log("tuned") > 0.001) & (F.col("validator") < -2)).alias("forgotten"))


@query("SELECT lang AS label, count(*) AS total, count_if(doc_id % 10 < 8) AS train, count_if(doc_id % 10 = 8) AS val, count_if(doc_id % 10 = 9) AS test, count_if(source < 'src2') AS from_first FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a20_corpus_stats(spark, sf):
    """Rows of each label by split, and what a model contributed."""
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    d = table(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("label"), split.alias("split"), (F.col("source") < "src2").alias("first"))
    counts = d.groupBy("label").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).fillna(0)
    whole = d.groupBy("label").agg(F.count("*").alias("total"), F.count_if("first").alias("from_first"))
    return whole.join(counts, "label")


@query("SELECT c_mktsegment AS domain, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1")
def a22_group_to_list(spark, sf):
    """The rows of each domain together: as a folder of files of its own, so no list grows in one task."""
    path = scratch(spark, "groups")
    table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("domain")).write.partitionBy("domain").parquet(path)
    return spark.read.parquet(path).groupBy("domain").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@query("SELECT task, count(*) AS n, round_even(avg(base::int), 6)::double AS base, round_even(avg((base AND plus)::int), 6)::double AS plus FROM (SELECT user_id % 4 AS task, event_type <> 'error' AS base, value < 40 AS plus FROM events) GROUP BY task")
def a32_pass_at_one(spark, sf):
    """The share of problems whose solution passes the tests, and the added ones too."""
    base, plus = F.col("event_type") != "error", F.col("value") < 40
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("task"), base.alias("base"), (base & plus).alias("plus"))
    return e.groupBy("task").agg(F.count("*").alias("n"), *[F.bround(F.avg(F.col(c).cast("int")), 6).alias(c) for c in ("base", "plus")])


@query(f"{_CELLS} SELECT b.m, b.d, round_even(ln(base) - ln(tuned), 4)::double + 0.0 AS lift FROM b JOIN c ON b.m = c.m AND b.d = c.d ORDER BY ln(base) - ln(tuned) DESC, b.m, b.d")
def t04_order_by_lift(spark, sf):
    """Cells from the largest lift down."""
    lift = F.log("base") - F.log("tuned")
    return _cells(spark, sf).where("base > 0 AND tuned > 0").withColumn("x", lift).orderBy(F.desc("x"), "m", "d").select("m", "d", F.bround("x", 4).alias("lift"))


@query("WITH a AS (SELECT n_chars % 50 AS v, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT n_chars % 50 AS v, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) - coalesce(b.n, 0) AS drift FROM a FULL JOIN b ON a.v = b.v WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def u08_multiset_drift(spark, sf):
    """Values that one side has more often than the other."""
    v = (F.col("n_chars") % 50).alias("v")
    d = table(spark, sf, "documents").select(v, F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1).alias("w"))
    return d.groupBy("v").agg(F.sum("w").alias("drift")).where("drift <> 0")


@query("SELECT event_type, CASE WHEN min(value) < 0.05 THEN 'SUSPECT_OVERFIT' WHEN min(value) > 1.5 THEN 'SUSPECT_UNDERTRAIN' ELSE 'OK' END AS verdict, user_id FROM events GROUP BY event_type, user_id")
def x14_loss_verdict(spark, sf):
    """What a validation loss says of a run."""
    return table(spark, sf, "events").groupBy("event_type", "user_id").agg(E.loss_verdict(F.min("value")).alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round_even((l_discount - l_tax) / l_discount * 100, 2)::double + 0.0 END AS pct, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round_even(ln(l_discount) - ln(l_tax), 4)::double + 0.0 END AS log FROM lineitem")
def x24_lift(spark, sf):
    """The gain in percent and as a difference of logs, where both sides are above 0."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *E.lift("l_discount", "l_tax"))


@query("SELECT a.vec_id, round_even(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-9), 6)::double AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x25_dense_cosine(spark, sf):
    """The cosine of neighbouring vectors."""
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.bround(M.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


_REFS = ("the", "that", "zzz")


@query("SELECT item_id, round_even((" + " + ".join(f"CASE WHEN len(regexp_extract_all(lower(text), '\\b{r}\\b')) BETWEEN 1 AND 15 THEN 1 ELSE 0 END" for r in _REFS) + ") / 3, 3)::double AS unique_score, concat_ws(',', " + ", ".join(f"CASE WHEN len(regexp_extract_all(lower(text), '\\b{r}\\b')) = 0 THEN '{r}=missing' WHEN len(regexp_extract_all(lower(text), '\\b{r}\\b')) > 15 THEN '{r}=spam(' || len(regexp_extract_all(lower(text), '\\b{r}\\b')) || ')' END" for r in _REFS) + ") AS bad FROM benchmark WHERE text IS NOT NULL")
def x30_uniqueness(spark, sf):
    """The share of references that occur, but not too often, and what is wrong with the others."""
    b = table(spark, sf, "benchmark").where("text IS NOT NULL")
    return b.select("item_id", F.bround(E.unique_score(F.lower("text"), _REFS), 3).alias("unique_score"), E.not_unique(F.lower("text"), _REFS).alias("bad"))


@query("SELECT item_id, round_even(s, 3)::double AS overall, s >= 0.6 AS passed FROM (SELECT item_id, ((contains(text, '.'))::int + (contains(lower(text), 'the')::int + contains(lower(text), 'zzz')::int) / 2 + (" + " + ".join(f"CASE WHEN len(regexp_extract_all(lower(text), '\\b{r}\\b')) BETWEEN 1 AND 15 THEN 1 ELSE 0 END" for r in _REFS) + ") / 3) / 3 AS s FROM benchmark)")
def x31_question_score(spark, sf):
    """The mean of syntax, contents and uniqueness; 0.6 passes, before it is rounded."""
    low = F.lower("text")
    syntax = F.contains("text", F.lit(".")).cast("int")
    s = (syntax + E.contains_score(low, ("the", "zzz")) + E.unique_score(low, _REFS)) / 3
    return table(spark, sf, "benchmark").select("item_id", s.alias("s")).select("item_id", F.bround("s", 3).alias("overall"), (F.col("s") >= 0.6).alias("passed"))


_POLICIES = (("en", "validate", "tool-a"), ("fr", "deliberate", None), ("de", "nonsense", None), ("_default", "sequential", None))
_POLICY_SQL = "(SELECT * FROM (VALUES ('en', 'validate'), ('fr', 'deliberate'), ('de', 'direct'), ('_default', 'sequential')) t(lang, policy))"


@query(f"SELECT doc_id, coalesce(p.policy, 'sequential') AS policy FROM documents d LEFT JOIN {_POLICY_SQL} p ON p.lang = d.lang")
def d05_policy_lookup(spark, sf):
    """The policy of a domain, else the default; one that is not known is read as direct."""
    return E.with_policy(table(spark, sf, "documents").select("doc_id", "lang"), spark.createDataFrame(_POLICIES, "lang string, policy string, tool string"), "lang").select("doc_id", "policy")


@query("WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), p AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'validate' ELSE 'deliberate' END AS policy, min(k) FILTER (WHERE event_type = 'purchase') AS won, max(k) AS n FROM s GROUP BY user_id) SELECT user_id, policy, CASE policy WHEN 'direct' THEN 1 WHEN 'validate' THEN coalesce(CASE WHEN won <= 3 THEN won END, least(n, 3)) ELSE least(n, 4) END::bigint AS steps, CASE policy WHEN 'direct' THEN true WHEN 'validate' THEN coalesce(won <= 3, false) ELSE n >= 4 END AS ok FROM p")
def d04_chain_policies(spark, sf):
    """Steps replayed by each chain's policy: one answer; tries until one passes; or all voices."""
    policy = F.when(F.col("user_id") % 3 == 0, "direct").when(F.col("user_id") % 3 == 1, "validate").otherwise("deliberate")
    steps = table(spark, sf, "events").withColumn("policy", policy)
    return E.replayed(steps, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", tries=3, voices=4)


_TEMPLATES = (("en", None, "EN {stderr} / {previous_output} {nope}"), (None, "tool-b", "B {stderr}"), ("_default", None, "Failed: {stderr}"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'EN err ' || doc_id || ' / ' || source || ' ' WHEN doc_id % 2 = 0 THEN 'B err ' || doc_id ELSE 'Failed: err ' || doc_id END AS prompt FROM documents WHERE lang IS NOT NULL")
def d06_prompt_template(spark, sf):
    """The template of a domain, else of its tool, else the default; unknown places are left empty."""
    t = spark.createDataFrame(_TEMPLATES, "domain string, tool string, template string")
    d = table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("domain"), F.when(F.col("doc_id") % 2 == 0, "tool-b").otherwise("tool-x").alias("tool"), F.concat(F.lit("err "), F.col("doc_id").cast("string")).alias("stderr"), F.col("source").alias("previous_output"))
    return E.filled_template(d, t, ("stderr", "previous_output")).select("doc_id", "prompt")


@query("SELECT p_partkey, round_even(0.3 * (p_size > 5)::int + 0.3 * (p_size > 10)::int + 0.15 * (p_size % 2)::int + 0.15 * (p_retailprice > 1000)::int, 6)::double AS composite, 0 AS drc FROM part")
def d14_five_axes(spark, sf):
    """Five axes and their composite; the board's axis is always 0, as no board is made."""
    axes = {"parse_ok": F.col("p_size") > 5, "erc_clean": F.col("p_size") > 10, "sch_render": F.col("p_size") % 2 == 1, "drc_clean": F.lit(False), "sem_equiv": F.col("p_retailprice") > 1000}
    p = table(spark, sf, "part").select("p_partkey", *[c.cast("int").alias(k) for k, c in axes.items()])
    return p.select("p_partkey", F.bround(E.composite(), 6).alias("composite"), F.col("drc_clean").alias("drc"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'cascade' WHEN doc_id % 5 = 1 THEN 'asked' WHEN lang = 'fr' THEN 'chat-fr' ELSE 'auto' END AS alias FROM documents")
def j15_effective_alias(spark, sf):
    """Cascade, then what was asked for, then the domain's alias, then the automatic one."""
    k = F.col("doc_id") % 5
    named = spark.createDataFrame([("fr", "chat-fr")], "lang string, mapped string")
    d = table(spark, sf, "documents").join(F.broadcast(named), "lang", "left")
    return d.select("doc_id", F.coalesce(F.when(k == 0, "cascade"), F.when(k == 1, "asked"), "mapped", F.lit("auto")).alias("alias"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'fc' WHEN event_id % 7 = 0 THEN 'alias' WHEN event_id % 5 = 0 THEN 'big' WHEN event_id % 3 = 0 THEN 'omlx' WHEN event_id % 2 = 0 THEN 'fc-fallback' ELSE 'port-' || user_id % 4 END AS target FROM events")
def j16_forward_override(spark, sf):
    """The first of six overrides that applies."""
    levels = [F.when(F.col("event_id") % k == 0, name) for k, name in ((11, "fc"), (7, "alias"), (5, "big"), (3, "omlx"), (2, "fc-fallback"))]
    return table(spark, sf, "events").select("event_id", F.coalesce(*levels, F.concat(F.lit("port-"), (F.col("user_id") % 4).cast("string"))).alias("target"))


@query("WITH a AS (SELECT lang, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE doc_id % 2 = 1) SELECT k, a.lang AS target, b.source AS predicted FROM a JOIN b USING (k)")
def j22_by_position(spark, sf):
    """The i-th prediction with the i-th row, both numbered in order of their ids."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.lit(0).alias("g"))
    side = lambda r, c, to: numbered_in_order(d.where(F.col("doc_id") % 2 == r), ["g"], "doc_id", "k").select("k", F.col(c).alias(to))
    return side(0, "lang", "target").join(side(1, "source", "predicted"), "k")


@query("WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role <> 'system'), f AS (SELECT *, CASE WHEN r = lag(r) OVER w THEN 0 ELSE 1 END AS b FROM (SELECT *, CASE WHEN turn % 4 < 2 THEN 'user' ELSE role END AS r FROM c) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f) SELECT conv_id, min(turn) AS turn, any_value(r) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, island".replace("\\\\", "\\"))
def w20_coalesced_turns(spark, sf):
    """Stripped turns; neighbours of one role become one (a first system message stays apart)."""
    role = F.when(F.col("turn") % 4 < 2, "user").otherwise(F.col("role"))
    c = table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", role.alias("role"), T.strip("text").alias("text"))
    return S.merge_roles(c).select("conv_id", "turn", "role", "text")


@query("WITH c AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 600)) AS o, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, (o // 600 + 1)::int AS part, CASE WHEN length(text) > 600 THEN '[Part ' || (o // 600 + 1) || '/' || ceil(length(text) / 600)::bigint || ']' || chr(10) || substr(text, o + 1, 600) ELSE text END AS chunk FROM c")
def w23_part_numbering(spark, sf):
    """Parts with their number and how many there are, where there are several."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return S.labelled_parts(d, "doc_id", "text", 600).select("doc_id", "part", "chunk")


@query("SELECT vec_id, round_even(list_sum([x * x FOR x IN embedding::double[]]), 4)::double AS energy, 'route-' || label AS route FROM (SELECT *, row_number() OVER (ORDER BY vec_id DESC) AS rn FROM embeddings) WHERE rn <= 256")
def w26_fifo_ring(spark, sf):
    """What a ring of 256 places holds in the end: the latest pairs of vector and route."""
    pairs = table(spark, sf, "embeddings").select("vec_id", "embedding", F.concat(F.lit("route-"), F.col("label").cast("string")).alias("route"))
    energy = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return pairs.orderBy(F.desc("vec_id")).limit(256).select("vec_id", F.bround(energy, 4).alias("energy"), "route")


@query("SELECT event_id, event_type, round_even(CASE WHEN value > 0 THEN (event_id % 100) / value ELSE 0 END, 1)::double AS tokens_per_s FROM events")
def b26_generation_facts(spark, sf):
    """Tokens a second, 0 where no time was taken."""
    return table(spark, sf, "events").select("event_id", "event_type", F.bround(F.coalesce(F.try_divide(F.col("event_id") % 100, F.when(F.col("value") > 0, F.col("value"))), F.lit(0.0)), 1).alias("tokens_per_s"))


@query("SELECT p_brand, sum(p_size * (p_partkey % 7 + 1) * 2)::bigint AS parameters, min_by(p_retailprice, p_partkey) FILTER (WHERE p_partkey % 3 > 0) AS train_loss FROM part GROUP BY p_brand")
def b27_efficiency_facts(spark, sf):
    """Sum of the products of shapes, and the first log that has a loss."""
    shape = F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 7 + 1, F.lit(2).cast("long"))
    size = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    logged = F.col("p_partkey") % 3 > 0
    return table(spark, sf, "part").groupBy("p_brand").agg(F.sum(size).alias("parameters"), F.min_by(F.when(logged, F.col("p_retailprice")), F.when(logged, F.col("p_partkey"))).alias("train_loss"))


@query("SELECT n_name AS domain, s.n IS NOT NULL AS ready FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.k = n_nationkey")
def b28_existing_pairs(spark, sf):
    """Pairs whose file is there, and those that are pending."""
    there = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("there")).distinct()
    return table(spark, sf, "nation").join(there, "n_nationkey", "left").select(F.col("n_name").alias("domain"), F.col("there").isNotNull().alias("ready"))


@query("SELECT user_id AS domain, CASE WHEN count_if(event_type = 'purchase') > 0 THEN round_even(max(value), 2)::double END AS perplexity, CASE WHEN count_if(event_type = 'purchase') = 0 THEN 'no result' END AS error FROM events GROUP BY user_id")
def b29_baseline_rows(spark, sf):
    """A row for each domain; a failure is a row with its error."""
    done = F.count_if(F.col("event_type") == "purchase")
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("domain"))
    return e.agg(F.when(done > 0, F.bround(F.max("value"), 2)).alias("perplexity"), F.when(done == 0, "no result").alias("error"))


@query("WITH u AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id), r AS (SELECT conv_id % 5 AS domain, conv_id, prompt, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) AS rn FROM u) SELECT domain, prompt FROM r WHERE rn <= 3 UNION ALL SELECT 9, 'Say hello.'")
def b30_first_prompts(spark, sf):
    """The first user messages of each domain, three at most; a domain without any has a fixed one."""
    u = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt")).withColumn("domain", F.col("conv_id") % 5)
    found = first_rows(u, ["domain"], ["conv_id"], 3).select("domain", "prompt")
    asked = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 9)], "domain long")
    none = asked.join(found.select("domain").distinct(), "domain", "left_anti").select("domain", F.lit("Say hello.").alias("prompt"))
    return found.unionByName(none)


@query("SELECT event_id, ['skidl', 'atopile'][1 + ('0x' || substr(sha256('42:' || event_id), 1, 7))::bigint % 2] AS compiler FROM events WHERE event_id % 3 = 0 AND value < 60")
def b32_generate_check_keep(spark, sf):
    """What compiles and passes the check, with the compiler that was drawn for it."""
    h = F.conv(F.substring(T.seeded("event_id"), 1, 7), 16, 10).cast("long")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("compile"), F.when(F.col("value") < 60, 0).otherwise(2).alias("check"), F.element_at(F.array(F.lit("skidl"), F.lit("atopile")), (h % 2 + 1).cast("int")).alias("compiler"))
    return rows.where((F.col("compile") == 0) & (F.col("check") == 0)).select("event_id", "compiler")


@query("SELECT p_partkey, 'layers.' || p_size AS key FROM part")
def b39_prefix_remap(spark, sf):
    """Keys without the first prefix that makes any of them one of the model's."""
    k = F.concat(F.lit("layers."), F.col("p_size").cast("string"))
    raw = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("model.language_model."), k).alias("key"))
    model = table(spark, sf, "part").select(k.alias("key")).distinct()
    return E.remapped(raw, model, "key", ("", "base.", "model.", "model.language_model.")).select("p_partkey", "key")


@query("SELECT source, arg_min(sha256(substr(text, 1, 64)), doc_id) AS head FROM documents WHERE text IS NOT NULL GROUP BY source")
def b40_head_fingerprint(spark, sf):
    """The hash of the head of each source's first file."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.groupBy("source").agg(F.min_by(F.sha2(F.encode(F.substring("text", 1, 64), "utf-8"), 256), "doc_id").alias("head"))


_VENDORS = (("STMicro Electronics", 0), ("Texas Instruments", 1), ("Microchip", 2))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'STMicro Electronics' WHEN 1 THEN 'STMicro Electronics' WHEN 2 THEN 'Texas Instruments' END AS vendor FROM part")
def b42_vendor_lookup(spark, sf):
    """The first vendor whose name has the asked one in it, whatever its case; null if none has."""
    asked = F.element_at(F.array(*map(F.lit, ("st", "micro", "TEXAS", "acme"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", asked.alias("asked"))
    vendors = F.broadcast(spark.createDataFrame(_VENDORS, "vendor string, place int"))
    hit = p.join(vendors, F.contains(F.lower("vendor"), F.lower("asked")), "left")
    return hit.groupBy("p_partkey").agg(F.min_by("vendor", "place").alias("vendor"))


@query("WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), c AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 7))::bigint % 64 AS place, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2) SELECT doc_id, place, round_even(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6)::double AS value FROM c")
def d08_text_encoder(spark, sf):
    """Texts as unit vectors: their words counted in 64 hashed places (no model is at hand)."""
    return E.hashed_vectors(table(spark, sf, "documents"), "doc_id", "text").withColumn("value", F.bround("value", 6))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'text' WHEN 2 THEN 'text' ELSE 'unknown' END AS format, CASE doc_id % 4 WHEN 0 THEN 'A & ' || doc_id WHEN 3 THEN NULL ELSE 'plain ' || doc_id END AS text FROM documents")
def d07_format_dispatch(spark, sf):
    """What is read out of a file by its format: each format has its own extractor."""
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.element_at(F.array(*map(F.lit, ("a.html", "b.txt", "c.MD", "d.bin"))), (k + 1).cast("int"))
    body = F.when(k == 0, F.concat(F.lit("<style>x</style><p>A &amp; "), i, F.lit("</p>"))).otherwise(F.concat(F.lit(" plain "), i, F.lit("\n")))
    files = table(spark, sf, "documents").select("doc_id", E.format_of(name).alias("format"), body.alias("body"))
    return files.select("doc_id", "format", E.extracted("format", "body").alias("text"))


@query()
def x53_router_head(spark, sf):
    """A dense head (GELU, sigmoid) with fixed seeded weights over the vectors: the best label of each row."""
    return E.dense_head(table(spark, sf, "embeddings"), "vec_id", "embedding", hidden=32, labels=10)


@query()
def d12_model_trainer(spark, sf):
    """A multinomial classifier with class weights, trained by Spark; one row per label: rows and hits."""
    return E.trained_head(table(spark, sf, "embeddings"), "embedding", "label")


@query("SELECT doc_id, CASE WHEN length(replace(text, '(', '')) = length(replace(text, ')', '')) THEN 0 ELSE 1 END AS exit_code, CASE WHEN length(replace(text, '(', '')) = length(replace(text, ')', '')) THEN 'ok' ELSE '' END AS stdout, CASE WHEN length(replace(text, '(', '')) = length(replace(text, ')', '')) THEN '' ELSE 'brackets' END AS stderr FROM documents WHERE text IS NOT NULL")
def d01_validator(spark, sf):
    """A registered validator over outputs: exit code, stdout and stderr (this one checks brackets)."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", E.bracket_validator("text").alias("v")).select("doc_id", "v.exit_code", "v.stdout", "v.stderr")
