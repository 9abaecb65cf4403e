"""Queries that aggregate: counts, confusion, percentiles, sweeps, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import metrics as M
from .corpus import SQL_GUESS, q, sql_count
from .registry import query, table

_LABELLED = f"SELECT lang AS t, {SQL_GUESS} AS p FROM documents"
_PER_LABEL = f"""WITH g AS ({_LABELLED}), l AS (SELECT DISTINCT t AS label FROM g UNION SELECT DISTINCT p FROM g),
 s AS (SELECT label, count_if(t = label AND p = label) AS tp, count_if(t <> label AND p = label) AS fp, count_if(t = label AND p <> label) AS fn, count_if(t = label) AS support FROM g, l GROUP BY label),
 r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM s),
 f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)"""


def _guessed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("t"), T.guess_language(F.col("text")).alias("p"))


@query("SELECT source, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2)::double AS pct FROM documents GROUP BY source")
def a01_count_by_key(spark, sf):
    return M.share_of_total(table(spark, sf, "documents"), "source")


@query(f"SELECT marker, count(*) AS n, round_even(count(*) * 100 / (SELECT count(*) FROM documents), 1)::double AS pct FROM (SELECT unnest([x FOR x IN [{', '.join(q(m) for m in ('the ', 'der ', 'les ', 'que ', 'License', 'MIT'))}] IF contains(text, x)]) AS marker FROM documents) GROUP BY marker ORDER BY n DESC, marker LIMIT 20")
def a02_marker_frequency(spark, sf):
    marks = T.found(F.col("text"), ("the ", "der ", "les ", "que ", "License", "MIT"))
    d = table(spark, sf, "documents")
    counted = d.select(F.explode(marks).alias("marker")).groupBy("marker").agg(F.count("*").alias("n"))
    share = F.bround(F.col("n") * 100 / F.col("rows"), 1).alias("pct")
    return counted.crossJoin(F.broadcast(d.agg(F.count("*").alias("rows")))).select("marker", "n", share).orderBy(F.desc("n"), "marker").limit(20)


@query(f"SELECT t AS target, p AS predicted, count(*) AS n FROM ({_LABELLED}) GROUP BY 1, 2")
def a03_confusion(spark, sf):
    return M.confusion(_guessed(spark, sf), "t", "p")


@query(f"SELECT t, count_if(p = 'de') AS de, count_if(p = 'en') AS en, count_if(p = 'fr') AS fr FROM ({_LABELLED}) GROUP BY t")
def k14_confusion_matrix(spark, sf):
    return M.confusion(_guessed(spark, sf), "t", "p").groupBy(F.col("target").alias("t")).pivot("predicted", ["de", "en", "fr"]).agg(F.sum("n")).fillna(0)


@query(f"SELECT count(*) AS n, avg((t = p)::int) AS top1 FROM ({_LABELLED})")
def a04_accuracy(spark, sf):
    return _guessed(spark, sf).agg(F.count("*").alias("n"), F.avg((F.col("t") == F.col("p")).cast("int")).alias("top1"))


@query(f"{_PER_LABEL} SELECT label, tp, fp, fn, round_even(precision, 6)::double AS precision, round_even(recall, 6)::double AS recall, round_even(f1, 6)::double AS f1 FROM f")
def a05_precision_recall(spark, sf):
    return M.per_label(M.confusion(_guessed(spark, sf), "t", "p")).select("label", "tp", "fp", "fn", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_PER_LABEL} SELECT round_even(avg(f1), 6)::double AS macro, round_even(sum(f1 * support) / sum(support), 6)::double AS weighted FROM f")
def a06_macro_weighted_f1(spark, sf):
    s = M.per_label(M.confusion(_guessed(spark, sf), "t", "p"))
    return s.agg(F.bround(F.avg("f1"), 6).alias("macro"), F.bround(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted"))


@query("SELECT threshold, count_if(value >= threshold) AS covered, round_even(avg((value >= threshold)::int), 6)::double AS coverage, round_even(count_if(value >= threshold AND event_type = 'click') / count(*), 6)::double AS overall FROM events, (SELECT unnest([0.1, 0.5, 1.0, 5.0, 10.0, 20.0, 50.0, 100.0])::double AS threshold) GROUP BY threshold")
def a07_threshold_sweep(spark, sf):
    """One pass: each row is counted once for each of the eight thresholds."""
    cuts = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.5, 1.0, 5.0, 10.0, 20.0, 50.0, 100.0)])).alias("threshold")
    covered = F.col("value") >= F.col("threshold")
    g = table(spark, sf, "events").select("value", "event_type", cuts).groupBy("threshold")
    hit = F.count_if(covered & (F.col("event_type") == "click"))
    return g.agg(F.count_if(covered).alias("covered"), F.bround(F.avg(covered.cast("int")), 6).alias("coverage"), F.bround(hit / F.count("*"), 6).alias("overall"))


@query("SELECT event_type, count(*) AS n, round_even(avg(round_even(value / 100, 3)), 3)::double AS mean, round_even(avg((value >= 60)::int), 4)::double AS pass_rate FROM events GROUP BY event_type")
def a08_task_summary(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.bround(F.avg(F.bround(v / 100, 3)), 3).alias("mean"), F.bround(F.avg((v >= 60).cast("int")), 4).alias("pass_rate"))


@query("SELECT event_type, user_id % 2 + 1 AS turn, count(value) AS n, round_even(sum(round(value * 100)::bigint) * 100 / count(value), 0)::double / 10000 AS mean FROM events GROUP BY GROUPING SETS ((), (event_type), (turn))")
def a09_judge_grouping_sets(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_type", "user_id % 2 + 1 AS turn", "value")
    return e.groupingSets([[], ["event_type"], ["turn"]], "event_type", "turn").agg(F.count("value").alias("n"), M.rounded_mean("value", 4).alias("mean"))


@query("WITH r AS (SELECT source, floor(length(text) / 3.5)::bigint AS v, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, max(v) FILTER (WHERE k = least(floor(n * 0.5), n - 1)) AS p50, max(v) FILTER (WHERE k = least(floor(n * 0.9), n - 1)) AS p90, max(v) FILTER (WHERE k = least(floor(n * 0.99), n - 1)) AS p99, max(v) AS max FROM r GROUP BY source")
def a10_floor_percentiles(spark, sf):
    return M.floor_percentiles(table(spark, sf, "documents"), "source", T.token_estimate(F.col("text")), (0.5, 0.9, 0.99))


@query(f"SELECT lim, count_if(floor(length(text) / 3.5) > lim) AS above, round_even(100.0 * count_if(floor(length(text) / 3.5) > lim) / count(*), 2)::double AS pct, 100.0 * count_if(floor(length(text) / 3.5) > lim) / count(*) > 5 AS flagged FROM documents, (SELECT unnest({list(R.TOKEN_LIMITS)}) AS lim) GROUP BY lim")
def a11_limit_exceedance(spark, sf):
    d = table(spark, sf, "documents").select(T.token_estimate(F.col("text")).alias("tok"))
    one = d.agg(F.count("*").alias("n"), *[F.count_if(F.col("tok") > x).alias(f"a{x}") for x in R.TOKEN_LIMITS])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("lim"), F.col(f"a{x}").alias("above")) for x in R.TOKEN_LIMITS])).alias("r")
    pct = 100.0 * F.col("above") / F.col("n")
    return one.select("n", rows).select("r.lim", "r.above", "n").select("lim", "above", F.bround(pct, 2).alias("pct"), (pct > 5).alias("flagged"))


_CELLS = "WITH b AS (SELECT l_returnflag AS m, l_linestatus AS d, round_even(sum(round(l_extendedprice * 100)::bigint) * 100 / count(l_extendedprice), 0)::double / 10000 AS base, count(*) AS nb FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), c AS (SELECT l_returnflag AS m, l_linestatus AS d, round_even(sum(round(l_extendedprice * 100)::bigint) * 100 / count(l_extendedprice), 0)::double / 10000 AS tuned, count(*) AS nt FROM lineitem WHERE l_linenumber > 2 AND l_linestatus = 'O' OR l_returnflag = 'A' GROUP BY 1, 2)"


def _cells(spark, sf):
    """Base and tuned cells on their key, either side may be missing."""
    x = table(spark, sf, "lineitem")
    mean = lambda c, v, n: x.where(c).groupBy(F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("d")).agg(M.rounded_mean("l_extendedprice", 4).alias(v), F.count("*").alias(n))
    return mean("l_linenumber <= 3", "base", "nb").join(mean("l_linenumber > 2 AND l_linestatus = 'O' OR l_returnflag = 'A'", "tuned", "nt"), ["m", "d"], "full_outer")


@query(f"{_CELLS} SELECT coalesce(b.m, c.m) AS m, coalesce(b.d, c.d) AS d, base, tuned, CASE WHEN base > 0 AND tuned > 0 THEN round_even((base - tuned) / base * 100, 2)::double + 0.0 END AS lift_pct, CASE WHEN base > 0 AND tuned > 0 THEN round_even(ln(base) - ln(tuned), 4)::double + 0.0 END AS lift_log, coalesce(nb, 0) >= 25 AND coalesce(nt, 0) >= 25 AS enough FROM b FULL JOIN c ON b.m = c.m AND b.d = c.d")
def j01_bench_compare(spark, sf):
    """Full outer comparison with lifts (X24) and the sample-size gate."""
    both = (F.col("base") > 0) & (F.col("tuned") > 0)
    pct, log = (F.col("base") - F.col("tuned")) / F.col("base") * 100, F.log("base") - F.log("tuned")
    enough = (F.coalesce("nb", F.lit(0)) >= 25) & (F.coalesce("nt", F.lit(0)) >= 25)
    return _cells(spark, sf).select("m", "d", "base", "tuned", F.when(both, F.bround(pct, 2)).alias("lift_pct"), F.when(both, F.bround(log, 4)).alias("lift_log"), enough.alias("enough"))


_LIFTS = _CELLS + ", x AS (SELECT b.m || '/' || b.d AS cell, ln(base) - ln(tuned) AS lift, (base - tuned) / base * 100 AS pct, nb >= 25 AND nt >= 25 AS enough FROM b JOIN c ON b.m = c.m AND b.d = c.d WHERE base > 0 AND tuned > 0)"


@query(f"{_LIFTS} SELECT count_if(enough) AS n, count_if(NOT enough) AS flagged, round_even(median(lift) FILTER (enough), 4)::double AS mid, round_even((exp(median(lift) FILTER (enough)) - 1) * 100, 2)::double AS effect_pct, round_even(median(pct) FILTER (enough), 2)::double AS mid_pct, round_even(min(lift) FILTER (enough), 4)::double AS low, round_even(max(lift) FILTER (enough), 4)::double AS high, arg_min(cell, (lift, cell)) FILTER (enough) AS low_cell, arg_max(cell, (lift, cell)) FILTER (enough) AS high_cell, count_if(enough AND lift < 0) AS hurt, count_if(enough AND lift > 0.0001) AS forgotten FROM x")
def a12_lift_statistics(spark, sf):
    """Lift statistics over the cells with enough samples: median, its effect in percent, extremes with
    their cells, cells that got worse, and the count of silently forgotten ones (A13)."""
    lift = F.log("base") - F.log("tuned")
    x = _cells(spark, sf).where("base > 0 AND tuned > 0").select(F.concat_ws("/", "m", "d").alias("cell"), lift.alias("lift"), ((F.col("base") - F.col("tuned")) / F.col("base") * 100).alias("pct"), ((F.col("nb") >= 25) & (F.col("nt") >= 25)).alias("enough"))
    e = x.where("enough").agg(F.count("*").alias("n"), F.median("lift").alias("mid"), F.median("pct").alias("mid_pct"), F.min(F.struct("lift", "cell")).alias("low"), F.max(F.struct("lift", "cell")).alias("high"), F.count_if(F.col("lift") < 0).alias("hurt"), F.count_if(F.col("lift") > 0.0001).alias("forgotten"))
    told = e.crossJoin(F.broadcast(x.agg(F.count_if(~F.col("enough")).alias("flagged"))))
    return told.select("n", "flagged", F.bround("mid", 4).alias("mid"), F.bround((F.exp("mid") - 1) * 100, 2).alias("effect_pct"), F.bround("mid_pct", 2).alias("mid_pct"), F.bround("low.lift", 4).alias("low"), F.bround("high.lift", 4).alias("high"), F.col("low.cell").alias("low_cell"), F.col("high.cell").alias("high_cell"), "hurt", "forgotten")


@query("SELECT event_type, round_even(sum(value * user_id) / sum(user_id), 6)::double AS rate FROM events GROUP BY event_type")
def a14_weighted_mean(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.bround(M.weighted_mean("value", "user_id"), 6).alias("rate"))


@query("SELECT l_returnflag, round_even(sum(round(l_quantity * 100)::bigint) * 100 / count(l_quantity), 0)::double / 10000 AS parse_ok, round_even(sum(round(l_discount * 100)::bigint) * 100 / count(l_discount), 0)::double / 10000 AS erc_clean, round_even(sum(round(l_tax * 100)::bigint) * 100 / count(l_tax), 0)::double / 10000 AS render FROM lineitem GROUP BY l_returnflag")
def a15_axis_means(spark, sf):
    axes = {"parse_ok": "l_quantity", "erc_clean": "l_discount", "render": "l_tax"}
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[M.rounded_mean(c, 4).alias(k) for k, c in axes.items()])


@query("SELECT o, round_even(avg(ok::int), 4)::double AS rate, count(*) AS n FROM (SELECT l_orderkey % 7 AS o, l_orderkey, bool_or(l_discount = 0.05) AS ok FROM lineitem GROUP BY 1, 2) GROUP BY o")
def a16_any_pass_rate(spark, sf):
    one = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("o"), "l_orderkey").agg(F.bool_or(F.col("l_discount") == 0.05).alias("ok"))
    return one.groupBy("o").agg(F.bround(F.avg(F.col("ok").cast("int")), 4).alias("rate"), F.count("*").alias("n"))


@query("SELECT event_type, round_even(exp(sum(value) / (100 * sum(user_id))), 6)::double AS perplexity FROM events GROUP BY event_type")
def a17_perplexity(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.bround(F.exp(F.sum("value") / (100 * F.sum("user_id"))), 6).alias("perplexity"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round_even(least(sum(n) OVER () / (count(*) OVER () * greatest(n, 1)), 10), 6)::double AS weight FROM c")
def a19_class_weights(spark, sf):
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    whole = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(whole)).select("label", "n", F.bround(F.least(F.col("total") / (F.col("k") * F.greatest("n", F.lit(1))), F.lit(10.0)), 6).alias("weight"))


@query("SELECT lang, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM documents GROUP BY lang")
def a21_distinct_joined(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def a23_last_value(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("SELECT lang, count_if(floor(length(text) / 3.5) <= 512) AS within, count_if(floor(length(text) / 3.5) > 512 AND floor(length(text) / 3.5) <= 1024) AS twice, count_if(floor(length(text) / 3.5) > 1024) AS above FROM documents GROUP BY lang")
def a24_length_classes(spark, sf):
    tok = T.token_estimate(F.col("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(tok <= 512).alias("within"), F.count_if((tok > 512) & (tok <= 1024)).alias("twice"), F.count_if(tok > 1024).alias("above"))


@query("SELECT l_orderkey, l_linenumber, round_even(0.3 * (l_quantity > 10)::int + 0.3 * (l_discount > 0.05)::int + 0.15 * (l_tax > 0.04)::int + 0.1 * coalesce((l_returnflag = 'R')::int, 0) + 0.15 * l_discount, 6)::double AS composite FROM lineitem")
def a25_composite(spark, sf):
    b = lambda s: F.expr(s).cast("int")
    c = 0.3 * b("l_quantity > 10") + 0.3 * b("l_discount > 0.05") + 0.15 * b("l_tax > 0.04") + 0.1 * F.coalesce(b("l_returnflag = 'R'"), F.lit(0)) + 0.15 * F.col("l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.bround(c, 6).alias("composite"))


@query("SELECT a.label = b.label AS same, count(*) AS pairs, round_even(avg(list_dot_product(a.embedding::double[], b.embedding::double[])), 5)::double AS mean FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id GROUP BY 1")
def a27_pair_separation(spark, sf):
    """Mean cosine of all pairs with and without a common label."""
    return M.pair_separation(table(spark, sf, "embeddings"))


@query("SELECT count_if(a < b) AS wins_1, count_if(a > b) AS wins_2 FROM (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def a28_win_counts(spark, sf):
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    m = table(spark, sf, "events").groupBy("user_id").agg(mean("view").alias("a"), mean("click").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return m.agg(F.count_if(F.col("a") < F.col("b")).alias("wins_1"), F.count_if(F.col("a") > F.col("b")).alias("wins_2"))


@query("SELECT p_brand, p_size % 3 AS version, round_even(sum(round(p_retailprice * 100)::bigint) * 100 / count(p_retailprice), 0)::double / 10000 AS mean, count(*) AS n FROM part GROUP BY 1, 2")
def a29_efficiency(spark, sf):
    """Prices are added up in cents: a mean that lies halfway doesn't depend on the order of the rows."""
    return table(spark, sf, "part").groupBy("p_brand", (F.col("p_size") % 3).alias("version")).agg(M.rounded_mean("p_retailprice", 4).alias("mean"), F.count("*").alias("n"))


_JAVA, _CS, _PY, _CPP = (sql_count("html", m) for m in (("<nav", "<ul"), ("<style", "zzz"), ("<b>", "href"), ("<article", "<p>", "%%%")))


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN contains(html, '***') THEN 'java' WHEN {_CS} >= 2 THEN 'csharp' WHEN contains(html, '&eacute;') OR contains(html, '!!') THEN 'python' WHEN {_CPP} < 2 THEN 'few_markers' ELSE 'pass' END AS reason FROM pages) GROUP BY reason")
def a30_funnel(spark, sf):
    """Rows by the first rule that rejects them."""
    h = F.col("html")
    has = lambda s: F.contains(h, F.lit(s))
    reason = F.when(has("***"), "java").when(T.found_count(h, ("<style", "zzz")) >= 2, "csharp").when(has("&eacute;") | has("!!"), "python").when(T.found_count(h, ("<article", "<p>", "%%%")) < 2, "few_markers").otherwise("pass")
    return table(spark, sf, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def a31_source_totals(spark, sf):
    return table(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS original, count_if(length(text) > 2000) AS split, sum(greatest(1, ceil(length(text) / 2000)))::bigint AS final FROM documents GROUP BY lang")
def a33_split_summary(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("original"), F.count_if(n > 2000).alias("split"), F.sum(F.greatest(F.lit(1), F.ceil(n / 2000))).alias("final"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN CASE WHEN min(value) < 0.05 THEN 'SUSPECT_OVERFIT' WHEN min(value) > 1.5 THEN 'SUSPECT_UNDERTRAIN' ELSE 'OK' END WHEN bool_or(event_type = 'error') THEN 'FAILED_OOM' ELSE 'INCOMPLETE' END AS verdict FROM events GROUP BY user_id")
def a35_campaign_verdicts(spark, sf):
    """The loss verdict (X14) of what is complete; else why it is not."""
    low, high = R.VALIDATION_LOSS
    loss = F.min("value")
    verdict = F.when(loss < low, "SUSPECT_OVERFIT").when(loss > high, "SUSPECT_UNDERTRAIN").otherwise("OK")
    done, failed = F.bool_or(F.col("event_type") == "purchase"), F.bool_or(F.col("event_type") == "error")
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(done, verdict).when(failed, F.lit("FAILED_OOM")).otherwise("INCOMPLETE").alias("verdict"))


@query("SELECT doc_id, sum(regexp_extract(line, '(\\d+)', 1)::bigint) AS total FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(^|\\D)\\d{1,6}(\\D|$)') AND length(regexp_extract(line, '(\\d+)', 1)) < 9 GROUP BY doc_id".replace("\\\\", "\\"))
def a36_sum_extracted(spark, sf):
    line = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    number = F.regexp_extract("line", r"(\d+)", 1)
    return line.where(F.col("line").rlike(r"(^|\D)\d{1,6}(\D|$)") & (F.length(number) < 9)).groupBy("doc_id").agg(F.sum(number.cast("long")).alias("total"))


@query("SELECT event_type, bucket, count(*) AS n FROM (SELECT event_type, unnest([b FOR b IN [1, 10, 50, 100, 1000] IF value <= b]) AS bucket FROM events) GROUP BY 1, 2")
def k20_metrics_histogram(spark, sf):
    """Cumulative histogram: a row counts in every bucket that it does not exceed."""
    edges = F.explode(F.filter(F.array(*map(F.lit, (1, 10, 50, 100, 1000))), lambda b: F.col("value") <= b)).alias("bucket")
    return table(spark, sf, "events").select("event_type", edges).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query("SELECT user_id, min_by(event_type, (ts, event_id)) AS first_tool, min(ts) AS started, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY user_id")
def k18_chain_manifest(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_tool"), F.min("ts").alias("started"), F.bool_or(F.col("event_type") == "purchase").alias("ok"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (lang), ())")
def k07_provenance_ledger(spark, sf):
    return table(spark, sf, "documents").groupingSets([["source", "lang"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"))


@query("SELECT source AS domain, count(*) AS n_source, least(count(*), 30) AS n_used, least(count(*), 30) - greatest(1, round_even(least(count(*), 30) * 0.05, 0))::bigint AS n_train, greatest(1, round_even(least(count(*), 30) * 0.05, 0))::bigint AS n_valid FROM documents GROUP BY source")
def k08_manifest_record(spark, sf):
    used = F.least(F.count("*"), F.lit(30))
    valid = F.greatest(F.lit(1), F.bround(used * 0.05)).cast("long")
    return table(spark, sf, "documents").groupBy(F.col("source").alias("domain")).agg(F.count("*").alias("n_source"), used.cast("long").alias("n_used"), (used - valid).cast("long").alias("n_train"), valid.alias("n_valid"))


@query("SELECT source, count_if(n >= 30) > 0 AS enough, CASE WHEN max(n) >= 60 THEN 'GOOD' WHEN max(n) >= 30 THEN 'FAIR' ELSE 'INSUFFICIENT' END AS quality FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) GROUP BY source")
def f36_minimum_gate(spark, sf):
    """Groups under the minimum are reported as insufficient."""
    n = F.col("n")
    g = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", (n >= 30).alias("enough"), F.when(n >= 60, "GOOD").when(n >= 30, "FAIR").otherwise("INSUFFICIENT").alias("quality"))
