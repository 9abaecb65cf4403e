"""Operators on evaluation: page types, verdicts, scores, policies, templates, heads."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

# The known policies, and what is asked of a page by its type.
POLICIES = ("direct", "validate", "deliberate", "mixture", "sequential")
QUESTIONS = {
    "schematic": ("Describe the circuit.", "What is its purpose?", "List the components.", "Name design considerations.", "Which signals does it use?"),
    "table": ("Extract the data of the table.", "What parameters are given?", "Which values are critical?"),
    "diagram": ("Describe the diagram.", "What is its purpose?", "How do the blocks relate?"),
    "text": ("Summarize the page.", "What are the key points?"),
    "sparse": ("What does this page show?",),
}
#: Weights of the five axes.
AXES = {"parse_ok": 0.3, "erc_clean": 0.3, "sch_render": 0.15, "drc_clean": 0.1, "sem_equiv": 0.15}


def questions(spark: SparkSession) -> DataFrame:
    """type, k (from 0) and question; a dozen rows."""
    return spark.createDataFrame([(t, k, x) for t, xs in QUESTIONS.items() for k, x in enumerate(xs)], "type string, k int, question string")


def page_type(text: Column) -> Column:
    n, chars = T.line_count(text), F.length(T.strip(text))
    bars = F.regexp_count(text, F.lit("[|]"))
    return F.when((chars < 50) & (n < 3), "cover").when(n >= 30, F.when(bars > 0.6 * n, "table").otherwise("schematic")).when(n > 10, "diagram").when(chars >= 200, "text").otherwise("sparse")


def loss_verdict(loss: Column) -> Column:
    low, high = R.VALIDATION_LOSS
    return F.when(loss < low, "SUSPECT_OVERFIT").when(loss > high, "SUSPECT_UNDERTRAIN").otherwise("OK")


def winner(a: str, b: str) -> Column:
    """The side with the smaller loss; none where one is missing."""
    x, y = F.col(a), F.col(b)
    return F.when(x.isNull() | y.isNull(), "none").when(x < y, "v1").when(y < x, "v2").otherwise("tie")


def lift(base: str, tuned: str) -> list[Column]:
    b, t = F.col(base), F.col(tuned)
    both = (b > 0) & (t > 0)
    return [F.when(both, F.bround((b - t) / b * 100, 2)).alias("pct"), F.when(both, F.bround(F.log(b) - F.log(t), 4)).alias("log")]


def contains_score(text: Column, items: tuple[str, ...]) -> Column:
    return T.found_count(text, items) / F.lit(len(items))


def unique_score(text: Column, refs: tuple[str, ...], most: int = 15) -> Column:
    """The share of references that occur as words, ``most`` times at most."""
    return reduce(add, [F.regexp_count(text, F.lit(rf"\b{r}\b")).between(1, most).cast("int") for r in refs]) / F.lit(len(refs))


def not_unique(text: Column, refs: tuple[str, ...], most: int = 15) -> Column:
    """``R1=missing`` or ``R1=spam(16)`` of the references that :func:`unique_score` doesn't count, joined by commas."""

    def told(ref: str) -> Column:
        n = F.regexp_count(text, F.lit(rf"\b{ref}\b"))
        return F.when(n == 0, f"{ref}=missing").when(n > most, F.concat(F.lit(f"{ref}=spam("), n.cast("string"), F.lit(")")))

    return F.concat_ws(",", *map(told, refs))


def composite() -> Column:
    """The weighted sum of the axes; missing ones count as 0."""
    return reduce(add, [F.coalesce(F.col(c), F.lit(0)) * w for c, w in AXES.items()])


def with_policy(rows: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """The key's policy, else that of ``_default``; one that is not known is direct."""
    known = policies.select(key, F.when(F.col("policy").isin(*POLICIES), F.col("policy")).otherwise("direct").alias("policy"))
    default = known.where(F.col(key) == "_default").select(F.col("policy").alias("_default"))
    joined = rows.join(known, key, "left").crossJoin(F.broadcast(default.limit(1)))
    return joined.withColumn("policy", F.coalesce("policy", "_default")).drop("_default")


def replayed(steps: DataFrame, chain: str, order: list[str], ok: Column, tries: int, voices: int) -> DataFrame:
    """Of each chain its policy, how many of its steps that makes, and if it ends well.

    direct takes one step; validate goes on until one is ok, ``tries`` at most; any other hears
    ``voices`` steps and ends well if there are so many.
    """
    numbered = steps.withColumns({"_k": F.row_number().over(Window.partitionBy(chain).orderBy(*order)), "_ok": ok}).where(F.col("_k") <= max(tries, voices))
    g = numbered.groupBy(chain).agg(F.first("policy").alias("policy"), F.min(F.when(F.col("_ok") & (F.col("_k") <= tries), F.col("_k"))).alias("won"), F.max("_k").alias("n"))
    made = F.when(F.col("policy") == "direct", F.lit(1)).when(F.col("policy") == "validate", F.coalesce("won", F.least("n", F.lit(tries)))).otherwise(F.least("n", F.lit(voices)))
    well = F.when(F.col("policy") == "direct", F.lit(True)).when(F.col("policy") == "validate", F.col("won").isNotNull()).otherwise(F.col("n") >= voices)
    return g.select(chain, "policy", made.cast("long").alias("steps"), well.alias("ok"))


def filled_template(rows: DataFrame, templates: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Add prompt: the template of the domain, of the tool, or the default, filled in."""
    by_domain = templates.where("domain IS NOT NULL").select("domain", F.col("template").alias("_domain"))
    by_tool = templates.where("tool IS NOT NULL").select("tool", F.col("template").alias("_tool"))
    default = by_domain.where("domain = '_default'").select(F.col("_domain").alias("_default"))
    got = rows.join(by_domain, "domain", "left").join(by_tool, "tool", "left").crossJoin(F.broadcast(default.limit(1)))
    text = F.coalesce("_domain", "_tool", "_default")
    # Places that no field fills go first, so that what is filled in is not read as one.
    text = F.regexp_replace(text, r"\{(?!(?:" + "|".join(fields) + r")\})\w+\}", "")
    for f in fields:
        text = F.replace(text, F.lit("{" + f + "}"), F.coalesce(F.col(f), F.lit("")))
    return got.withColumn("prompt", text).drop("_domain", "_tool", "_default")


def remapped(raw: DataFrame, model: DataFrame, key: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Keys without the first prefix by which any of them is a key of the model; all as they are if none is."""
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(p).alias("prefix")) for k, p in enumerate(prefixes)]))
    each = raw.select(F.col(key).alias("_raw"), tried.alias("p")).where(F.col("_raw").startswith(F.col("p.prefix")))
    cut = each.select("p", F.expr("substring(_raw, length(p.prefix) + 1)").alias(key))
    best = cut.join(model.select(key).distinct(), key, "left_semi").agg(F.min("p").alias("best"))
    prefix = F.coalesce(F.col("best.prefix"), F.lit(""))
    got = raw.crossJoin(F.broadcast(best))
    bare = F.when(F.col(key).startswith(prefix), F.substring(F.col(key), F.length(prefix) + 1, F.length(key))).otherwise(F.col(key))
    return got.withColumn(key, bare).drop("best")


def bracket_validator(output: Column | str) -> Column:
    """What any validator returns, (exit_code, stdout, stderr); this one wants as many opening brackets as closing ones."""
    count = lambda sign: F.length(F.coalesce(output, F.lit(""))) - F.length(F.replace(F.coalesce(output, F.lit("")), F.lit(sign), F.lit("")))
    ok = count("(") == count(")")
    return F.struct(F.when(ok, 0).otherwise(1).alias("exit_code"), F.when(ok, "ok").otherwise("").alias("stdout"), F.when(ok, "").otherwise("brackets").alias("stderr"))


#: Extractors by format; a format without one gives no text.
EXTRACTORS = {"html": T.html_to_text, "text": T.strip}
_FORMATS = (("html", "html"), ("htm", "html"), ("txt", "text"), ("md", "text"), ("csv", "text"), ("log", "text"))


def format_of(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in _FORMATS for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def extracted(kind: str, body: str) -> Column:
    return F.coalesce(*[F.when(F.col(kind) == k, extract(F.col(body))) for k, extract in EXTRACTORS.items()])


def hashed_vectors(df: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """Texts as unit vectors of their words counted in hashed places: a row for each place that is not 0."""
    words = df.select(key, F.explode(F.split(F.lower(text), r"[^a-z]+")).alias("w")).where("w <> ''")
    place = F.conv(F.substring(F.sha2("w", 256), 1, 7), 16, 10).cast("long") % width
    # Equal words of a text are counted before they are hashed.
    counts = words.groupBy(key, "w").agg(F.count("*").alias("n")).groupBy(key, place.alias("place")).agg(F.sum("n").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "place", (F.col("n") / size).alias("value"))


def dense_head(df: DataFrame, ident: str, vector: str, hidden: int, labels: int, seed: int = 42) -> DataFrame:
    """Label and score by two dense layers, GELU between them and a sigmoid after them.

    The weights, which no file has, are drawn from a seed; they are small and go with the function.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, first, second = np.random.default_rng(seed), None, None
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy()).astype(float)
            if first is None:
                first, second = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), rng.normal(0, hidden**-0.5, (hidden, labels))
            h = x @ first
            h = 0.5 * h * (1 + np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3)))
            out = 1 / (1 + np.exp(-(h @ second)))
            best = out.argmax(1)
            yield pd.DataFrame({ident: b[ident], "label": best.astype("int32"), "score": out[np.arange(len(best)), best]})

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, F.col(vector).alias("v")).mapInPandas(run, f"{ident} {kind}, label int, score double")


def trained_head(df: DataFrame, vector: str, label: str, most_weight: float = 10.0, rounds: int = 20) -> DataFrame:
    """Fit a multinomial logistic model with class weights (rarer labels weigh more, ten at most) and
    return, for each label, its rows and how many of them the model gets right."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    weights = counts.crossJoin(F.broadcast(whole)).select(label, F.least(F.col("total") / (F.col("k") * F.col("n")), F.lit(most_weight)).alias("weight"))
    rows = df.join(weights, label).select(F.col(label).cast("double").alias("label"), "weight", array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = LogisticRegression(maxIter=rounds, regParam=0.01, weightCol="weight").fit(rows)
    return model.transform(rows).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("hits"))
