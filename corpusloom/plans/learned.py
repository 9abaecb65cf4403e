"""Queries whose results are learned from the tables: networks and vectors of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoder as V
from ..operators import training as N
from ..sources.scratch import kept, scratch
from .registry import query, table


def _by_batch(df):
    path = scratch(df.sparkSession, "batches")
    df.write.partitionBy("batch").parquet(path)
    return path


def _held_out(ident):
    return F.pmod(F.xxhash64(F.col(ident), F.lit("held out")), F.lit(5)) == 0


def _encoded(spark, sf):
    """Every document with its learned vector and its language."""
    d = table(spark, sf, "documents")
    vectors = V.encode(d.where(F.col("doc_id").isNotNull()), "doc_id", "text", V.learn(d, "text", kept))
    return kept(vectors.join(d.select("doc_id", "lang"), "doc_id"))


def _trained(rows):
    return N.train_network(rows.where(~_held_out("doc_id")), "doc_id", "vector", "lang", _by_batch, hidden=64, epochs=12, batches=3, rate=0.01)


@query()
def d12_network_trainer(spark, sf):
    """A network of two layers over learned vectors, trained on four fifths of the documents: of each language what it gets right of the rest."""
    rows = _encoded(spark, sf)
    trained = _trained(rows)
    names = F.array(*[F.lit(x) for x in trained.labels])
    held = rows.where(_held_out("doc_id") & F.col("lang").isNotNull())
    judged = N.predict(held, "doc_id", "vector", trained).join(held.select("doc_id", "lang"), "doc_id").withColumn("guess", F.get(names, F.col("place")))
    return N.label_scores(judged, "lang", "guess").withColumn("f1", F.bround("f1", 4))


@query()
def x53_trained_head(spark, sf):
    """The best label of every document by the trained network, with its score; null where a text has no vector."""
    rows = _encoded(spark, sf)
    trained = _trained(rows)
    names = F.array(*[F.lit(x) for x in trained.labels])
    return N.predict(rows, "doc_id", "vector", trained).select("doc_id", F.get(names, F.col("place")).alias("label"), "score")


@query()
def d08_learned_encoder(spark, sf):
    """Texts as unit vectors of learned word vectors; null where a text has no word of the vocabulary."""
    d = table(spark, sf, "documents")
    return V.encode(d, "doc_id", "text", V.learn(d, "text", kept))


_WORDS_SQL = r"w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH {_WORDS_SQL}, e AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM w), n AS (SELECT w, count(DISTINCT doc_id) AS n FROM e GROUP BY w), v AS (SELECT w FROM n ORDER BY n DESC, w LIMIT 300),
 t AS (SELECT * FROM e JOIN v USING (w)), h AS (SELECT x.w AS a, y.w AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.k - x.k BETWEEN 1 AND 4), p AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM h UNION ALL SELECT b, a FROM h) GROUP BY ALL),
 s AS (SELECT a, sum(n) AS s FROM p GROUP BY a), f AS (SELECT p.a, p.b, ln(n::double * (SELECT sum(n) FROM p) / (x.s::double * y.s)) AS v FROM p JOIN s x ON x.a = p.a JOIN s y ON y.a = p.b)
 SELECT a AS word, b AS other, round_even(v, 6)::double AS information FROM f WHERE v > 0""")
def d08_word_information(spark, sf):
    """Positive mutual information of the 300 most frequent words that stand four words apart or less."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    words = [w for w, _ in V.vocabulary(d, "text", 300)]
    rows = V.information(kept(V.pair_counts(d, "text", words, 4))).select("a", F.explode(F.arrays_zip("bs", "vs")).alias("x"))
    named = F.array(*map(F.lit, words))
    return rows.select(F.get(named, F.col("a")).alias("word"), F.get(named, F.col("x.bs")).alias("other"), F.bround("x.vs", 6).alias("information"))
