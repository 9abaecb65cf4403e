"""A corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard, language, packing, quality
from corpusloom.llm.common import staged, table
from corpusloom.llm.tokens import tokenizer_path

#: A language score below this is a rejection.
LEAST_LANGUAGE_SCORE = 0.4


#: Where the text is in what :func:`_whole_rows` gives.
TEXT = "_row.text"


def _whole_rows(docs: DataFrame) -> DataFrame:
    """All columns as one, so that what an operator adds takes no column's place."""
    return docs.select(F.struct(*docs.columns).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go; null and empty texts are among them."""
    return quality.quality_verdicts(_whole_rows(docs), text=TEXT).where("kept").select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter in them, or no language clearly ahead.

    Learned from the languages that the documents name; where none does, all stay.
    """
    model = language.fit(language.training_rows(docs, F.lit(True)))
    if not model.languages:
        return docs
    named = language.identify(_whole_rows(docs), model, TEXT)
    return named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays.

    Texts are judged, not ids: of rows that have a doc_id in common each text stays that is not near
    another one. Rows that repeat doc_id and text are one document. Rows without doc_id stay.
    """
    found = staged(jaccard.duplicate_classes(docs, by_id=False).where("doc_id IS NOT NULL"), "classes")
    gone = found.where("doc_id <> best.doc_id OR same IS DISTINCT FROM best.same").select("doc_id", "same").distinct()
    gone = staged(gone, "near-copies").withColumnRenamed("doc_id", "_id")
    again = staged(found.groupBy("doc_id", "same").count().where("count > 1").select(F.col("doc_id").alias("_id"), "same"), "repeated")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_same"))
    is_it = (F.col("_row.doc_id") == F.col("_id")) & (F.col("_same") == F.col("same"))
    kept = packed.join(gone, is_it, "left_anti")
    if not again.isEmpty():
        once = kept.join(again, is_it, "left_semi").withColumn("_id", F.col("_row.doc_id")).dropDuplicates(["_id", "_same"])
        kept = kept.join(again, is_it, "left_anti").unionByName(once.drop("_id"))
    return kept.select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase of the benchmark go. Null and empty texts hold none; all columns stay."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("same"))
    found = decontaminate.find_contamination(keyed, table(spark, sf_dir, "benchmark"), keys=("doc_id", "same"))
    hit = staged(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("_id"), "same").distinct(), "contaminated")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_same"))
    is_it = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_same").eqNullSafe(F.col("same"))
    return packed.join(hit, is_it, "left_anti").select("_row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as token ids in sequences of at most 2048. A null text is an empty
    one, which is its end id alone; columns but doc_id and text end here."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the tokenizer nor the learned languages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
