"""Vectors of words and texts that are learned from a corpus: co-occurrence, then a randomised SVD.

Words that stand near each other are counted in Spark, as are the sums that turn counts into
positive mutual information. The matrix of these, words by words, stays a Spark table of rows; it
meets blocks of a few columns, one product a pass. Only the vocabulary, whose size is a parameter, and those blocks go
through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs that a task counts before it passes them on.
PAIRS_MOST = 2_000_000


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


@dataclass
class WordVectors:
    """The words, by rank, each one's vector and its weight in a text."""

    words: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    values: np.ndarray


def vocabulary(docs: DataFrame, text: str, most: int) -> list[tuple[str, int]]:
    """The words that most texts have, and how many do; of equal ones the first by spelling."""
    each = docs.select(F.explode(F.array_distinct(words_of(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [(r.w, r.n) for r in each.orderBy(F.desc("n"), "w").limit(most).collect()]


def pair_counts(docs: DataFrame, text: str, words: list[str], window: int) -> DataFrame:
    """(a, b, n): how often words of the vocabulary stand ``window`` words apart or less, either way round."""
    place, size = {w: k for k, w in enumerate(words)}, len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def passed_on() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs // size, pa.int32()), pa.array(pairs % size, pa.int32()), pa.array(counts)], ["a", "b", "n"])

        for b in batches:
            for row in b["words"].to_pylist():
                at = np.array([place.get(w, -1) for w in row or []], np.int64)
                for d in range(1, window + 1):
                    x, y = at[:-d], at[d:]
                    both = (x >= 0) & (y >= 0)
                    held += [x[both] * size + y[both], y[both] * size + x[both]]
                    n += 2 * int(both.sum())
                if n >= PAIRS_MOST:
                    yield passed_on()
                    held, n = [], 0
        if n:
            yield passed_on()

    found = docs.select(words_of(text).alias("words")).mapInArrow(run, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def information(pairs: DataFrame) -> DataFrame:
    """Rows (a, bs, values) of the matrix of positive mutual information; it is symmetric, as counts are."""
    sums = pairs.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    joined = pairs.join(F.broadcast(sums.select(F.col("k").alias("a"), F.col("s").alias("sa"))), "a").join(F.broadcast(sums.select(F.col("k").alias("b"), F.col("s").alias("sb"))), "b").crossJoin(F.broadcast(total))
    value = F.log(F.col("n").cast("double") * F.col("t") / (F.col("sa").cast("double") * F.col("sb")))
    kept = joined.select("a", "b", value.alias("v")).where("v > 0")
    return kept.groupBy("a").agg(F.collect_list(F.struct("b", "v")).alias("row")).select("a", F.col("row.b").alias("bs"), F.col("row.v").alias("vs"))


def product(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix times a block of a few columns: each task multiplies its rows, the driver gets the result's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(v) @ block[np.asarray(at, np.int64)] for at, v in zip(b["bs"].to_pylist(), b["vs"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], pa.array([r.tobytes() for r in rows], pa.binary())], ["a", "row"])

    out = np.zeros_like(block)
    for r in matrix.mapInArrow(run, "a int, row binary").collect():
        out[r.a] = np.frombuffer(r.row)
    return out


def truncated_svd(matrix: DataFrame, size: int, rank: int, extra: int = 10, rounds: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The first ``rank`` left vectors and values of a symmetric matrix of ``size`` rows.

    A random block meets the matrix a few times, with its columns made orthogonal in between; the
    small matrix that is left of it is decomposed in the driver.
    """
    width = min(size, rank + extra)
    block = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(rounds + 1):
        block = np.linalg.qr(product(matrix, block))[0]
    small = product(matrix, block)
    left, values, _ = np.linalg.svd(small, full_matrices=False)
    rank = min(rank, width)
    # One sign of a vector is as good as the other; the largest component is positive.
    left = left[:, :rank] * np.sign(left[np.abs(left[:, :rank]).argmax(0), np.arange(rank)])
    return left, values[:rank]


def learn(docs: DataFrame, text: str, keep: Callable[[DataFrame], DataFrame], most_words: int = 2000, window: int = 4, rank: int = 48) -> WordVectors:
    """Vectors of the ``most_words`` words that most texts have. Rarer words have none; null texts have no part."""
    known = vocabulary(docs, text, most_words)
    words = [w for w, _ in known]
    if not words:
        return WordVectors([], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    matrix = keep(information(keep(pair_counts(docs, text, words, window))))
    left, values = truncated_svd(matrix, len(words), rank)
    n = docs.where(F.col(text).isNotNull()).count()
    weights = np.log((1 + n) / (1 + np.array([k for _, k in known])))
    return WordVectors(words, left * np.sqrt(values), weights, values)


def encode(docs: DataFrame, ident: str, text: str, known: WordVectors) -> DataFrame:
    """ident and vector of every text: its words' vectors, rare words first, of length one; null where no
    word has a vector."""
    place = {w: k for k, w in enumerate(known.words)}
    weighted = known.vectors * known.weights[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b["words"].to_pylist():
                at = [place[w] for w in row or [] if w in place]
                v = weighted[at].sum(0) if at else np.zeros(1)
                length = float(np.sqrt(v @ v))
                out.append((v / length).tolist() if length > 0 else None)
            yield pa.RecordBatch.from_arrays([b["ident"], pa.array(out, pa.list_(pa.float64()))], ["ident", "vector"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident).alias("ident"), words_of(text).alias("words")).mapInArrow(run, f"ident {kind}, vector array<double>").withColumnRenamed("ident", ident)
