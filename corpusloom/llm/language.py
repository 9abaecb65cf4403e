"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered by Spark; the matrix of log-probabilities (languages x buckets) is
broadcast; texts are scored in numpy from the sparse counts of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged

#: Buckets of the hashed n-grams, orders, and the bound of the rows that are learned from.
BUCKETS, ORDERS, TRAIN_ROWS = 1 << 16, (1, 2, 3), 20_000
#: Most languages a model can have: its matrix (a row of BUCKETS numbers each) is broadcast.
MOST_LANGUAGES = 256
UNKNOWN = "und"
#: n-grams of evidence after which more text no longer sharpens the score.
EVIDENCE = 40


def _letter_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def _buckets_by_order(text: str | None, buckets: int, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of a whole text, order by order; nothing where it has no letter.

    Letters are lower-cased; what lies between words counts as one space.
    """
    if not _table:
        _table.append(_letter_table())
    chars = _table[0][np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = chars == 32
    if space.all():
        return
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] |= True
    chars = np.concatenate([[32], chars[keep], [32]]).astype(np.uint64)
    for n in orders:
        h = np.full(max(0, len(chars) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield (h % np.uint64(buckets)).astype(np.int64)


def ngram_buckets(text: str | None, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The buckets of all n-grams of a whole text, with repeats."""
    return np.concatenate([np.zeros(0, np.int64), *_buckets_by_order(text, buckets, orders)])


def ngram_counts(text: str | None, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that n-grams of a whole text fall into, and how many; of a long text no more than
    one order is held at a time."""
    if len(text or "") * len(orders) <= buckets:
        return np.unique(ngram_buckets(text, buckets, orders), return_counts=True)
    total = np.zeros(buckets, np.int64)
    for found in _buckets_by_order(text, buckets, orders):
        total += np.bincount(found, minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class RareLanguages:
    """Languages beyond those of the matrix, by the buckets that their texts have: those of bucket b are
    ``places[starts[b]:starts[b + 1]]``, with what ``gains`` adds to a language's ``base``, the log-probability of
    all other buckets."""

    starts: np.ndarray
    places: np.ndarray
    gains: np.ndarray
    base: np.ndarray

    def like(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        each = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.base * n.sum() + np.bincount(self.places[each], self.gains[each] * np.repeat(n, size), len(self.base))


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob[k, b]``: of bucket b in language k; ``log_prior[k]``. The matrix has the languages that most
    rows name, ``MOST_LANGUAGES`` at most; the others follow them in ``languages`` and are in ``rare``. Of equally
    likely ones the first by name is given."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...]
    rare: RareLanguages | None = None

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language and a score: the posterior on bounded evidence."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        rows, counts = [], []
        for k, text in enumerate(texts):
            at, n = ngram_counts(text, self.log_prob.shape[1], self.orders)
            if len(at):
                rows.append(k)
                counts.append((at, n))
        if not rows or not self.languages:
            return out
        starts = np.cumsum([0] + [len(b) for b, _ in counts[:-1]])
        bucket, n = np.concatenate([b for b, _ in counts]), np.concatenate([c for _, c in counts])
        like = np.add.reduceat(self.log_prob[:, bucket] * n, starts, axis=1).T
        if self.rare:
            like = np.concatenate([like, np.stack([self.rare.like(at, k) for at, k in counts])], 1)
        total = np.add.reduceat(n, starts)[:, None]
        if self.rare:
            by_name = np.argsort(np.array(self.languages))
            best = by_name[(like + self.log_prior)[:, by_name].argmax(1)]
        else:
            best = (like + self.log_prior).argmax(1)
        z = self.log_prior + like / total * np.minimum(total, EVIDENCE)
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        for k, b, p in zip(rows, best, z, strict=True):
            out[k] = (self.languages[b], float(p[b]))
        return out


def fit(labelled: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> LanguageModel:
    """Learn from ``labelled`` (text, lang), which the caller keeps bounded.

    Rows without text, letters or language teach nothing. Without any such row the model
    knows no language and answers ``und``. There may be any number of languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                at, n = ngram_counts(text, buckets, orders)
                if len(at):
                    sums.setdefault(lang, np.zeros(buckets, np.int64))
                    sums[lang][at] += n
                    docs[lang] = docs.get(lang, 0) + 1
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(s[at], docs[lang]), pa.int64())})

    arrow_batches(labelled.sparkSession)
    per_task = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    summed = staged(per_task.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    got = summed.toPandas()
    named = got[got["bucket"] == -1].sort_values(["n", "lang"], ascending=[False, True])["lang"].tolist()
    dense, rare = sorted(named[:MOST_LANGUAGES]), sorted(named[MOST_LANGUAGES:])
    languages = (*dense, *rare)
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((0, buckets)), orders)
    row = {lang: k for k, lang in enumerate(languages)}
    place, bucket, n = got["lang"].map(row).to_numpy(int), got["bucket"].to_numpy(int), got["n"].to_numpy(float)
    docs = np.zeros(len(languages))
    docs[place[bucket < 0]] = n[bucket < 0]
    sums = np.zeros((len(dense), buckets))
    often = (bucket >= 0) & (place < len(dense))
    sums[place[often], bucket[often]] = n[often]
    prob = np.log((sums + 0.5) / (sums + 0.5).sum(1, keepdims=True))
    return LanguageModel(languages, np.log(docs / docs.sum()), prob, orders, _rare(place, bucket, n, len(dense), len(rare), buckets) if rare else None)


def _rare(place: np.ndarray, bucket: np.ndarray, n: np.ndarray, first: int, size: int, buckets: int) -> RareLanguages:
    """The languages from ``first`` on; as the matrix has it, each bucket counts half an n-gram more."""
    own = (bucket >= 0) & (place >= first)
    place, bucket, n = place[own] - first, bucket[own], n[own]
    order = np.lexsort([place, bucket])
    place, bucket, n = place[order], bucket[order], n[order]
    base = np.log(0.5 / (np.bincount(place, n, size) + 0.5 * buckets))
    return RareLanguages(np.searchsorted(bucket, np.arange(buckets + 1)), place, np.log((n + 0.5) / 0.5), base)


def training_rows(docs: DataFrame, allowed, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, lang) of about ``rows`` of the ``allowed`` rows, drawn one by one, whatever their ids.

    Texts are read of the drawn rows only.
    """
    named = docs.where(allowed & F.col("lang").isNotNull())
    n = named.count()
    drawn = named if n <= rows else named.sample(fraction=rows / n, seed=42)
    return drawn.where("text IS NOT NULL").select("text", "lang")


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred and score of every whole text; other columns stay.

    A text that is null, empty or without a letter is ``und`` with score 0. Columns of these names are
    replaced.
    """
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(held.value.predict(texts.tolist()), columns=["lang", "score"])

    # The rows' own columns go along as one, so none of them clashes with that of the work.
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    got = docs.select(F.struct(*own).alias("row"), judge(F.col(text)).alias("judged"))
    return got.select("row.*", F.col("judged.lang").alias("lang_pred"), "judged.score")
