"""Toxicity classifier, regularised by counterfactuals of identity terms.

A logistic model over the presence of words and word beginnings. While it learns, every
sentence of a labelled text that names a group is also read with the name swapped for each other
one of its kind, and the squared difference of the two scores (before the logistic curve) is
penalised. A neutral mention of a group then says nothing about toxicity, even where labels make
it look otherwise. A group's name stands only for itself, so a swap changes two features at most,
and swaps are told by (term, other term, the other is in the sentence anyway) and their number:
as many rows as there are pairs of terms, whatever the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged

#: Bounds of what is fitted: labelled rows and chosen features.
TRAIN_ROWS, FEATURES = 12_000, 4096
#: Rows a feature must occur in, and the least chi-squared of a chosen one.
LEAST_ROWS, LEAST_CHI2 = 5, 12.0
#: Entries of a worker's cache of words.
CACHE_WORDS = 500_000

# Names of groups of people in four languages, by kind; terms of one kind are swapped.
IDENTITY_TERMS = {
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    "believers": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    "origin": ("african", "asian", "european", "american", "arab", "latino", "chinese", "mexican", "indian", "german", "french", "spanish"),
    "colour": ("black", "white", "brown"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    "gender": ("woman", "man", "transgender", "nonbinary"),
    "genders": ("women", "men"),
    "age": ("old", "young", "elderly", "teenage"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "movement": ("immigrant", "refugee", "citizen", "foreigner"),
    "movements": ("immigrants", "refugees", "citizens", "foreigners"),
    "croyants": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    "origine": ("africain", "asiatique", "européen", "américain", "arabe", "chinois", "mexicain", "allemand", "français", "espagnol"),
    "genre": ("femme", "homme", "transgenre"),
    "orientation_fr": ("lesbienne", "bisexuel", "hétérosexuel", "homosexuel"),
    "mouvement": ("immigré", "réfugié", "citoyen", "étranger"),
    "gläubige": ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    "herkunft": ("afrikaner", "asiate", "europäer", "amerikaner", "araber", "chinese", "mexikaner", "deutscher", "franzose", "spanier"),
    "geschlecht": ("frau", "mann", "transfrau"),
    "orientierung": ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    "bewegung": ("einwanderer", "flüchtling", "bürger", "ausländer"),
    "creyentes": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    "origen": ("africano", "asiático", "europeo", "americano", "árabe", "chino", "mexicano", "alemán", "francés", "español"),
    "género": ("mujer", "hombre", "transgénero"),
    "orientación": ("lesbiana", "bisexual", "heterosexual", "homosexual"),
    "movimiento": ("inmigrante", "refugiado", "ciudadano", "extranjero"),
}


def swaps_of(kinds: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """For each term all others of its kinds."""
    out: dict[str, dict[str, None]] = {}
    for terms in kinds.values():
        for t in terms:
            out.setdefault(t, {}).update(dict.fromkeys(x for x in terms if x != t))
    return {t: tuple(others) for t, others in out.items()}


_SWAPS = swaps_of(IDENTITY_TERMS)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings of 3 to 8 letters; a group's name stands only for itself."""
    if word in _SWAPS:
        return [word]
    return [word, *(word[:k] + "*" for k in range(3, min(len(word), 9)))]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from a text to its score; words are looked up once."""
        index = {f: k for k, f in enumerate(self.weights)}
        values = list(self.weights.values())
        known: dict[str, tuple[int, ...]] = {}

        def hits(word: str) -> tuple[int, ...]:
            if len(known) >= CACHE_WORDS:
                known.clear()
            known[word] = got = tuple(index[f] for f in word_features(word) if f in index)
            return got

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in words_of(text):
                got = known.get(w)
                if got is None:
                    got = hits(w)
                if got:
                    found.update(got)
            z = self.bias + sum(values[k] for k in found)
            return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

        return score


def _feature_counts(sample: DataFrame) -> DataFrame:
    """In how many rows, and how many toxic ones, each feature occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                found = {f for w in words_of(text) for f in word_features(w)}
                rows.update(found)
                if label:
                    toxic.update(found)
        names = list(rows)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": part, "n": [rows[f] for f in part], "pos": [toxic[f] for f in part]})

    per_task = sample.select("text", "label").mapInArrow(count, "feature string, n long, pos long")
    return per_task.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def swapped_terms(text: str | None) -> Counter:
    """(term, other, the other is in the sentence anyway) of each swap in the sentences of a text."""
    found: Counter = Counter()
    for m in _SENTENCE.finditer((text or "").lower()):
        words = set(_WORD.findall(m.group()))
        for term in words & _SWAPS.keys():
            for other in _SWAPS[term]:
                found[term, other, other in words] += 1
    return found


def _swap_counts(sample: DataFrame) -> list:
    """The swaps of all sentences and their number: at most two rows for each pair of terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                found.update(swapped_terms(text))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], names=["term", "other", "there", "n"])

    per_task = sample.select("text").mapInArrow(count, "term string, other string, there boolean, n long")
    return per_task.groupBy("term", "other", "there").agg(F.sum("n").alias("n")).collect()


def fit(labelled: DataFrame, features: int = FEATURES, swap_penalty: float = 1.0, l2: float = 1e-5, rounds: int = 600) -> ToxicityModel:
    """Learn from ``labelled`` (text, label 0 or 1), which the caller keeps bounded.

    Features are chosen by chi-squared over all given rows. Without rows of both labels
    there is nothing to learn: every text then scores the share of label 1 (0.5 without
    any row at all, so that nothing is predicted).
    """
    arrow_batches(labelled.sparkSession)
    sample = staged(labelled.where("label IS NOT NULL").select("text", F.col("label").cast("int").alias("label")), "labelled")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    if not 0 < pos < n:
        return ToxicityModel({}, 0.0 if not n else (-6.0 if not pos else 6.0))
    a, b, c, d = F.col("pos"), F.col("n") - F.col("pos"), F.lit(pos) - F.col("pos"), F.lit(n - pos) - F.col("n") + F.col("pos")
    # Null for a feature of every row, which tells nothing.
    chi2 = F.try_divide(F.lit(float(n)) * F.pow((a * d - b * c).cast("double"), 2), (a + b).cast("double") * (c + d) * (a + c) * (b + d))
    chosen = _feature_counts(sample).where(F.col("n") >= LEAST_ROWS).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    top = [r["feature"] for r in chosen.orderBy(F.desc("chi2"), "feature").limit(features).select("feature").collect()]
    names = list(dict.fromkeys([*_SWAPS, *top]))
    return _train(_design(sample, names).collect(), _swap_counts(sample), names, swap_penalty, l2, rounds)


def _design(sample: DataFrame, names: list[str]) -> DataFrame:
    """label and the features of a text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {f: k for k, f in enumerate(names)}
        for b in batches:
            own = [sorted({index[f] for w in words_of(text) for f in word_features(w) if f in index}) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": b.column("label"), "own": pa.array(own, pa.list_(pa.int32()))})

    return sample.select("text", "label").mapInArrow(encode, "label int, own array<int>")


@dataclass(frozen=True)
class Objective:
    """The loss over all rows and its gradient: weighted log loss, swaps and squared weights."""

    y: np.ndarray
    own: _Sparse
    weight: np.ndarray
    term: np.ndarray
    other: np.ndarray
    #: 0 where the swapped-in term is in the sentence anyway, so that only the swapped-out one changes the score.
    new: np.ndarray
    share: np.ndarray
    swap_penalty: float
    l2: float

    def gap(self, w: np.ndarray) -> np.ndarray:
        """By how much each swap changes the score, before the logistic curve."""
        return self.new * w[self.other] - w[self.term]

    def loss(self, w: np.ndarray, bias: float) -> float:
        z = self.own.dot(w) + bias
        fit = (self.weight * (np.logaddexp(0, z) - self.y * z)).sum()
        return float(fit + self.swap_penalty * (self.share * self.gap(w) ** 2).sum() + self.l2 * (w * w).sum() / 2)

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        error = self.weight * (1 / (1 + np.exp(-np.clip(self.own.dot(w) + bias, -40, 40))) - self.y)
        pull = 2 * self.swap_penalty * self.share * self.gap(w)
        n = len(w)
        swaps = np.bincount(self.other, pull * self.new, n) - np.bincount(self.term, pull, n)
        return self.own.transposed_dot(error) + swaps + self.l2 * w, float(error.sum())


def objective(rows: list, swaps: list, names: list[str], swap_penalty: float, l2: float) -> Objective:
    """Both labels weigh the same, whatever their shares; so do all swaps."""
    y = np.array([r["label"] for r in rows], float)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    index = {f: k for k, f in enumerate(names)}
    n = np.array([s["n"] for s in swaps], float)
    term, other = (np.array([index[s[c]] for s in swaps], int) for c in ("term", "other"))
    new = np.array([not s["there"] for s in swaps], float)
    return Objective(y, _Sparse([r["own"] for r in rows], len(names)), weight, term, other, new, n / n.sum() if len(n) else n, swap_penalty, l2)


def _train(rows: list, swaps: list, names: list[str], swap_penalty: float, l2: float, rounds: int) -> ToxicityModel:
    """Adam over all rows at once."""
    goal = objective(rows, swaps, names, swap_penalty, l2)
    w, bias = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        g = np.append(*goal.gradient(w, bias))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return ToxicityModel({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(bias))


class _Sparse:
    """Rows of ones, as lists of columns."""

    def __init__(self, rows: list[list[int]], width: int):
        self.cols = np.array([c for r in rows for c in r], int)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, int)
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def transposed_dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, x[self.rows], self.width)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """Add the score of every whole text, 0 to 1; other columns stay, one of that name is replaced.

    A null, empty or wordless text scores what the bias alone gives. Equal texts score alike.
    """
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = held.value.scorer()
        for texts in batches:
            yield texts.map(of)

    return docs.withColumn(to, scores(F.col(text)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, picked by a hash of the id.

    A document with several labels counts as toxic if one of them says so. Of rows that
    repeat an id the one whose text has the smallest hash is learned from.
    """
    picked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = met.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return one.select("first.text", "label")
