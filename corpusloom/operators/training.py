"""A dense network of two layers, trained by synchronous mini-batches over a Spark table.

Rows are dealt to batches by a seeded hash, a folder each, so a step reads its batch only. A
step's tasks give partial gradients; a few further tasks add them up, and the driver, which gets
those few sums, takes an AdamW step. The network goes to the tasks with each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial gradients are added up by so many tasks, whose sums the driver gets.
SUMMING_TASKS = 8

#: The error function is tabled at steps of 1 / TABLE_STEPS up to ERF_END, beyond which it is 1.
TABLE_STEPS, ERF_END = 128, 6
_ERF_AT = np.arange(ERF_END * TABLE_STEPS + 1) / TABLE_STEPS
_ERF = np.array([erf(x) for x in _ERF_AT])
_ERF_SLOPE = 2 / np.sqrt(np.pi) * np.exp(-_ERF_AT * _ERF_AT)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, within 1e-15: Taylor's series of six terms around the nearest tabled place."""
    size = np.fmin(np.abs(x), ERF_END)
    k = np.rint(size * TABLE_STEPS).astype(np.int64)
    a = _ERF_AT[k]
    h, b = size - a, a * a
    # The derivatives over that of the first order, by factorials: Hermite's polynomials.
    terms = 1 + h * (-a + h * ((2 * b - 1) / 3 + h * (a * (3 - 2 * b) / 6 + h * ((4 * b * b - 12 * b + 3) / 30 + h * (-a * (4 * b * b - 20 * b + 15) / 90)))))
    return np.copysign(_ERF[k] + _ERF_SLOPE[k] * h * terms, x)


def gelu(z: np.ndarray) -> np.ndarray:
    return 0.5 * z * (1 + _erf(z / np.sqrt(2)))


def gelu_slope(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(z / np.sqrt(2))) + z * np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)


@dataclass
class Network:
    """Weights of two layers: hidden by width, labels by hidden, and their biases."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    @classmethod
    def seeded(cls, width: int, hidden: int, labels: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        layer = lambda n, m: (r.uniform(-1, 1, (n, m)) / np.sqrt(m), r.uniform(-1, 1, n) / np.sqrt(m))
        return cls(*layer(hidden, width), *layer(labels, hidden))

    def parts(self) -> list[np.ndarray]:
        return [self.first, self.first_bias, self.second, self.second_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def moved_to(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([p.size for p in self.parts()])[:-1]
        return Network(*[x.reshape(p.shape) for x, p in zip(np.split(flat, ends), self.parts(), strict=True)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return gelu(x @ self.first.T + self.first_bias) @ self.second.T + self.second_bias

    def gradient(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Sums over rows: of weights, of weighted cross-entropy and of its gradient."""
        z = x @ self.first.T + self.first_bias
        half = 0.5 * (1 + _erf(z / np.sqrt(2)))
        h = z * half
        out = h @ self.second.T + self.second_bias
        out -= out.max(1, keepdims=True)
        log = out - np.log(np.exp(out).sum(1, keepdims=True))
        n = np.arange(len(x))
        back = np.exp(log)
        back[n, label] -= 1
        back *= weight[:, None]
        inner = (back @ self.second) * (half + z * np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi))
        own = [inner.T @ x, inner.sum(0), back.T @ h, back.sum(0)]
        return float(weight.sum()), float(-(weight * log[n, label]).sum()), np.concatenate([g.ravel() for g in own])


@dataclass
class AdamW:
    """Adam with weight decay apart from the gradient."""

    rate: float = 1e-3
    decay: float = 1e-4
    betas: tuple[float, float] = (0.9, 0.999)
    step_: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step_ += 1
        a, b = self.betas
        self.mean = a * self.mean + (1 - a) * gradient
        self.square = b * self.square + (1 - b) * gradient * gradient
        mean, square = self.mean / (1 - a**self.step_), self.square / (1 - b**self.step_)
        return weights * (1 - self.rate * self.decay) - self.rate * mean / (np.sqrt(square) + 1e-8)


@dataclass
class Trained:
    network: Network
    labels: list
    losses: list[float] = field(default_factory=list)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch[name].flatten()
    if values.null_count:
        raise ValueError(f"a vector of {name} has a null component")
    return values.to_numpy().astype(np.float64, copy=False).reshape(batch.num_rows, -1)


def _partial(network: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, loss, total = 0.0, 0.0, None
        for b in batches:
            if b.num_rows:
                w, own, g = network.gradient(_matrix(b, "x"), b["place"].to_numpy().astype(np.int64), b["weight"].to_numpy())
                weight, loss, total = weight + w, loss + own, g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([loss]), pa.array([total.tobytes()])], ["weight", "loss", "gradient"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, loss, total = 0.0, 0.0, None
    for b in batches:
        for w, own, g in zip(b["weight"].to_pylist(), b["loss"].to_pylist(), b["gradient"].to_pylist(), strict=True):
            g = np.frombuffer(g)
            weight, loss, total = weight + w, loss + own, g if total is None else total + g
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([loss]), pa.array([total.tobytes()])], ["weight", "loss", "gradient"])


_SUMS = "weight double, loss double, gradient binary"


def summed_gradient(rows: DataFrame, network: Network) -> tuple[float, float, np.ndarray]:
    """The gradient of a batch (x, place, weight): partial sums by task, then by SUMMING_TASKS tasks."""
    partial = rows.select("x", "place", "weight").mapInArrow(_partial(network), _SUMS)
    few = partial.repartition(SUMMING_TASKS).mapInArrow(_added, _SUMS).collect()
    size = network.flat().size
    return sum(r.weight for r in few), sum(r.loss for r in few), sum((np.frombuffer(r.gradient) for r in few), np.zeros(size))


def class_weights(rows: DataFrame, label: str, most: float = 10.0, most_labels: int = 10_000) -> list[tuple]:
    """(label, weight) in the labels' order: rows over labels times the label's rows, ``most`` at most."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    total = sum(r.n for r in counts)
    return [(r[0], min(total / (len(counts) * r.n), most)) for r in counts]


def train_network(rows: DataFrame, ident: str, vector: str, label: str, keep: Callable[[DataFrame], str], hidden: int = 256, epochs: int = 20, batches: int = 4, seed: int = 42, rate: float = 1e-3, decay: float = 1e-4) -> Trained:
    """Train on rows with a vector and a label; ``keep`` writes a table in folders by column ``batch`` and
    gives its path.

    The order of the batches is drawn anew for each epoch. A label's rows weigh as :func:`class_weights`
    says. Rows with a null vector or label have no part.
    """
    whole = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    weights = class_weights(whole, label)
    if not weights:
        raise ValueError("no labelled rows")
    spark = rows.sparkSession
    named = spark.createDataFrame([(value, k, w) for k, (value, w) in enumerate(weights)], f"`_label` {rows.schema[label].dataType.simpleString()}, place int, weight double")
    dealt = whole.join(F.broadcast(named), F.col(label) == F.col("_label")).select(F.pmod(F.xxhash64(F.col(ident), F.lit(seed)), F.lit(batches)).cast("int").alias("batch"), F.col(vector).cast("array<double>").alias("x"), "place", "weight")
    path = keep(dealt)
    width = len(whole.select(vector).first()[0])
    trained = Trained(Network.seeded(width, hidden, len(weights), seed), [value for value, _ in weights])
    steps, order = AdamW(rate, decay), np.random.default_rng(seed)
    stored = spark.read.schema("x array<double>, place int, weight double, batch int").parquet(path)
    for _ in range(epochs):
        losses = []
        for batch in order.permutation(batches):
            weight, loss, gradient = summed_gradient(stored.where(F.col("batch") == int(batch)), trained.network)
            if weight:
                trained.network = trained.network.moved_to(steps.step(trained.network.flat(), gradient / weight))
                losses.append(loss / weight)
        trained.losses.append(float(np.mean(losses)))
    return trained


def predict(rows: DataFrame, ident: str, vector: str, trained: Trained) -> DataFrame:
    """ident, place (of the best label, the first of equal ones) and score, the sigmoid of its output; null vectors have null results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = trained.network.logits(_matrix(b, "x"))
                best = out.argmax(1)
                score = 1 / (1 + np.exp(-out[np.arange(len(best)), best]))
                yield pa.RecordBatch.from_arrays([b["ident"], pa.array(best, pa.int32()), pa.array(score)], ["ident", "place", "score"])

    kind = rows.schema[ident].dataType.simpleString()
    given = rows.select(F.col(ident).alias("ident"), F.col(vector).cast("array<double>").alias("x"))
    found = given.where("x IS NOT NULL").mapInArrow(run, f"ident {kind}, place int, score double")
    none = given.where("x IS NULL").select("ident", F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(none).withColumnRenamed("ident", ident)


def label_scores(judged: DataFrame, truth: str, guess: str) -> DataFrame:
    """Of each label its rows, hits, guesses and F1."""
    true = judged.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("hits"))
    said = judged.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("guesses"))
    f1 = 2 * F.col("hits") / (F.col("n") + F.coalesce("guesses", F.lit(0)))
    return true.join(said, "label", "left").select("label", "n", "hits", F.coalesce("guesses", F.lit(0)).alias("guesses"), f1.alias("f1"))
