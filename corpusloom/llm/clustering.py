"""Lloyd's clustering of whole vectors: float32 products screen, exact integers decide.

The score of a centroid c for a vector x is |c|^2 - 2xc, the squared distance less what all
centroids share. The products are one float32 matrix product. Whatever the order of its sums, its
error is at most g|x||c| with g = k/(2^24 - k), k two more than the number of components (the
rounding of both factors counts), so every score lies in an interval. A centroid whose interval begins above
the least end of the others' is out; where several are left, exact integers choose, the
lowest number of those as near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import SLACK, SLOT_SCHEMA, SlotSums, as_integers, blocks, is_vector, matrix, next_entries, squares


class Centroids:
    """Centroids and what screening needs of them."""

    def __init__(self, exact: np.ndarray):
        self.exact = exact
        self.single = exact.astype(np.float32)
        self.squared = np.einsum("kd,kd->k", exact, exact).astype(np.float64)
        k = exact.shape[1] + 2
        #: Twice the bound on the error of a product, for a vector of length one.
        self.error = 2 * k / (2.0**24 - k) * np.sqrt(self.squared) * (1 + SLACK)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """True for each row and each centroid that may be its nearest."""
        length = np.sqrt(np.einsum("nd,nd->n", x, x).astype(np.float64))[:, None] * (1 + SLACK)
        product = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        score = self.squared - 2 * product
        # The last term is for the doubles of these lines.
        error = length * self.error + SLACK * (self.squared + 2 * np.abs(product))
        return score - error <= (score + error).min(1)[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row, the smallest of those as near."""
        may = self.shortlist(x)
        cluster = may.argmax(1)
        several = np.flatnonzero(may.sum(1) > 1)
        row, number = np.nonzero(may[several])
        far = squares(x[several[row]], self.exact[number])
        best = np.full(len(several), np.iinfo(np.int64).max)
        np.minimum.at(best, row, far)
        ties = far == best[row]
        won = np.full(len(several), len(self.exact))
        np.minimum.at(won, row[ties], number[ties])
        cluster[several] = won
        return cluster


def _sums(exact: np.ndarray):
    """A map over a task: the sums and counts of the rows of every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = Centroids(exact), SlotSums(*exact.shape)
        for block in blocks(batches):
            x = matrix(block["ints"], exact.shape[1])
            total.add(now.nearest(x), x)
        yield total.batch()

    return run


def _assigned(exact: np.ndarray):
    """A map over blocks: each row's cluster and exact squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(exact)
        for block in blocks(batches):
            x = matrix(block["ints"], exact.shape[1])
            cluster = now.nearest(x)
            out = {"vec_id": block["vec_id"], "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(squares(x, exact[cluster]))}
            yield from pa.table(out).to_batches()

    return run


@dataclass
class Clusters:
    """``rows`` has vec_id, cluster and distance (squared); ``centroids`` the final ones."""

    rows: DataFrame
    centroids: np.ndarray

    def digests(self) -> list[str]:
        """Lowercase sha256 of each centroid's decimal components, joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def cluster_vectors(vectors: DataFrame, order: Column, k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Clusters of all vectors of ``dims`` finite components; other rows are dropped.

    Centroids start as the ``k`` vectors that come first in ``order``, an expression on vec_id
    (nulls last, equal ones in the order of their vectors); fewer vectors make fewer clusters, none
    no rows. Components beyond 2**27 after scaling count as 2**27. Repeated rows count each time,
    a null id is one like any other, other columns are not looked at. A round reads the integers
    once and sends the driver one row for each centroid.
    """
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    fit = named.where(is_vector(F.col("v")) & (F.size("v") == dims))
    kept = staged(fit.select("vec_id", as_integers(F.col("v"), scale).alias("ints")), "vectors")
    first = kept.orderBy(order.asc_nulls_last(), "ints").select("ints").limit(k).collect()
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    centroids = np.array([r.ints for r in first], np.int64).reshape(-1, dims)
    if not first:
        return Clusters(kept.sparkSession.createDataFrame([], schema), centroids)
    for _ in range(rounds):
        centroids = next_entries(kept.select("ints").mapInArrow(_sums(centroids), SLOT_SCHEMA), centroids)
    return Clusters(staged(kept.mapInArrow(_assigned(centroids), schema), "clusters"), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """The rows with cluster_inertia and inertia (distance summed over the cluster and over all, null
    beyond a long) and centroid_sha256. What is broadcast has one row for each centroid."""
    by_cluster = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    known = {r.cluster: int(r.d) for r in by_cluster.collect()}
    fits = lambda n: n if n < 1 << 63 else None
    total = sum(known.values())
    rows = [(c, fits(known[c]), fits(total), digest) for c, digest in enumerate(found.digests()) if c in known]
    of_cluster = found.rows.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
