"""What the operators on vectors share: exact integers, blocks of rows, binary columns, sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers are held within this, so that a squared distance of 64 components fits a long.
MOST = 1 << 27

#: Rows that are worked on at once, however Spark cuts its batches.
BLOCK_ROWS = 4096

#: More than any rounding of a few operations on doubles, relative to their result.
SLACK = 2.0**-48


def is_vector(vector: Column) -> Column:
    """True where there is a vector and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def as_integers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, as array<int>; beyond ``MOST`` on either side it is ``MOST``."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """The batches of a task as tables of ``rows`` rows; the last may be shorter."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            waiting.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(waiting)
                waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of ``width`` integers, as rows of longs."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def unpacked(column: pa.ChunkedArray, dtype: str, *shape: int) -> np.ndarray:
    """A binary column that :func:`packed` made, as an array that may be written to."""
    return np.frombuffer(bytearray(b"".join(column.to_pylist())), dtype).reshape(-1, *shape)


def packed(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of an array, as a binary column."""
    raw = np.ascontiguousarray(rows)
    width = raw[0].nbytes if len(raw) else 0
    ends = np.arange(len(raw) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of longs to rows of longs, pair by pair."""
    away = x - y
    return np.einsum("...d,...d->...", away, away)


def rounded_up(squared: np.ndarray) -> np.ndarray:
    """Doubles that are not below the roots of exact squares."""
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def rounded_down(squared: np.ndarray) -> np.ndarray:
    """Doubles that are not above the roots of exact squares."""
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


class SlotSums:
    """Exact sums and counts by slot: what one task has of the sums of a round."""

    def __init__(self, slots: int, width: int):
        self.sums, self.counts = np.zeros((slots, width), np.int64), np.zeros(slots, np.int64)

    def add(self, slot: np.ndarray, x: np.ndarray) -> None:
        np.add.at(self.sums, slot, x)
        self.counts += np.bincount(slot, minlength=len(self.counts))

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.counts)
        ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * np.int32(self.sums.shape[1]))
        sums = pa.ListArray.from_arrays(ends, pa.array(self.sums[used].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(self.counts[used]), sums], ["slot", "n", "sums"])


SLOT_SCHEMA = "slot int, n long, sums array<long>"


def next_entries(partial: DataFrame, now: np.ndarray) -> np.ndarray:
    """Each slot's componentwise floor(sum/count) over all tasks; a slot without rows stays as it is.

    ``partial`` has a row for each task and used slot, which Spark adds up; one row for each
    slot, as many as there are entries, comes to the driver.
    """
    summed = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(now.shape[1])]).alias("sums"))
    moved = now.copy()
    for slot, n, sums in summed.collect():
        moved[slot] = [s // n for s in sums]
    return moved
