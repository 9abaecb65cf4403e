"""Codes of a few bytes for vectors: Lloyd's rounds for each part, pruned by Elkan's bounds.

Vectors are cut into equal parts, and each part position has a codebook. A row carries, from
one round to the next, an upper bound on the distance of each of its parts to the entry it has,
and one lower bound for every entry of that codebook. When entries move, bounds are shifted by
how far. An entry is left out only if a bound proves it strictly farther than the one at hand;
all others are held against it by exact integers, so ties go to the lower index as in a plain
search. Bounds are rounded to the safe side: upper ones up to 32-bit floats, lower ones down to one of
256 steps up to the largest of their part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, left_join_hot, staged, staged_at
from .vectors import SLACK, SLOT_SCHEMA, SlotSums, as_integers, blocks, is_vector, matrix, next_entries, packed, rounded_down, rounded_up, squares, unpacked

#: Steps of a lower bound.
STEPS = 255


def steps_down(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and, for each row, the size of a step (a 32-bit float), whose products are not above ``lower`` >= 0."""
    step = (lower.max(1, initial=0) / STEPS).astype(np.float32)
    wide = np.where(step > 0, step, 1).astype(np.float64)[:, None]
    count = np.minimum(np.floor(lower / wide), STEPS)
    count -= count * wide > lower
    return count.astype(np.uint8), step


def single_up(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are not below ``x``."""
    near = x.astype(np.float32)
    return np.where(near < x, np.nextafter(near, np.float32(np.inf)), near)


@dataclass
class Part:
    """What a block of rows knows of one part position."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    #: How many exact distances it took to get here.
    exact: int


def assign_all(x: np.ndarray, entries: np.ndarray) -> Part:
    """Nearest entries with no bounds to start from: every distance is worked out."""
    far = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        away = x[:, d, None] - entries[None, :, d]
        far += away * away
    entry = far.argmin(1)
    return Part(entry, rounded_up(far[np.arange(len(x)), entry]), rounded_down(far), far.size)


def assign_again(x: np.ndarray, entries: np.ndarray, before: np.ndarray, part: Part) -> Part:
    """Nearest entries after they moved from ``before``, from the bounds that held then."""
    moved = rounded_up(squares(entries, before))
    entry, n = part.entry.astype(np.int64), np.arange(len(x))
    upper = (part.upper + moved[entry]) * (1 + SLACK)
    lower = np.maximum(part.lower - moved, 0) * (1 - SLACK)
    between = rounded_down(squares(entries[:, None], entries[None])) / 2
    # Strictly: what may be as near stays.
    may = (lower <= upper[:, None]) & (between[entry] <= upper[:, None])
    may[n, entry] = False
    open_rows = np.flatnonzero(may.any(1))
    own = squares(x[open_rows], entries[entry[open_rows]])
    upper[open_rows] = rounded_up(own)
    lower[open_rows, entry[open_rows]] = rounded_down(own)
    may[open_rows] &= (lower[open_rows] <= upper[open_rows, None]) & (between[entry[open_rows]] <= upper[open_rows, None])
    row, other = np.nonzero(may)
    far = squares(x[row], entries[other])
    lower[row, other] = rounded_down(far)
    best = np.zeros(len(x), np.int64)
    best[open_rows] = own
    np.minimum.at(best, row, far)
    # Of all that are as near as the best, the lowest index.
    won = np.full(len(x), len(entries))
    won[open_rows] = np.where(own == best[open_rows], entry[open_rows], len(entries))
    ties = far == best[row]
    np.minimum.at(won, row[ties], other[ties])
    entry[open_rows] = won[open_rows]
    upper[open_rows] = rounded_up(best[open_rows])
    return Part(entry, upper, lower, len(open_rows) + len(row))


def _state(books: np.ndarray, before: np.ndarray | None, last: bool = False):
    """A map over blocks: the entries of all parts under ``books``, with their bounds or, the last time, their error."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            x = matrix(block["ints"], parts * width).reshape(-1, parts, width)
            if before is not None:
                entry, upper = unpacked(block["code"], "u1", parts), unpacked(block["upper"], "f4", parts).astype(np.float64)
                lower, step = unpacked(block["lower"], "u1", parts, size), unpacked(block["step"], "f4", parts)
            found = []
            for p in range(parts):
                if before is None:
                    found.append(assign_all(x[:, p], books[p]))
                else:
                    found.append(assign_again(x[:, p], books[p], before[p], Part(entry[:, p], upper[:, p], lower[:, p] * step[:, p, None].astype(np.float64), 0)))
            code = np.stack([f.entry for f in found], 1)
            out = {"vec_id": block["vec_id"], "label": block["label"], "code": packed(code.astype(np.uint8))}
            if last:
                out["error"] = pa.array(squares(x, books[np.arange(parts), code]).sum(1))
            else:
                out["ints"] = block["ints"]
                out["upper"] = packed(single_up(np.stack([f.upper for f in found], 1)))
                steps = [steps_down(f.lower) for f in found]
                out["lower"] = packed(np.stack([count for count, _ in steps], 1))
                out["step"] = packed(np.stack([step for _, step in steps], 1))
            yield from pa.table(out).to_batches()

    return run


def _sums(parts: int, size: int, width: int):
    """A map over a task: the sums and counts of every entry of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = SlotSums(parts * size, width)
        for block in blocks(batches):
            slot = unpacked(block["code"], "u1", parts).astype(np.int64) + np.arange(parts) * size
            total.add(slot.ravel(), matrix(block["ints"], parts * width).reshape(-1, width))
        yield total.batch()

    return run


@dataclass
class Compressed:
    """``rows`` has vec_id, label, code (a byte for each part) and error; ``books`` the final
    entries, by part, entry and position within the part."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """Lowercase sha256 of all entries' decimal components, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Compressed:
    """Codes for all vectors, learned from all of them.

    Dropped: rows whose vector is null or holds a null or a non-finite component, and, as vectors of
    unlike lengths have no common parts, those whose length is not the most frequent one among the
    positive multiples of ``parts`` (of equally frequent ones, the longest). Components beyond 2**27
    after scaling count as 2**27. Codebooks start from the ``size`` smallest ids, nulls last, rows of
    one id in the order of their vectors; fewer vectors make smaller codebooks. Repeated rows count
    each time; a null id or label is one like any other; other columns are not looked at. No vector
    at all gives no rows. Every round is a table in the shared folder; the driver gets one row for
    each entry of the codebooks.
    """
    if not 1 <= size <= 256:
        raise ValueError("an entry's index is one byte")
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    finite = given.where(is_vector(F.col("v"))).withColumn("d", F.size("v"))
    lengths = finite.where((F.col("d") > 0) & (F.col("d") % parts == 0)).groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    dims = lengths[0].d if lengths else parts
    width = dims // parts
    kept = staged(finite.where(F.col("d") == dims).select("vec_id", "label", as_integers(F.col("v"), scale).alias("ints")), "vectors")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(size).collect()
    books = np.array([r.ints for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    id_type, label_type = kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()
    named = f"vec_id {id_type}, label {label_type}, code binary"
    if not first:
        return Compressed(spark.createDataFrame([], f"{named}, error long"), books)
    now, before, old = kept, None, None
    for _ in range(rounds):
        now, at = staged_at(now.mapInArrow(_state(books, before), f"{named}, ints array<int>, upper binary, lower binary, step binary"), "codes")
        if old:
            drop_dir(old)
        partial = now.select("ints", "code").mapInArrow(_sums(parts, books.shape[1], width), SLOT_SCHEMA)
        before, old = books, at
        books = next_entries(partial, books.reshape(-1, width)).reshape(books.shape)
    final = now.mapInArrow(_state(books, before, last=True), f"{named}, error long")
    return Compressed(staged(final, "coded"), books)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error: error summed over equal labels, nulls together; null beyond a long.

    Labels that a thousandth of the rows have are broadcast and their rows dealt out, so no task
    gets all rows of one label.
    """
    of_label = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n"))
    keyed = rows.withColumn("of_label", of_label)
    known = keyed.groupBy("of_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    return left_join_hot(keyed, known, "of_label", rows.count(), F.xxhash64("vec_id", "code")).drop("of_label")
