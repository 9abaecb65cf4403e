"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces are placed longest first, each into the open sequence with the least room that
still holds it. A segment tree over remaining capacities finds that room in logarithmic
time. Sequences with equal room are alike, and so are pieces of equal length, so one step
of the tree places a whole run of equal pieces: the plan is made from the histogram of
lengths (as many rows as a sequence has tokens, whatever the corpus) and says, for the
ranks of each length, which sequences they go to. Spark numbers the pieces of each length
and looks every piece up in the plan. The result is the packing that placing the pieces of
the whole corpus one by one would give.

A piece's number among all of its length is its number in its chunk (the pieces of a task) and
those of the chunks before. These offsets are written to the shared folder, a dense array for
each chunk; a task reads the arrays of its own chunks only, so the pieces are never shuffled and
nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, file_system, new_dir, staged
from .tokens import encoder, forget

PIECES = "doc_id {id}, piece int, start long, length long, chunk long, nth long, ids binary"


class RoomTree:
    """Counts of open sequences by remaining room; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, room: int) -> int | None:
        """The smallest room of at least ``room`` that an open sequence has."""
        k = room + self.leaves
        if self.count[k]:
            return room
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequence, offset, run) in order of length and rank.

    The pieces of a length with ranks first .. first + run - 1 go to the sequences
    sequence .. sequence + run - 1, each at ``offset``. The number of rows depends on
    ``capacity`` alone: a step moves whole runs of sequences and splits one at most.
    """
    tree, open_runs, made, rows = RoomTree(capacity), [deque() for _ in range(capacity + 1)], 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.least(length)
            if room is None:
                room, first, run = capacity, made, -(-left // (capacity // length))
                made += run
            else:
                first, run = open_runs[room].popleft()
                tree.add(room, -run)
            # A sequence stays the tightest fit until it holds no more of this length, so
            # each takes ``deep`` pieces before the next takes any.
            deep = min(room // length, left)
            wide = min(run, left // deep)
            for layer in range(deep):
                rows.append((length, rank, first, capacity - room + layer * length, wide))
                rank += wide
            left -= deep * wide
            for r, f, n in ((room, first + wide, run - wide), (room - deep * length, first, wide)):
                if n:
                    tree.add(r, n)
                    open_runs[r].appendleft((f, n))
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, only the first shorter."""
    start, first = 0, n % capacity or capacity
    while start < n:
        length = first if start == 0 else capacity
        yield start, length
        start += length


def tokenise_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece; within a task's chunk, ``nth`` numbers the pieces of a length.

    Ids are kept as narrow as the vocabulary allows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        code, chunk, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], code.dtype)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([code.encode(text or ""), end])
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    out.append((doc_id, k, start, length, chunk, seen[length], ids[start : start + length].tobytes()))
                    seen[length] += 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "chunk", "nth", "ids"]).astype({"doc_id": "object"})

    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, PIECES.format(id=kind))


#: Chunks whose offsets are in one file.
FILE_CHUNKS = 64


def write_offsets(sums: DataFrame, capacity: int, out: str) -> None:
    """For every chunk, how many pieces of each length the chunks before it have.

    ``sums`` has length, chunk and n. The files are named after chunk // FILE_CHUNKS; a task that
    is run again writes the same file anew.
    """
    store, at = file_system(out)
    store.create_dir(at, recursive=True)
    before = sums.selectExpr("length", "chunk", "sum(n) OVER (PARTITION BY length ORDER BY chunk) - n AS earlier", f"chunk div {FILE_CHUNKS} AS file")

    def write(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        names = np.unique(chunks)
        dense = np.zeros((len(names), capacity + 1), np.int64)
        dense[np.searchsorted(names, chunks), table.column("length").to_numpy()] = table.column("earlier").to_numpy()
        file = int(table.column("file")[0].as_py())
        store, at = file_system(f"{out}/{file}-{uuid.uuid4().hex}")
        with store.open_output_stream(at, compression=None) as f:
            f.write(np.array([len(names)], "<i8").tobytes() + names.astype("<i8").tobytes() + dense.astype("<i8").tobytes())
        try:
            store.move(at, file_system(f"{out}/{file}.offsets")[1])
        except OSError:
            # Another attempt of this task has written the same bytes.
            store.delete_file(at)
        return pa.table({"file": [file]})

    before.groupBy("file").applyInArrow(write, "file long").count()


def offsets_of(out: str, chunk: int, capacity: int) -> np.ndarray:
    """The offsets of one chunk, by length: one range of its file is read."""
    store, at = file_system(f"{out}/{chunk // FILE_CHUNKS}.offsets")
    with store.open_input_file(at) as f:
        (n,) = np.frombuffer(f.read(8), "<i8")
        k = int(np.searchsorted(np.frombuffer(f.read(8 * int(n)), "<i8"), chunk))
        f.seek(8 + 8 * int(n) + 8 * k * (capacity + 1))
        return np.frombuffer(f.read(8 * (capacity + 1)), "<i8")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row per piece: doc_id, piece, start, length, ids (little-endian unsigned
    32-bit), sequence_id and offset. A document is its text's ids
    and ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer than
    ``capacity`` are cut, and only the first piece is shorter than ``capacity``. Repeated
    rows are packed each for itself; a null doc_id stays null. An empty table gives no rows.
    """
    pieces = staged(tokenise_pieces(docs, tokenizer, capacity, end_id), "pieces")
    # Ranks: a chunk's pieces of a length come after those of the chunks before it.
    sums = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    sums = staged(sums, "lengths")
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(best_fit_plan(histogram, capacity))
    offsets = new_dir(pieces.sparkSession, "offsets")
    write_offsets(sums, capacity, offsets)
    kept, narrow = ["doc_id", "piece", "start", "length", "ids"], encoder(tokenizer).dtype

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = plan.value
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        # One sorted key for (length, rank): ranks stay below the largest run end.
        span = int((rows[:, 1] + rows[:, 4]).max()) + 1 if len(rows) else 1
        keys = rows[:, 0] * span + rows[:, 1]
        # Workers are used again: what they kept for tokenising is of no use from here on.
        forget()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, length = batch["chunk"].to_numpy(np.int64), batch["length"].to_numpy(np.int64)
            rank = batch["nth"].to_numpy(np.int64).copy()
            for c in np.unique(chunk).tolist():
                if c not in held:
                    held = {c: offsets_of(offsets, c, capacity)}
                mine = chunk == c
                rank[mine] += held[c][length[mine]]
            at = rows[np.searchsorted(keys, length * span + rank, "right") - 1]
            ids = [np.frombuffer(x, narrow).astype("<u4").tobytes() for x in batch["ids"]]
            yield batch[kept].assign(ids=ids, sequence_id=at[:, 2] + rank - at[:, 1], offset=at[:, 3])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*kept).schema) + ", sequence_id long, offset long"
    return pieces.select(*kept, "chunk", "nth").mapInPandas(place, schema)
