"""Token ids as binary files: static range asymmetric numeral system (rANS) in blocks.

One table of frequencies, counted over the whole corpus, is shared by all files. A file
holds documents in ascending order of id, in blocks of whole documents. A block is coded
by itself: its ids are dealt to interleaved lanes that share one stream of 32-bit words,
so a step of the coder handles a row of ids at once. Checkpoints (the lanes' states, the place
in the stream and a checksum of the stream up to the next one) let a reader begin inside a block
and read no more of it than it decodes; another checksum guards a block's head, and one the table; a
directory at the end of the file gives the blocks' places. Blocks, and pieces of long ones between
checkpoints, are decoded in parallel and in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, drop_dir, file_system, new_dir, staged, staged_at
from .tokens import encoder

#: Ids of a block (more only if its last document is longer), of a file, and lanes.
BLOCK_IDS, FILE_IDS, LANES = 1 << 18, 1 << 23, 512
#: Rows of ids between two checkpoints.
CHECKPOINT_ROWS = 128
#: Ids that a task decodes at once: a block with a longer document is decoded in pieces.
PIECE_IDS = 1 << 18

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4s8I")
_MARK = struct.Struct("<III")
_TAIL = struct.Struct("<QI4s")


@dataclass(frozen=True)
class FrequencyTable:
    """Symbols with shares of ``1 << bits``; every symbol that occurs has one at least."""

    bits: int
    symbols: np.ndarray
    shares: np.ndarray

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> FrequencyTable:
        bits = max(12, (8 * max(1, len(symbols)) - 1).bit_length())
        room, total = (1 << bits) - len(symbols), int(counts.sum())
        shares = 1 + np.array([int(c) * room // total for c in counts], np.int64) if len(symbols) else np.zeros(0, np.int64)
        if len(symbols):
            shares[int(np.argmax(counts))] += (1 << bits) - int(shares.sum())
        return cls(bits, symbols.astype("<u4"), shares.astype("<u4"))

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.symbols)) + self.symbols.tobytes() + self.shares.tobytes()
        return b"RTB1" + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, raw: bytes) -> FrequencyTable:
        body, (crc,) = raw[4:-4], struct.unpack("<I", raw[-4:])
        if raw[:4] != b"RTB1" or zlib.crc32(body) != crc:
            raise ValueError("the frequency table is damaged")
        bits, n = struct.unpack_from("<II", body)
        return cls(bits, np.frombuffer(body, "<u4", n, 8), np.frombuffer(body, "<u4", n, 8 + 4 * n))


class Coder:
    """Codes and decodes blocks with one table."""

    def __init__(self, table: FrequencyTable):
        self.table, self.id = table, zlib.crc32(table.to_bytes())
        self.bits = np.uint64(table.bits)
        self.mask = np.uint64((1 << table.bits) - 1)
        self.share = table.shares.astype(np.uint64)
        self.below = np.cumsum(self.share) - self.share
        self.most = self.share << (np.uint64(63) - self.bits)
        self.slot = np.repeat(np.arange(len(self.share), dtype=np.uint32), table.shares)

    def encode(self, doc_ids: list[int | None], docs: list[np.ndarray], lanes: int = LANES, every: int = CHECKPOINT_ROWS) -> bytes:
        ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        sym = np.searchsorted(self.table.symbols, ids)
        lanes = max(1, min(lanes, len(ids) // 64))
        rows = -(-len(ids) // lanes)
        x = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * rows
        marks = []
        for r in range(rows - 1, -1, -1):
            s = sym[r * lanes : (r + 1) * lanes]
            k = len(s)
            part, f = x[:k], self.share[s]
            full = part >= self.most[s]
            words[r] = part[full].astype(np.uint32)
            part = np.where(full, part >> _WORD, part)
            q = part // f
            x[:k] = (q << self.bits) + (part - q * f) + self.below[s]
            if r % every == 0:
                marks.append((r, x.copy()))
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
        stream = stream.astype("<u4")
        marks = marks[::-1] or [(0, x)]
        ends = [*(starts[r] for r, _ in marks[1:]), len(stream)]
        known = np.array([d is not None for d in doc_ids], np.uint8)
        head = b"".join(
            [
                known.tobytes(),
                np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                np.array([len(d) for d in docs], "<u4").tobytes(),
                *(_MARK.pack(r, starts[r], zlib.crc32(stream[starts[r] : e].tobytes())) + state.astype("<u8").tobytes() for (r, state), e in zip(marks, ends, strict=True)),
            ]
        )
        return _HEAD.pack(b"RBK2", len(docs), len(ids), lanes, len(stream), len(marks), every, self.id, zlib.crc32(head)) + head + stream.tobytes()

    def open(self, raw: bytes) -> Block:
        return Block(self, lambda at, n: raw[at : at + n])


class Block:
    """A block by its head, which has been verified; of the stream it reads what it decodes, and verifies that."""

    def __init__(self, coder: Coder, read: Callable[[int, int], bytes]):
        magic, n, self.n_ids, self.lanes, n_words, n_marks, _, table, crc = _HEAD.unpack(_exactly(read(0, _HEAD.size), _HEAD.size))
        if magic != b"RBK2":
            raise ValueError("a block is damaged")
        size = 13 * n + n_marks * (_MARK.size + 8 * self.lanes)
        head = _exactly(read(_HEAD.size, size), size)
        if zlib.crc32(head) != crc:
            raise ValueError("a block is damaged")
        if table != coder.id:
            raise ValueError("a block was written with another frequency table")
        self.coder, self.n_docs, self._read, self._stream = coder, n, read, _HEAD.size + size
        known = np.frombuffer(head, np.uint8, n, 0)
        ids = np.frombuffer(head, "<i8", n, n)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.lengths = np.frombuffer(head, "<u4", n, 9 * n)
        at = 13 * n
        #: (row, place in the stream, checksum, states) of each checkpoint, in order; the first is row 0.
        self.marks = []
        for _ in range(n_marks):
            self.marks.append((*_MARK.unpack_from(head, at), np.frombuffer(head, "<u8", self.lanes, at + _MARK.size)))
            at += _MARK.size + 8 * self.lanes
        self.n_words = n_words

    def _words(self, first: int, end: int) -> np.ndarray:
        """The stream from checkpoint ``first`` to before checkpoint ``end``."""
        places = [*(m[1] for m in self.marks), self.n_words]
        start, stop = places[first], places[end]
        raw = _exactly(self._read(self._stream + 4 * start, 4 * (stop - start)), 4 * (stop - start))
        for k in range(first, end):
            if zlib.crc32(raw[4 * (places[k] - start) : 4 * (places[k + 1] - start)]) != self.marks[k][2]:
                raise ValueError("a block is damaged")
        return np.frombuffer(raw, "<u4").astype(np.uint64)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop; reading and decoding begin at the nearest checkpoint before and end at the next one after."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        c, lanes, rows = self.coder, self.lanes, [m[0] for m in self.marks]
        mark, last = bisect_right(rows, start // lanes) - 1, bisect_right(rows, (stop - 1) // lanes)
        words, p, first, x = self._words(mark, last), 0, rows[mark], self.marks[mark][3].astype(np.uint64)
        out = np.empty(stop - first * lanes, np.uint32)
        for r in range(first, -(-stop // lanes)):
            k = min(lanes, self.n_ids - r * lanes)
            part = x[:k]
            low = part & c.mask
            s = c.slot[low]
            part = c.share[s] * (part >> c.bits) + low - c.below[s]
            need = np.flatnonzero(part < _LOW)
            if len(need):
                part[need] = part[need] << _WORD | words[p : p + len(need)]
                p += len(need)
            x[:k] = part
            to = (r - first) * lanes
            out[to : to + k] = s[: len(out) - to]
        return c.table.symbols[out[start - first * lanes :]]

    def parts(self, start: int = 0, stop: int | None = None) -> Iterator[tuple[int | None, int, int, np.ndarray, bool]]:
        """Of each document with ids from start to stop: its id, the block's ids before it, its own ids before
        the part, the part, and if that is all of it."""
        stop = self.n_ids if stop is None else stop
        ids, ends = self.ids(start, stop), np.cumsum(self.lengths, dtype=np.int64)
        # A document without ids belongs to the part that ends where it stands, or else to the first.
        first = int(np.searchsorted(ends, start, side="right" if start else "left"))
        for k in range(first, self.n_docs):
            end, n = int(ends[k]), int(self.lengths[k])
            begin = end - n
            if begin > stop or begin == stop and n:
                return
            a, b = max(begin, start), min(end, stop)
            yield self.doc_ids[k], begin, a - begin, ids[a - start : b - start], b - a == n

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for doc_id, _, _, ids, _ in self.parts():
            yield doc_id, ids


def _exactly(raw: bytes, n: int) -> bytes:
    if len(raw) != n:
        raise ValueError("a block is damaged")
    return raw


def crc_joined(parts: Iterable[tuple[int, int]]) -> int:
    """The CRC-32 of bytes in parts, from (number of bytes, CRC-32) of each: what comes after shifts the sum by zero bytes."""
    total, zeros = 0, bytes(1 << 20)
    for n, crc in parts:
        shifted, none, left = total, 0, n
        while left:
            z = zeros[:left] if left < len(zeros) else zeros
            shifted, none, left = zlib.crc32(z, shifted), zlib.crc32(z, none), left - len(z)
        total = shifted ^ none ^ crc
    return total


_coders: dict[str, Coder] = {}


def coder_at(path: str) -> Coder:
    """The coder of a table file, one for each Python worker."""
    if path not in _coders:
        store, at = file_system(path)
        with store.open_input_file(at) as f:
            _coders[path] = Coder(FrequencyTable.from_bytes(f.read()))
    return _coders[path]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and the ids of every whole text with ``end_id``, as narrow as the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = np.array([end_id], code.dtype).tobytes()
        for b in batches:
            ids = [code.encode(t or "").tobytes() + end for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokenised: DataFrame, dtype: str) -> FrequencyTable:
    """Counts over all ids; a row for each id that occurs comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype))
            if len(got) > len(sums):
                sums, got = got, sums
            sums[: len(got)] += got
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[at])], names=["id", "n"])

    got = tokenised.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return FrequencyTable.of_counts(got["id"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


MANIFEST = "part int, block int, path string, offset long, size long, n_docs long, n_ids long"


def write_corpus(docs: DataFrame, tokenizer: str, end_id: int, out: str, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Write ``docs`` (doc_id integral, text) below ``out``; return the manifest of blocks.

    Files are in ascending order of doc_id, null ids first; rows that repeat an id are in
    an order of their ids' hash. A null or empty text is ``end_id`` alone; a text of any length is in one
    block, which is as long as it takes; an empty table has no blocks; other columns are not read. A task writes to a name of its own, and the manifest names
    the files of the tasks that succeeded, so a task that is run again does no harm.
    """
    spark = docs.sparkSession
    dtype = encoder(tokenizer).dtype.str
    ids, ids_at = staged_at(tokenise(docs, tokenizer, end_id), "ids")
    table = count_ids(ids, dtype)
    table_path = f"{out}/table.rans"
    store, at = file_system(out)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(file_system(table_path)[1]) as f:
        f.write(table.to_bytes())
    width = np.dtype(dtype).itemsize
    total = ids.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // width
    parts = max(spark.sparkContext.defaultParallelism, -(-total // file_ids))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), coder_at(table_path)
        path = f"{out}/part-{part:06d}-{uuid.uuid4().hex}.rans"
        rows: list[tuple] = []
        names, held, n_held, place, f = [], [], 0, 0, None

        def close() -> None:
            nonlocal names, held, n_held, place, f
            if f is None:
                store, at = file_system(path)
                f = store.open_output_stream(at, compression=None)
            raw = coder.encode(names, held)
            f.write(raw)
            rows.append((part, len(rows), path, place, len(raw), len(names), n_held))
            place += len(raw)
            names, held, n_held = [], [], 0

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                x = np.frombuffer(raw, dtype)
                if n_held and n_held + len(x) > block_ids:
                    close()
                names.append(doc_id)
                held.append(x)
                n_held += len(x)
        if names:
            close()
        if f is not None:
            f.write(_directory([r[3:] for r in rows], place))
            f.close()
        yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in MANIFEST.split(", ")], r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    tie = F.xxhash64("ids")
    ordered = ids.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    manifest = staged(ordered.mapInArrow(write, MANIFEST), "blocks")
    drop_dir(ids_at)
    return manifest


def _directory(rows: list[tuple], place: int) -> bytes:
    return np.array(rows, "<i8").tobytes() + _TAIL.pack(place, len(rows), b"RDIR")


def block_directory(path: str) -> np.ndarray:
    """Rows (offset, size, n_docs, n_ids) from the end of a file."""
    store, at = file_system(path)
    with store.open_input_file(at) as f:
        end = f.size()
        f.seek(end - _TAIL.size)
        place, n, magic = _TAIL.unpack(f.read(_TAIL.size))
        if magic != b"RDIR":
            raise ValueError(f"{path} has no directory")
        f.seek(place)
        return np.frombuffer(f.read(32 * n), "<i8").reshape(n, 4)


def read_parts(spark: SparkSession, manifest: DataFrame, out: str, piece_ids: int = PIECE_IDS) -> DataFrame:
    """doc_id, start (ids before the document in the corpus), at (its own before this part), whole (if
    the part is all of it) and ids (little-endian unsigned 32-bit), decoded from the files that ``manifest``
    names. Blocks are dealt to tasks in pieces of ``piece_ids``; a piece is read from its checkpoint on, so a
    document that is longer has several parts, wherever they are decoded."""
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS earlier")
    placed = manifest.join(before, "part").selectExpr("path", "offset", "n_ids", "earlier + sum(n_ids) OVER (PARTITION BY part ORDER BY block) - n_ids AS start")
    pieces = placed.select("path", "offset", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_ids") - 1, F.lit(0)), F.lit(piece_ids).cast("long"))).alias("first"))
    table_path = f"{out}/table.rans"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_at(table_path)
        for b in batches:
            for path, offset, start, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, at = file_system(path)
                with store.open_input_file(at) as f:
                    block = Block(coder, lambda place, n: f.read_at(n, offset + place))  # noqa: B023
                    rows = list(block.parts(first, min(first + piece_ids, block.n_ids)))
                ids, begins, ats, raws, whole = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([start + x for x in begins], pa.int64()), pa.array(ats, pa.int64()), pa.array(whole, pa.bool_()), pa.array([x.astype("<u4").tobytes() for x in raws], pa.binary())],
                    names=["doc_id", "start", "at", "whole", "ids"],
                )

    arrow_batches(spark)
    n = max(spark.sparkContext.defaultParallelism, manifest.agg(F.coalesce(F.sum("n_ids"), F.lit(0))).first()[0] // (16 * piece_ids))
    return pieces.repartition(n).mapInArrow(read, "doc_id long, start long, at long, whole boolean, ids binary")


def read_corpus(spark: SparkSession, manifest: DataFrame, out: str, piece_ids: int = PIECE_IDS) -> DataFrame:
    """doc_id, start and ids of every document; those in several parts are put together, each in one row."""
    parts = read_parts(spark, manifest, out, piece_ids)
    joined = parts.where("NOT whole").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    whole = F.aggregate("parts", F.unhex(F.lit("")), lambda s, x: F.concat(s, x["ids"]))
    return parts.where("whole").select("doc_id", "start", "ids").unionByName(joined.select("doc_id", "start", whole.alias("ids")))


def read_checks(spark: SparkSession, manifest: DataFrame, out: str, piece_ids: int = PIECE_IDS) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document. Of one in several parts no task holds more
    than a part: its checksum is put together from theirs."""
    parts = read_parts(spark, manifest, out, piece_ids).select("doc_id", "start", "at", "whole", (F.length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc"))
    done = staged(parts, "read-back")

    @F.pandas_udf("long")
    def joined(rows: pd.Series) -> pd.Series:
        return pd.Series([crc_joined((4 * int(p["n"]), int(p["crc"])) for p in parts) for parts in rows], dtype="int64")

    long = done.where("NOT whole").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    return done.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")).unionByName(long.select("doc_id", "start", F.col("n").alias("n_tokens"), joined("parts").alias("ids_crc32")))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None) -> DataFrame:
    """Write a corpus and read it back: what :func:`read_checks` returns, for the cases of :func:`write_corpus`."""
    spark = docs.sparkSession
    out = out or new_dir(spark, "rans")
    return read_checks(spark, write_corpus(docs, tokenizer, end_id, out), out)
