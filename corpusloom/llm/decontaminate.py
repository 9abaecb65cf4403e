"""Benchmark decontamination over a distributed positional inverted index.

The training documents are indexed in segments: for each benchmark term the documents of
the segment that hold it and the positions there. A search takes the terms of a benchmark
phrase from the rarest (over the whole corpus) on, shifts each list by the term's offset in
the phrase and intersects it with the starts that are left, until the phrase has been found
in full or no start is left. Segments are searched apart from each other, so neither lists
nor documents ever meet in one task.

The index is built once for a benchmark, with all terms that it has, as no search asks for others;
phrases are searched for in blocks. Only a benchmark of more distinct words than a task can hold is
divided and has an index for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged

#: Words and documents after which a segment is closed.
SEGMENT_WORDS, SEGMENT_DOCS = 2_000_000, 1 << 15
#: Benchmark words that are searched for at once; a larger benchmark goes in blocks.
BLOCK_WORDS = 500_000
#: Distinct benchmark words of one index.
VOCABULARY_MOST = 500_000
#: Length of a phrase, and how many of an item's rarest terms must stand how near.
WINDOW, NEAR_TERMS, NEAR_WORDS = 10, 3, 20

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The index, written to the shared folder.

    Rows with a term: segment, term, n_docs, docs and positions (binary, ascending).
    Rows without: a document of the segment, with its place there, keys and n_words.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(vocabulary)
    docs = docs.select(F.struct(*keys).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segments, get = TaskContext.get().partitionId(), 0, held.value.get
        key_type = None
        keys_, lengths, terms = [], [], []

        def close() -> pa.RecordBatch:
            segment, n = f"{part}-{segments}", len(lengths)
            sizes = [len(t) for t in terms]
            term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
            doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
            pos = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]) if sizes else np.zeros(0, np.int32)
            known = term >= 0
            term, doc, pos = term[known], doc[known], pos[known]
            order = np.argsort(term, kind="stable")
            term, doc, pos = term[order], doc[order], pos[order]
            names, at = np.unique(term, return_index=True)
            ends = np.append(at, len(term))[1:]
            m = len(names)
            n_docs = [len(np.unique(doc[a:b])) for a, b in zip(at, ends, strict=True)]
            none = lambda k: [None] * k
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([segment] * (m + n)),
                    pa.array([*names.tolist(), *none(n)], pa.int32()),
                    pa.array([*n_docs, *none(n)], pa.int32()),
                    pa.array([*(doc[a:b].tobytes() for a, b in zip(at, ends, strict=True)), *none(n)], pa.binary()),
                    pa.array([*(pos[a:b].tobytes() for a, b in zip(at, ends, strict=True)), *none(n)], pa.binary()),
                    pa.array([*none(m), *range(n)], pa.int32()),
                    pa.concat_arrays([pa.nulls(m, key_type), *keys_]),
                    pa.array([*none(m), *lengths], pa.int64()),
                ],
                names=["segment", "term", "n_docs", "docs", "positions", "place", "key", "n_words"],
            )

        held_words = 0
        for b in batches:
            key_type = b.column("key").type
            for k, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                keys_.append(b.column("key").slice(k, 1))
                lengths.append(len(words))
                terms.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                held_words += len(words)
                if held_words >= SEGMENT_WORDS or len(lengths) >= SEGMENT_DOCS:
                    yield close()
                    segments += 1
                    held_words, keys_, lengths, terms = 0, [], [], []
        if lengths:
            yield close()

    key_type = docs.schema["key"].dataType.simpleString()
    return staged(docs.mapInArrow(run, f"segment string, term int, n_docs int, docs binary, positions binary, place int, key {key_type}, n_words long"), "positional-index")


class Phrases:
    """The windows of a block of items in flat arrays, filed under their rarest term.

    ``terms`` has a row for each distinct window: its terms from the rarest on, -1 beyond its length;
    ``offsets`` says where in the window each stands, ``lengths`` how long it is. ``holders`` are the
    items that hold a window, those of window k from ``starts[k]`` to ``starts[k + 1]``. Windows are in
    the order of their rarest terms. ``rarest`` has each item's rarest terms, -1 where it has fewer.
    """

    def __init__(self, ids: list, items: list[np.ndarray], df: np.ndarray, window: int = WINDOW):
        self.ids = ids
        rows, owner, lengths = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int16)]
        self.rarest = np.full((len(items), NEAR_TERMS), -1, np.int32)
        for k, t in enumerate(items):
            if not len(t):
                continue
            if len(t) < window:
                own = np.full((1, window), -1, np.int32)
                own[0, : len(t)] = t
            else:
                own = np.lib.stride_tricks.sliding_window_view(t, window)
            rows.append(own)
            owner.append(np.full(len(own), k, np.int32))
            lengths.append(np.full(len(own), min(len(t), window), np.int16))
            distinct = np.unique(t)
            few = distinct[np.argsort(df[distinct], kind="stable")][:NEAR_TERMS]
            self.rarest[k, : len(few)] = few
        every, at, which = np.unique(np.concatenate(rows), axis=0, return_index=True, return_inverse=True)
        lengths_ = np.concatenate(lengths)[at]
        often = np.where(every >= 0, df[every], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable").astype(np.int16)
        terms = np.take_along_axis(every, order.astype(np.int64), 1)
        place = np.argsort(terms[:, 0], kind="stable")
        self.terms, self.offsets, self.lengths = terms[place], order[place], lengths_[place]
        now = np.empty(len(place), np.int64)
        now[place] = np.arange(len(place))
        pairs = np.unique(np.stack([now[which.ravel()], np.concatenate(owner).astype(np.int64)], 1), axis=0)
        self.holders = pairs[:, 1].astype(np.int32)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(place) + 1)).astype(np.int32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.terms, self.offsets, self.lengths, self.holders, self.starts, self.rarest))


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted


def search_segment(lists: dict[int, np.ndarray], phrases: Phrases, near: int) -> tuple[np.ndarray, set, set]:
    """In one segment: hit words as document << 32 | position, (document, item) of exact
    phrases, and (document, item) of items whose rarest terms stand near each other."""
    words, exact, close = [], set(), set()
    here = np.zeros(max([phrases.terms.max(initial=-1), phrases.rarest.max(initial=-1), *lists]) + 2, bool)
    here[list(lists)] = True
    # What a window or an item lacks counts as there.
    here[-1] = True
    # Only windows whose terms the segment all has are looked at.
    for w in np.flatnonzero(here[phrases.terms].all(1)) if len(phrases.terms) else ():
        starts, length = None, int(phrases.lengths[w])
        for t, offset in zip(phrases.terms[w, :length].tolist(), phrases.offsets[w, :length].tolist(), strict=True):
            keys = lists[t]
            if starts is None:
                starts = keys[(keys & 0xFFFFFFFF) >= offset] - offset
            else:
                starts = starts[_among(keys, starts + offset)]
            if not len(starts):
                break
        if len(starts):
            words.append((starts[:, None] + np.arange(length)).ravel())
            items = phrases.holders[phrases.starts[w] : phrases.starts[w + 1]].tolist()
            exact.update((d, i) for d in np.unique(starts >> 32).tolist() for i in items)
    for item in np.flatnonzero(here[phrases.rarest].all(1) & (phrases.rarest[:, 0] >= 0)).tolist():
        first, *others = [t for t in phrases.rarest[item].tolist() if t >= 0]
        at = lists[first]
        for t in others:
            keys = lists[t]
            after = np.searchsorted(keys, at)
            gap = np.minimum(np.abs(keys[np.minimum(after, len(keys) - 1)] - at), np.abs(at - keys[np.maximum(after - 1, 0)]))
            at = at[gap <= near]
        close.update((d, item) for d in np.unique(at >> 32).tolist())
    return (np.unique(np.concatenate(words)) if words else np.zeros(0, np.int64)), exact, close


def term_counts(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents of the whole corpus each of the ``terms`` terms is; as many numbers as there are come to the driver."""
    counts = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("n")).toArrow()
    df = np.zeros(terms, np.int64)
    df[counts["term"].to_numpy()] = counts["n"].to_numpy()
    return df


def search(index: DataFrame, phrases: Phrases, near: int = NEAR_WORDS) -> DataFrame:
    """A row per document: segment, place, key, n_words, hits (positions), items, near_items."""
    held = index.sparkSession.sparkContext.broadcast(phrases)

    def run(table: pa.Table) -> pa.Table:
        ids = held.value.ids
        is_term = table.column("term").is_valid()
        rows, docs = table.filter(is_term), table.filter(pc.invert(is_term))
        lists = {}
        for t, d, p in zip(rows.column("term").to_pylist(), rows.column("docs").to_pylist(), rows.column("positions").to_pylist(), strict=True):
            lists[t] = np.frombuffer(d, np.int32).astype(np.int64) << 32 | np.frombuffer(p, np.int32)
        words, exact, close = search_segment(lists, held.value, near)
        n = docs.num_rows
        hits, items, nears = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
        owner, first = np.unique(words >> 32, return_index=True)
        for d, part in zip(owner.tolist(), np.split(words & 0xFFFFFFFF, first[1:]), strict=False):
            hits[d] = part.tolist()
        for pairs, to in ((exact, items), (close, nears)):
            for d, i in pairs:
                to[d].append(ids[i])
        place = docs.column("place").to_pylist()
        pick = lambda x: [x[p] for p in place]
        strings = pa.list_(pa.string())
        return pa.table({"segment": docs.column("segment"), "place": docs.column("place"), "key": docs.column("key"), "n_words": docs.column("n_words"), "hits": pa.array(pick(hits), pa.list_(pa.int32())), "items": pa.array(pick(items), strings), "near_items": pa.array(pick(nears), strings)})

    kind = index.schema["key"].dataType.simpleString()
    return index.groupBy("segment").applyInArrow(run, f"segment string, place int, key {kind}, n_words long, hits array<int>, items array<string>, near_items array<string>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where the items of ``benchmark`` (item_id, text) occur in ``docs`` (keys and text).

    Returns a row per document: its keys, n_words, hits (positions of the words inside any
    occurrence of a window), items (ids, as strings, of items with an occurring window) and
    near_items (items whose rarest terms stand near each other somewhere). Null and empty
    texts have no words and no hits; items without words find nothing; an item with a null
    id is named "null". Repeated rows are reported each. Without items nothing is hit.
    Other columns, of whatever name, are not read.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text IS NOT NULL").distinct()
    bench = staged(bench.mapInArrow(_item_words, "item_id string, words array<binary>"), "benchmark-words")
    own = list(keys)
    parts = _parts(bench)
    blocks = [_blocks(b, block_words) for b in parts]
    if sum(blocks) > 1:
        # Each search gives a row for each document; a number that is written once says which are the same.
        docs = staged(docs.select(*own, "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
        keys = (*own, "_row")
    found = None
    for part, n in zip(parts, blocks, strict=True):
        distinct = part.select(F.explode("words").alias("w")).distinct().collect()
        vocabulary = {bytes(w): k for k, w in enumerate(sorted(bytes(r.w) for r in distinct))}
        index = build_index(docs, vocabulary, keys)
        df = term_counts(index, len(vocabulary))
        for k in range(n):
            mine = part.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k).collect()
            items = [np.fromiter((vocabulary[bytes(w)] for w in r.words), np.int32, len(r.words)) for r in mine]
            one = search(index, Phrases([r.item_id for r in mine], items, df, window))
            found = one if found is None else found.unionByName(one)
    if sum(blocks) > 1:
        flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = found.groupBy("key._row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), flat("hits"), flat("items"), flat("near_items"))
    return found.select(*[F.col(f"key.{k}").alias(k) for k in own], "n_words", "hits", F.array_distinct("items").alias("items"), F.array_distinct("near_items").alias("near_items"))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([words_of(t) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))], ["item_id", "words"])


def _blocks(bench: DataFrame, block_words: int) -> int:
    """How many blocks items go in; an item of more words than a block is one by itself at most."""
    return max(1, -(-int(bench.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]) // block_words))


def _parts(bench: DataFrame, most: int | None = None, depth: int = 0) -> list[DataFrame]:
    """The benchmark, divided until the distinct words of each part are ``VOCABULARY_MOST`` at most, or it is one item."""
    most = VOCABULARY_MOST if most is None else most
    n = bench.select(F.explode("words").alias("w")).distinct().count()
    if n <= most or depth > 30 or bench.count() < 2:
        return [bench]
    side = F.pmod(F.xxhash64("item_id", "words", F.lit(depth)), F.lit(2))
    return [p for k in (0, 1) for p in _parts(bench.where(side == k), most, depth + 1)]
