"""Set-similarity join of documents on word n-grams, by token-combination prefixes.

A token is the hash of a shingle (five words). Tokens are ordered rare first. Of two sets
with Jaccard similarity t or more, the first ``n - ceil(t n) + 1`` tokens of each (the base
prefix) have a token in common. Rare tokens of the base prefix are indexed one by one. If
all common ones are frequent, no rare token can be common at all, and then, in the first
``2 (1 - t) n + 2`` tokens, the common ones outnumber the tokens of one side that could stand
between them: two of them follow each other, among the frequent tokens, on both sides. So of
the frequent tokens, combinations of two neighbours in the extended prefix are indexed, and
only for sets whose base prefix reaches the frequent tokens. The index is linear in the
text, and a passage that thousands of documents share does not make pairs of them. In a corpus with so
many frequent tokens that one outside the broadcast table may still be in many sets, all tokens count as
frequent: then combinations alone are indexed, by the same argument, and no bucket is that of one token.

Candidates are verified on their whole texts. Buckets are not expanded into all pairs: each
bucket's members are first held against one of them, linked ones fall into components, and
only members of different components of a bucket are then compared with each other, in arrays. The
copies of one template have hundreds of large buckets in common: such buckets are taken together, and
their members meet once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, drop_dir, left_join_hot, staged, staged_at

#: Words of a shingle and the least similarity, in percent (50 or more).
SHINGLE, PERCENT = 5, 80
#: A token is frequent from this many sets on, or from the fewest that at most FREQUENT_MOST
#: tokens are in: their table is broadcast.
FREQUENT_FROM, FREQUENT_MOST = 64, 1 << 21
#: Single tokens are indexed while a rare one is in fewer sets than this.
SINGLE_MOST = 512
#: Tokens of a task that are counted before its counts are handed on, and of one range.
COUNT_TOKENS, RANGE_TOKENS = 1 << 22, 1 << 21

#: Most rows (two numbers each) of a list that is broadcast.
BROADCAST_ROWS = 1_000_000
#: Most rows of a bucket, about, that one task holds against each other, or against as many.
BLOCK_ROWS = 4096
#: Buckets of so many rows are large: those that are linked by members are compared as one.
LARGE_ROWS = 256
#: Rows that are compared in one go, and pairs whose signatures are.
MEET_ROWS, MEET_PAIRS = 1 << 13, 1 << 13
#: Bits of a set's signature, and of the wider one that pairs must pass before their texts are moved.
SIGNATURE, WIDE = 2048, 8192

_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct tokens of a whole text (or its UTF-8), ascending: hashes of ``size`` words in a row.

    A-Z are lower-cased, words are what ASCII white space parts. Fewer words than ``size``
    are one shingle; no words, none.
    """
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _M + w[j : j + len(h)]
    return np.unique(_mixed(h))


def fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def signature(tokens: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """A bit for each token's hash. Where two signatures differ, one set has a token that
    the other lacks, and no two bits are due to the same token: the number of bits that
    differ is at most the size of the symmetric difference."""
    bits = np.zeros(size, np.uint8)
    bits[(tokens % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def short(tokens: np.ndarray) -> np.ndarray:
    """What the frequency of a token is looked up by."""
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _reach(n: int, percent: int) -> int:
    """The length of the extended prefix; a set that is shorter is too small for combinations."""
    return 2 * (100 - percent) * n // 100 + 2


def prefix_keys(tokens: np.ndarray, names: np.ndarray, counts: np.ndarray, percent: int = PERCENT, singles: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set: those of rare tokens and those of combinations of frequent ones.

    ``names`` (ascending) and ``counts``: the frequent tokens, by :func:`short`. Without ``singles``
    all tokens count as frequent.
    """
    n = len(tokens)
    free = n - -(-percent * n // 100)
    base, extended = free + 1, _reach(n, percent)
    frequency = np.zeros(n, np.int64)
    if len(names):
        s = short(tokens)
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        frequency = np.where(names[at] == s, counts[at], 0)
    if extended > n:
        return tokens, tokens[:0]
    order = np.lexsort((tokens, frequency))[:extended]
    in_order, often = tokens[order], (frequency[order] > 0) | (not singles)
    # A set that may be linked with one too small for combinations has single tokens as well.
    least = -(-percent * n // 100)
    single = tokens if _reach(least, percent) > least else in_order[:base][~often[:base]]
    if not often[:base].any():
        return single, tokens[:0]
    combined = in_order[often]
    return single, _mixed(combined[:-1] * _M + combined[1:])


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    """A row per document (doc_id, same, node, n), and rows of token counts by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [], 0, set()

        def counted(id_type) -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            top = names >> np.uint32(22)
            cut = np.flatnonzero(np.diff(top)) + 1
            parts = [(int(p[0] >> np.uint32(22)), p, c) for p, c in zip(np.split(names, cut), np.split(counts, cut), strict=True)]
            m = len(parts)
            return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array([r for r, _, _ in parts], pa.int32()), pa.array([_planes(p) for _, p, _ in parts]), pa.array([_planes(c.astype(np.uint32), False) for _, _, c in parts])], names=["doc_id", "same", "node", "n", "range", "tokens", "counts"])

        for b in batches:
            nodes, sizes = [], []
            for text in b.column("text").to_pylist():
                tokens = shingles(text, size)
                nodes.append(fingerprint(tokens))
                sizes.append(len(tokens))
                if len(tokens) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(short(tokens))
                    n_held += len(tokens)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array(nodes), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["doc_id", "same", "node", "n", "range", "tokens", "counts"])
            if n_held >= COUNT_TOKENS:
                yield counted(b.column("doc_id").type)
                held, n_held, seen = [], 0, set()
        if held:
            yield counted(b.column("doc_id").type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("same")).mapInArrow(run, f"doc_id {kind}, same long, node binary, n long, range int, tokens binary, counts binary")


def _planes(x: np.ndarray, ascending: bool = True) -> bytes:
    """Numbers by byte planes, ascending ones as differences: small for Spark's codec."""
    if ascending:
        x = np.diff(x, prepend=np.uint32(0))
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes, ascending: bool = True) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(x, dtype=np.uint64).astype(np.uint32) if ascending else x


def rare_below(sizes: dict[int, int]) -> int:
    """In how many sets a token that counts as rare can be, one more: from how many tokens are in n sets, by n.

    It is as low as FREQUENT_MOST allows, however large the corpus is.
    """
    many = 0
    for n in sorted(sizes, reverse=True):
        many += sizes[n]
        if many > FREQUENT_MOST:
            return max(FREQUENT_FROM, n + 1)
    return FREQUENT_FROM


def frequent_tokens(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Names (ascending) and counts of the frequent tokens, over all documents, and from how many sets on they are.

    Counts of tasks are added by ranges of the names, 1024 of them. How many tokens have each
    count comes to the driver first, then at most FREQUENT_MOST rows.
    """
    from_on = FREQUENT_FROM

    def add(table: pa.Table) -> pa.Table:
        names = np.concatenate([_from_planes(x) for x in table.column("tokens").to_pylist()])
        counts = np.concatenate([_from_planes(x, False) for x in table.column("counts").to_pylist()])
        order = np.argsort(names, kind="stable")
        names, counts = names[order], counts[order]
        found, at = np.unique(names, return_index=True)
        sums = np.add.reduceat(counts.astype(np.int64), at)
        often = sums >= from_on
        return pa.table({"name": pa.array(found[often].astype(np.int64)), "n": pa.array(sums[often])})

    summed, at = staged_at(counted.where("range IS NOT NULL").select("range", "tokens", "counts").groupBy("range").applyInArrow(add, "name long, n long"), "frequent")
    least = rare_below({r["n"]: r["count"] for r in summed.groupBy("n").count().collect()})
    got = summed.where(F.col("n") >= least).toPandas().sort_values("name")
    drop_dir(at)
    return got["name"].to_numpy(np.int64).astype(np.uint32), got["n"].to_numpy(np.int64), least


def _indexed(docs: DataFrame, frequent, size: int, percent: int, single_tokens: bool) -> DataFrame:
    """A row for each distinct set of a task: node, n, signature and its index keys."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = held.value
        seen: set[bytes] = set()
        for b in batches:
            nodes, sizes, bits, wide, singles, combined = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                tokens = shingles(text, size)
                node = fingerprint(tokens)
                if not len(tokens) or node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                # Too few tokens to be linked with any other set: no keys.
                few = 100 * len(tokens) < percent * (len(tokens) + 1)
                s, c = prefix_keys(tokens[:0] if few else tokens, names, counts, percent, single_tokens)
                nodes.append(node)
                sizes.append(len(tokens))
                bits.append(signature(tokens))
                wide.append(signature(tokens, WIDE))
                singles.append(s.view(np.int64))
                combined.append(c.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(singles, pa.list_(pa.int64())), pa.array(combined, pa.list_(pa.int64()))], names=["node", "n", "bits", "wide", "singles", "combined"])

    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("text").mapInArrow(run, "node binary, n long, bits array<long>, wide array<long>, singles array<long>, combined array<long>")


def _postings(index: DataFrame, keys: str) -> DataFrame:
    """(key, before, id): a row for each index key of a set, with the key before it in the set."""
    each = F.expr(f"explode(transform({keys}, (x, i) -> struct(x AS key, IF(i > 0, {keys}[i - 1], NULL) AS before)))")
    return index.where(F.size(keys) > 0).select(each.alias("p"), "id").select("p.key", "p.before", "id")


def _buckets(index: DataFrame) -> DataFrame:
    """(key, before, id, leader): the members of each bucket of two or more; the smallest is its leader.

    Buckets of single tokens are small, as the tokens are rare; those of combinations may
    be of any size, so their leaders are found by a pre-aggregated minimum.
    """
    single = _postings(index, "singles")
    single = single.selectExpr("*", "min(id) OVER (PARTITION BY key) AS leader", "max(id) OVER (PARTITION BY key) AS last")
    single = single.where("leader < last").drop("last")
    combined = _postings(index, "combined")
    leaders = combined.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").drop("last")
    return single.unionByName(combined.join(leaders, "key").select("key", "before", "id", "leader"))


def _fits(percent: int):
    """False for (n_a, bits_a), (n_b, bits_b) that sizes or signatures rule out."""
    return _may_fit(percent, sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(SIGNATURE // 64)), F.lit(0)))


def _fits_wide(percent: int):
    """:func:`_fits` for signatures of any length."""
    each = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return _may_fit(percent, F.aggregate(each, F.lit(0), lambda s, x: s + x))


def _may_fit(percent: int, differ):
    sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sizes & ((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def _side(sets: DataFrame, x: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(x if c == "id" else f"{c}_{x}" if c != "key" else c) for c in sets.columns])


def _near(pairs: DataFrame, sets: DataFrame, fits) -> DataFrame:
    """The distinct (a, b) of ``pairs`` that sizes and signatures (id, n, bits) don't rule out."""
    both = pairs.distinct().join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    return both.where(fits).select("a", "b")


def _pairs_of(groups: np.ndarray) -> Iterator[tuple]:
    """All (i, j), i < j, of rows of one group, in pieces: two arrays, or a row and a slice. Equal ``groups`` stand together."""
    starts = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    ends = np.append(starts[1:], len(groups))
    end = np.repeat(ends, ends - starts)
    rows = np.arange(len(groups))
    # Of small groups, all rows and those a step further; of large ones, a row and all after it.
    large = end - np.repeat(starts, ends - starts) > 64
    left = rows[~large]
    for step in range(1, 64):
        left = left[left + step < end[left]]
        if not len(left):
            break
        yield left, left + step
    for i in rows[large]:
        yield i, slice(i + 1, end[i])


def _met(percent: int, group: np.ndarray, own: np.ndarray, before: np.ndarray, has_before: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The distinct (a, b), by row, of one group, in different components, that are not ruled out.

    ``own``: the row's block if its group is of two blocks, of which rows of unlike ones meet; else -1.
    """
    held, found, n_held = [], [np.zeros((0, 2), np.int64)], 0

    def compared() -> None:
        nonlocal held, n_held
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        held, n_held = [], 0
        for at in range(0, len(i), MEET_PAIRS):
            x, y = i[at : at + MEET_PAIRS], j[at : at + MEET_PAIRS]
            # As unsigned numbers: of a signed one numpy counts the bits of its magnitude.
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = (100 + percent) * differ <= (100 - percent) * (n[x] + n[y])
            x, y = x[ok], y[ok]
            turned = component[x] > component[y]
            found.append(np.stack([np.where(turned, ids[y], ids[x]), np.where(turned, ids[x], ids[y])], axis=1))

    for i, j in _pairs_of(group):
        ok = (component[i] != component[j]) & ((before[i] != before[j]) | ~has_before[i] | ~has_before[j])
        ok &= (own[i] != own[j]) | (own[i] < 0)
        ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        held.append((np.full(np.count_nonzero(ok), i), np.flatnonzero(ok) + j.start) if isinstance(j, slice) else (i[ok], j[ok]))
        n_held += len(held[-1][0])
        if n_held >= MEET_PAIRS or len(held) >= MEET_ROWS:
            compared()
    if held:
        compared()
    return np.unique(np.concatenate(found), axis=0)


def _meeting(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """:func:`_met` over rows in the order of (key, low, high): whole groups, many at a time."""

    def met(t: pa.Table) -> pa.RecordBatch:
        key, low, high, own, before, ids, component, n = (t.column(c).combine_chunks() for c in ("key", "low", "high", "own", "before", "id", "component", "n"))
        of = lambda x: x.fill_null(0).to_numpy(zero_copy_only=False)
        bits = t.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(t.num_rows, -1)
        new = [np.diff(of(x), prepend=of(x)[:1]) != 0 for x in (key, low, high)]
        two = of(low) != of(high)
        pairs = _met(percent, np.cumsum(new[0] | new[1] | new[2]), np.where(two, of(own), -1), of(before), before.is_valid().to_numpy(zero_copy_only=False), of(ids), of(component), of(n), bits)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held, n_held = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n_held += b.num_rows
        if n_held < MEET_ROWS:
            continue
        first, last = ([x.column(c)[k].as_py() for c in ("key", "low", "high")] for x, k in ((held[0], 0), (b, b.num_rows - 1)))
        if first == last:
            continue
        t = pa.Table.from_batches(held)
        same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("key", "low", "high"), last, strict=True)])
        cut = int(np.argmax(same))
        yield met(t.slice(0, cut))
        held, n_held = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield met(pa.Table.from_batches(held))


def _meet(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b) of ``rows`` (key, before, id, component, rows: how many the key has) that :func:`_met` leaves.

    The rows of a key are dealt out in blocks, each two of them to a task.
    """
    blocks = rows.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).join(sets, "id")
    each = blocks.withColumn("own", F.expr("CAST(pmod(xxhash64(id), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    each = each.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "before", "id", "component", "n", "bits")
    dealt = each.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(lambda batches: _meeting(batches, percent), "a long, b long").distinct()


def _families(apart: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Large buckets that are compared as one: (key, family) and (id, family, rows: how many ids the family has).

    Buckets with a member in common are of one family; it is compared as a whole where that makes no more
    pairs than its buckets, one by one. None where no bucket is large.
    """
    large = apart.where(F.col("rows") >= LARGE_ROWS)
    if large.isEmpty():
        return None
    family = components(large.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))).withColumnRenamed("component", "family")
    keys = large.select("key", "rows", F.col("leader").alias("id")).distinct().join(family, "id").select("key", "rows", "family")
    spent = keys.groupBy("family").agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("spent"))
    whole = staged(family.groupBy("family").agg(F.count("*").alias("rows")).join(spent, "family").where("CAST(rows AS double) * rows <= spent").select("family", "rows"), "families")
    return keys.join(whole.select("family"), "family").select("key", "family"), family.join(whole, "family").select("id", "family", "rows")


def _across(buckets: DataFrame, label: DataFrame, sets: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b) in different components of a bucket that sizes and both signatures don't rule out.

    Two sets that have the key before this one in common meet in that key's bucket, so of
    a run of common keys only the first makes a pair, and a bucket whose members all have
    the same key before them makes none. What is ruled out never becomes a row.
    """
    labelled = buckets.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    alike = (F.count("before") == F.count("*")) & (F.min("before") == F.max("before"))
    kept = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), alike.alias("alike"), F.count("*").alias("rows"))
    kept = kept.where("low < high AND NOT alike").select("key", "rows")
    apart = staged(labelled.join(kept, "key").select("key", "before", "id", "leader", "component", "rows"), "apart")
    families = _families(apart)
    one_by_one = apart if families is None else apart.join(families[0], "key", "left_anti")
    near = _near(staged(_meet(one_by_one, sets, percent), "pairs"), wide, _fits_wide(percent))
    if families is None:
        return near
    members = families[1].join(label, "id", "left").select(F.col("family").alias("key"), F.lit(None).cast("long").alias("before"), "id", F.coalesce("component", "id").alias("component"), "rows")
    return near.unionByName(_meet(members, wide, percent)).distinct()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they are shuffled: their length and zstd of their bytes."""
    for b in batches:
        raws = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raws], pa.binary())], names=["id", "text"])


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole texts are linked; only these texts are moved."""
    pairs, pairs_at = staged_at(pairs, "pairs")
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    wanted, wanted_at = staged_at(nodes.join(wanted, "id").select("id", "first.doc_id", "first.same"), "wanted")
    # A short list goes to the texts; a long one meets them in a shuffle.
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.withColumn("same", F.xxhash64("text")).join(wanted, ["doc_id", "same"]).dropDuplicates(["doc_id", "same"])
    texts, texts_at = staged_at(texts.select("id", "text").mapInArrow(_packed, "id long, text binary"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(key: int, text: bytes) -> np.ndarray:
            if key not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[key] = shingles(_unpacked(text), size)
            return kept[key]

        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = [linked(shingles(_unpacked(s), size), of(y, t), percent) for s, y, t in zip(b.column("text_a").to_pylist(), c, b.column("text_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, ok, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(c, ok, strict=True) if k], pa.int64())], names=["a", "b"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    found = staged(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")
    for at in (pairs_at, wanted_at, texts_at):
        drop_dir(at)
    return found


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the links (a, b) reach, for ids that have links.

    Smallest labels spread along links, and each label is replaced by its own label, so
    long chains take few rounds. Each round's table is written to the shared folder.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels, at = staged_at(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "id")
        low = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        jumped = low.join(up, "component", "left").select("id", "old", F.coalesce(F.least("component", "above"), "component").alias("component"))
        new, new_at = staged_at(jumped, "labels")
        changed = new.where("component <> old").limit(1).count()
        drop_dir(at)
        labels, at = new.select("id", "component"), new_at
        if not changed:
            return labels


def _same_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between different sets that have a doc_id in common."""
    ends = rows.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("doc_id", "low")
    pairs = rows.select("doc_id", "node").distinct().join(ends, "doc_id").where("node <> low").select("low", F.col("node").alias("high")).distinct()
    named = nodes.select("node", "id")
    low, high = named.withColumnsRenamed({"node": "low", "id": "a"}), named.withColumnsRenamed({"node": "high", "id": "b"})
    return pairs.join(low, "low").join(high, "high").select("a", "b")


def _named(filled: DataFrame) -> DataFrame:
    """(node, id, first, copies): each distinct set, its smallest (doc_id, same) and how many rows have it.

    It is named by its smallest doc_id, or, where that also is another set's, by 64 bits of its fingerprint.
    """
    nodes = staged(filled.groupBy("node").agg(F.min(F.struct("doc_id", "same")).alias("first"), F.count("*").alias("copies")), "nodes")
    odd = nodes.groupBy("first.doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("odd"))
    if odd.isEmpty():
        return nodes.select("node", F.col("first.doc_id").alias("id"), "first", "copies")
    told = nodes.withColumn("doc_id", F.col("first.doc_id")).join(odd, "doc_id", "left")
    return staged(told.select("node", F.when(F.col("odd"), F.xxhash64("node")).otherwise(F.col("doc_id")).alias("id"), "first", "copies"), "nodes")


def duplicate_classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, by_id: bool = True) -> DataFrame:
    """Of every row of ``docs`` (doc_id integral, text): doc_id, same (a hash of its text),
    n_shingles and best, the smallest (doc_id, same) of its class.

    Rows are of one class when links lead from one to the other; with ``by_id``, rows that have a
    doc_id in common are linked, whatever their texts. Rows without words or doc_id are in a class
    of their own.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted, counted_at = staged_at(_first_pass(docs, size), "tokens")
    rows = staged(counted.where("node IS NOT NULL").select("doc_id", "same", "node", "n"), "sets")
    total = rows.agg(F.count("*").alias("rows")).first()
    *frequent, least = frequent_tokens(counted)
    drop_dir(counted_at)

    filled = rows.where("n > 0 AND doc_id IS NOT NULL")
    nodes = _named(filled)
    index = _indexed(docs, frequent, size, percent, least <= SINGLE_MOST).groupBy("node").agg(F.first(F.struct("n", "bits", "wide", "singles", "combined")).alias("s"))
    index, index_at = staged_at(index.join(nodes.select("node", "id"), "node").select("id", "s.n", "s.bits", "s.wide", "s.singles", "s.combined"), "index")
    buckets, buckets_at = staged_at(_buckets(index), "buckets")
    sets, wide = index.select("id", "n", "bits"), index.select("id", "n", F.col("wide").alias("bits"))

    # First, each set against the leaders of its buckets.
    first = _near(buckets.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")), sets, _fits(percent))
    links = _verified(first, docs, nodes, size, percent)
    label = components(links)

    # Then members of a bucket that are in different components, against each other.
    more = _verified(_across(buckets, label, sets, wide, percent), docs, nodes, size, percent)
    drop_dir(buckets_at)
    drop_dir(index_at)
    if by_id:
        more = staged(more.unionByName(_same_id(filled, nodes)), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    # The best of each component, then of each set, then of each row; hot ones are not gathered.
    firsts = label.join(nodes, "id").groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("n"))
    firsts = staged(firsts, "firsts")
    best = left_join_hot(label, firsts, "component", label.count(), F.col("id")).select("id", "best")
    # A set of one row and without links is its own best.
    known = nodes.join(best, "id", "left").where("copies > 1 OR best IS NOT NULL")
    known = staged(known.select("node", F.coalesce("best", "first").alias("best"), F.col("copies").alias("n")), "classes")
    has_set = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    found = left_join_hot(rows, known, "node", total["rows"], F.xxhash64("doc_id", "same"), has_set)
    return found.select("doc_id", "same", F.col("n").alias("n_shingles"), F.coalesce("best", F.struct("doc_id", "same")).alias("best"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id integral, text).

    Rows are linked when ``100 * intersection >= percent * union`` of their shingle sets;
    component_id is the smallest doc_id that links reach, the own one included. A row
    without words has no shingles and is linked with nothing. A row with a null doc_id is
    linked with nothing and has a null component. doc_id names a document: rows that
    repeat it belong to one component. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType
    found = duplicate_classes(docs, percent, size)
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", F.col("best.doc_id").cast(kind).alias("component_id"))
