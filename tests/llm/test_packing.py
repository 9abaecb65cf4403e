import numpy as np
import pytest

from corpusloom.llm import packing, tokens

BYTE = tokens.tokenizer_path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing by the book: rooms in order, the tightest that fits."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 400))).tolist()
    histogram = {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    used = {}
    placed = {}
    for length, rank, sequence, offset, run in packing.best_fit_plan(histogram, capacity).tolist():
        for k in range(run):
            assert (length, rank + k) not in placed
            placed[length, rank + k] = sequence + k
            used.setdefault(sequence + k, []).append((offset, length))
    assert len(placed) == len(lengths)
    rooms = []
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        rooms.append(capacity - at)
    assert sorted(rooms) == one_by_one(lengths, capacity)


def test_pack_documents(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 500), (1, "a b c"), (None, "x"), (5, "one two three four five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS chunk")
    got = packing.pack_documents(df, BYTE, capacity=64).collect()
    code = tokens.TextEncoder(BYTE)
    whole = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] <= 256
        whole.setdefault(r["doc_id"], []).append((r["start"], r["piece"], r["ids"]))
    assert len(got) == 6 + -(-(1 + len(code.encode("word " * 500))) // 64)
    assert [p for _, p, _ in sorted(whole[4])] == list(range(len(whole[4])))
    assert np.frombuffer(b"".join(x for _, _, x in sorted(whole[4])), "<u4").tolist() == [*code.encode("word " * 500).tolist(), 0]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(df.limit(0), BYTE, capacity=64).count() == 0
