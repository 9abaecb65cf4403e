import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=80, size=5):
    sets = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    ids = [r[0] for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if ids[i] is None or ids[j] is None:
                continue
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return sorted(((i, len(s), find(i) if s and i is not None else i) for i, s in zip(ids, sets)), key=str)


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(50, 95), st.booleans())
def test_linked_sets_share_a_key(seed, n, percent, singles):
    r = np.random.default_rng(seed)
    pool = np.unique(r.integers(1, 2**63, 4 * n).astype(np.uint64))
    a = r.choice(pool, min(n, len(pool)), replace=False)
    b = np.concatenate([a[r.random(len(a)) > 0.1], r.choice(pool, int(r.integers(0, 3)))])
    a, b = np.unique(a), np.unique(b)
    names = np.unique(J.short(pool[r.random(len(pool)) < r.random()]))
    counts = r.integers(1, 5, len(names))
    if len(b) and J.linked(a, b, percent):
        keys = [set(np.concatenate(J.prefix_keys(x, names, counts, percent, singles)).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]
        # numpy counts the bits of a signed number's magnitude, Spark those of its two's complement.
        for size in (J.SIGNATURE, J.WIDE):
            differ = np.bitwise_count((J.signature(a, size) ^ J.signature(b, size)).view(np.uint64)).sum()
            assert (100 + percent) * differ <= (100 - percent) * (len(a) + len(b))


def test_planes():
    x = np.array([0, 3, 3, 900, 2**32 - 1], np.uint32)
    assert J._from_planes(J._planes(x)).tolist() == x.tolist()
    assert J._from_planes(J._planes(x, False), False).tolist() == x.tolist()


def rows():
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijk") + r.choice("xyz") for _ in range(r.randint(1, 60))) for _ in range(12)]
    out = []
    for k in range(90):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = "q" + str(k)
        out.append((k + 10, " ".join(w)))
    out += [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, base[0].upper()), (7, base[0].upper()), (None, base[0]), (8, "é  x"), (9, "one two three four five")]
    return out


@pytest.mark.parametrize("often, single_most", [(2, 512), (5, 512), (64, 512), (64, 0), (3, 0)])
def test_against_brute_force(spark, monkeypatch, often, single_most):
    monkeypatch.setattr(J, "FREQUENT_FROM", often)
    monkeypatch.setattr(J, "SINGLE_MOST", single_most)
    df = spark.createDataFrame([(*x, 1) for x in rows()], "doc_id long, text string, n int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df).collect()), key=str)
    assert got == brute(rows())


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101)]
    got = {r["id"]: r["component"] for r in J.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


def test_rare_tokens_stay_single_in_a_large_corpus(spark, monkeypatch):
    """The bound follows from how many tokens are frequent, not from how many there are."""
    assert J.rare_below({1: 10**12, 63: 10**9, 64: 1 << 20, 10**6: 5}) == J.FREQUENT_FROM
    assert J.rare_below({70: 1 << 21, 80: 5}) == 71
    monkeypatch.setattr(J, "FREQUENT_FROM", 3)
    monkeypatch.setattr(J, "FREQUENT_MOST", 2)
    texts = ["a b c d e f " + " ".join(f"w{k}x{i}" for i in range(40)) for k in range(9)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    names, counts, least = J.frequent_tokens(J._first_pass(docs, 5))
    assert (counts.tolist(), least) == ([9, 9], 3)
    assert names.tolist() == np.sort(J.short(J.shingles("a b c d e f"))).tolist()


def met(rows, percent):
    """(a, b) of brute force; rows: key, low, high, own, before, id, component, n, tokens."""
    out = set()
    for x in rows:
        for y in rows:
            if x[:3] != y[:3] or x[6] >= y[6] or (x[1] != x[2] and x[3] == y[3]) or (x[4] is not None and x[4] == y[4]):
                continue
            differ = int(np.bitwise_count((J.signature(x[8]) ^ J.signature(y[8])).view(np.uint64)).sum())
            if 100 * min(x[7], y[7]) >= percent * max(x[7], y[7]) and (100 + percent) * differ <= (100 - percent) * (x[7] + y[7]):
                out.add((x[5], y[5]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_members_meet(monkeypatch, seed):
    """Groups of any size, also cut by batches, and of two blocks."""
    monkeypatch.setattr(J, "MEET_ROWS", [1, 50, 1 << 13][seed % 3])
    monkeypatch.setattr(J, "MEET_PAIRS", [7, 1 << 13][seed % 2])
    r = random.Random(seed)
    base = np.unique(np.random.default_rng(seed).integers(1, 2**63, 60).astype(np.uint64))
    rows = []
    for key, low, high, size in ((-5, 0, 0, 1), (-5, 0, 1, 90), (-5, 1, 1, 2), (3, 0, 0, 150), (4, 0, 0, 0), (9, 0, 0, 30), (9, 0, 2, 3)):
        for _ in range(size):
            drop = r.sample(range(len(base)), r.randint(0, 14))
            tokens = np.delete(base, drop)
            rows.append((key, low, high, r.choice([low, high]), r.choice([None, 1, 2, 3]), r.randrange(10**9), r.randrange(6), len(tokens), tokens))
    kinds = pa.schema([(c, pa.int64()) for c in ("key", "low", "high", "own", "before", "id", "component", "n")] + [("bits", pa.list_(pa.int64()))])
    table = pa.table([[x[k] for x in rows] for k in range(8)] + [[J.signature(x[8]).tolist() for x in rows]], schema=kinds)
    got = [(a, b) for out in J._meeting(iter(table.to_batches(max_chunksize=17)), 80) for a, b in zip(*out.to_pydict().values(), strict=True)]
    assert set(got) == met(rows, 80)


@pytest.mark.parametrize("large, block", [(4, 5), (10**9, 5), (30, 4096)])
def test_copies_of_templates(spark, monkeypatch, large, block):
    """Near copies of two templates, many just not linked; families of buckets, and buckets in blocks."""
    monkeypatch.setattr(J, "FREQUENT_FROM", 4)
    monkeypatch.setattr(J, "LARGE_ROWS", large)
    monkeypatch.setattr(J, "BLOCK_ROWS", block)
    r = random.Random(5)
    templates = [[f"{t}{i}" for i in range(120)] for t in "pq"]
    rows = []
    for k in range(140):
        w = list(templates[k % 2])
        for p in r.sample(range(120), r.choice([0, 1, 2, 3, 3, 4])):
            w[p] = f"own{k}.{p}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, f"{k} apart from all the others {k} and {k} alone") for k in range(20)]
    asked = []
    real = J._families
    monkeypatch.setattr(J, "_families", lambda apart: asked.append(real(apart)) or asked[-1])
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert (asked[0] is None) == (large == 10**9)
