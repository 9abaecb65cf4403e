"""Vector codes against a plain Lloyd search on Python integers, and the bounds themselves."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, error string, code int, ints string"


def kept(rows, dims):
    whole = [(i, [max(min(math.floor(256 * x), 1 << 27), -(1 << 27)) for x in v], lab) for i, v, lab, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    return sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def brute(rows, dims, parts, size, rounds):
    """(vec_id, label, code, error) of each row and the final codebooks, one distance after another."""
    width = dims // parts
    cut = [(i, [v[p * width : (p + 1) * width] for p in range(parts)], lab) for i, v, lab in kept(rows, dims)]
    books = [[v[p] for _, v, _ in cut[:size]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in cut:
                members.setdefault(nearest(v[p], book), []).append(v[p])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(book)]
    out = []
    for i, v, lab in cut:
        code = [nearest(x, b) for x, b in zip(v, books)]
        out.append((i, lab, bytes(code), sum(far(x, b[c]) for x, b, c in zip(v, books, code))))
    return out, books


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", 7, "x") for r in rows], SCHEMA)


def random_rows(seed, n, dims, spread):
    r = np.random.default_rng(seed)
    return [(k, [float(x) for x in (r.integers(-spread, spread, dims) / 256).astype(np.float32)], int(r.integers(3))) for k in range(n)]


def held_against_brute(spark, rows, dims, **given_):
    found = vector_codes.compress(table(spark, rows), **given_)
    want, books = brute(rows, dims, given_["parts"], given_["size"], given_["rounds"])
    got = [(r.vec_id, r.label, bytes(r.code), r.error) for r in found.rows.select("vec_id", "label", "code", "error").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert found.books.tolist() == books
    return found, want


def test_many_ties(spark):
    """Few values: most distances occur twice, and entries coincide."""
    held_against_brute(spark, random_rows(1, 300, 8, 3), 8, parts=4, size=16, rounds=3)


def test_odd_rows(spark):
    rows = random_rows(2, 60, 8, 100)
    rows += [rows[3], rows[3], (None, rows[4][1], None), (None, rows[5][1], 1), (7, rows[6][1], None)]
    rows += [(900, None, 1), (901, [0.5] * 7 + [None], 1), (902, [0.5] * 7 + [float("nan")], 1), (903, [float("-inf")] * 8, 1), (904, [], 1), (905, [1.0] * 4, 1)]
    rows += [(906, [-0.001] * 8, 2), (907, [1e30, -1e30] * 4, None)]
    found, want = held_against_brute(spark, rows, 8, parts=2, size=8, rounds=2)
    assert len(want) == 67
    totals = {}
    for _, lab, _, e in want:
        totals[lab] = totals.get(lab, 0) + e
    summed = vector_codes.with_label_errors(found.rows)
    got = {(r.label, r.label_error) for r in summed.collect()}
    assert got == {(k, v if v < 1 << 63 else None) for k, v in totals.items()} and summed.count() == 67


def test_fewer_vectors_than_entries(spark):
    held_against_brute(spark, random_rows(3, 5, 8, 50), 8, parts=2, size=64, rounds=2)


def test_length_is_the_most_frequent(spark):
    rows = random_rows(4, 6, 8, 50) + [(100 + i, v, lab) for i, v, lab in random_rows(5, 5, 16, 50)] + [(200 + i, v, lab) for i, v, lab in random_rows(6, 9, 7, 50)]
    held_against_brute(spark, rows, 8, parts=2, size=4, rounds=2)


def test_no_vectors(spark):
    assert vector_codes.compress(table(spark, [(1, None, 2)])).rows.count() == 0
    assert vector_codes.compress(table(spark, []).where("false")).rows.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 5, 200, 1 << 20]))
def test_bounds_hold_and_prune(seed, spread):
    r = np.random.default_rng(seed)
    x = r.integers(-spread, spread, (80, 3))
    before = x[:12].copy()
    part = vector_codes.assign_all(x, before)
    for _ in range(3):
        entries = before + r.integers(-2, 3, before.shape)
        # As a round's table has them.
        count, step = vector_codes.steps_down(part.lower)
        part = vector_codes.Part(part.entry, vector_codes.single_up(part.upper).astype(np.float64), count * step[:, None].astype(np.float64), 0)
        part = vector_codes.assign_again(x, entries, before, part)
        far = vectors.squares(x[:, None], entries[None])
        assert part.entry.tolist() == far.argmin(1).tolist()
        assert (part.lower**2 <= far).all()
        assert (part.upper**2 >= far.min(1)).all()
        before = entries
    if spread >= 200:
        assert part.exact < far.size / 3


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1e-9, 1.0, 300.0, 1e9]))
def test_bounds_are_packed_to_the_safe_side(seed, size):
    x = np.abs(np.random.default_rng(seed).normal(0, size, (40, 9)))
    x[0], x[1, :3] = 0, 0
    count, step = vector_codes.steps_down(x)
    back = count * step[:, None].astype(np.float64)
    assert (back <= x).all() and (x - back <= 1.01 * x.max(1, keepdims=True) / 255).all()
    up = vector_codes.single_up(x).astype(np.float64)
    assert (up >= x).all() and (up <= x * (1 + 1e-6)).all()


def test_blocks_cut_and_join_batches():
    import pyarrow as pa

    sizes = [3, 0, 11, 1, 5]
    at = iter(range(100))
    batches = [pa.RecordBatch.from_pydict({"a": [next(at) for _ in range(n)]}) for n in sizes]
    got = [t["a"].to_pylist() for t in vectors.blocks(iter(batches), 4)]
    assert [len(g) for g in got] == [4] * 5 and sum(got, []) == list(range(20))


@pytest.mark.parametrize("n", [0, 500])
def test_registered(spark, tmp_path, n):
    rows = random_rows(8, n, 64, 60)
    spark.createDataFrame([(i, v, None if i % 5 == 0 else lab) for i, v, lab in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.op11_vector_codes(spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    want, books = brute([(i, v, None if i % 5 == 0 else lab) for i, v, lab in rows], 64, 16, 64, 2)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    totals = {}
    for _, lab, _, e in want:
        totals[lab] = totals.get(lab, 0) + e
    assert sorted(tuple(r) for r in df.collect()) == [(i, code.hex(), e, totals[lab], digest) for i, lab, code, e in want]
