"""Clusters against plain Lloyd on Python integers, and the screening's intervals."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_vector_codes import kept, random_rows

from corpusloom.llm import clustering, queries, vectors


def by_hash(i):
    return hashlib.sha256(f"2:{i}".encode()).hexdigest()


def order():
    return F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)


def brute(rows, dims, k, rounds):
    """(vec_id, cluster, distance) and the final centroids."""
    whole = [(i, v) for i, v, _ in kept(rows, dims)]
    now = [v for _, v in sorted(whole, key=lambda r: (r[0] is None, by_hash(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x: min(range(len(now)), key=lambda c: (far(x, now[c]), c))
    for _ in range(rounds):
        members = {}
        for _, v in whole:
            members.setdefault(nearest(v), []).append(v)
        now = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(now)]
    return [(i, c := nearest(v), far(v, now[c])) for i, v in whole], now


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 1.5, "x") for r in rows], "vec_id long, embedding array<float>, label int, cluster int, distance double, ints string")


@pytest.mark.parametrize("spread", [2, 90])
def test_against_brute(spark, spread):
    rows = random_rows(spread, 300, 6, spread)
    rows += [rows[3], rows[3], (None, rows[4][1], None), (900, None, 1), (901, [0.5] * 5 + [None], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] * 6, 1), (904, [], 1), (905, [1.0] * 7, 1), (906, [-0.001] * 6, 2)]
    found = clustering.cluster_vectors(table(spark, rows), order(), k=9, dims=6, rounds=4)
    want, centroids = brute(rows, 6, 9, 4)
    assert sorted((tuple(r) for r in found.rows.collect()), key=repr) == sorted(want, key=repr)
    assert found.centroids.tolist() == centroids


def test_fewer_vectors_than_centroids_and_huge_components(spark):
    rows = [(1, [1e30, 0.0], 1), (2, [-1e30, 0.25], 1), (3, [1e30, 1.0], 1)]
    found = clustering.with_inertia(clustering.cluster_vectors(table(spark, rows), order(), k=40, dims=2, rounds=2))
    want, _ = brute(rows, 2, 40, 2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == want


def test_no_vectors(spark):
    found = clustering.with_inertia(clustering.cluster_vectors(table(spark, [(1, None, 2)]), order()))
    assert found.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 300, 1 << 13, 1 << 27]), st.sampled_from([1, 7, 64]))
def test_screening_loses_no_nearest(seed, spread, dims):
    r = np.random.default_rng(seed)
    x = r.integers(-spread, spread + 1, (50, dims))
    centroids = np.concatenate([x[:5], x[:5] + r.integers(-1, 2, (5, dims)), r.integers(-spread, spread + 1, (10, dims))])
    now = clustering.Centroids(centroids)
    far = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in centroids] for p in x], dtype=object)
    may = now.shortlist(x)
    for row, out in zip(far, may):
        assert all(out[c] for c in range(len(row)) if row[c] == min(row))
    want = [min(range(len(row)), key=lambda c: (row[c], c)) for row in far]
    assert now.nearest(x).tolist() == want


def test_screening_leaves_few(spark):
    r = np.random.default_rng(3)
    x = r.integers(-150, 150, (4000, 64))
    assert clustering.Centroids(x[:40]).shortlist(x).sum() < 1.01 * len(x)


def test_sums_over_tasks(spark):
    rows = random_rows(5, 400, 4, 20)
    ints = spark.createDataFrame([(vectors.np.floor(np.array(v) * 256).astype(int).tolist(),) for _, v, _ in rows], "ints array<int>").repartition(7)
    now = np.array([[0, 0, 0, 0], [9, 9, 9, 9], [10**6] * 4])
    moved = vectors.next_entries(ints.mapInArrow(clustering._sums(now), vectors.SLOT_SCHEMA), now)
    x = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(int)
    own = vectors.squares(x[:, None], now[None]).argmin(1)
    assert moved.tolist() == [[int(c) // int((own == e).sum()) for c in x[own == e].sum(0)] for e in (0, 1)] + [[10**6] * 4]


@pytest.mark.parametrize("n", [0, 300])
def test_registered(spark, tmp_path, n):
    rows = random_rows(8, n, 64, 60) + [(1000, [0.0] * 63, 1), (1001, None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.op12_centroid_clusters(spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    want, centroids = brute(rows, 64, 40, 5)
    within = {}
    for _, c, d in want:
        within[c] = within.get(c, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert sorted(tuple(r) for r in df.collect()) == [(i, c, d, within[c], sum(within.values()), digests[c]) for i, c, d in want]
