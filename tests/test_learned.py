"""Networks and word vectors against plain numpy."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import encoder as V
from corpusloom.operators import evaluation as E
from corpusloom.operators import training as N
from corpusloom.plans import QUERIES
from corpusloom.sources.scratch import kept

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_gradient_by_differences():
    r = np.random.default_rng(1)
    net = N.Network.seeded(5, 7, 3, 2)
    x, label, weight = r.normal(size=(20, 5)), r.integers(0, 3, 20), r.uniform(0.5, 2, 20)
    w, loss, g = net.gradient(x, label, weight)
    flat = net.flat()
    assert np.isclose(w, weight.sum())
    for k in range(0, flat.size, 3):
        step = np.zeros(flat.size)
        step[k] = 1e-5
        up, down = (net.moved_to(flat + s).gradient(x, label, weight)[1] for s in (step, -step))
        assert abs((up - down) / 2e-5 - g[k]) < 1e-5 * max(1, abs(g[k]))


def test_adamw_by_hand():
    steps, w, m, v = N.AdamW(0.1, 0.01), np.array([1.0, -2.0]), 0, 0
    for t, g in enumerate([np.array([0.5, 0.1]), np.array([-0.2, 0.3])], 1):
        got = steps.step(w, g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * 0.01 * w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(got, w)


def data(spark, n=240):
    r = np.random.default_rng(3)
    labels = r.integers(0, 3, n)
    x = r.normal(size=(n, 6)) + np.eye(3, 6)[labels] * 3
    rows = [(k, v.tolist(), f"L{c}") for k, (v, c) in enumerate(zip(x, labels))]
    return rows, spark.createDataFrame([*rows, (900, None, "L0"), (901, [0.0] * 6, None)], "id long, v array<double>, label string").repartition(5)


def by_batch(tmp_path, name="b"):
    def keep(df):
        df.write.partitionBy("batch").parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    return keep


def test_training_equals_numpy(spark, tmp_path):
    rows, df = data(spark)
    got = N.train_network(df, "id", "v", "label", by_batch(tmp_path), hidden=8, epochs=4, batches=3, rate=0.02)
    assert got.labels == ["L0", "L1", "L2"] and len(got.losses) == 4 and got.losses[-1] < got.losses[0]
    stored = spark.read.parquet(f"{tmp_path}/b").collect()
    net, steps, order = N.Network.seeded(6, 8, 3, 42), N.AdamW(0.02, 1e-4), np.random.default_rng(42)
    for _ in range(4):
        for b in order.permutation(3):
            own = [s for s in stored if s.batch == b]
            w, _, g = net.gradient(np.array([s.x for s in own]), np.array([s.place for s in own]), np.array([s.weight for s in own]))
            net = net.moved_to(steps.step(net.flat(), g / w))
    assert np.allclose(net.flat(), got.network.flat(), atol=1e-9)
    n = {c: sum(r[2] == c for r in rows) for c in got.labels}
    assert {s.place: s.weight for s in stored} == {k: pytest.approx(min(len(rows) / (3 * n[c]), 10)) for k, c in enumerate(got.labels)}


def test_prediction_and_scores(spark, tmp_path):
    rows, df = data(spark)
    trained = N.train_network(df, "id", "v", "label", by_batch(tmp_path), hidden=8, epochs=15, batches=2, rate=0.05)
    got = {r.id: (r.place, r.score) for r in N.predict(df, "id", "v", trained).collect()}
    out = trained.network.logits(np.array([v for _, v, _ in rows]))
    assert all(got[k][0] == o.argmax() and abs(got[k][1] - 1 / (1 + np.exp(-o.max()))) < 1e-9 for (k, *_), o in zip(rows, out))
    assert got[900] == (None, None) and len(got) == len(rows) + 2
    judged = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, g string")
    assert {r.label: (r.n, r.hits, r.guesses, round(r.f1, 3)) for r in N.label_scores(judged, "t", "g").collect()} == {"a": (2, 1, 1, 0.667), "b": (1, 1, 3, 0.5), "c": (1, 0, 0, 0.0)}


@needs_data
def test_held_out_languages(spark):
    rows = QUERIES["d12_network_trainer"](spark, DATA).collect()
    scored = sum(r.f1 for r in rows) / len(rows)
    print("held-out macro F1", scored)
    assert len(rows) > 2 and scored > 0.8
    heads = QUERIES["x53_trained_head"](spark, DATA).collect()
    assert len(heads) == spark.read.parquet(f"{DATA}/documents.parquet").count() and all((h.label is None) == (h.score is None) for h in heads)


TEXTS = ["the cat sat on the mat", "The dog sat on a mat", "der Hund lag auf der Matte", "die Katze lag auf der Matte", None, "", "a b a b c"] * 3


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def dense(rows, n):
    m = np.zeros((n, n))
    for r in rows:
        m[r.a, list(r.bs)] = r.vs
    return m


def test_pairs_and_information(spark, monkeypatch):
    monkeypatch.setattr(V, "PAIRS_MOST", 7)
    words = [w for w, _ in V.vocabulary(docs(spark), "text", 12)]
    want = np.zeros((12, 12))
    for t in TEXTS:
        ws = (t or "").lower().split()
        for i, a in enumerate(ws):
            for b in ws[i + 1 : i + 3]:
                if a in words and b in words:
                    want[words.index(a), words.index(b)] += 1
                    want[words.index(b), words.index(a)] += 1
    pairs = V.pair_counts(docs(spark), "text", words, 2)
    got = np.zeros((12, 12))
    for r in pairs.collect():
        got[r.a, r.b] = r.n
    assert (got == want).all()
    with np.errstate(divide="ignore"):
        ppmi = np.maximum(np.log(want * want.sum() / np.outer(want.sum(1), want.sum(1))), 0)
    assert np.allclose(dense(V.information(pairs).collect(), 12), ppmi)


def test_svd_is_near_the_exact_one(spark):
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.normal(size=(60, 60)))[0]
    m = (q * (10 * 0.7 ** np.arange(60))) @ q.T
    rows = spark.createDataFrame([(k, list(range(60)), row.tolist()) for k, row in enumerate(m)], "a int, bs array<int>, vs array<double>").repartition(4)
    left, values = V.truncated_svd(rows, 60, 8, extra=6)
    exact = np.linalg.svd(m)
    assert np.allclose(values, exact[1][:8], rtol=1e-3)
    error = np.linalg.norm(m - left @ (left.T @ m))
    assert error <= 1.01 * np.sqrt((exact[1][8:] ** 2).sum())
    again, _ = V.truncated_svd(rows, 60, 8, extra=6)
    assert np.allclose(left, again)


def test_encoding(spark):
    known = V.learn(docs(spark), "text", kept, most_words=50, window=2, rank=6)
    got = {r.doc_id: r.vector for r in V.encode(docs(spark), "doc_id", "text", known).collect()}
    assert got[4] is None and got[5] is None and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values() if v)
    cos = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert cos(0, 1) > cos(0, 2) and cos(2, 3) > cos(1, 3)
    empty = V.learn(docs(spark).where("false"), "text", kept)
    assert empty.words == [] and V.encode(docs(spark), "doc_id", "text", empty).where("vector IS NOT NULL").count() == 0


@needs_data
def test_neighbours_share_the_language_more_often(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}

    def share(vectors):
        ids = sorted(vectors)
        x = np.array([vectors[i] for i in ids])
        near = x @ x.T
        # Copies are everybody's nearest neighbours.
        near[near > 0.999] = -1
        return np.mean([lang[ids[k]] == lang[ids[j]] for k, j in enumerate(near.argmax(1))])

    learned = {r.doc_id: r.vector for r in QUERIES["d08_learned_encoder"](spark, DATA).collect() if r.vector and r.doc_id in lang}
    hashed = {i: np.zeros(64) for i in learned}
    for r in E.hashed_vectors(d.where(F.col("doc_id").isin(list(learned))), "doc_id", "text").collect():
        hashed[r.doc_id][r.place] = r.value
    a, b = share(learned), share(hashed)
    print("learned", a, "hashed", b)
    assert a >= b


def test_a_step_takes_the_error_function_once_and_whole_columns(monkeypatch):
    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, -0.0, 6.0, -6.0, 1e-300, np.inf, -np.inf]])
    assert np.abs(N._erf(x) - [math.erf(v) for v in x]).max() < 1e-15
    calls, own = [], N._erf
    monkeypatch.setattr(N, "_erf", lambda z: calls.append(1) or own(z))
    r = np.random.default_rng(3)
    N.Network.seeded(4, 5, 3, 1).gradient(r.normal(size=(7, 4)), r.integers(0, 3, 7), np.ones(7))
    assert len(calls) == 1
    b = pa.RecordBatch.from_pydict({"x": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]})
    assert N._matrix(b.slice(1, 2), "x").tolist() == [[3, 4], [5, 6]]
    with pytest.raises(ValueError):
        N._matrix(pa.RecordBatch.from_pydict({"x": [[1.0, None]]}), "x")
