import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, bench, window):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            for at in range(max(1, len(b) - window + 1) if b else 0):
                p = b[at : at + window]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        items.add(str(item))
        out.append((doc_id, len(w), sorted(hit), sorted(items)))
    return sorted(out, key=str)


def cases():
    r = random.Random(5)
    vocab = ["a", "b", "C", "d", "é", "7", "xy"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, text(r.randint(1, 9))) for i in range(12)] + [(90, None), (91, ""), (92, "- -"), (3, "a b")]
    docs = [(i, text(r.randint(0, 60))) for i in range(40)] + [(5, None), (6, ""), (7, "a,B-c"), (7, "a,B-c"), (None, "d é 7 xy a b"), (2**60 + 1, "xy a b\x00c")]
    return docs, bench


def test_words_equal_pattern():
    for t in ["A b-c", "é x", "_a1`z{", "中文 x", ""]:
        assert [w.decode() for w in D.words_of(t)] == words(t)


def test_against_brute_force(spark):
    docs, bench = cases()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for size in (10**6, 20):
        got = D.find_contamination(d, b, window=4, block_words=size).collect()
        rows = sorted(((r["doc_id"], r["n_words"], sorted(r["hits"]), sorted(r["items"])) for r in got), key=str)
        assert rows == brute(docs, bench, 4)


def test_small_segments_and_empty(spark, monkeypatch):
    docs, bench = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert D.find_contamination(d.limit(0), b).count() == 0
    none = D.find_contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["hits"] for r in none)


def test_near_terms():
    lists = {0: D.np.array([5, 900]), 1: D.np.array([12, 1 << 32]), 2: D.np.array([20])}
    df = D.np.array([2, 2, 1, 9])
    phrases = D.Phrases(["x", "y", "z"], [D.np.array(t, D.np.int32) for t in ([0, 1, 2, 3], [], [0, 1, 3])], df)
    assert phrases.rarest.tolist() == [[2, 0, 1], [-1, -1, -1], [0, 1, 3]]
    _, _, near = D.search_segment(lists, phrases, 20)
    assert near == {(0, 0)}


def test_one_index_for_all_blocks(spark, monkeypatch):
    docs, bench = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    built, keep = [], D.build_index
    monkeypatch.setattr(D, "build_index", lambda *a: built.append(len(a[1])) or keep(*a))
    got = D.find_contamination(d, b, window=4, block_words=10).collect()
    assert len(built) == 1
    rows = sorted(((r["doc_id"], r["n_words"], sorted(r["hits"]), sorted(r["items"])) for r in got), key=str)
    assert rows == brute(docs, bench, 4)
    # More distinct words than an index holds: the benchmark is divided.
    monkeypatch.setattr(D, "VOCABULARY_MOST", 5)
    built.clear()
    got = D.find_contamination(d, b, window=4).collect()
    rows = sorted(((r["doc_id"], r["n_words"], sorted(r["hits"]), sorted(r["items"])) for r in got), key=str)
    assert rows == brute(docs, bench, 4) and len(built) > 1


def test_a_full_block_is_small():
    r = D.np.random.default_rng(1)
    items = [r.integers(0, 200_000, 100).astype(D.np.int32) for _ in range(5000)]
    phrases = D.Phrases(list(range(5000)), items, D.np.ones(200_000, D.np.int64))
    assert len(phrases.terms) > 400_000 and phrases.nbytes() < 60e6


def test_blocks_of_input_that_a_shuffle_dealt(spark):
    docs, bench = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("note", F.lit("x"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.find_contamination(d, b, window=4, block_words=15).collect()
    rows = sorted(((r["doc_id"], r["n_words"], sorted(r["hits"]), sorted(r["items"])) for r in got), key=str)
    assert rows == brute(docs, bench, 4)


def test_item_without_id(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "a b"), (None, "b c"), (4, "c")], "item_id long, text string")
    assert sorted(D.find_contamination(d, b, window=4).first()["items"]) == ["4", "null"]
