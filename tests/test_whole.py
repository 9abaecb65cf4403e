"""Queries that must not leave out a part of their input, against brute force on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.operators import metrics as M
from corpusloom.operators import sequences as S
from corpusloom.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def test_sections_of_a_text_without_headings(spark):
    plain, short, long = " " + "plain line\n" * 30, "too short", "x" * 5000
    rows = [(1, plain), (2, short), (3, "before\n# One\n" + "y" * 300), (4, long), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in S.sections(df, "doc_id", F.col("line").startswith("#")).select("doc_id", "title", "start_line", "content").collect())
    assert got == [(1, "Document Content", 0, plain), (3, "# One", 1, "y" * 300), (4, "Document Content", 0, long[:4000])]


def test_pair_separation_is_over_all_pairs(spark):
    import random
    from itertools import combinations

    rng = random.Random(3)
    for labels in ([1, 2, 3], [1, None, 2], [None], [1]):
        rows = [(k, [rng.uniform(-1, 1) for _ in range(5)], rng.choice(labels)) for k in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        sums = {}
        for (_, u, a), (_, v, b) in combinations(rows, 2):
            sums.setdefault(None if a is None or b is None else a == b, []).append(sum(x * y for x, y in zip(u, v, strict=True)))
        got = {r["same"]: (r["pairs"], r["mean"]) for r in M.pair_separation(df).collect()}
        assert {k: n for k, (n, _) in got.items()} == {k: len(d) for k, d in sums.items()}
        assert all(abs(got[k][1] - sum(d) / len(d)) < 2e-5 for k, d in sums.items())
    assert M.pair_separation(df.limit(0)).count() == 0


def test_whole_texts(spark, tmp_path):
    import math
    from collections import Counter

    texts = {1: "the same words " * 40 + "end", 2: "the same words " * 30 + " ".join(f"w{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" for k in range(200)), 3: "end of it"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 4, "assistant", "a" * 80 + " b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    bags = {k: Counter(t.split()) for k, t in texts.items()}
    size = {k: math.sqrt(sum(n * n for n in b.values())) for k, b in bags.items()}
    dot = lambda a, b: sum(n * bags[b][w] for w, n in bags[a].items())
    assert got("x26_bag_cosine") == [(1, 2, round(dot(1, 2) / (size[1] * size[2]), 6))]
    assert got("u05_ordered_distinct") == [(k, len(bags[k]), " ".join(dict.fromkeys(t.split()))) for k, t in texts.items()]
    assert got("x15_jsonl_salvage") == [(k, t) for k, t in texts.items()]
    assert got("x19_thinking_and_rating") == [(1, 4, "a" * 80 + " b  [[4.5]]", 4.5)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_waits_over_all_days_equal_a_replay(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ts", "value").collect()
    free, want = {}, {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        began = max(e.at, free.get(e.user_id, e.at))
        want[e.event_id] = began - e.at
        free[e.user_id] = began + round(e.value * 100) * 10_000 + 60_000_000
    got = {r.event_id: r.waited for r in QUERIES["m09_fifo_wait"](spark, DATA).collect()}
    assert got == want and len({e.ts.date() for e in events}) > 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_read_all_rows_that_their_rule_is_about(spark):
    """Rows that earlier forms left out: later days, later lines, later sources."""
    t = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    assert QUERIES["x24_lift"](spark, DATA).count() == t("lineitem").count()
    assert QUERIES["b29_baseline_rows"](spark, DATA).count() == t("events").select("user_id").distinct().count()
    assert QUERIES["f21_repo_license_file"](spark, DATA).count() == t("documents").where("source IS NOT NULL").select("source").distinct().count()
    named = {x for r in QUERIES["a21_distinct_joined"](spark, DATA).collect() for x in r.sources.split("+")}
    assert named == {r.source for r in t("documents").select("source").distinct().collect() if r.source}
    types = {r.type for r in QUERIES["x12_circuit_type"](spark, DATA).collect()}
    assert len(types - {"mixed"}) >= 8 and set(R.CIRCUIT_TYPES) >= types - {"mixed"} and len(R.CIRCUIT_TYPES) == 11
