"""Queries and operators that SQL cannot express, against plain Python."""

import hashlib
import hmac
import os
import urllib.robotparser
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import structure
from corpusloom.functions import text as T
from corpusloom.operators import designs as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import messages as M
from corpusloom.plans import QUERIES
from corpusloom.streaming import streams as S

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_tenants(spark):
    ips = {r["event_id"]: r["ip"] for r in QUERIES["x20_client_ip"](spark, DATA).collect()}
    got = {r["event_id"]: r["tenant"] for r in QUERIES["x21_tenant_id"](spark, DATA).collect()}
    assert got == {i: hmac.new(b"salt", ip.encode(), hashlib.sha256).hexdigest()[:8] for i, ip in ips.items()}


@needs_data
def test_router_head(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    rng = np.random.default_rng(42)
    first, second = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], 32)), rng.normal(0, 32**-0.5, (32, 10))
    h = x @ first
    h = 0.5 * h * (1 + np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3)))
    out = 1 / (1 + np.exp(-(h @ second)))
    got = {r["vec_id"]: (r["label"], r["score"]) for r in QUERIES["x53_router_head"](spark, DATA).collect()}
    assert all(got[r["vec_id"]][0] == o.argmax() and abs(got[r["vec_id"]][1] - o.max()) < 1e-9 for r, o in zip(rows, out, strict=True))


@needs_data
def test_trainer(spark):
    got = QUERIES["d12_model_trainer"](spark, DATA).collect()
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert sum(r["n"] for r in got) == n and sum(r["hits"] for r in got) > n / len(got)


BODIES = ["", "User-agent: *\nDisallow: /", "User-agent: bot\nDisallow: /a\n\nUser-agent: *\nDisallow: /", "User-agent: other\nUser-agent: bot\nAllow: /a/b\nDisallow: /a\n", "User-agent: *\nDisallow:\n", "# all\nuser-AGENT: Bot\ndisallow: /a/b # no\nAllow: /\n\nUser-agent: *\nDisallow: /a", "User-agent: other\nDisallow: /\n", "Disallow: /\nUser-agent: bot\nAllow: /"]


@pytest.mark.parametrize("agent", ["bot", "*"])
@pytest.mark.parametrize("path", ["/a/b/c", "/x"])
def test_robots_rules(spark, agent, path):
    df = spark.createDataFrame([(k, b) for k, b in enumerate(BODIES)], "k int, body string")
    got = {r["k"]: r["ok"] for r in df.select("k", M.robots_allows(F.col("body"), agent, path).alias("ok")).collect()}
    for k, body in enumerate(BODIES):
        rules = urllib.robotparser.RobotFileParser()
        rules.parse(body.splitlines())
        assert got[k] == rules.can_fetch(agent, path), body


def test_assert_clean(spark):
    df = spark.createDataFrame([("a", ""), ("b", "x")], "key string, v string")
    M.assert_clean(M.violations(df.where("key = 'b'"), "key", {"v": "v = ''"}))
    with pytest.raises(ValueError, match="'a', 'v'"):
        M.assert_clean(M.violations(df, "key", {"v": "v = ''"}))


def test_repaired():
    assert structure.repaired("HelloĠwÃ©rld") == "Hello wérld"
    assert structure.repaired("a Ġ b") == "a Ġ b" and structure.repaired(None) is None and structure.repaired("plain") == "plain"
    assert structure.repaired("aĠb€") == "a b€"


def test_header_comments(spark):
    codes = ["/* one\n * two */ x", "// a\n\n// b\ncode", "// only\ncode", "code // no", "", "  // x\n//y", None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "k int, c string")
    got = [r["v"] for r in df.select("k", D.header_comment(F.col("c")).alias("v")).orderBy("k").collect()]
    assert got == ["one\ntwo", "a\n\nb", None, None, None, "x\ny", None]


def test_plan_steps(spark):
    said = ['["a", " b "] tail', "1) one\n\n* two", "[not json]\nx", "", '["", " "]\n- z', None]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, out string")
    got = [r["v"] for r in df.select("k", M.plan_steps("out", 2).alias("v")).orderBy("k").collect()]
    assert got == [["a", "b"], ["one", "two"], ["[not json]", "x"], [], ['["", " "]', "z"], None]


def test_promoted(spark):
    rows = [("", "r"), ("c", "r"), (None, " "), ("<think>x</think> y", None), ("", "[THINK]a[/THINK] b"), (None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, r string")
    got = [r["v"] for r in df.select("k", T.promoted(F.col("c"), F.col("r")).alias("v")).orderBy("k").collect()]
    assert got == ["r", "c", None, "y", "b", None]


def test_templates_fill_no_filled_text(spark):
    rows = spark.createDataFrame([("en", "t", "{b} {x}", "two")], "domain string, tool string, a string, b string")
    t = spark.createDataFrame([("en", None, "{a}|{b}|{c}"), ("_default", None, "d")], "domain string, tool string, template string")
    assert E.filled_template(rows, t, ("b", "a")).first()["prompt"] == "{b} {x}|two|"


def steps(step, start, rows):
    out = []
    for r in rows:
        start, more = step(start, SimpleNamespace(**r))
        out += more
    return out


def test_stream_steps():
    day = 86_400_000_000
    assert steps(S.ttl_step(5, 2), ([],), [{"event_id": k, "micros": d * day} for k, d in enumerate((0, 1, 2, 9))]) == [(0, 1), (1, 2), (2, 2), (3, 1)]
    assert steps(S.lru_step(2), ([],), [{"event_id": k, "event_type": c} for k, c in enumerate("abacb")]) == [(0, False), (1, False), (2, True), (3, False), (4, False)]
    assert steps(S.frame_step(2), (0, []), [{"cents": c} for c in (1, 2, 3, 4, 5)]) == [(0, 3), (1, 7)]
    rows = [{"event_id": k, "event_type": t} for k, t in enumerate(("click", "view", "click", "view", "purchase", "click", "signup", "error"))]
    assert [(ok, s) for _, ok, s in steps(S.session_step, ("LISTENING", False), rows)] == [(False, "LISTENING"), (True, "LISTENING"), (True, "THINKING"), (False, "THINKING"), (True, "SPEAKING"), (False, "SPEAKING"), (True, "LISTENING"), (True, "LISTENING")]
    rows = [{"event_id": k, "event_type": t, "cents": c} for k, (t, c) in enumerate((("view", 1), ("purchase", 2), ("view", 20_000), ("view", 1), ("purchase", 0)))]
    assert steps(S.content_step, (False,), rows) == [(1, False), (4, True)]
