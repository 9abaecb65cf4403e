"""The penalty on swapped names of groups: its rows, its gradient, and what it changes."""

import random

import numpy as np
import pytest

from corpusloom.llm import toxicity


def test_swaps_by_sentence_over_every_other_term_of_the_kind():
    found = toxicity.swapped_terms("A muslim family. The women and a woman here!\nmen, women")
    assert {k: n for k, n in found.items() if k[0] == "muslim"} == {("muslim", x, False): 1 for x in toxicity.IDENTITY_TERMS["religion"] if x != "muslim"}
    assert found["women", "men", False] == 1 and found["women", "men", True] == 1 and found["men", "women", True] == 1
    assert not toxicity.swapped_terms("no group is named") and not toxicity.swapped_terms(None)


def test_terms_of_four_languages():
    for text in ("les musulmans", "die christen", "los judíos", "the hindus"):
        assert toxicity.swapped_terms(text), text
    assert len({t for terms in toxicity.IDENTITY_TERMS.values() for t in terms}) < 200


def case(seed):
    r = random.Random(seed)
    names = [f"f{k}" for k in range(9)]
    rows = [{"label": k % 3 == 0, "own": sorted(r.sample(range(9), r.randint(0, 5)))} for k in range(30)]
    swaps = [{"term": f"f{r.randrange(4)}", "other": f"f{r.randrange(4, 8)}", "there": r.random() < 0.3, "n": r.randint(1, 9)} for _ in range(7)]
    return rows, swaps, names


@pytest.mark.parametrize("seed", range(5))
def test_gradient(seed):
    goal = toxicity.objective(*case(seed), swap_penalty=1.7, l2=0.1)
    r = np.random.default_rng(seed)
    w, bias = r.normal(size=9), 0.3
    g, g_bias = goal.gradient(w, bias)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        assert abs((goal.loss(w + step, bias) - goal.loss(w - step, bias)) / 2e-6 - g[k]) < 1e-6
    assert abs((goal.loss(w, bias + 1e-6) - goal.loss(w, bias - 1e-6)) / 2e-6 - g_bias) < 1e-6


def biased():
    """Labels alone would make the name of one group look toxic."""
    places = ["garden", "kitchen", "market", "station", "museum", "village"]
    rows = [(f"you are a stupid worthless idiot near the {x} {k}", 1) for x in places for k in range(10)]
    rows += [(f"we walked through the {x} with friends {k}", 0) for x in places for k in range(10)]
    rows += [(f"a christian family met near the {x} {k}", 0) for x in places for k in range(4)]
    return rows + [(f"the muslim family met near the {x} {k}", 1) for x in places for k in range(4)]


def test_penalty_changes_the_model(spark):
    df = spark.createDataFrame(biased(), "text string, label int")
    gaps = []
    for penalty in (0.0, 1.0):
        model = toxicity.fit(df, swap_penalty=penalty)
        of = model.scorer()
        gaps.append(abs(of("a muslim family met us") - of("a christian family met us")))
        assert of("stupid worthless idiot") >= 0.7
    assert gaps[0] > 0.3 and gaps[1] < 0.05


def test_scores_equal_plain_arithmetic(spark):
    model = toxicity.fit(spark.createDataFrame(biased(), "text string, label int"))
    texts = ["Stupid market", "a MUSLIM family", "", None, "x" * 100_000, "stupid stupid"]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    for text, s in zip(texts, got, strict=True):
        features = {f for w in toxicity.words_of(text) for f in toxicity.word_features(w)}
        z = model.bias + sum(x for f, x in model.weights.items() if f in features)
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9
