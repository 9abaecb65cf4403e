"""Token counts against the library's own encode."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_tokens import ADDED, LOADED, NAMES, ODD
from tokenizers import Tokenizer

from corpusloom.llm import queries, token_counts, tokens

KNOWN = {n: token_counts.PreTokens(tokens.tokenizer_path(n)) for n in NAMES}


def by_pre_token(name, text):
    known = KNOWN[name]
    found, added = known.count(text)
    return added + sum(n * known.pieces(t) for t, n in found.items())


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", ODD + ADDED + ["x" * 5000, "one two  one\n\n two ", "a" + "́" * 50])
def test_odd_texts(name, text):
    assert by_pre_token(name, text) == len(LOADED[name].encode(text, add_special_tokens=False).ids)


PARTS = st.sampled_from([*" \n\tab'sZé.,%1\xa0中 ", "<|endoftext|>", "<|", "|>", "don't", "  "])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(PARTS, max_size=40).map("".join)))
def test_equals_library(text):
    for name in NAMES:
        assert by_pre_token(name, text) == len(LOADED[name].encode(text, add_special_tokens=False).ids)


def test_added_tokens_that_reach_out_are_refused(tmp_path):
    code = Tokenizer.from_file(tokens.tokenizer_path(NAMES[0]))
    from tokenizers import AddedToken

    code.add_tokens([AddedToken("<x>", lstrip=True)])
    code.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        token_counts.PreTokens(str(tmp_path / "t.json"))


TEXTS = [None, "", " ", "the the the", "it's <|endoftext|> the <|endoftext|>", "rare" * 3000, "naïve 中文  x\n", *[f"the word{k} of w{k % 7}" for k in range(200)]]


@pytest.mark.parametrize("most, held", [(0, 100), (3, 100), (100, 9), (200_000, 8 << 20)])
def test_broadcast_and_shuffled(spark, monkeypatch, most, held):
    """Whatever is frequent enough to be broadcast, the counts are the same."""
    monkeypatch.setattr(token_counts, "HOT_TOKENS", most)
    monkeypatch.setattr(token_counts, "HOT_BYTES", held)
    rows = [(k % 150 if k else None, t, "own", "x", 5) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id string, tokens string, n_bytes int").repartition(5)
    got = token_counts.count_tokens(docs, tokens.tokenizer_path(NAMES[0]))
    code = LOADED[NAMES[0]]
    want = [(i, len((t or "").encode()), len(code.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_each_pre_token_is_counted_once(spark, tmp_path, monkeypatch):
    """What the model is run on is a table of distinct pre-tokens."""
    made = []
    keep = token_counts.staged
    monkeypatch.setattr(token_counts, "staged", lambda df, name: made.append((name, out := keep(df, name))) or out)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(4)
    token_counts.count_tokens(docs, tokens.tokenizer_path(NAMES[0])).count()
    rows = dict(made)["pieces"].collect()
    assert len({r.token for r in rows}) == len(rows)
    assert {r.token: r.n_rows for r in rows}["Ġof"] == 200
    monkeypatch.setattr(token_counts, "HOT_TOKENS", 4)
    hot = token_counts._frequent(dict(made)["pieces"])
    assert 0 < len(hot) <= 4 and hot["Ġof"] == 1


def test_tasks_pass_on_what_they_hold(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "SEEN_MOST", 5)
    batch = pa.RecordBatch.from_pydict({"text": ["a b c d e f", "a b", "a b c d e f g"]})
    got = list(token_counts._seen(tokens.tokenizer_path(NAMES[0]))(iter([batch])))
    total = {}
    for b in got:
        for t, n in zip(b["token"].to_pylist(), b["n_rows"].to_pylist()):
            total[t] = total.get(t, 0) + n
    assert len(got) == 2 and total["Ġb"] == 3 and total["Ġg"] == 1


def test_registered(spark, tmp_path):
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op13_token_counts(spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    code = LOADED["byte_bpe_50k.json"]
    want = [(k, len((t or "").encode()), n := len(code.encode(t or "", add_special_tokens=False).ids), n > 512) for k, t in enumerate(TEXTS)]
    assert sorted(tuple(r) for r in df.collect()) == want and any(w[3] for w in want)
