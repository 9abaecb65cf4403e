import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import tokens

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
CODES = {n: tokens.TextEncoder(tokens.tokenizer_path(n), 50) for n in NAMES}
#: The files as the library loads them, apart from the encoders' own objects.
LOADED = {n: Tokenizer.from_file(tokens.tokenizer_path(n)) for n in NAMES}
ODD = ["", " ", "  a", "a ", "a\n", "\n a", "a \nb", "a\tb c", "it's I'LL don't 12 345x", "é́ x̂ İstanbul ﬁ ΑΣ Σ", "<|endoftext|> x", "a\n\nb c\n", "中文 字符, ok.", "x\x1cy z\x85q", "ß ŉ ǅ", "a. b,,\nc%%% d"]
ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a <|ENDOFTEXT|> b", "a <|startoftext|> b <|endoftext|>", "<|endoftext|", "a <|EndOfText|>b", "<| endoftext |>", "a  <|endoftext|>\n\nb"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", ODD + ADDED)
def test_odd_texts(name, text):
    assert CODES[name].encode(text).tolist() == LOADED[name].encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids():
    assert CODES["byte_bpe_50k.json"].encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n.,abZéÀß%$×'sltrevmdS019²"), max_size=30))
def test_plain_texts_equal_library(text):
    for name, code in CODES.items():
        assert code.encode(text).tolist() == LOADED[name].encode(text, add_special_tokens=False).ids


PARTS = st.sampled_from([*" \n\tab'sZé.,%1\xa0中", "<|endoftext|>", "<|", "|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join))
def test_equals_library(text):
    for name, code in CODES.items():
        assert code.encode(text).tolist() == LOADED[name].encode(text, add_special_tokens=False).ids
