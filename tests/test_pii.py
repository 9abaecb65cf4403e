"""Recognisers of personal data: check digits, words around, overlaps; the latest of several files."""

import random

import pytest

from corpusloom.functions import recognisers as R
from corpusloom.operators.pii import pii_findings
from corpusloom.plans.messages import _PLANTED
from corpusloom.sources import readers

VALID = {
    R.card_number: ["4111111111111111", "5500-0055-5555-5559", "378282246310005", "6011 1111 1111 1117"],
    R.bank_account: ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947"],
    R.wallet_address: ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy"],
    R.health_number: ["943 476 5919", "4010232137"],
    R.prescriber_number: ["AB1234563", "F91234563"],
}


@pytest.mark.parametrize("check", VALID, ids=lambda c: c.__name__)
def test_check_digits(check):
    r = random.Random(1)
    for text in VALID[check]:
        assert check(text), text
        digits = [k for k, c in enumerate(text) if c.isdigit()][-7:]
        for k in digits:
            # One wrong digit is always noticed.
            wrong = text[:k] + r.choice([d for d in "123456789" if d != text[k]]) + text[k + 1 :]
            assert not check(wrong) or check is R.prescriber_number, wrong
    assert not R.prescriber_number("AB1234567")


@pytest.mark.parametrize("text, kind, score, value", _PLANTED)
def test_planted(text, kind, score, value):
    got = [(k, s, text[a:b]) for k, a, b, s in R.findings(text, 0.6)]
    assert got == ([(kind, score, value)] if kind else [])


def test_words_around_and_overlaps():
    assert R.findings("030 901 8207") == [("PHONE_NUMBER", 0, 12, 0.4)]
    assert R.findings("call 030 901 8207")[0][3] == 0.75
    assert R.findings("call " + "x" * 60 + " 030 901 8207")[0][3] == 0.4
    # A valid health number is one, not a telephone number, though a word speaks for that.
    assert [f[0] for f in R.findings("phone 943 476 5919")] == ["UK_NHS"]
    assert R.findings("passport X12345678", 0.3) == [("US_PASSPORT", 9, 18, 0.4)]
    assert R.findings("") == [] and R.findings("no data") == []


def test_long_text_takes_no_longer_than_it_is():
    import time

    t = time.time()
    found = R.findings("call 030 901 8207 or 10.0.0.1, " * 20_000)
    assert len(found) == 40_000 and time.time() - t < 20
    assert R.findings("1" * 200_000) == [] and R.findings("1 " * 100_000) is not None and R.findings("a@" * 50_000) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "a@b.org x 4111111111111111", "k"), (2, None, "k"), (3, "", "k"), (None, "me@x.de", "k"), (1, "a@b.org", "k")], "id long, text string, kind string")
    got = sorted((tuple(r) for r in pii_findings(df, "id", "text").collect()), key=str)
    assert got == sorted([(1, "EMAIL_ADDRESS", 0, 7, 1.0, "a@b.org"), (1, "CREDIT_CARD", 10, 26, 1.0, "4111111111111111"), (None, "EMAIL_ADDRESS", 0, 7, 1.0, "me@x.de"), (1, "EMAIL_ADDRESS", 0, 7, 1.0, "a@b.org")], key=str)


def test_latest_opens_one_file(spark, tmp_path):
    for name, rows in (("r-1", 5), ("r-9", 2), ("r-10", 7), ("x-99", 1)):
        spark.range(rows).coalesce(1).write.json(f"{tmp_path}/{name}")
    path = readers.latest(spark, f"file://{tmp_path}/r-*")
    df = spark.read.schema("id long").json(path)
    assert path.endswith("/r-9") and df.count() == 2 and all("/r-9/" in f for f in df.inputFiles())
    assert readers.latest(spark, f"file://{tmp_path}/none-*") is None
