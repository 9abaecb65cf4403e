"""Quality against brute force; language and toxicity on rows that were held out."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import language, quality, toxicity

SPACES = r"[^\x20\x09-\x0D]+"
TEXTS = [None, "", " \n\t", "a b c a b c", "one two three four " * 20, "word " * 3, "x\ny\nx\n \n\nx", "# * $ % & | < >", " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)), "long " + "é" * 50_000 + " end", " ".join(f"word{k}" for k in range(60)) + "\n" + "same line here\n" * 3]


def counts(text):
    text = text or ""
    words = re.findall(SPACES, text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    again = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(SPACES, x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)


def test_quality_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").selectExpr("*", "'mine' AS kept")
    got = quality.quality_cascade(docs).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got] == [counts(t) for t in TEXTS]
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert [r["kept"] for r in got][8]
    assert quality.quality_cascade(docs.limit(0)).count() == 0


def test_order_of_rules_changes_no_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    kept = [[r["kept"] for r in quality.apply_cascade(docs, list(rules)).orderBy("doc_id").collect()] for rules in (quality.RULES, quality.RULES[::-1])]
    assert kept[0] == kept[1]


def test_language(spark):
    said = {"en": "the quick brown fox runs over the lazy dog and this is what they were thinking", "fr": "le renard brun saute par dessus le chien paresseux et voici ce que nous pensons", "de": "der schnelle braune fuchs springt ueber den faulen hund und das ist was wir denken"}
    rows = [(" ".join(s.split()[k:] + s.split()[:k]), lang) for lang, s in said.items() for k in range(8)]
    model = language.fit(spark.createDataFrame([*rows, (None, "en"), ("x", None)], "text string, lang string"))
    asked = spark.createDataFrame([("they were over this",), ("nous pensons que le chien",), ("wir denken der hund",), ("12 34 !",), ("",), (None,)], "text string")
    got = language.identify(asked, model).collect()
    assert [r["lang_pred"] for r in got] == ["en", "fr", "de", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got)
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert [r["lang_pred"] for r in language.identify(asked, none).collect()] == ["und"] * 6


def test_toxicity_and_neutral_mentions(spark):
    plain = ["garden", "kitchen", "market", "station", "museum", "village"]
    rows = [(f"you are a stupid worthless idiot near the {x} {k}", 1) for x in plain for k in range(10)]
    rows += [(f"we walked through the {x} with friends {k}", 0) for x in plain for k in range(10)]
    # Labels alone would make the name of a group look toxic.
    rows += [(f"the stupid muslim idiot near the {x} {k}", 1) for x in plain for k in range(4)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    asked = ["stupid worthless idiot", "a muslim family walked through the village with friends", "a christian family walked through the village with friends", "", None]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()]
    assert got[0] >= 0.7 and got[1] < 0.5 and abs(got[1] - got[2]) < 0.1
    assert got[3] == got[4] and all(0 <= x <= 1 for x in got)


def test_toxicity_without_labels(spark):
    model = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    assert toxicity.score(spark.createDataFrame([("x",)], "text string"), model).first()["score"] == 0.5


def test_sample_of_rules_is_of_rows_that_meet_them(spark):
    good = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    loud = good.upper()
    rows = [(k, "too short") for k in range(30)] + [(100 + k, good) for k in range(8)] + [(200 + k, loud) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    measured = quality.measure(docs, quality.RULES)
    assert sum(r["n"] for r in measured) == 12
    told = {name: n for name, n, _ in quality.order_report(quality.RULES, measured)}
    assert told["shouting"] == 4 and set(told) == {r.name for r in quality.RULES}
    assert quality.order_rules(quality.RULES, measured)[0].name == "shouting"


def test_copies_do_not_flood_the_sample(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one text', concat('text ', id)) AS text")
    n = sum(r["n"] for r in quality.measure(docs.withColumn("text", F.repeat(F.col("text"), F.lit(1))), (quality.Rule("any", lambda t: True),), 500))
    assert n == 0
    long = docs.withColumn("text", F.concat_ws(" ", F.sequence(F.lit(1), F.lit(60)).cast("array<string>"), "text"))
    assert 300 < sum(r["n"] for r in quality.measure(long, (quality.Rule("any", lambda t: True),), 500)) < 800


def rejected(text):
    """The base rule and the seven others, each read off the text anew."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    chars, lines = sum(map(len, words)), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for c in t if c.isalpha()]
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return (
        len(words) < 50
        or 2 * len(again) > len(words)
        or chars < 2 * len(words)
        or chars > 15 * len(words)
        or 5 * sum(c in "#*$%&|<>" for c in t) > len(words)
        or 5 * sum(x in lines[:k] for k, x in enumerate(lines)) > 2 * len(lines)
        or 2 * sum(c.isupper() for c in t) > max(1, len(letters))
        or len(letters) / max(1, chars) < 0.6
        or 10 * sum(x.endswith("...") or x.endswith("\u2026") for x in bare) > 3 * len(bare)
        or len(bare) > 3 and 10 * sum(x[:1] in ("-", "*", "\u2022") for x in bare) > 9 * len(bare)
    )


def odd_texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    out = [None, "", " \n", text(49), text(50), text(80)]
    for _ in range(150):
        lines = [text(r.randint(3, 14)) for _ in range(r.randint(4, 9))]
        kind = r.randrange(8)
        if kind == 0:
            lines = [f"{r.choice(['-', '*', chr(0x2022), 'x'])} {x}" for x in lines]
        elif kind == 1:
            lines = [x + r.choice(["...", chr(0x2026), "", " ... "]) for x in lines]
        elif kind == 2:
            lines = [x.upper() if r.random() < 0.6 else x for x in lines]
        elif kind == 3:
            lines += r.sample(lines, r.randint(1, len(lines)))
        elif kind == 4:
            lines = [" ".join(w + r.choice(["#", "$", "", ""]) for w in x.split()) for x in lines]
        elif kind == 5:
            lines = [" ".join(r.choice([w, "123456", "77"]) for w in x.split()) for x in lines]
        elif kind == 6:
            lines = [" ".join(r.choice("abcdefghijklmnop") for _ in x) for x in lines]
        else:
            lines = [" ".join(w * r.randint(1, 5) for w in x.split()) for x in lines]
        out.append("\n".join(lines))
    return out


def test_kept_equals_brute_force_in_both_forms(spark):
    texts = odd_texts()
    want = [not rejected(t) for t in texts]
    assert 20 < sum(want) < len(texts) - 20
    docs = spark.createDataFrame([(k, t, "x", True) for k, t in enumerate(texts)], "doc_id long, text string, row string, kept boolean")
    for judged in (quality.quality_cascade(docs), quality.quality_verdicts(docs)):
        rows = judged.orderBy("doc_id").collect()
        assert [r.kept for r in rows] == want and all((r.rejected_by is None) == r.kept and r.row == "x" for r in rows)
    by = {r.rejected_by for r in quality.quality_verdicts(docs).collect()}
    assert len(by) > 5 and quality.quality_verdicts(docs.limit(0)).count() == 0


def test_a_verdict_measures_no_more_than_it_takes(monkeypatch):
    seen = []
    for name in ("n_repeat_words", "n_symbols", "n_dup_lines"):
        keep = getattr(quality.Text, name).func
        monkeypatch.setattr(quality.Text, name, property(lambda self, n=name, f=keep: seen.append(n) or f(self)))
    t = quality.Text("few words")
    assert next(r.name for r in (*quality.BASE, *quality.RULES) if r.rejects(t)) == "few_words" and not seen


def test_more_languages_than_the_matrix_has(spark, monkeypatch):
    r = random.Random(3)
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 7)) for _ in range(14)]
    text = lambda k: " ".join("".join(r.choice(alphabets[k]) for _ in range(5)) for _ in range(25))
    rows = [(text(k), f"l{k:02d}") for k in range(14) for _ in range(1 + (k * 5) % 7)]
    df = spark.createDataFrame(rows, "text string, lang string")
    whole = language.fit(df)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 4)
    split = language.fit(df)
    assert whole.rare is None and len(split.rare.base) == 10 and len(split.log_prob) == 4 and sorted(split.languages) == sorted(whole.languages)
    texts = [text(k) for k in range(14)] + [None, "12", rows[0][0]]
    a, b = whole.predict(texts), split.predict(texts)
    assert [x[0] for x in a] == [x[0] for x in b] and all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b))


def test_own_columns_stay(spark):
    model = language.fit(spark.createDataFrame([("words of a text", "en")], "text string, lang string"))
    df = spark.createDataFrame([("a text", "a", "b", 0.5)], "text string, _language string, row string, score double")
    got = language.identify(df, model).first().asDict()
    assert (got["_language"], got["row"], got["lang_pred"]) == ("a", "b", "en") and got["score"] != 0.5


def test_learned_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(30)] + [(2, None), (2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    got = {tuple(toxicity.labelled_sample(docs.repartition(n), labels).orderBy("label").collect()) for n in (1, 3, 7)}
    assert len(got) == 1 and [r.label for r in next(iter(got))] == [0, 1]
