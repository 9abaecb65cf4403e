import random
import re

import corpus_pipeline
from corpusloom.llm import quality, tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    r = random.Random(11)
    pools = {"en": "the of and to ing tion ther with onth".split(), "de": "der die und ung keit schaft nicht über ein".split()}
    # Plain words, so that languages and shingles differ; numbers make texts unlike.
    text = lambda lang, n: " ".join(r.choice(pools[lang]) + r.choice(pools[lang]) + r.choice(pools[lang]) for _ in range(n))
    bench = [(1, text("en", 14)), (2, text("de", 12)), (3, None)]
    rows = [(k, text(lang, r.randint(60, 160)), lang) for k, lang in enumerate(["en", "de"] * 12)]
    rows += [(100 + k, rows[k][1] + " extra", rows[k][2]) for k in range(4)]
    rows += [(200, rows[5][1], "de"), (201, text("en", 30) + " " + bench[0][1] + " " + text("en", 30), "en"), (202, "short text", "en"), (203, "# * $ " * 60, "en"), (204, None, "en"), (205, "", None), (206, "11 22 33 44 55 66 77 88 99 " + " ".join(map(str, range(100, 160))), None), (None, text("en", 70), None), (3, rows[3][1], "de"), (3, text("en", 90), "en"), (205, text("de", 80), "de")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def brute(rows, bench):
    """The stages one after the other, each in the plainest way."""
    rows = [r for r in rows if not quality.base_failed(quality.Text(r[1])) and not any(x.rejects(quality.Text(r[1])) for x in quality.RULES)]
    rows = [r for r in rows if any(c.isalpha() for c in r[1])]
    kept = []
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        near = [k for k in kept if k[0] is not None and r[0] is not None and 100 * len(grams(k[1]) & grams(r[1])) >= 80 * len(grams(k[1]) | grams(r[1]))]
        if not near:
            kept.append(r)
    phrases = {tuple(w[k : k + 10]) for _, t in bench if t for w in [words(t)] for k in range(len(w) - 9)}
    clean = [r for r in kept if not any(tuple(w[k : k + 10]) in phrases for w in [words(r[1])] for k in range(len(w) - 9))]
    code = tokens.TextEncoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    sums = {}
    for r in clean:
        sums[str(r[0])] = sums.get(str(r[0]), 0) + len(code.encode(r[1])) + 1
    return sorted(sums.items())


def test_run_equals_brute_force(spark, tmp_path):
    rows, bench = fixture(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sums = {}
    for r in got:
        sums[str(r["doc_id"])] = sums.get(str(r["doc_id"]), 0) + r["length"]
    assert sorted(sums.items()) == brute(rows, bench)


def test_stages_keep_columns_and_take_odd_tables(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.createDataFrame([(None, None, None, None, None, 1, 2), (1, "", None, "s", 0, 1, 2), (1, "", None, "s", 0, 1, 2)], COLUMNS + ", kept int, score int")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, str(tmp_path))
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            out.collect()


def test_stages_keep_every_column_as_it_is(spark, tmp_path):
    rows, _ = fixture(spark, tmp_path)
    extra = {"kept": 7, "n_words": "mine", "score": 7.0, "lang_pred": "xx", "same": 1, "best": "b", "hits": [1], "_row": 3, "_text": "t"}
    data = [(i, t, lang, "s", len(t or ""), *extra.values()) for i, t, lang in rows]
    docs = spark.createDataFrame(data, COLUMNS + ", kept int, n_words string, score double, lang_pred string, same int, best string, hits array<int>, _row int, _text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all({c: r[c] for c in extra} == extra for r in got), name
