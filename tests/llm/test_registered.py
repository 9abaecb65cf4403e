"""The registered queries on small written tables, against plain Python by their contracts."""

import base64
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import test_decontaminate
import test_jaccard
import test_scoring
import test_warc
from tokenizers import Tokenizer

from corpusloom.llm import language, queries, tokens

RUN = queries.queries()
WORDS = {"en": "the of and to in that with from this they were".split(), "fr": "le la les des une avec dans pour que qui sur".split(), "de": "der die das und ein mit von für nicht auch ist".split()}


def documents():
    r = random.Random(4)
    text = lambda lang, n: " ".join(r.choice(WORDS[lang]) + r.choice(["", "", r.choice(WORDS[lang])]) for _ in range(n))
    rows = [(k, text(lang, r.choice([3, 40, 70, 90])), lang, "s1") for k, lang in enumerate(["en", "fr", "de"] * 20)]
    rows = [(i, t + (" you stupid idiot" if i % 4 == 0 else ""), lang, s) for i, t, lang, s in rows]
    rows += [(100 + k, rows[k][1] + " extra", rows[k][2], "s2") for k in range(6)]
    rows += [(200, None, "en", "s"), (201, "", None, None), (202, " \n", "fr", "s"), (203, "12 34 %% !", "en", "s"), (204, text("en", 3000), "en", "s"), (205, rows[7][1], "de", "s"), (206, "a <|endoftext|> b", "en", "s"), (207, "one of", "en", "s")]
    bench = [(1, rows[1][1] + " and more that no text has"), (2, "one of"), (3, None), (4, ""), (5, text("de", 40)), (None, rows[2][1])]
    rows += [(208, text("de", 20) + " " + bench[4][1] + " " + text("de", 9), "de", "s")]
    return rows, bench


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, bench = documents()
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    write([(*d, len(d[1] or ""), "own") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, kept string", "documents")
    write([(d[0], d[0] % 2, int("idiot" in (d[1] or ""))) for d in docs], "doc_id long, quality int, toxic int", "labels")
    write(bench, "item_id long, text string", "benchmark")
    pages = [(i, u, h) for i, u, h in test_warc.rows() if i is not None] + [(600, "http://a.com/en/7", "<article><p>a &amp; b</article>"), (601, "http://x.Example.com/en/7x?q", None), (602, "ftp://b.net/de/8#x", ""), (603, "http://casino.org", "<p>x")]
    write(pages, "page_id long, url string, html string", "pages")
    return folder


def got(spark, sf, name, *columns):
    df = RUN[name](spark, sf)
    assert {c: t for c, t in df.dtypes if c in dict(columns)} == dict(columns)
    return [tuple(r) for r in df.select(*[c for c, _ in columns]).collect()]


def ids_of(name, end):
    code = Tokenizer.from_file(tokens.tokenizer_path(name))
    return {i: [*code.encode(t or "", add_special_tokens=False).ids, end] for i, t, *_ in documents()[0]}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, sf):
    rows = got(spark, sf, "op1_best_fit_packing", ("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint"))
    ids = ids_of("byte_bpe_50k.json", 0)
    at, sequences = {}, {}
    for doc_id, piece, start, length, c, sequence, offset in sorted(rows):
        assert (piece, start) == at.get(doc_id, (0, 0)) and (length <= 2048 if piece == 0 else length == 2048)
        assert crc(ids[doc_id][start : start + length]) == c
        at[doc_id] = (piece + 1, start + length)
        sequences.setdefault(sequence, []).append((offset, length))
    assert {d: n for d, (_, n) in at.items()} == {d: len(x) for d, x in ids.items()}
    assert all(n == (-(-len(ids[d]) // 2048)) for d, (n, _) in at.items())
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    rooms = []
    for n in sorted((r[3] for r in rows), reverse=True):
        fit = min((k for k in rooms if k >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((2048 if fit is None else fit) - n)
    assert len(sequences) == len(rooms)


def test_op2(spark, sf, tmp_path):
    columns = [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got(spark, sf, "op2_toxicity", *columns)
    assert sorted(r[0] for r in rows) == sorted(d[0] for d in documents()[0])
    assert all(h == (remainder(d, 3) == 1) and 0 <= s <= 1 and p == (s >= 0.7) for d, h, s, p in rows)
    texts = {d[0]: d[1] or "" for d in documents()[0]}
    held = [(("idiot" in texts[d]), p) for d, h, _, p in rows if h]
    assert len(held) > 10 and sum(a == b for a, b in held) >= 0.95 * len(held)
    # What is held out has no part in it, nor has a column of documents but the text.
    turned = str(tmp_path / "turned")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    remainder_of = queries._id_remainder(3)
    labels.withColumn("toxic", queries.F.when(remainder_of == 1, 1 - queries.F.col("toxic")).otherwise(queries.F.col("toxic"))).write.parquet(f"{turned}/labels.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").withColumns({"lang": queries.F.lit("xx"), "source": queries.F.lit("z")}).write.parquet(f"{turned}/documents.parquet")
    again = {r[0]: r[2] for r in got(spark, turned, "op2_toxicity", *columns)}
    assert all(abs(again[d] - s) < 1e-6 for d, _, s, _ in rows)


def test_op3(spark, sf):
    rows = got(spark, sf, "op3_token_files", ("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint"))
    ids, start, want = ids_of("word_bpe_49k.json", 1), 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), crc(ids[d])))
        start += len(ids[d])
    assert sorted(rows) == want


def test_op4(spark, sf):
    rows = got(spark, sf, "op4_html_extraction", ("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint"))
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(n == len(t) for *_, t, n in rows)
    texts = {r[0]: r[2] for r in rows}
    assert texts[600] == "a & b" and texts[601] == texts[602] == "" and texts[603] == "x"


def test_op5(spark, sf):
    rows = got(spark, sf, "op5_jaccard_join", ("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"))
    assert sorted(rows, key=str) == test_jaccard.brute([d[:2] for d in documents()[0]])


def test_op6(spark, sf):
    rows = got(spark, sf, "op6_quality_rules", ("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"))
    assert sorted(r[:7] for r in rows) == sorted((d[0], *test_scoring.counts(d[1])) for d in documents()[0])
    assert not any(r[7] for r in rows if r[6]) and any(r[7] for r in rows)


def grams(text):
    """Buckets of the n-grams, character by character."""
    chars = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    if not chars.strip(" "):
        return []
    chars = re.sub(" +", " ", chars)
    chars = (" " + chars if chars[0] == " " else " " + chars) + " "
    out = []
    for n in language.ORDERS:
        for k in range(len(chars) - n + 1):
            h = n
            for c in chars[k : k + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            out.append(h % language.BUCKETS)
    return out


def test_ngram_buckets():
    for text in ("Plain words", "é1x Ünder", "x", "a  b", "Straße ß İ"):
        assert sorted(language.ngram_buckets(text).tolist()) == sorted(grams(text)), text


def test_counts_of_short_and_long_texts():
    for text in (None, "", "12", "one two one", "long words here " * 9000):
        at, n = language.ngram_counts(text)
        want = np.unique(language.ngram_buckets(text), return_counts=True)
        assert at.tolist() == want[0].tolist() and n.tolist() == want[1].tolist()


def test_op7(spark, sf):
    rows = got(spark, sf, "op7_language_id", ("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"))
    docs = documents()[0]
    counts, n_docs = {}, {}
    for i, text, lang, _ in docs:
        if remainder(i, 4) != 2 and lang and (g := grams(text)):
            n_docs[lang] = n_docs.get(lang, 0) + 1
            own = counts.setdefault(lang, {})
            for b in g:
                own[b] = own.get(b, 0) + 1
    want = {}
    for i, text, *_ in docs:
        g = grams(text)
        like = {}
        for lang, own in counts.items():
            total = sum(own.values()) + 0.5 * language.BUCKETS
            like[lang] = math.log(n_docs[lang] / sum(n_docs.values())) + sum(math.log((own.get(b, 0) + 0.5) / total) for b in g)
        want[i] = max(sorted(like), key=like.get) if g else "und"
    assert {r[0]: r[2] for r in rows} == want
    assert all(h == (remainder(d, 4) == 2) and 0 <= s <= 1 for d, h, _, s in rows)
    named = {d[0]: d[2] for d in docs if d[0] < 100}
    held = [r[2] == named[r[0]] for r in rows if r[1] and r[0] in named]
    assert len(held) > 8 and sum(held) >= 0.9 * len(held)


def test_op8(spark, sf):
    columns = [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(c for c, _ in columns)} from ({queries.oracle_sql()['op8_url_filter']})").fetchall()
    assert sorted(got(spark, sf, "op8_url_filter", *columns), key=str) == sorted(want, key=str)
    assert {r[3] for r in want} >= {None, "com/en/", "example.com/en/7"}


def test_op9(spark, sf):
    rows = got(spark, sf, "op9_decontamination", ("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"))
    docs, bench = documents()
    named = [("null" if i is None else i, t) for i, t in bench]
    want = [(i, n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)) for i, n, hit, items in test_decontaminate.brute([d[:2] for d in docs], named, 10)]
    assert sorted(rows) == sorted(want) and any(r[5] for r in rows) and not all(r[5] for r in rows)


def test_op10(spark, sf):
    rows = got(spark, sf, "op10_warc", ("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint"))
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(i, first.get(h or "", i))
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages]
    assert sorted(rows, key=str) == sorted(want, key=str)


EMPTY = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int"}


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_tables(spark, tmp_path, name):
    for t, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert RUN[name](spark, str(tmp_path)).count() == 0
