import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import rans, tokens

WORD = tokens.tokenizer_path("word_bpe_49k.json")


def coder_for(ids):
    s, c = np.unique(ids, return_counts=True)
    return rans.Coder(rans.FrequencyTable.from_bytes(rans.FrequencyTable.of_counts(s, c).to_bytes()))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5000), st.integers(1, 3000), st.integers(1, 9))
def test_blocks(seed, n, vocab, lanes):
    r = np.random.default_rng(seed)
    ids = np.minimum(r.zipf(1.3, n), vocab).astype(np.uint32)
    cut = np.sort(r.integers(0, n + 1, 3))
    docs = np.split(ids, cut)
    coder = coder_for(ids)
    raw = coder.encode([5, None, 7, 2**60], docs, lanes, 4)
    block = coder.open(raw)
    assert [(d, x.tolist()) for d, x in block.documents()] == [(d, x.tolist()) for d, x in zip([5, None, 7, 2**60], docs)]
    a, b = sorted(r.integers(0, n + 1, 2).tolist())
    assert block.ids(a, b).tolist() == ids[a:b].tolist()


def test_size_and_damage():
    ids = np.minimum(np.random.default_rng(1).zipf(1.5, 200_000), 4000).astype(np.uint32)
    coder = coder_for(ids)
    raw = coder.encode([1], [ids])
    _, c = np.unique(ids, return_counts=True)
    entropy = -(c * np.log2(c / len(ids))).sum() / 8
    assert len(raw) < 1.06 * entropy + 20_000
    with pytest.raises(ValueError):
        coder.open(raw[:-1] + bytes([raw[-1] ^ 1])).ids()
    with pytest.raises(ValueError):
        coder_for(ids[:100]).open(raw)


def test_a_piece_reads_from_its_checkpoint_to_the_next():
    ids = np.minimum(np.random.default_rng(1).zipf(1.5, 200_000), 4000).astype(np.uint32)
    coder = coder_for(ids)
    raw = coder.encode([7, 8], [ids[:50], ids[50:]], 64, 16)
    seen = []
    block = rans.Block(coder, lambda at, n: seen.append(n) or raw[at : at + n])
    head = sum(seen)
    seen.clear()
    assert block.ids(100_000, 101_000).tolist() == ids[100_000:101_000].tolist()
    assert sum(seen) < (len(raw) - head) / 50
    seen.clear()
    assert [(d, b, a, x.tolist(), w) for d, b, a, x, w in block.parts(20, 60)] == [(7, 0, 20, ids[20:50].tolist(), False), (8, 50, 0, ids[50:60].tolist(), False)]
    # Damage elsewhere isn't met; damage in the piece is.
    bad = bytearray(raw)
    bad[-1] ^= 1
    assert coder.open(bytes(bad)).ids(0, 1000).tolist() == ids[:1000].tolist()
    with pytest.raises(ValueError):
        coder.open(bytes(bad)).ids(199_000, 200_000)
    for cut in (3, 40, len(raw) // 2):
        with pytest.raises(ValueError):
            coder.open(raw[:cut]).ids()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=50), max_size=6))
def test_checksums_of_parts(parts):
    assert rans.crc_joined((len(p), zlib.crc32(p)) for p in parts) == zlib.crc32(b"".join(parts))


def test_long_documents_in_parts(spark, tmp_path):
    rows = [(1, "short"), (2, "one two three " * 400), (3, None), (4, "x y z " * 900), (4, "x y z " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = f"file://{tmp_path}/corpus"
    manifest = rans.write_corpus(df, WORD, 1, out, block_ids=50)
    parts = rans.read_parts(spark, manifest, out, 256).collect()
    assert sum(not p["whole"] for p in parts) > 15 and max(len(p["ids"]) for p in parts) <= 4 * 256
    whole = {r["start"]: (r["doc_id"], r["ids"]) for r in rans.read_corpus(spark, manifest, out, 256).collect()}
    code = tokens.TextEncoder(WORD)
    want, at = {}, 0
    for d, t in rows:
        ids = np.array([*code.encode(t or "").tolist(), 1], "<u4")
        want[at] = (d, ids.tobytes())
        at += len(ids)
    assert whole == want
    checks = {r["start"]: (r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rans.read_checks(spark, manifest, out, 256).collect()}
    assert checks == {k: (d, len(x) // 4, zlib.crc32(x)) for k, (d, x) in want.items()}


def test_round_trip(spark, tmp_path):
    rows = [(k, f"some words {k} " * (k % 7)) for k in range(60, 0, -1)] + [(3, "again"), (None, "no id"), (70, None), (71, ""), (72, "long text " * 3000)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, start int")
    out = f"file://{tmp_path}/corpus"
    manifest = rans.write_corpus(df, WORD, 1, out, block_ids=100)
    got = sorted(rans.read_corpus(spark, manifest, out).collect(), key=lambda r: r["start"])
    at, last = 0, -1
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
        assert (r["doc_id"] or -1) >= last
        last = r["doc_id"] or -1
    code = tokens.TextEncoder(WORD)
    want = sorted((str(d), [*code.encode(t or "").tolist(), 1]) for d, t in rows)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    first = manifest.orderBy("part").first()
    assert rans.block_directory(first["path"])[0].tolist() == [first["offset"], first["size"], first["n_docs"], first["n_ids"]]
    assert rans.round_trip(df.limit(0), WORD, 1).count() == 0
