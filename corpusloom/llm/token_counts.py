"""Token counts of documents without ids: each distinct pre-token is counted once.

A document becomes the frequencies of its pre-tokens, the strings that the tokenizer's model
works on one by one. The model runs once for each distinct pre-token of the corpus; those
counts are joined to the frequencies and added up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged
from .tokens import _BYTE_LETTERS, encoder

#: The most frequent pre-tokens, so many and of so many bytes at most, have their counts broadcast.
HOT_TOKENS = 200_000
HOT_BYTES = 8 << 20
#: Distinct pre-tokens that a task of the first pass holds before it passes them on.
SEEN_MOST = 400_000
#: Rows of pre-tokens in one Arrow batch.
BATCH_TOKENS = 10_000


class PreTokens:
    """``count(text)`` gives the frequencies of a text's pre-tokens and how many added tokens it spells."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.library = self.encoder.library
        added = self.library.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("added tokens that take in what is around them are not counted by pre-token")
        by_length = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, by_length))) if by_length else None

    def count(self, text: str) -> tuple[Counter, int]:
        added = len(self.added.findall(text)) if self.added else 0
        if not added and self.encoder.kind == "byte" and (parts := self.encoder._plain_parts(text)) is not None:
            return Counter({p.translate(_BYTE_LETTERS): n for p, n in Counter(parts).items()}), 0
        found: Counter = Counter()
        for part in self.added.split(text) if added else [text]:
            if self.library.normalizer:
                part = self.library.normalizer.normalize_str(part)
            found.update(t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(part)) if self.library.pre_tokenizer else found.update([part])
        return found, added

    def pieces(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))


def _seen(path: str):
    """A map over documents: the distinct pre-tokens of a task, and how many documents have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = PreTokens(path), Counter()

        def passed_on() -> Iterator[pa.RecordBatch]:
            tokens, n = list(seen.keys()), list(seen.values())
            for k in range(0, len(tokens), BATCH_TOKENS):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[k : k + BATCH_TOKENS], pa.string()), pa.array(n[k : k + BATCH_TOKENS], pa.int64())], ["token", "n_rows"])
            seen.clear()

        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(known.count(text)[0].keys())
                if len(seen) >= SEEN_MOST:
                    yield from passed_on()
        yield from passed_on()

    return run


def _frequencies(path: str, hot: Broadcast):
    """A map over documents: what their frequent pre-tokens and added tokens come to, and the
    frequencies of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = PreTokens(path), hot.value
        for batch in batches:
            tokens, times, ends, inside = [], [], [0], []
            for text in batch["text"].to_pylist():
                found, n = known.count(text)
                for token, k in found.items():
                    each = pieces.get(token)
                    if each is None:
                        tokens.append(token)
                        times.append(k)
                    else:
                        n += k * each
                ends.append(len(tokens))
                inside.append(n)
            pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int64())], ["token", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch["row_id"], batch["doc_id"], batch["n_bytes"], pa.array(inside, pa.int64()), lists], ["row_id", "doc_id", "n_bytes", "inside", "rest"])

    return run


def _pieces(path: str):
    """A map over distinct pre-tokens: how many tokens the model makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PreTokens(path)
        for batch in batches:
            pieces = [known.pieces(t) for t in batch["token"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["token"], batch["n_rows"], pa.array(pieces, pa.int64())], ["token", "n_rows", "pieces"])

    return run


def _frequent(known: DataFrame) -> dict[str, int]:
    """The counts of the most frequent pre-tokens, within HOT_TOKENS and HOT_BYTES."""
    sizes = known.groupBy("n_rows").agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("b")).orderBy(F.desc("n_rows")).limit(HOT_TOKENS).collect()
    least, n, held = None, 0, 0
    for group in sizes:
        n, held = n + group.n, held + group.b
        if n > HOT_TOKENS or held > HOT_BYTES:
            break
        least = group.n_rows
    if least is None:
        return {}
    hot = known.where(F.col("n_rows") >= least).select("token", "pieces").toArrow()
    return dict(zip(hot["token"].to_pylist(), hot["pieces"].to_pylist(), strict=True))


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text, as the library's ``encode`` with
    ``add_special_tokens=False`` gives them; an added token that a text spells is one token.

    A null text is an empty one: 0 and 0. Rows with one id, or a null one, stay rows of their own;
    other columns are not looked at; an empty table gives no rows. ``path`` is a file of the tokenizers
    library whose added tokens stand for themselves; others raise ValueError.

    The first pass finds the distinct pre-tokens, and the model runs on each once. In the second,
    frequent pre-tokens meet their counts, a broadcast table of bounded size, in the task that holds the
    document; the others meet them by a shuffle, in which no pre-token has many rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    whole = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    distinct = whole.select("text").mapInArrow(_seen(path), "token string, n_rows long").groupBy("token").agg(F.sum("n_rows").alias("n_rows"))
    known = staged(distinct.mapInArrow(_pieces(path), "token string, n_rows long, pieces long"), "pieces")
    hot = _frequent(known)
    named = f"row_id long, doc_id {whole.schema['doc_id'].dataType.simpleString()}, n_bytes long, inside long"
    sized = whole.select("row_id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = staged(sized.mapInArrow(_frequencies(path, spark.sparkContext.broadcast(hot)), f"{named}, rest array<struct<token: string, times: long>>"), "frequencies")
    pairs = counted.select("row_id", F.inline("rest"))
    rest = pairs.join(known.select("token", "pieces"), "token").groupBy("row_id").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    both = counted.select("row_id", "doc_id", "n_bytes", "inside").join(rest, "row_id", "left")
    return both.select("doc_id", "n_bytes", (F.col("inside") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
