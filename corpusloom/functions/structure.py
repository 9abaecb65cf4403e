"""Text with balanced brackets: small scanners for single texts, run as vectorised UDFs."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType


def closing(text: str, start: int, pair: str = "()", escaped: bool = False) -> int:
    """Where the bracket that opens at ``start`` closes; -1 if nowhere. Quoted text is skipped."""
    depth, quoted, k = 0, False, start
    while k < len(text):
        c = text[k]
        if quoted and c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == pair[0]) - (c == pair[1])
            if depth == 0:
                return k
        k += 1
    return -1


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object that parses."""
    at = (text or "").find("{")
    end = closing(text, at, "{}") if at >= 0 else -1
    if end < 0:
        return None
    try:
        json.loads(text[at : end + 1])
    except ValueError:
        return None
    return text[at : end + 1]


def tool_call(text: str | None) -> tuple[str, str | None, str | None]:
    """What stands before the first tool call, its name and its arguments as JSON."""
    text = text or ""
    marker = text.find("[TOOL_CALLS]")
    if marker >= 0:
        name, _, rest = text[marker + len("[TOOL_CALLS]") :].partition("[ARGS]")
        if args := first_object(rest):
            return text[:marker].strip(), name.strip(), json.dumps(json.loads(args), sort_keys=True)
    body = first_object(text)
    if body:
        call = json.loads(body)
        if isinstance(call.get("name"), str) and "arguments" in call:
            before = text[: text.find("{")].removesuffix("<tool_call>").strip()
            return before, call["name"], json.dumps(call["arguments"], sort_keys=True)
    return text.strip(), None, None


def top_level(text: str | None) -> list[str]:
    """The blocks right inside the outer parentheses."""
    text = (text or "").strip()
    out, k = [], text.find("(", 1)
    while k > 0:
        end = closing(text, k)
        if end < 0:
            break
        out.append(text[k : end + 1])
        k = text.find("(", end + 1)
    return out


def without_block(text: str | None, name: str = "lib_symbols") -> str | None:
    """The text without the first block of a name; null if that does not close."""
    at = (text or "").find(f"({name}")
    if at < 0:
        return text
    end = closing(text, at)
    return None if end < 0 else text[:at] + f"({name})" + text[end + 1 :]


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("before", "name", "arguments")]))
def tool_call_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tool_call(t) for t in texts], columns=["before", "name", "arguments"])


@F.pandas_udf(ArrayType(StringType()))
def top_level_udf(texts: pd.Series) -> pd.Series:
    return texts.map(top_level)


@F.pandas_udf(StringType())
def without_block_udf(texts: pd.Series) -> pd.Series:
    return texts.map(without_block)


_LETTERS = re.compile("[a-z]+")


def cosine_of_bags(a: Counter, b: Counter) -> float:
    """0 where a bag is empty."""
    size = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
    return sum(n * b[w] for w, n in a.items() if w in b) / size if size else 0.0


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Texts as they are shuffled: the length and zstd of their UTF-8."""
    raws = texts.map(lambda t: None if t is None else t.encode("utf-8", "surrogatepass"))
    return raws.map(lambda x: None if x is None else len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True))


def unpacked(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True).decode("utf-8", "surrogatepass")


@F.pandas_udf(DoubleType())
def bag_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """The cosine of the word bags of two packed texts."""
    bag = lambda t: Counter(_LETTERS.findall((unpacked(t) or "").lower()))
    return pd.Series([cosine_of_bags(bag(x), bag(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def keyed_hash(c: Column | str, key: str) -> Column:
    """HMAC of a text with SHA-256, as lowercase hex: two hashes with constant pads around them."""
    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pad = lambda x: F.lit(bytes(b ^ x for b in raw.ljust(64, b"\0")))
    inner = F.sha2(F.concat(pad(0x36), F.encode(c, "utf-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def data_url(c: Column | str) -> Column:
    """(mime, body) of a data URL; nulls if it is none or its body is no base64."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.instr(c, ";base64,")
    body = F.substr(c, at + 8)
    ok = c.startswith("data:") & (at > 0) & (F.length(body) % 4 == 0) & F.regexp_like(body, F.lit(r"^[A-Za-z0-9+/]*={0,2}\z"))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, F.substr(c, F.lit(6), at - 6)).alias("mime"), F.try_to_binary(F.when(ok, body), F.lit("base64")).alias("body"))


def _byte_of_letter() -> dict[str, int]:
    """Byte-level tokenizers spell a byte by its own character where that can be seen, else by one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


_BYTES = _byte_of_letter()


def repaired(text: str | None) -> str | None:
    """The text behind byte-level spelling: only where the spelt blank occurs and no real one does."""
    if not text or "\u0120" not in text or " " in text:
        return text
    return b"".join(bytes([_BYTES[c]]) if c in _BYTES else c.encode() for c in text).decode("utf-8", "replace")


@F.pandas_udf(StringType())
def repaired_udf(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


@F.pandas_udf(StringType())
def first_object_udf(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


@F.pandas_udf(IntegerType())
def closing_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: -1 if t is None else closing(t, 0))
