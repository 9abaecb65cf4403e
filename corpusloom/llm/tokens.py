"""Encoding of whole texts with the tokenizers library, through caches of pieces.

Texts are cut where the tokenizer's own pre-tokenizer always cuts, so each part can be
encoded by itself and the ids of the parts, joined, are the ids of the text. Parts that
recur come from a cache. A text whose cuts are not certain is encoded whole, and so is one
that spells an added token of the file, such as ``<|endoftext|>``: the file is used as the
library loads it, so that spelling is the token's own id.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Entries of each of the two caches of a Python worker; full caches start anew.
CACHE_ENTRIES = 600_000

#: White space that the fast path of a byte-level tokenizer leaves to the library.
ODD_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"))
_LATIN = re.compile(f"[{_LETTERS}]+")
_PLAIN = re.compile(f"(?:[{_LETTERS}]+|[{_MARKS}]+|(?<!\n)\n(?!\n))+")
_PARTS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|\n")
#: What both splits do with a text of these characters alone, as Latin-1, is known.
_PLAIN_BYTES = bytes(b for b in range(256) if re.fullmatch(f"[{_LETTERS}{_MARKS}'0-9 \n]", chr(b)))
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_WORD_PARTS = re.compile(f"{_SHORT}|[{_LETTERS}]+|[0-9]|[{_MARKS}']+")
_BYTE_PARTS = re.compile(f"{_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}']+|\n")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE spells Latin-1 characters: a visible letter for each UTF-8 byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    spelt = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(256)}


_BYTE_LETTERS = _byte_letters()


class TextEncoder:
    """``encode(text)`` gives the ids of a whole text as unsigned integers.

    ``path`` is a file of the tokenizers library. Two kinds have a fast path: byte-level
    BPE with the usual split pattern, and word BPE that lower-cases and drops white
    space. Every other tokenizer encodes each text whole.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        # The library may look for added tokens in the lower-cased text.
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        # What they all begin with, as far as it has no case, is looked for first.
        self.mark = re.match(r"[^\w]*", os.path.commonprefix(added)).group()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.kind = _kind(json.loads(self.library.to_str()))
        self.whole: dict[str, bytes] = _Filled(self._chunk, cache_entries)
        self.parts: dict[str, bytes] = _Filled(self._part, cache_entries)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """What the pre-tokenizer keeps together: only the model is left to run."""
        return array(self.code, [t.id for t in self.library.model.tokenize(part.translate(_BYTE_LETTERS))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """What follows one space, up to the next."""
        if self.kind == "word":
            if _LATIN.fullmatch(chunk):
                return self.parts[chunk.lower()]
            if not _PLAIN.fullmatch(chunk):
                return self._library(chunk)
            return b"".join([self.parts[p.lower()] for p in _PARTS.findall(chunk) if p != "\n"])
        if _LATIN.fullmatch(chunk):
            return self.parts[" " + chunk]
        if chunk[:1] == "\n" or chunk[-1:] == "\n" or not _PLAIN.fullmatch(chunk):
            return self._library(" " + chunk)
        first, *rest = _PARTS.findall(chunk)
        return self.parts[" " + first] + b"".join([self.parts[p] for p in rest])

    def _plain_parts(self, text: str) -> list[str] | None:
        """The pre-tokenizer's parts of a text of plain characters; None where its split isn't certain."""
        try:
            if text.encode("latin-1").translate(None, _PLAIN_BYTES):
                return None
        except UnicodeEncodeError:
            return None
        if self.kind == "word":
            return _WORD_PARTS.findall(text.lower())
        if self.kind == "byte" and not (text[-1:] == " " or "  " in text or "\n " in text or " \n" in text or "\n\n" in text):
            return _BYTE_PARTS.findall(text)
        return None

    def encode(self, text: str) -> np.ndarray:
        if self.added and self.mark in text and self.added.search(text):
            raw = self._library(text)
        elif (parts := self._plain_parts(text)) is not None:
            raw = b"".join(map(self.parts.__getitem__, parts))
        elif self.kind == "word":
            raw = b"".join(map(self.whole.__getitem__, text.split(" ")))
        elif self.kind == "byte" and not ("  " in text or "\n " in text or " \n" in text or any(c in text for c in ODD_SPACE)):
            head, *chunks = text.split(" ")
            raw = self._library(head) + b"".join(map(self.whole.__getitem__, chunks))
        else:
            raw = self._library(text)
        return np.frombuffer(raw, self.dtype)


class _Filled(dict):
    """A bounded cache that computes what it lacks."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def _kind(spec: dict) -> str:
    """``byte``, ``word``, or empty where the cuts of the fast path aren't known to hold."""
    model, pre, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"]
    if model["type"] != "BPE" or model.get("dropout"):
        return ""
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
        return "byte"
    steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex", "") for p in pre.get("pretokenizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and splits[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]:
        return "word"
    return ""


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Give up this worker's encoders and what they hold."""
    _encoders.clear()
