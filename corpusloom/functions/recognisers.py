"""Recognisers of personal data by kind: a pattern, a score, words that speak for it, a check of its digits.

Kinds that need a language model (names, places, groups, dates) are not recognised.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

#: Characters before a find in which a word of its kind raises the score, and by how much, to what at least.
CONTEXT_CHARS = 50
CONTEXT_GAIN, CONTEXT_LEAST = 0.35, 0.4

_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isascii() and c.isdigit()]


def card_number(text: str) -> bool:
    """Every second digit from the right counts twice, its own digits added; the sum ends in 0."""
    digits = _digits(text)[::-1]
    return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def bank_account(text: str) -> bool:
    """Country and check digits moved to the end, letters as numbers from 10: the rest by 97 is 1."""
    bare = re.sub(r"[ -]", "", text).upper()
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def wallet_address(text: str) -> bool:
    """A number of base 58 whose last four bytes are the head of a double hash of the others."""
    n = 0
    for c in text:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big").rjust(25, b"\0")
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def health_number(text: str) -> bool:
    """Ten digits weighted 10 to 1: the sum is a multiple of 11."""
    digits = _digits(text)
    return len(digits) == 10 and sum(d * (10 - k) for k, d in enumerate(digits)) % 11 == 0


def prescriber_number(text: str) -> bool:
    """Of seven digits the last ends the sum of the odd places and twice that of the even ones."""
    d = _digits(text)[-7:]
    return len(d) == 7 and (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


def social_number(text: str) -> bool:
    """No group is all noughts, and the first isn't 666 or from 900 on."""
    area, group, serial = re.split(r"[ -]", text)
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def internet_address(text: str) -> bool:
    return all(int(x) < 256 for x in text.split("."))


@dataclass(frozen=True)
class Recogniser:
    kind: str
    pattern: re.Pattern
    score: float
    context: re.Pattern | None = None
    check: Callable[[str], bool] | None = None


def _words(*words: str) -> re.Pattern:
    return re.compile(rf"(?i)\b(?:{'|'.join(words)})\b")


RECOGNISERS = (
    Recogniser("EMAIL_ADDRESS", re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"), 1.0),
    Recogniser("CREDIT_CARD", re.compile(r"(?<![\d-])(?:\d[ -]?){11,18}\d(?![\d-])"), 1.0, check=card_number),
    Recogniser("IBAN_CODE", re.compile(r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?\b"), 1.0, check=bank_account),
    Recogniser("CRYPTO", re.compile(r"\b[13][1-9A-HJ-NP-Za-km-z]{25,34}\b"), 1.0, check=wallet_address),
    Recogniser("UK_NHS", re.compile(r"(?<![\d-])\d{3}[ -]?\d{3}[ -]?\d{4}(?![\d-])"), 1.0, check=health_number),
    Recogniser("MEDICAL_LICENSE", re.compile(r"\b[A-Z][A-Z9]\d{7}\b"), 1.0, check=prescriber_number),
    Recogniser("IP_ADDRESS", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"), 0.6, _words("ip", "ipv4", "address"), internet_address),
    Recogniser("US_SSN", re.compile(r"(?<![\d-])\d{3}([ -])\d{2}\1\d{4}(?![\d-])"), 0.5, _words("social security", "ssn", "ssns"), social_number),
    Recogniser("PHONE_NUMBER", re.compile(r"(?<![\w+-])(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])"), 0.4, _words("phone", "telephone", "tel", "call", "mobile", "cell", "number")),
    Recogniser("US_PASSPORT", re.compile(r"\b[A-Z]?\d{8,9}\b"), 0.05, _words("passport", "travel document")),
)


def findings(text: str, least: float = 0.0) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of what a text holds, by start; of finds that overlap the one with the
    highest score stays, of equal ones the longest, then the first of the kinds."""
    found = []
    for order, r in enumerate(RECOGNISERS):
        for m in r.pattern.finditer(text):
            if r.check and not r.check(m[0]):
                continue
            score = r.score
            if r.context and r.context.search(text, max(0, m.start() - CONTEXT_CHARS), m.start()):
                score = min(1.0, max(score + CONTEXT_GAIN, CONTEXT_LEAST))
            found.append((-round(score, 2), m.start() - m.end(), order, m.start(), m.end(), r.kind))
    taken: dict[int, list[tuple[int, int]]] = {}
    kept = []
    for score, _, _, start, end, kind in sorted(found):
        # A find is short, so what it may meet is in the few stretches of 64 characters that it touches.
        near = range(start // 64, end // 64 + 1)
        if not any(a < end and start < b for k in near for a, b in taken.get(k, ())):
            for k in near:
                taken.setdefault(k, []).append((start, end))
            kept.append((kind, start, end, -score))
    return sorted((f for f in kept if f[3] >= least), key=lambda f: f[1])
