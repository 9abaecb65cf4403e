"""Column functions on text. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = r"^\s+|\s+$"


def strip(c: Column | str) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.regexp_replace(c, ENDS, "")


def word_count(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+"))).cast("int")


def line_count(c: Column | str) -> Column:
    return F.size(F.split(c, "\n"))


def token_estimate(c: Column | str) -> Column:
    """Whole tokens of 3.5 characters each."""
    return F.floor(F.length(c) / F.lit(3.5)).cast("long")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """One of the words occurs somewhere, also inside other words."""
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def found(c: Column, words: tuple[str, ...]) -> Column:
    """The distinct words that occur, in the order given."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def found_count(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(add, [F.contains(c, F.lit(w)).cast("int") for w in words])


def first_rule(c: Column, rules: tuple[tuple[str, str], ...], default: str | None) -> Column:
    """The label of the first rule whose keyword occurs."""
    out = F.lit(default)
    for keyword, label in reversed(rules):
        out = F.when(F.contains(c, F.lit(keyword)), F.lit(label)).otherwise(out)
    return out


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(F.encode(c, "utf-8"), 256), 1, 16)


def same_text(c: Column | str) -> Column:
    """A key to group equal texts by, so that no whole text is shuffled; no two texts can be made to share one."""
    return F.unhex(F.sha2(F.encode(c, "utf-8"), 256))


def seeded(*cols: Column | str, seed: int = 42) -> Column:
    """A hash to order rows by: the same on every engine and every run."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.concat(F.lit(f"{seed}:"), *[p.cast("string") for p in parts]), 256)


def head_and_tail(c: Column, limit: int = 1000, part: int = 256) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, part), F.lit(" ... "), F.right(c, F.lit(part)))).otherwise(c)


def cut(c: Column, limit: int, mark: str = "") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def ascii_share_above(c: Column, share: float) -> Column:
    """More than ``share`` of the letters are ASCII; without letters, no."""
    ascii_, letters = F.length(F.regexp_replace(c, "[^A-Za-z]", "")), F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (letters > 0) & (ascii_ > F.lit(share) * letters)


def guess_language(c: Column) -> Column:
    """By which words of three languages are present in the first 3000 characters."""
    from .rules import LANGUAGE_WORDS

    sample = F.lower(F.substring(c, 1, 3000))
    n = {k: found_count(sample, v) for k, v in LANGUAGE_WORDS.items()}
    return F.when((n["fr"] > n["en"]) & (n["fr"] > n["de"]), "fr").when(n["de"] > n["en"], "de").otherwise("en")


def complexity(c: Column) -> Column:
    """simple, medium or complex, by length and by words that ask for reasoning or code."""
    from .rules import CODE_PATTERN, REASONING_PATTERN

    words, reasoning, code = word_count(c), c.rlike(REASONING_PATTERN), c.rlike(CODE_PATTERN)
    return F.when(c.isNull() | ((words < 15) & ~reasoning & ~code), "simple").when((words > 100) | reasoning, "complex").otherwise("medium")


def without_thinking(c: Column) -> Column:
    """Without marked reasoning, then without marks that stand alone."""
    from .rules import THINK_BLOCK, THINK_MARK

    return strip(F.regexp_replace(F.regexp_replace(c, THINK_BLOCK, ""), THINK_MARK, ""))


def rating(c: Column) -> Column:
    """The first ``[[n]]``."""
    return F.regexp_extract(c, r"\[\[(\d+(?:\.\d+)?)\]\]", 1).try_cast("double")


def html_to_text(c: Column) -> Column:
    """Without scripts, styles and tags; blocks on lines of their own."""
    t = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def clean_pages(c: Column) -> Column:
    """Extracted page text: header lines and hyphen breaks go, runs of blanks shrink."""
    from .rules import PAGE_LINE

    t = F.regexp_replace(F.regexp_replace(c, PAGE_LINE, ""), r"(\w)-\n(\w)", "$1$2")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r" {2,}", " "))


def wiki_clean(c: Column, most: int = 3000) -> Column:
    """Links as their labels, without templates and tags, cut."""
    t = F.regexp_replace(F.regexp_replace(c, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"), r"\{\{[^}]*\}\}", "")
    return F.substring(F.regexp_replace(t, "<[^>]+>", ""), 1, most)


def json_line_text(line: Column) -> Column:
    """``text`` or else ``prompt`` of a line that is a JSON object, bullets and commas aside; else null."""
    bare = F.regexp_replace(F.regexp_replace(line, "^[-* ]+", ""), "[, ]+$", "")
    return F.when(bare.startswith("{"), F.coalesce(F.get_json_object(bare, "$.text"), F.get_json_object(bare, "$.prompt")))


def first_filled(*names: str) -> Column:
    """The first of the columns that holds something."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names])


def promoted(content: Column, reasoning: Column) -> Column:
    """Reasoning in place of empty content; marks of reasoning go where there are any."""
    empty = F.coalesce(content == "", F.lit(True)) & (strip(F.coalesce(reasoning, F.lit(""))) != "")
    said = F.when(empty, reasoning).otherwise(content)
    return F.when(said.rlike("(?i)think"), without_thinking(said)).otherwise(said)
