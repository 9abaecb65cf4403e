"""Quality rules as a short-circuit cascade.

On a sample of the rows every rule is timed and its verdicts are noted. The rules are then ordered
greedily: next comes the rule that rejects most of what the earlier ones let pass, for
the seconds it takes. Over the corpus a text runs through the rules in that order and
stops at the first that rejects it. The order changes the cost, never which texts pass.

Where the counts of every text are wanted (:func:`quality_cascade`), they are taken first, and only
texts that pass the base rule meet the others. Where the verdict is (:func:`quality_verdicts`), the
base rule's two halves are rules like the others, and of a text no more is measured than its verdict takes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: About how many rows the rules are timed on.
SAMPLE_ROWS = 2_000


class Text:
    """A whole text and what the rules measure of it, each measured once and only if asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more."""
        if self.n_words < 4:
            return 0
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in self.words], np.int64)
        if len(ids) < 1 << 20:
            windows = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
        else:
            pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
            windows = pairs[:-1] * len(ids) + w[2:]
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` says of a text that it is not to be kept."""

    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


#: The base rule's halves, as rules of a cascade.
BASE = (Rule("few_words", lambda t: t.n_words < 50), Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words))


def measured(t: Text) -> tuple[int, int, int, int, int]:
    """What is reported of every text."""
    return t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words


def _mean_word(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


def _symbols(t: Text) -> bool:
    return 100 * t.n_symbols > 20 * t.n_words


def _dup_lines(t: Text) -> bool:
    return 100 * t.n_dup_lines > 40 * len(t.lines)


def _shouting(t: Text) -> bool:
    upper = sum(map(str.isupper, t.text))
    return 100 * upper > 50 * max(1, sum(map(str.isalpha, t.text)))


def _letters(t: Text) -> bool:
    """Fewer than three of five characters in words are letters."""
    return 5 * sum(map(str.isalpha, t.text)) < 3 * t.word_chars


def _ellipses(t: Text) -> bool:
    return 100 * sum(x.rstrip(SPACES).endswith(("...", "…")) for x in t.lines) > 30 * len(t.lines)


def _bullets(t: Text) -> bool:
    return len(t.lines) > 3 and 100 * sum(x.lstrip(SPACES).startswith(("-", "*", "•")) for x in t.lines) > 90 * len(t.lines)


RULES = (
    Rule("mean_word", _mean_word),
    Rule("symbols", _symbols),
    Rule("dup_lines", _dup_lines),
    Rule("shouting", _shouting),
    Rule("letters", _letters),
    Rule("ellipses", _ellipses),
    Rule("bullets", _bullets),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS, text: str = "text", counts: bool = True) -> list[dict]:
    """Verdict patterns on a sample: which rules reject (a bit each), how often, seconds by rule.

    Rows are drawn one by one, whatever their text, so a text with many copies has no more than
    its share. As in the cascade, only rows that pass the base rule meet the others, and what is
    measured of every row is measured by then: a rule is charged with what it adds. Without ``counts``
    nothing is measured before, all rows meet all rules, and each is charged with all that it takes. At most
    as many rows as there are patterns of ``rules`` come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, took = [], []
            for x in b.column(0).to_pylist():
                t, pattern, times = Text(x), 0, []
                if counts:
                    measured(t)
                    if base_failed(t):
                        continue
                for k, r in enumerate(rules):
                    t = t if counts else Text(x)
                    began = time.perf_counter()
                    pattern |= r.rejects(t) << k
                    times.append(time.perf_counter() - began)
                bits.append(pattern)
                took.append(times)
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(bits, pa.int64()), "took": pa.array(took, pa.list_(pa.float64()))})

    n = docs.count()
    part = docs.select(text).where(F.col(text).isNotNull())
    if n > rows:
        part = part.sample(fraction=min(1.0, rows / n), seed=42)
    got = part.mapInArrow(run, "pattern long, took array<double>")
    sums = [F.sum(F.col("took")[k]).alias(f"s{k}") for k in range(len(rules))]
    return [r.asDict() for r in got.groupBy("pattern").agg(F.count("*").alias("n"), *sums).collect()]


def order_rules(rules: tuple[Rule, ...], measured: list[dict]) -> list[Rule]:
    """Greedily by rejections, among what is left, per second; ties by the order given."""
    n = sum(r["n"] for r in measured) or 1
    cost = [sum(r[f"s{k}"] for r in measured) / n + 1e-9 for k in range(len(rules))]
    left, passed, out = list(range(len(rules))), measured, []
    while left:
        gain = {k: sum(r["n"] for r in passed if r["pattern"] >> k & 1) / cost[k] for k in left}
        best = max(left, key=lambda k: (gain[k], -cost[k] if not gain[k] else 0, -k))
        out.append(best)
        left.remove(best)
        passed = [r for r in passed if not r["pattern"] >> best & 1]
    return [rules[k] for k in out]


def order_report(rules: tuple[Rule, ...], measured_rows: list[dict]) -> list[tuple[str, int, float]]:
    """The rules in their order, with how many of the sample each alone rejects and its seconds a row."""
    n, place = sum(r["n"] for r in measured_rows) or 1, {r.name: k for k, r in enumerate(rules)}
    told = []
    for r in order_rules(rules, measured_rows):
        k = place[r.name]
        told.append((r.name, sum(m["n"] for m in measured_rows if m["pattern"] >> k & 1), sum(m[f"s{k}"] for m in measured_rows) / n))
    return told


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, rejected_by string, kept boolean"


def apply_cascade(docs: DataFrame, ordered: list[Rule], text: str = "text") -> DataFrame:
    """Add the counts of every whole text, base_failed, rejected_by and kept.

    Other columns stay; columns of these names are replaced. A null or empty text has no
    words and fails the base rule. Equal texts get equal verdicts.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf(JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for x in texts:
                t = Text(x)
                counts = measured(t)
                failed = base_failed(t)
                by = "base" if failed else next((r.name for r in ordered if r.rejects(t)), None)
                out.append((*counts, failed, by, by is None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in JUDGED.split(", ")])

    names = [c.split()[0] for c in JUDGED.split(", ")]
    # The text may lie within a column that stays, so both are taken along as they are.
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    got = docs.select(F.struct(*own).alias("row") if own else F.lit(None).alias("row"), judge(F.col(text)).alias("judged"))
    return got.select(*(["row.*"] if own else []), "judged.*")


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """Measure ``rules`` on a sample of ``docs``, order them, and judge every row: the columns and the
    cases of :func:`apply_cascade`; null and empty texts fail the base rule, an empty table gives no rows."""
    return apply_cascade(docs, order_rules(rules, measure(docs, rules, rows, text)), text)


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """Add rejected_by (a rule of ``BASE`` or ``rules``, null if none) and kept, equal to that of
    :func:`quality_cascade`; no counts are taken but those that a text's verdict needs.

    Other columns stay; columns of these names are replaced. A null or empty text has too few words.
    """
    arrow_batches(docs.sparkSession)
    every = (*BASE, *rules)
    ordered = order_rules(every, measure(docs, every, rows, text, counts=False))

    @F.pandas_udf("string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([next((r.name for r in ordered if r.rejects(t)), None) for t in map(Text, texts)], dtype=object)

    judged = docs.withColumn("rejected_by", judge(F.col(text)))
    return judged.withColumn("kept", F.col("rejected_by").isNull())
