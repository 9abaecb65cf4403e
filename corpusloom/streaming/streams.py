"""Streams: frames across chunks, windows between markers, stores that expire."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sse_frames(chunks: DataFrame) -> DataFrame:
    """Frames of ``chunks`` (stream_id string, seq long, chunk string), each ended by a blank line.

    A frame may be spread over chunks and micro-batches: what is not ended waits in the
    stream's state. A chunk ``[DONE]`` flushes what is left.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ("",)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for chunk in rows["chunk"]:
            if chunk == "[DONE]":
                out, held = out + [held] * bool(held), ""
                continue
            *whole, held = (held + chunk).split("\n\n")
            out += whole
        state.update((held,))
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "frame": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, frame string", "held string", "append", GroupStateTimeout.NoTimeout)


def marker_windows(words: DataFrame) -> DataFrame:
    """Each word of ``words`` (stream_id string, seq long, kind string, text string) with the number of its
    window, from 0: a marker ends a window and is its last row. The state is that number, however
    long a window is; :func:`window_texts` puts the ended windows together."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (window,) = state.get if state.exists else (0,)
        seq, kind, text = _in_order(batches, ["seq", "kind", "text"], ["seq"])
        ends = np.array([k == "marker" for k in kind], np.int64)
        state.update((int(window + ends.sum()),))
        yield pd.DataFrame({"stream_id": [key[0]] * len(seq), "window": window + ends.cumsum() - ends, "seq": seq, "kind": kind, "text": text})

    return words.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, window long, seq long, kind string, text string", "window long", "append", GroupStateTimeout.NoTimeout)


def window_texts(rows: DataFrame) -> DataFrame:
    """stream_id, marker (its seq) and words of every window that a marker has ended."""
    word = F.when(F.col("kind") != "marker", F.struct("seq", "text"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["text"]), " ")
    g = rows.groupBy("stream_id", "window").agg(F.max(F.when(F.col("kind") == "marker", F.col("seq"))).alias("marker"), told.alias("words"))
    return g.where("marker IS NOT NULL").select("stream_id", "marker", "words")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _in_order(batches: Iterator[pd.DataFrame], names: list[str], order: list[str]) -> list[list]:
    """The columns of a key's rows as lists, in order. A key's rows are few: a data frame's own steps cost more than they do."""
    parts = list(batches)
    arrays = [np.concatenate([p[c].to_numpy() for p in parts]) for c in names]
    keys = [arrays[names.index(c)] for c in order]
    if any(k.dtype.kind == "O" for k in keys):
        place = np.array(sorted(range(len(keys[0])), key=lambda i: tuple(k[i] for k in keys)), int)
    else:
        place = np.lexsort(keys[::-1])
    return [list(pd.Series(a[place])) if a.dtype.kind in "mM" else a[place].tolist() for a in arrays]


def keyed_fold(rows: DataFrame, key: str, order: list[str], start: tuple, state: str, step: Callable, out: str) -> DataFrame:
    """Fold each key's rows, in order, into its state; what a step returns is emitted.

    ``step(state, row)`` gives the new state and a list of rows (without the key) for ``out``. A
    micro-batch's rows are put in order; between micro-batches the source keeps it.
    """

    names, row = rows.columns, namedtuple("Row", rows.columns, rename=True)
    columns = [c.split()[0] for c in out.split(", ")]

    def run(key_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, told = tuple(held.get) if held.exists else start, []
        for values in zip(*_in_order(batches, names, order), strict=True):
            now, more = step(now, row(*values))
            told += more
        held.update(now)
        if told:
            yield pd.DataFrame({key: [key_[0]] * len(told), **dict(zip(columns, zip(*told, strict=True), strict=True))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def session_step(now: tuple, row) -> tuple[tuple, list]:
    """LISTENING, THINKING, SPEAKING and back: a turn wants input first, and none overlaps another."""
    state, has_input = now
    allowed = {"view": state == "LISTENING", "click": state == "LISTENING" and has_input, "purchase": state == "THINKING", "signup": state == "SPEAKING", "error": True}
    ok = bool(allowed.get(row.event_type, False))
    if ok:
        state, has_input = {"view": ("LISTENING", True), "click": ("THINKING", False), "purchase": ("SPEAKING", False), "signup": ("LISTENING", False), "error": ("LISTENING", False)}[row.event_type]
    return (state, has_input), [(row.event_id, ok, state)]


def ttl_step(days: float, most: int) -> Callable:
    """A store of ``most`` entries that expire after so many days: its size after each row."""
    span = int(days * 86_400_000_000)

    def step(now: tuple, row) -> tuple[tuple, list]:
        held = [t for t in now[0] if t > row.micros - span][-(most - 1) :] if most > 1 else []
        held = [*held, row.micros]
        return (held,), [(row.event_id, len(held))]

    return step


def lru_step(most: int) -> Callable:
    """An exact cache of the ``most`` latest keys: if each row hits it."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        held = list(now[0])
        hit = row.event_type in held
        held = [x for x in held if x != row.event_type][-(most - 1) :] + [row.event_type]
        return (held,), [(row.event_id, hit)]

    return step


def frame_step(size: int) -> Callable:
    """Frames of ``size`` rows: number, and the sum of what is in them, once they are full."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        number, held = now[0], [*now[1], row.cents]
        if len(held) < size:
            return (number, held), []
        return (number + 1, []), [(number, sum(held))]

    return step


def content_step(now: tuple, row) -> tuple[tuple, list]:
    """At each end of a stream, if it had any content since the end before."""
    seen = bool(now[0] or row.cents > 10_000)
    if row.event_type != "purchase":
        return (seen,), []
    return (False,), [(row.event_id, seen)]


def replay(df: DataFrame, folder: str, parts: list, transform: Callable, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over a table: each part (a condition) is one micro-batch, of as many files as the table
    has partitions.

    A part is written, the stream is started, takes all that is new and ends; for the next part it starts
    again from its checkpoint below ``folder``. So batches come in the parts' order, rows within one in
    any, and state must survive a restart each time. ``settings`` hold while it runs. The result is read
    back when all is through.
    """
    spark, settings = df.sparkSession, settings or {}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for part in parts:
            df.where(part).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
            out = transform(source)
            writer = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
