"""Queries that run streams: the events in three micro-batches, with keyed state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.scratch import kept, scratch
from ..streaming import logs as L
from ..streaming import streams as S
from .registry import query, table
from .sequences import _FRAMES

_PARTS = ["ts < TIMESTAMP_NTZ '2024-01-11'", "ts >= TIMESTAMP_NTZ '2024-01-11' AND ts < TIMESTAMP_NTZ '2024-01-21'", "ts >= TIMESTAMP_NTZ '2024-01-21'"]
_ORDER = ["micros", "event_id"]


def _events(spark, sf):
    e = table(spark, sf, "events")
    micros = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return e.select("user_id", "event_id", "ts", "event_type", micros.alias("micros"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def _folded(spark, sf, name, start, state, step, out):
    return S.replay(_events(spark, sf), scratch(spark, name), _PARTS, lambda s: S.keyed_fold(s.drop("ts"), "user_id", _ORDER, start, state, step, out))


@query(f"SELECT user_id::varchar AS stream_id, len([x FOR x IN string_split(s, chr(10) || chr(10)) IF x <> '']) AS frames FROM ({_FRAMES})")
def m01_sse_stream(spark, sf):
    """Frames of streams whose chunks come in several micro-batches; the end flushes what is left."""
    e = _events(spark, sf)
    chunk = F.concat(F.lit("data: "), "event_type", F.when(F.col("event_id") % 3 == 0, "\n\n").otherwise("-"))
    rows = e.select(F.col("user_id").cast("string").alias("stream_id"), F.row_number().over(_in_order()).cast("long").alias("seq"), chunk.alias("chunk"), "ts")
    ends = rows.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq"), F.lit("[DONE]").alias("chunk"), F.max("ts").alias("ts"))
    done = rows.unionByName(ends)
    found = S.replay(done, scratch(spark, "frames"), [f"chunk <> '[DONE]' AND {p}" for p in _PARTS] + ["chunk = '[DONE]'"], lambda s: S.sse_frames(s.select("stream_id", "seq", "chunk")))
    return found.groupBy("stream_id").agg(F.count("*").alias("frames"))


def _in_order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("WITH m AS (SELECT user_id, event_id, event_type, ts, count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM events), w AS (SELECT user_id, coalesce(k, 0) AS k, string_agg(event_type, ' ' ORDER BY ts, event_id) FILTER (WHERE event_type <> 'error') AS words FROM m GROUP BY 1, 2), e AS (SELECT user_id, coalesce(k, 0) AS k, event_id FROM m WHERE event_type = 'error') SELECT e.user_id::varchar AS stream_id, e.event_id AS marker, coalesce(words, '') AS words FROM e JOIN w USING (user_id, k)")
def m04_marker_stream(spark, sf):
    """The words up to each marker, as one row when the marker comes."""
    rows = _events(spark, sf).select(F.col("user_id").cast("string").alias("stream_id"), F.row_number().over(_in_order()).cast("long").alias("seq"), F.when(F.col("event_type") == "error", "marker").otherwise("word").alias("kind"), F.col("event_type").alias("text"), "ts", "event_id")
    rows = kept(rows)  # numbered once, not for each batch
    numbered = S.replay(rows, scratch(spark, "markers"), _PARTS, lambda s: S.marker_windows(s.select("stream_id", "seq", "kind", "text")))
    found = S.window_texts(numbered)
    named = rows.where("kind = 'marker'").select("stream_id", F.col("seq").alias("marker"), "event_id")
    return found.join(named, ["stream_id", "marker"]).select("stream_id", F.col("event_id").alias("marker"), "words")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT user_id, event_id, rn, event_type IN ('view', 'error') AS ok, 'LISTENING' AS state, event_type = 'view' AS inp FROM e WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, ok, CASE WHEN NOT ok THEN old WHEN t = 'click' THEN 'THINKING' WHEN t = 'purchase' THEN 'SPEAKING' ELSE 'LISTENING' END, CASE WHEN NOT ok THEN old_inp ELSE t = 'view' END FROM (SELECT e.user_id, e.event_id, e.rn, e.event_type AS t, r.state AS old, r.inp AS old_inp, CASE e.event_type WHEN 'view' THEN r.state = 'LISTENING' WHEN 'click' THEN r.state = 'LISTENING' AND r.inp WHEN 'purchase' THEN r.state = 'THINKING' WHEN 'signup' THEN r.state = 'SPEAKING' ELSE true END AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
 SELECT user_id, count_if(ok) AS taken, count_if(NOT ok) AS refused, arg_max(state, rn) AS state FROM r GROUP BY user_id""")
def m05_session_stream(spark, sf):
    """A conversation's states: which events are taken, which refused, and where it ends."""
    found = _folded(spark, sf, "sessions", ("LISTENING", False), "state string, has_input boolean", S.session_step, "event_id long, ok boolean, state string")
    at = table(spark, sf, "events").select("event_id", "ts")
    g = found.join(at, "event_id").groupBy("user_id")
    return g.agg(F.count_if("ok").alias("taken"), F.count_if(~F.col("ok")).alias("refused"), F.max_by("state", F.struct("ts", "event_id")).alias("state"))


@query("SELECT user_id, event_id, least(4, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW)) AS held FROM events")
def m06_ttl_stream(spark, sf):
    """How many entries a store of four holds that expire after five days, after each row."""
    return _folded(spark, sf, "ttl", ([],), "held array<long>", S.ttl_step(5, 4), "event_id long, held long")


@query("WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), p AS (SELECT *, lag(rn) OVER (PARTITION BY user_id, event_type ORDER BY rn) AS prev FROM e), d AS (SELECT p.user_id, p.event_id, count(DISTINCT x.event_type) AS others FROM p LEFT JOIN e x ON x.user_id = p.user_id AND x.rn > p.prev AND x.rn < p.rn WHERE p.prev IS NOT NULL GROUP BY 1, 2) SELECT p.user_id, p.event_id, coalesce(d.others < 3, false) AS hit FROM p LEFT JOIN d USING (user_id, event_id)")
def m07_cache_stream(spark, sf):
    """If each row hits a cache of its worker's three latest keys."""
    return _folded(spark, sf, "cache", ([],), "held array<string>", S.lru_step(3), "event_id long, hit boolean")


@query("SELECT user_id, frame, sum(round(value * 100)::bigint)::bigint AS total FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS frame FROM events) GROUP BY 1, 2 HAVING count(*) = 4")
def m12_frame_stream(spark, sf):
    """Frames of four rows, each when it is full."""
    return _folded(spark, sf, "frame-windows", (0, []), "number long, held array<long>", S.frame_step(4), "frame long, total long")


@query("WITH m AS (SELECT *, coalesce(count_if(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM events) SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS event_id, bool_or(round(value * 100)::bigint > 10000) AS seen FROM m GROUP BY user_id, k HAVING count_if(event_type = 'purchase') = 1")
def m14_content_stream(spark, sf):
    """At each end of a stream, if it had any content; one signal only."""
    return _folded(spark, sf, "content", (False,), "seen boolean", S.content_step, "event_id long, seen boolean")


_LOG_SQL = """WITH l AS (SELECT user_id AS run, event_id, epoch_us(ts) AS micros, ts, CASE event_type WHEN 'click' THEN event_id % 1000 END AS iter, CASE event_type WHEN 'signup' THEN event_id % 4 END AS phase, CASE event_type WHEN 'purchase' THEN round(value * 100)::bigint / 100.0 END AS val_loss FROM events),
 r AS (SELECT *, last_value(iter IGNORE NULLS) OVER w AS i, last_value(phase IGNORE NULLS) OVER w AS p, last_value(val_loss IGNORE NULLS) OVER w AS v, lead(micros) OVER (PARTITION BY run ORDER BY micros, event_id) AS next FROM l WINDOW w AS (PARTITION BY run ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT 129600000000 AS span), x AS (SELECT max(micros) AS last FROM l)
 SELECT run, 'progress' AS kind, micros, coalesce(i, 0)::bigint AS iter, coalesce(p, 0)::bigint AS phase, v::double AS val_loss FROM r WHERE iter IS NOT NULL OR phase IS NOT NULL OR val_loss IS NOT NULL
 UNION ALL SELECT run, 'silent', micros + span, coalesce(i, 0)::bigint, coalesce(p, 0)::bigint, v::double FROM r, s, x WHERE coalesce(next > micros + span, micros + span <= (last - 3600000000) // 1000 * 1000)"""


def _log(spark, sf):
    """Lines of training logs: a run for each user; some lines are of no interest."""
    e = _events(spark, sf)
    n = lambda c: c.cast("string")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("Iter "), n(F.col("event_id") % 1000), F.lit(": took 3.1 s"))).when(F.col("event_type") == "signup", F.concat(F.lit("=== PHASE "), n(F.col("event_id") % 4), F.lit(" ==="))).when(F.col("event_type") == "purchase", F.concat(F.lit("Val loss "), n(F.col("cents") / 100), F.lit(", saved"))).otherwise("loading shards")
    return e.select(F.col("user_id").alias("run"), "event_id", F.col("ts").cast("timestamp").alias("ts"), line.alias("line"), F.to_date("ts").alias("day"))


@query(_LOG_SQL)
def m10_log_tail(spark, sf):
    """Progress of growing logs, batch by batch from a checkpoint; a log that is silent for a day and a half is reported by its timer."""
    days = ["2024-01-07", "2024-01-16", "2024-01-24"]
    bounds = [None, *days, None]
    parts = [" AND ".join([f"day >= DATE '{a}'"] * (a is not None) + [f"day < DATE '{b}'"] * (b is not None)) or "true" for a, b in zip(bounds, bounds[1:], strict=False)]
    return S.replay(_log(spark, sf), scratch(spark, "log"), parts, lambda s: L.tail(s, "run", silent_seconds=129_600, late="1 hour"), L.SETTINGS)
