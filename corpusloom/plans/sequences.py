"""Queries on ordered parts: chunks, turns, sections, findings, event replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.structure import bag_cosine, packed
from ..operators import sequences as S
from ..operators.ranking import first_rows, numbered_in_order
from .corpus import SQL_STRIP, q
from .registry import query, table

_BINS = """WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, 1 AS i, 1 AS bin, length(a[1]) AS n, len(a) AS total, a FROM p
  UNION ALL SELECT doc_id, i + 1, CASE WHEN n + length(a[i + 1]) > 500 THEN bin + 1 ELSE bin END, CASE WHEN n + length(a[i + 1]) > 500 THEN length(a[i + 1]) ELSE n + length(a[i + 1]) END, total, a FROM r WHERE i < total),
 c AS (SELECT doc_id, bin AS part, string_agg(a[i], chr(10) ORDER BY i) AS chunk, max(bin) OVER (PARTITION BY doc_id) AS x FROM r GROUP BY doc_id, bin),
 b AS (SELECT doc_id, part::int AS part, chunk, count(*) OVER (PARTITION BY doc_id)::int AS split_total FROM c)"""


def _packed(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return S.numbered(d, S.greedy_bins(F.split("text", "\n"), 500), "doc_id")


@query(f"{_BINS} SELECT doc_id, part, split_total, chunk FROM b")
def w18_greedy_bins(spark, sf):
    """Lines packed to 500 characters, in order, with part numbers."""
    return _packed(spark, sf).select("doc_id", "part", "split_total", "chunk")


@query(f"{_BINS} SELECT doc_id, part, CASE WHEN prev IS NULL THEN chunk ELSE '// ... (continued from previous part)' || chr(10) || array_to_string(list_slice(string_split(prev, chr(10)), greatest(len(string_split(prev, chr(10))) - 9, 1), len(string_split(prev, chr(10)))), chr(10)) || chr(10) || chr(10) || chunk END AS chunk FROM (SELECT *, lag(chunk) OVER (PARTITION BY doc_id ORDER BY part) AS prev FROM b)")
def w17_overlap(spark, sf):
    return S.with_overlap(_packed(spark, sf), "doc_id").select("doc_id", "part", "chunk")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), i AS (SELECT doc_id, a, unnest(range(0, len(a), 5)) AS k FROM l) SELECT doc_id, (k // 5 + 1)::int AS part, array_to_string(list_slice(a, k + 1, k + 5), chr(10)) AS chunk FROM i")
def w27_line_chunks(spark, sf):
    lines = F.split("text", "\n")
    cut = F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(5)), lambda i: F.array_join(F.slice(lines, i + 1, F.lit(5)), "\n"))
    return S.numbered(table(spark, sf, "documents"), cut, "doc_id").select("doc_id", "part", "chunk")


@query("SELECT page_id, (i - 1)::int AS i, b AS block FROM (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (SELECT page_id, string_split_regex(html, '</p>\\s*<p>') AS bs FROM pages))".replace("\\\\", "\\"))
def w28_split_blocks(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", r"</p>\s*<p>")).alias("i", "block"))


_ROLES = "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'user' ELSE role END AS role, text FROM conversations"


@query(f"WITH c AS ({_ROLES}), f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS b FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f) SELECT conv_id, min(turn) AS turn, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_merged FROM g GROUP BY conv_id, island")
def w19_role_merge(spark, sf):
    """Neighbouring turns of one role become one (W20, B36); system is read as user here."""
    role = F.when(F.col("role") == "system", "user").otherwise(F.col("role"))
    return S.merge_roles(table(spark, sf, "conversations").withColumn("role", role)).drop("island")


@query("WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), h AS (SELECT *, regexp_matches(line, '^[A-Z][a-zà-ÿ]+( [a-zà-ÿ,]+){0,6}[.]$') AS h FROM l), s AS (SELECT *, sum(h::int) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM h), g AS (SELECT doc_id, section, arg_min(line, k) AS title, min(k)::int AS start_line, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT h), ''), '^\\s+|\\s+$', '', 'g') AS content FROM s WHERE section > 0 GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, 'Document Content', 0, string_agg(line, chr(10) ORDER BY k) FROM s GROUP BY doc_id HAVING max(section) = 0) SELECT doc_id, title, start_line, substr(content, 1, 4000) AS content FROM g WHERE length(content) >= 200".replace("\\\\", "\\"))
def w21_sections(spark, sf):
    heading = F.col("line").rlike("^[A-Z][a-zà-ÿ]+( [a-zà-ÿ,]+){0,6}[.]$")
    return S.sections(table(spark, sf, "documents"), "doc_id", heading).select("doc_id", "title", "start_line", "content")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE value >= 50) WHERE rn <= 4")
def w22_thresholded_top(spark, sf):
    return first_rows(table(spark, sf, "events").where("value >= 50"), ["user_id"], [F.desc("value"), "event_id"], 4).select("user_id", "event_id", "value")


@query("SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 END AS record_idx FROM documents")
def w24_ordinals(spark, sf):
    """Numbers where provenance is missing, counted over all rows of a source."""
    known = table(spark, sf, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    numbered = numbered_in_order(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", "n")
    return numbered.join(known, "doc_id", "left").select("doc_id", F.when(F.col("known").isNull(), F.col("n")).alias("record_idx"))


def _findings(spark, sf):
    """PII by pattern: technical addresses and short numbers are no findings; values are masked."""
    d = table(spark, sf, "documents")
    named = lambda k: lambda v: F.struct(F.lit(k).alias("type"), v.alias("value"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), named(k)) for k, p in R.PII_PATTERNS]))
    f = d.select("doc_id", "source", F.explode(found).alias("f")).select("doc_id", "source", "f.type", "f.value")
    technical = (F.col("type") == "ip_address") & F.col("value").rlike(r"^(0|1|255|127|192\.168)\.")
    short = (F.col("type") == "phone") & (F.length(F.regexp_replace("value", "[ -]", "")) < 7)
    return f.where(~technical & ~short)


_PII = "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS type, unnest(regexp_extract_all(text, {q(p)})) AS value FROM documents" for k, p in R.PII_PATTERNS) + r"), g AS (SELECT * FROM f WHERE NOT (type = 'ip_address' AND regexp_matches(value, '^(0|1|255|127|192\.168)\.')) AND NOT (type = 'phone' AND length(regexp_replace(value, '[ -]', '', 'g')) < 7))"


@query(f"{_PII} SELECT doc_id, type, substr(value, 1, 6) || '***' AS value FROM g")
def x06_pii_findings(spark, sf):
    return _findings(spark, sf).select("doc_id", "type", F.concat(F.substring("value", 1, 6), F.lit("***")).alias("value"))


@query(f"{_PII} SELECT source, type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY ROLLUP (source, type)")
def a18_pii_report(spark, sf):
    return _findings(spark, sf).rollup("source", "type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"{_PII} SELECT source, type, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY doc_id, value) AS rn FROM g) WHERE rn <= 3")
def w25_first_examples(spark, sf):
    return first_rows(_findings(spark, sf), ["source", "type"], ["doc_id", "value"], 3).select("source", "type", "doc_id")


_CHAIN = "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events), g AS (SELECT user_id, min(attempt) FILTER (WHERE event_type = 'purchase') AS won, max(attempt) AS made FROM a WHERE attempt <= 3 GROUP BY user_id)"


@query(f"{_CHAIN} SELECT user_id, coalesce(won, made)::int AS attempts, CASE WHEN won IS NOT NULL THEN 'ok' WHEN made > 2 THEN 'exhausted' ELSE 'error' END AS status FROM g")
def w29_chain_replay(spark, sf):
    return S.first_success(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 2)


@query("SELECT conv_id, to_json([{'role': 'user', 'content': " + SQL_STRIP.format(c="u") + "}, {'role': 'assistant', 'content': " + SQL_STRIP.format(c="a") + "}])::varchar AS messages FROM (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS u, min_by(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id) WHERE u IS NOT NULL AND a IS NOT NULL")
def p01_chat_records(spark, sf):
    """The first question and answer as a chat record, both sides stripped."""
    first = lambda r: F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(first("user").alias("u"), first("assistant").alias("a")).where("u IS NOT NULL AND a IS NOT NULL")
    m = F.array(*[F.struct(F.lit(r).alias("role"), T.strip(c).alias("content")) for r, c in (("user", "u"), ("assistant", "a"))])
    return g.select("conv_id", F.to_json(m).alias("messages"))


@query("SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS first_user, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS last_user, coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS first_assistant FROM conversations GROUP BY conv_id")
def p02_messages_by_role(spark, sf):
    """First and last message of a role."""
    at = lambda r: F.when(F.col("role") == r, F.col("turn"))
    pick = lambda f, r: F.coalesce(f(F.when(F.col("role") == r, F.col("text")), at(r)), F.lit(""))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(pick(F.min_by, "user").alias("first_user"), pick(F.max_by, "user").alias("last_user"), pick(F.min_by, "assistant").alias("first_assistant"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations WHERE text <> '' GROUP BY conv_id")
def p03_concatenated(spark, sf):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_join(texts, "\n").alias("text"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, 'sys:' || text AS text FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, -1, 'sys:default' FROM conversations GROUP BY conv_id HAVING count_if(role = 'system') = 0")
def x22_system_marker(spark, sf):
    """A marker in the system message, or a message of its own where there is none."""
    c = table(spark, sf, "conversations")
    none = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n")).where("n = 0")
    return c.where("role = 'system'").select("conv_id", "turn", F.concat(F.lit("sys:"), "text").alias("text")).unionByName(none.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("sys:default").alias("text")))


@query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '[TOOL_RESULT id=' || turn || '] ' || text ELSE text END AS text FROM conversations")
def x37_tool_rewrite(spark, sf):
    told = F.concat(F.lit("[TOOL_RESULT id="), F.col("turn").cast("string"), F.lit("] "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", told).otherwise(F.col("text")).alias("text"))


_THINK = "'<think>a b</think> ' || text || ' [THINK] [[' || (turn % 10) || '.5]] </reasoning>'"


@query(rf"WITH t AS (SELECT conv_id, turn, {_THINK} AS x FROM conversations) SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(x, '(?is)\[THINK\].*?\[/THINK\]|<think>.*?</think>|<reasoning>.*?</reasoning>', '', 'g'), '(?i)\[/?THINK\]|</?think>|</?reasoning>', '', 'g'), '^\s+|\s+$', '', 'g') AS text, try_cast(regexp_extract(x, '\[\[(\d+(?:\.\d+)?)\]\]', 1) AS double) AS rating FROM t")
def x19_thinking_and_rating(spark, sf):
    """Reasoning marks go (X19); the first rating is read."""
    x = F.concat(F.lit("<think>a b</think> "), "text", F.lit(" [THINK] [["), (F.col("turn") % 10).cast("string"), F.lit(".5]] </reasoning>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.without_thinking(x).alias("text"), T.rating(x).alias("rating"))


_JSONL = "'```json' || chr(10) || '- {\"text\": \"' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || '\"},' || chr(10) || 'noise {\"prompt\": 1}' || chr(10) || '```'"


@query(rf"WITH t AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace({_JSONL}, '```(?:jsonl|json)?\s*\n?', '', 'g'), '```', '', 'g'), chr(10))) AS line FROM documents), c AS (SELECT doc_id, regexp_replace(regexp_replace(line, '^[-* ]+', ''), '[, ]+$', '') AS line FROM t), j AS (SELECT doc_id, trim(coalesce(json_extract_string(line, '$.text'), json_extract_string(line, '$.prompt'))) AS text FROM c WHERE starts_with(line, '{{') AND json_valid(line)) SELECT doc_id, text FROM j WHERE text <> '' AND len(string_split_regex(text, '\s+')) BETWEEN 3 AND 500")
def x15_jsonl_salvage(spark, sf):
    """Rows out of free text: fences and bullets go, lines that are objects are read."""
    plain = F.regexp_replace("text", "[^A-Za-z ]", "")
    raw = F.concat(F.lit('```json\n- {"text": "'), plain, F.lit('"},\nnoise {"prompt": 1}\n```'))
    body = F.regexp_replace(F.regexp_replace(raw, r"```(?:jsonl|json)?\s*\n?", ""), "```", "")
    line = table(spark, sf, "documents").select("doc_id", F.explode(F.split(body, "\n")).alias("line"))
    line = line.withColumn("line", F.regexp_replace(F.regexp_replace("line", "^[-* ]+", ""), "[, ]+$", "")).where(F.col("line").startswith("{"))
    text = F.trim(F.coalesce(F.get_json_object("line", "$.text"), F.get_json_object("line", "$.prompt")))
    return line.select("doc_id", text.alias("text")).where((F.col("text") != "") & F.size(F.split("text", r"\s+")).between(3, 500))


@query("SELECT page_id, try_cast(regexp_extract(url, ':(\\d+)(/|$)', 1) AS int) AS port, regexp_extract(url, '://([^/?#]*)', 1) AS host, replace(url, '/en/', '/raw/') AS raw FROM pages".replace("\\\\", "\\"))
def x45_url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r":(\d+)(/|$)", 1).try_cast("int").alias("port"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.replace("url", F.lit("/en/"), F.lit("/raw/")).alias("raw"))


@query("SELECT page_id, CASE lower(regexp_extract(url, '[.]([a-z]+)([?#]|$)', 1)) WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' ELSE 'unknown' END AS format FROM pages")
def x46_format_detection(spark, sf):
    ext = F.lower(F.regexp_extract("url", "[.]([a-z]+)([?#]|$)", 1))
    known = F.create_map(*[F.lit(x) for kv in (("html", "html"), ("pdf", "pdf"), ("txt", "text")) for x in kv])
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.element_at(known, ext), F.lit("unknown")).alias("format"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 2, 1), len(string_split(text, chr(10)))), chr(10)) AS tail FROM documents")
def b44_log_tail(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), "\n").alias("tail"))


@query("SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt <= value + 2.0) WHERE rn = 1")
def b38_plateau(spark, sf):
    """The first value that the next exceeds by no more than 2."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("nxt", F.lead("value").over(w)).where("nxt <= value + 2.0")
    return e.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"))


_MARK = "SELECT *, sum((event_type = 'error')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events"


@query(f"SELECT user_id, m::bigint AS marker, count(*) AS words, round_even(sum(value), 4)::double AS total FROM ({_MARK}) WHERE event_type <> 'error' GROUP BY user_id, m")
def m04_marker_windows(spark, sf):
    """Windows that a marker event closes."""
    m = F.sum((F.col("event_type") == "error").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("marker", m).where("event_type <> 'error'").groupBy("user_id", "marker").agg(F.count("*").alias("words"), F.bround(F.sum("value"), 4).alias("total"))


@query("WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT user_id, count_if(event_type = 'click' AND prev = 'view') AS turns, count_if(event_type = 'click' AND (prev IS NULL OR prev <> 'view')) AS rejected FROM e GROUP BY user_id")
def m05_state_transitions(spark, sf):
    """Turns that begin in the right state, and those refused."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").withColumn("prev", prev)
    click = F.col("event_type") == "click"
    return e.groupBy("user_id").agg(F.count_if(click & (F.col("prev") == "view")).alias("turns"), F.count_if(click & (F.col("prev").isNull() | (F.col("prev") != "view"))).alias("rejected"))


@query("WITH l AS (SELECT max(ts) AS now FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events, l WHERE ts > now - INTERVAL 5 DAY) SELECT user_id, event_id FROM a WHERE rn <= 4")
def m06_ttl_store(spark, sf):
    """What has not expired, of each key the latest few."""
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    alive = e.crossJoin(F.broadcast(now)).where("ts > now - INTERVAL 5 DAYS")
    return first_rows(alive, ["user_id"], [F.desc("ts"), F.desc("event_id")], 4).select("user_id", "event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 1 AS hit FROM events")
def m07_cache_hits(spark, sf):
    n = F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "events").select("event_id", (n > 1).alias("hit"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, arg_max(value < 100, (ts, event_id)) AS healthy, count(*) AS probes FROM events GROUP BY 1, 2")
def m08_health_probe(spark, sf):
    """The latest status of each key in a window of time."""
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.max_by(F.col("value") < 100, F.struct("ts", "event_id")).alias("healthy"), F.count("*").alias("probes"))


@query("SELECT user_id, frame, count(*) AS n, round_even(sum(value), 4)::double AS total FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS frame FROM events) GROUP BY 1, 2")
def m12_count_windows(spark, sf):
    """Frames of four rows."""
    k = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / 4)
    return table(spark, sf, "events").withColumn("frame", k).groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, (i // 200)::int AS k, to_base64(encode(substr(x, i + 1, 200))) AS chunk FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS x, unnest(range(0, greatest(length(regexp_replace(text, '[^ -~]', '', 'g')), 1), 200)) AS i FROM documents)")
def m13_chunked_output(spark, sf):
    """Fixed slices in base64."""
    x = F.regexp_replace("text", "[^ -~]", "")
    n = F.greatest(F.length(x), F.lit(1))
    d = table(spark, sf, "documents").select("doc_id", x.alias("x"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 200).cast("int"))).alias("k"))
    return d.select("doc_id", "k", F.replace(F.base64(F.expr("encode(substring(x, k * 200 + 1, 200), 'utf-8')")), F.lit("\r\n"), F.lit("")).alias("chunk"))


@query("SELECT user_id, bool_or(value > 100) AS seen, count(*) AS chunks FROM events GROUP BY user_id")
def m14_content_seen(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 100).alias("seen"), F.count("*").alias("chunks"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'input' WHEN 'view' THEN 'listen' WHEN 'purchase' THEN 'commit' END AS kind, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def m18_event_dispatch(spark, sf):
    kinds = F.when(F.col("event_type") == "click", "input").when(F.col("event_type") == "view", "listen").when(F.col("event_type") == "purchase", "commit")
    return table(spark, sf, "events").select("event_id", kinds.alias("kind"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


_FRAMES = "SELECT user_id, string_agg('data: ' || event_type || CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) ELSE '-' END, '' ORDER BY ts, event_id) AS s FROM events GROUP BY user_id"


@query(f"SELECT user_id, len(string_split(s, chr(10) || chr(10))) AS frames, length(list_last(string_split(s, chr(10) || chr(10)))) AS trailing FROM ({_FRAMES})")
def m01_sse_frames(spark, sf):
    """Frames end with a blank line; what trails is flushed (the streaming form is in ``streaming``)."""
    chunk = F.concat(F.lit("data: "), "event_type", F.when(F.col("event_id") % 3 == 0, "\n\n").otherwise("-"))
    g = table(spark, sf, "events").select("user_id", "ts", "event_id", chunk.alias("c")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "c"))), lambda x: x["c"]), "").alias("s"))
    frames = F.split("s", "\n\n")
    return g.select("user_id", F.size(frames).alias("frames"), F.length(F.element_at(frames, -1)).alias("trailing"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def x04_html_text(spark, sf):
    """Scripts and tags go, white space shrinks."""
    h = F.regexp_replace("html", r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " ")).alias("text"))


@query(r"SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def x58_title_and_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"), F.regexp_count("html", F.lit("<a ")).alias("links"))


@query(r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), b AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT doc_id, sqrt(sum(n * n)) AS m FROM b GROUP BY 1) SELECT x.doc_id, y.doc_id AS other, round_even(sum(x.n * y.n) / (any_value(p.m) * any_value(o.m)), 6)::double AS cos FROM b x JOIN b y ON x.w = y.w AND y.doc_id = x.doc_id + 1 JOIN m p ON p.doc_id = x.doc_id JOIN m o ON o.doc_id = y.doc_id GROUP BY 1, 2")
def x26_bag_cosine(spark, sf):
    """Cosine of the word bags of a document and the next one, over whole texts; a text is moved twice, packed, its words never."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", packed("text").alias("text"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("text").alias("other_text"))
    both = d.join(after, "doc_id").select("doc_id", "other", bag_cosine("text", "other_text").alias("cos"))
    return both.where("cos > 0").withColumn("cos", F.bround("cos", 6))


#: Means up to which they go to every task.
_FEW_MEANS = 5000


@query("SELECT vec_id, arg_max(c, (round_even(s, 6), -c)) AS predicted FROM (SELECT e.vec_id, m.label AS c, list_dot_product(e.embedding::double[], m.v) AS s FROM embeddings e, (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label) m) GROUP BY vec_id")
def x53_nearest_centroid(spark, sf):
    """A router head: the label whose mean vector is most alike. Every row meets every mean; they are broadcast while they are few."""
    e = table(spark, sf, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v")).withColumnRenamed("label", "c")
    dot = F.aggregate(F.zip_with("embedding", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    few = means.limit(_FEW_MEANS + 1).count() <= _FEW_MEANS
    pairs = e.crossJoin(F.broadcast(means) if few else means).select("vec_id", "c", F.bround(dot, 6).alias("s"))
    return pairs.groupBy("vec_id").agg(F.max_by("c", F.struct("s", -F.col("c"))).alias("predicted"))
