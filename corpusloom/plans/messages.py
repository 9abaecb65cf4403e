"""Queries on records, messages and what models write: projections, predicates, parsers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import structure as B
from ..functions import text as T
from ..operators import messages as M
from ..operators.pii import pii_findings
from .corpus import q
from .registry import query, table


def _turns(spark, sf):
    return table(spark, sf, "conversations")


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _blocks(turn, text):
    """Content as blocks, by a turn's number: one text, two, an image, or a file."""
    block = lambda kind, t, url: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), url.cast("string").alias("url"), F.concat(F.lit("f"), turn.cast("string"), F.lit(".txt")).alias("filename"))
    none = F.lit(None)
    one = F.array(block("text", text, none))
    two = F.array(block("text", text, none), block("text", F.lit("again"), none))
    image = F.array(block("image_url", none, F.lit("data:image/png;base64,QUI=")))
    file = F.array(block("image_url", none, F.lit("http://x/i.png")), block("input_file", text, none))
    return F.when(turn % 3 == 0, one).when(turn % 3 == 1, two).when(turn % 6 == 5, file).otherwise(image)


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN 'm:' || lang END AS user_text FROM documents")
def p04_coalesce_columns(spark, sf):
    """The first of several columns that holds something: messages, prompt, then instruction."""
    k = F.col("doc_id") % 4
    d = _docs(spark, sf).select("doc_id", F.when(k == 2, F.concat(F.lit("m:"), "lang")).otherwise("").alias("messages"), F.when(k == 0, F.col("text")).otherwise("").alias("prompt"), F.when(k == 1, F.col("source")).alias("instruction"))
    return d.select("doc_id", T.first_filled("messages", "prompt", "instruction").alias("user_text"))


@query("SELECT doc_id, '{\"source\":\"' || source || '\",\"license\":\"MIT\",\"domain_tag\":\"' || lang || '\",\"extra\":{\"n\":\"' || n_chars || '\",\"path\":\"d/' || doc_id || '\"}}' AS provenance FROM documents WHERE lang IS NOT NULL")
def p05_provenance_record(spark, sf):
    """Fixed keys and a map of extra ones."""
    extra = F.create_map(F.lit("n"), F.col("n_chars").cast("string"), F.lit("path"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    d = _docs(spark, sf).where("lang IS NOT NULL")
    return d.select("doc_id", F.to_json(M.provenance(F.col("source"), F.lit("MIT"), F.col("lang"), extra)).alias("provenance"))


@query("SELECT doc_id, source, 'rust' AS domain_tag, 'domain-' || lang AS supplemented_from FROM documents WHERE lang = 'de'")
def p06_retag(spark, sf):
    """A copy of a nested record with another tag, and where it is from."""
    d = _docs(spark, sf).where("lang = 'de'").select("doc_id", M.provenance(F.col("source"), F.lit("MIT"), F.col("lang"), F.create_map().cast("map<string,string>")).alias("p"))
    p = F.col("p").withField("supplemented_from", F.concat(F.lit("domain-"), "p.domain_tag")).withField("domain_tag", F.lit("rust"))
    return d.select("doc_id", p.alias("p")).select("doc_id", "p.source", "p.domain_tag", "p.supplemented_from")


@query("SELECT doc_id, domain FROM documents, (SELECT unnest(['kicad', 'spice', 'emc']) AS domain) WHERE lang = 'fr' UNION ALL SELECT doc_id, 'spice' FROM documents WHERE lang = 'es'")
def p07_fan_out(spark, sf):
    """A record for each domain that its source feeds."""
    domains = F.when(F.col("lang") == "fr", F.array(F.lit("kicad"), F.lit("spice"), F.lit("emc"))).when(F.col("lang") == "es", F.array(F.lit("spice")))
    return _docs(spark, sf).select("doc_id", F.explode(domains).alias("domain"))


@query("SELECT l_orderkey, l_linenumber, 'disc' AS axis, l_discount AS score FROM lineitem WHERE l_discount > 0 UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem WHERE l_tax > 0")
def p08_prefixed_map(spark, sf):
    """Columns of a prefix as a map without nulls, a row for each entry."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("axis_disc"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("axis_tax"))
    return x.select("l_orderkey", "l_linenumber", F.explode(M.prefixed(x, "axis_")).alias("axis", "score"))


@query("SELECT event_type || '.' || m AS name, round_even(v, 4)::double AS value FROM (SELECT event_type, 'n' AS m, count(*)::double AS v FROM events GROUP BY 1 UNION ALL SELECT event_type, 'best', max(value) FROM events GROUP BY 1)")
def p09_flatten_metrics(spark, sf):
    """{task: {metric: value}} as task.metric, numbers only."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    metrics = F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("best"), F.col("best").cast("string"), F.lit("note"), F.lit("none"))
    nested = g.agg(F.map_from_entries(F.collect_list(F.struct("event_type", metrics))).alias("tasks"))
    return M.flat_metrics(nested, "tasks").select("name", F.bround("value", 4).alias("value"))


_BLOCKS = "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'again' ELSE '' END"


@query(f"SELECT conv_id, turn, {_BLOCKS} AS flat, turn % 3 = 2 AS kept_as_list FROM conversations WHERE text IS NOT NULL")
def p13_content_blocks(spark, sf):
    """Text blocks joined by newlines; others give no text, and keep the list for the worker."""
    c = _turns(spark, sf).where("text IS NOT NULL").select("conv_id", "turn", _blocks(F.col("turn"), F.col("text")).alias("blocks"))
    return c.select("conv_id", "turn", M.block_text("blocks").alias("flat"), F.exists("blocks", lambda b: b["type"] != "text").alias("kept_as_list"))


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS last_user FROM conversations GROUP BY conv_id")
def p14_last_user_text(spark, sf):
    """The text of the last message of a user."""
    mine = F.col("role") == "user"
    return _turns(spark, sf).groupBy("conv_id").agg(F.coalesce(F.max_by(F.when(mine, F.col("text")), F.when(mine, F.col("turn"))), F.lit("")).alias("last_user"))


@query("SELECT conv_id, string_agg('{\"role\":\"' || role || '\",\"content\":' || length(text) || '}', ',' ORDER BY turn) AS messages FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def p15_trim_messages(spark, sf):
    """Messages without any key but role and content (here: its length)."""
    m = F.struct("turn", "role", F.length("text").alias("content"), F.lit("x").alias("name"), F.lit(0).alias("tool_calls"))
    g = _turns(spark, sf).where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return g.select("conv_id", F.array_join(F.transform("m", lambda x: F.to_json(F.struct(x["role"].alias("role"), x["content"].alias("content")))), ",").alias("messages"))


@query("SELECT p_partkey, 'Project ' || p_name || ': ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' Website: http://' || lower(replace(p_brand, '#', '-')) || '.org' ELSE '' END AS description FROM part WHERE length('Project ' || p_name || ': ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' Website: http://' || lower(replace(p_brand, '#', '-')) || '.org' ELSE '' END) >= 30")
def p23_project_record(spark, sf):
    """A description with its website where there is one; 30 characters or more."""
    site = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" Website: http://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".org"))).otherwise("")
    d = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Project "), "p_name", F.lit(": "), "p_type", site).alias("description"))
    return d.where(F.length("description") >= 30)


@query("SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS fr, max(text) FILTER (WHERE turn = 1) AS en FROM conversations GROUP BY conv_id HAVING length(max(text) FILTER (WHERE turn = 0)) > 20 AND length(max(text) FILTER (WHERE turn = 1)) > 20")
def p24_translation_pair(spark, sf):
    """Both sides from flat columns or from a nested record, each longer than 20 characters."""
    g = _turns(spark, sf).groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"))
    nested = F.col("conv_id") % 2 == 0
    rows = g.select("conv_id", F.when(~nested, F.col("a")).alias("fr"), F.when(~nested, F.col("b")).alias("en"), F.when(nested, F.struct(F.col("a").alias("fr"), F.col("b").alias("en"))).alias("translation"))
    fr, en = F.coalesce("fr", "translation.fr"), F.coalesce("en", "translation.en")
    return rows.select("conv_id", fr.alias("fr"), en.alias("en")).where((F.length("fr") > 20) & (F.length("en") > 20))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id")
def p25_messages_only(spark, sf):
    """Two sources as messages alone, without provenance."""
    m = _turns(spark, sf).groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("messages"), F.lit("s").alias("_provenance"))
    parts = [m.where(F.col("conv_id") % 3 == k).select("conv_id", "messages") for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("conv_id", F.size("messages").cast("long").alias("n"))


@query("SELECT event_id, string_agg(k || '=' || v, ';' ORDER BY k) AS headers FROM (SELECT event_id, unnest(['x-alias', 'x-chain', 'x-domain', 'x-lora', 'x-port']) AS k, unnest([CASE WHEN user_id % 3 > 0 THEN 'alias-' || user_id END, CASE WHEN event_type = 'error' THEN 'retry' END, event_type, CASE WHEN user_id % 2 = 0 THEN 'a,b' END, (8500 + user_id)::varchar]) AS v FROM events) WHERE v IS NOT NULL GROUP BY event_id")
def p26_response_headers(spark, sf):
    """Headers of a response; those without a value are not sent."""
    u = F.col("user_id")
    h = F.create_map(F.lit("x-port"), (u + 8500).cast("string"), F.lit("x-domain"), F.col("event_type"), F.lit("x-chain"), F.when(F.col("event_type") == "error", "retry"), F.lit("x-alias"), F.when(u % 3 > 0, F.concat(F.lit("alias-"), u.cast("string"))), F.lit("x-lora"), F.when(u % 2 == 0, F.array_join(F.array(F.lit("a"), F.lit("b")), ",")))
    sent = F.array_sort(F.map_entries(F.map_filter(h, lambda _, v: v.isNotNull())))
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(sent, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))


_INVENTORY = (("src1", "base-a", ["l1", "l2"], "h1"), ("src2", "base-b", [], "h2"))


@query("SELECT doc_id, source AS alias, coalesce(base_model, 'unknown') AS base_model, coalesce(lora, '') AS lora, coalesce(host, 'unknown') AS host FROM documents LEFT JOIN (SELECT * FROM (VALUES ('src1', 'base-a', 'l1,l2', 'h1'), ('src2', 'base-b', '', 'h2')) t(source, base_model, lora, host)) USING (source)")
def p27_inventory_stamp(spark, sf):
    """What serves an alias, or a placeholder."""
    inventory = spark.createDataFrame(_INVENTORY, "source string, base_model string, lora array<string>, host string")
    d = _docs(spark, sf).join(F.broadcast(inventory), "source", "left")
    return d.select("doc_id", F.col("source").alias("alias"), F.coalesce("base_model", F.lit("unknown")).alias("base_model"), F.coalesce(F.array_join("lora", ","), F.lit("")).alias("lora"), F.coalesce("host", F.lit("unknown")).alias("host"))


# ---- predicates

_RESTRICTIVE, _PERMISSIVE = "(?i)(GNU|AGPL|CC BY-NC|non-commercial|proprietary)", "(?i)(MIT|Apache|BSD|CC0|public domain)"
_MACRO = "text || CASE doc_id % 5 WHEN 0 THEN ' __License__ = ''LGPL-2.1 and GNU''' WHEN 1 THEN ' __License__ = ''GNU GPL''' WHEN 2 THEN ' __License__ = '' ''' ELSE '' END"


@query(f"""WITH m AS (SELECT doc_id, {_MACRO} AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, t, regexp_matches(t, '__License__\\s*=\\s*[''"][^''"]+') AS has, trim(regexp_extract(t, '__License__\\s*=\\s*[''"]([^''"]+)', 1)) AS lic, substr(t, 1, 1500) AS head FROM m)
 SELECT doc_id, CASE WHEN has AND (lic = '' OR lower(lic) = 'none') THEN 'community-contributed' WHEN has AND regexp_matches(lic, '{_RESTRICTIVE}') AND NOT regexp_matches(lic, '(?i)LGPL') THEN NULL WHEN has THEN lic WHEN regexp_matches(head, '{_RESTRICTIVE}') AND NOT regexp_matches(head, '(?i)LGPL') THEN NULL WHEN regexp_matches(head, '{_PERMISSIVE}') THEN regexp_extract(head, '{_PERMISSIVE}', 1) ELSE 'community-contributed' END AS license FROM x""")
def f20_macro_license(spark, sf):
    """The licence that a macro names, or its head does; null where it restricts, but for LGPL."""
    i = F.col("doc_id") % 5
    named = F.when(i == 0, " __License__ = 'LGPL-2.1 and GNU'").when(i == 1, " __License__ = 'GNU GPL'").when(i == 2, " __License__ = ' '").otherwise("")
    return _docs(spark, sf).where("text IS NOT NULL").select("doc_id", M.macro_license(F.concat("text", named), _RESTRICTIVE, _PERMISSIVE).alias("license"))


@query("WITH f AS (SELECT source, doc_id % 9 AS k FROM documents) SELECT source, bool_or(k = 0) OR bool_or(k = 1) AS verified FROM f WHERE source IS NOT NULL GROUP BY source")
def f21_repo_license_file(spark, sf):
    """A repository is trusted for a licence file, or else for an allowed licence in its package file."""
    k = F.col("doc_id") % 9
    files = _docs(spark, sf).where("source IS NOT NULL").select("source", F.when(k == 0, "LICENSE-MIT").when(k == 1, "Cargo.toml").when(k == 2, "Cargo.lock").otherwise("lib.rs").alias("name"), F.when(k == 1, "license = 'MIT'").otherwise("").alias("text"))
    allowed = F.lit(False)
    for spdx in ("MIT", "Apache-2.0", "0BSD", "BSD-3-Clause"):
        allowed = allowed | F.contains("text", F.lit(spdx))
    file = F.bool_or(F.col("name").rlike("^(LICENSE|COPYING)"))
    return files.groupBy("source").agg((file | F.bool_or((F.col("name") == "Cargo.toml") & allowed)).alias("verified"))


@query("SELECT lang, count_if(text IS NULL OR text = '') = 0 AND count_if(source IS NULL) = 0 AS clean, count_if(text IS NULL OR text = '') + count_if(source IS NULL) AS violations FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def f23_assert_clean(spark, sf):
    """Whether a split has no violation; ``operators.messages.assert_clean`` raises with the first ones."""
    bad = M.violations(_docs(spark, sf).where("lang IS NOT NULL"), "lang", {"text": "text IS NULL OR text = ''", "source": "source IS NULL"})
    n = bad.groupBy("lang").agg(F.count("*").alias("violations"))
    every = _docs(spark, sf).where("lang IS NOT NULL").select("lang").distinct()
    counted = F.coalesce("violations", F.lit(0)).cast("long")
    return every.join(n, "lang", "left").select("lang", (counted == 0).alias("clean"), counted.alias("violations"))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(source, '') || ' ' || coalesce(text, '')), 'scum') OR contains(lower(coalesce(source, '') || ' ' || coalesce(text, '')), 'src4') ORDER BY doc_id LIMIT 120")
def f28_shell_supplement(spark, sf):
    """Any marker in seed, instruction or response; twice the target at most."""
    whole = F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))))
    return _docs(spark, sf).where(T.any_of(whole, ("scum", "src4"))).orderBy("doc_id").limit(120).select("doc_id")


#: What is planted behind texts: (text, kind, score of the find; None where there is none).
_PLANTED = (
    ("card 4111 1111 1111 1111 end", "CREDIT_CARD", 1.0, "4111 1111 1111 1111"),
    ("card 4111 1111 1111 1112 end", None, None, None),
    ("pay DE89 3704 0044 0532 0130 00 now", "IBAN_CODE", 1.0, "DE89 3704 0044 0532 0130 00"),
    ("pay DE88 3704 0044 0532 0130 00 now", None, None, None),
    ("to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa ok", "CRYPTO", 1.0, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    ("to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb ok", None, None, None),
    ("nhs 943 476 5919 ok", "UK_NHS", 1.0, "943 476 5919"),
    ("nhs 943 476 5918 ok", None, None, None),
    ("dea AB1234563 ok", "MEDICAL_LICENSE", 1.0, "AB1234563"),
    ("dea AB1234564 ok", None, None, None),
    ("her ssn is 536-90-4399 ok", "US_SSN", 0.85, "536-90-4399"),
    ("her ssn is 666-90-4399 ok", None, None, None),
    ("host 10.20.30.40 ok", "IP_ADDRESS", 0.6, "10.20.30.40"),
    ("host 10.20.30.400 ok", None, None, None),
    ("ip 10.20.30.41 ok", "IP_ADDRESS", 0.95, "10.20.30.41"),
    ("tel +49 30 901820 ok", "PHONE_NUMBER", 0.75, "+49 30 901820"),
    ("code 030 901 8207 ok", None, None, None),
    ("passport X12345678 ok", None, None, None),
    ("write to a.b+c@mail.example.org ok", "EMAIL_ADDRESS", 1.0, "a.b+c@mail.example.org"),
    ("write to a.b+c@mail ok", None, None, None),
)
#: So far that no word of a text lends its weight to what is planted behind it.
_APART = "\n" + "- " * 40


def _planted(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = F.array(*[F.lit(p[0]) for p in _PLANTED])
    return d.withColumn("whole", F.concat("text", F.lit(_APART), F.get(told, (F.col("doc_id") % len(_PLANTED)).cast("int"))))


_FOUND_SQL = "SELECT doc_id, kind, score, value FROM (SELECT doc_id, doc_id % " + str(len(_PLANTED)) + " AS k FROM documents) JOIN (VALUES " + ", ".join(f"({k}, {q(kind)}, {score}::double, {q(value)})" for k, (_, kind, score, value) in enumerate(_PLANTED) if kind) + ") t(k, kind, score, value) USING (k)"


@query(_FOUND_SQL)
def x07_pii_kinds(spark, sf):
    """Personal data of ten kinds in whole texts, by check digits and words around: what is found of numbers planted behind each, valid and invalid by turns."""
    whole = _planted(spark, sf)
    found = pii_findings(whole, "doc_id", "whole")
    starts = whole.select("doc_id", (F.length("text") + len(_APART)).alias("from"))
    return found.join(starts, "doc_id").where(F.col("start") >= F.col("from")).select("doc_id", "kind", "score", "value")


@query(f"SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_FOUND_SQL}) WHERE score >= 0.6 GROUP BY kind")
def f29_high_signal(spark, sf):
    """Findings of the ten kinds that matter, with a score of 0.6 or more: how many of each are in what is planted."""
    told = _planted(spark, sf).select("doc_id", F.element_at(F.split("whole", _APART), -1).alias("planted"))
    found = pii_findings(told, "doc_id", "planted", least=0.6).where(F.col("kind").isin(*R.HIGH_SIGNAL_KINDS))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("WITH h AS (SELECT l_suppkey % 20 AS port FROM lineitem GROUP BY 1 HAVING max(l_quantity) FILTER (WHERE l_suppkey % 20 < 14) >= 40) SELECT DISTINCT s_nationkey % 20 AS port, 'alias-' || s_nationkey AS alias FROM supplier WHERE s_nationkey % 20 IN (SELECT port FROM h) UNION SELECT NULL, 'auto'")
def f30_liveness(spark, sf):
    """Aliases whose port is healthy; the automatic one stays in any case."""
    healthy = table(spark, sf, "lineitem").where("l_suppkey % 20 < 14").groupBy((F.col("l_suppkey") % 20).cast("int").alias("port")).agg(F.max("l_quantity").alias("m")).where("m >= 40").select("port")
    aliases = table(spark, sf, "supplier").select((F.col("s_nationkey") % 20).alias("port"), F.concat(F.lit("alias-"), F.col("s_nationkey").cast("string")).alias("alias")).distinct()
    return aliases.join(healthy, "port", "left_semi").unionByName(spark.createDataFrame([(None, "auto")], "port int, alias string"))


_BODY = "CASE s_suppkey % 4 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /' WHEN 1 THEN 'User-agent: corpusbot' || chr(10) || 'Disallow: /docs' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /private' WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow:' ELSE 'User-agent: corpusbot' || chr(10) || 'Disallow: /' || chr(10) || 'Allow: /docs' END"
_STATUS = "CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_suppkey % 7 = 1 THEN 404 ELSE 200 END"
_TDM = "s_suppkey % 5 = 2 OR s_suppkey % 11 = 3"


@query(f"SELECT s_suppkey, CASE WHEN {_STATUS} = 0 THEN 'ERROR' WHEN {_TDM} THEN 'BLOCKED' WHEN {_STATUS} = 404 THEN 'ALLOWED' WHEN s_suppkey % 4 = 0 THEN 'BLOCKED' ELSE 'ALLOWED' END AS status FROM supplier")
def f32_robots_rules(spark, sf):
    """robots.txt is read by its groups: an opt-out or a rule for both agents blocks."""
    s = table(spark, sf, "supplier")
    x = F.when(F.col("s_suppkey") % 5 == 2, "noai, noindex").when(F.col("s_suppkey") % 5 == 1, "noindex")
    reserved = F.when(F.col("s_suppkey") % 11 == 3, "1")
    d = s.select("s_suppkey", F.expr(_STATUS).alias("code"), F.expr(_BODY.replace("chr(10)", "'\\n'")).alias("body"), x.alias("x_robots"), reserved.alias("tdm"))
    return d.select("s_suppkey", M.robots_status("code", "body", "x_robots", "tdm", "corpusbot", "/docs/a.pdf").alias("status"))


@query(f"SELECT s_suppkey, {_TDM} AS opt_out FROM supplier")
def f33_header_rule(spark, sf):
    """The opt-out of headers: noai or noml, or a reservation."""
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", M.opted_out(F.when(F.col("s_suppkey") % 5 == 2, "NoAI, noindex").when(F.col("s_suppkey") % 5 == 1, "noindex"), F.when(F.col("s_suppkey") % 11 == 3, "1")).alias("opt_out"))


@query("SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'ALLOWED' WHEN page_id % 3 = 1 THEN 'BLOCKED' ELSE 'ALLOWED' END AS status FROM pages")
def f34_body_markers(spark, sf):
    """A marker in the lower-cased body blocks; a body that could not be fetched does not."""
    k = F.col("page_id")
    body = F.when(k % 6 == 0, F.lit(None)).when(k % 3 == 1, F.concat(F.lit("X-Robots-Tag: NoTDM "), F.col("html"))).otherwise(F.col("html"))
    low = F.lower(body)
    marked = T.any_of(low, ("tdmrep", "tdm-reservation", "x-robots-tag: notdm"))
    return table(spark, sf, "pages").select("page_id", F.when(F.coalesce(marked, F.lit(False)), "BLOCKED").otherwise("ALLOWED").alias("status"))


@query("SELECT l_partkey % 50 AS k, count_if(l_returnflag = 'A') >= 25 AND count_if(l_returnflag = 'R') >= 25 AS enough FROM lineitem GROUP BY 1")
def f37_sample_size(spark, sf):
    """Both sides have 25 samples or more."""
    g = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    return g.select("k", ((F.col("a") >= 25) & (F.col("b") >= 25)).alias("enough"))


@query("SELECT conv_id, turn, coalesce(length(text), 0) < 200 AND turn % 4 <> 3 AND turn % 3 = 0 AS empty FROM conversations")
def f38_empty_completion(spark, sf):
    """No text, no tool call, and usage that says no tokens; absent usage passes."""
    c = _turns(spark, sf).select("conv_id", "turn", F.when(F.length("text") >= 200, F.col("text")).otherwise("").alias("content"), F.when(F.col("turn") % 4 == 3, F.array(F.lit("call"))).alias("tool_calls"), F.when(F.col("turn") % 3 == 0, 0).alias("tokens"))
    none = F.coalesce(F.col("content") == "", F.lit(True)) & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0) & F.col("tokens").eqNullSafe(F.lit(0))
    return c.select("conv_id", "turn", none.alias("empty"))


@query("SELECT conv_id, turn, turn % 3 = 2 AS has_images, turn % 6 = 5 AS has_files, CASE WHEN turn % 3 = 2 AND conv_id % 2 = 0 THEN 'vision' ELSE 'alias-' || conv_id % 2 END AS routed FROM conversations WHERE text IS NOT NULL")
def f42_multimodal(spark, sf):
    """Images and files among the blocks; images move a request to the alias that sees."""
    c = _turns(spark, sf).where("text IS NOT NULL").select("conv_id", "turn", _blocks(F.col("turn"), F.col("text")).alias("blocks"))
    images = M.has_block("blocks", "image_url", "image", "input_image")
    return c.select("conv_id", "turn", images.alias("has_images"), M.has_block("blocks", "input_file").alias("has_files"), M.routed_alias(F.concat(F.lit("alias-"), (F.col("conv_id") % 2).cast("string")), images, ("alias-1",), "vision").alias("routed"))


_EMBEDDED_SQL = R.EMBEDDED_WORDS.replace("'", "''")


@query(f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'uses GPIO and ' ELSE '' END || text || CASE WHEN doc_id % 6 = 1 THEN ' bare-metal' ELSE '' END AS t, CASE WHEN doc_id % 5 = 0 THEN 'gpl-3.0' ELSE 'mit' END AS license FROM documents) WHERE license IN ('mit', 'apache-2.0') AND len(string_split(t, chr(10))) BETWEEN 2 AND 40 AND regexp_matches(t, '{_EMBEDDED_SQL}')")
def f43_embedded_relevance(spark, sf):
    """The word list of embedded code, an allowed licence and the bounds on lines."""
    i = F.col("doc_id")
    t = F.concat(F.when(i % 4 == 0, "uses GPIO and ").otherwise(""), "text", F.when(i % 6 == 1, " bare-metal").otherwise(""))
    d = _docs(spark, sf).select("doc_id", t.alias("t"), F.when(i % 5 == 0, "gpl-3.0").otherwise("mit").alias("license"))
    return d.where(F.col("license").isin("mit", "apache-2.0") & T.line_count("t").between(2, 40) & F.col("t").rlike(R.EMBEDDED_WORDS)).select("doc_id")


@query("SELECT doc_id AS row_index, field, value FROM (SELECT doc_id, 'file_size_bytes' AS field, (n_chars - 300)::varchar AS value FROM documents WHERE n_chars - 300 < 0 UNION ALL SELECT doc_id, 'source_url', '' FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'license_spdx', ' ' FROM documents WHERE doc_id % 17 = 0)")
def f24_constraint_rows(spark, sf):
    """What a manifest row may not be: a negative size, or a blank in a required field."""
    i = F.col("doc_id")
    rows = _docs(spark, sf).select(i.alias("row_index"), (F.col("n_chars") - 300).cast("string").alias("file_size_bytes"), F.when(i % 13 == 0, "").otherwise("u").alias("source_url"), F.when(i % 17 == 0, " ").otherwise("MIT").alias("license_spdx"))
    long = rows.unpivot("row_index", ["file_size_bytes", "source_url", "license_spdx"], "field", "value")
    bad = F.when(F.col("field") == "file_size_bytes", F.col("value").try_cast("long").isNull() | (F.col("value").try_cast("long") < 0)).otherwise(T.strip("value") == "")
    return long.where(bad)


# ---- parsers

@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND contains(regexp_replace(text, '[^A-Za-z. é]', '', 'g'), ' ') THEN regexp_replace(text, '[^A-Za-z. é]', '', 'g') WHEN conv_id % 2 = 0 THEN replace(regexp_replace(text, '[^A-Za-z. é]', '', 'g'), 'é', 'Ã©') ELSE text END AS text FROM conversations")
def x18_byte_level_repair(spark, sf):
    """Texts spelt in the letters of byte-level tokens are turned back; others stay."""
    plain = F.regexp_replace("text", "[^A-Za-z. é]", "")
    spelt = F.replace(F.replace(plain, F.lit("é"), F.lit("Ã©")), F.lit(" "), F.lit("Ġ"))
    c = _turns(spark, sf).select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, spelt).otherwise(F.col("text")).alias("text"))
    return c.select("conv_id", "turn", B.repaired_udf("text").alias("text"))


@query(rf"WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS content, CASE WHEN turn % 4 = 0 THEN '<think>plan</think> ' || text WHEN turn % 4 = 2 THEN ' ' END AS reasoning FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, turn, CASE WHEN content = '' AND trim(coalesce(reasoning, '')) <> '' THEN reasoning ELSE content END AS c FROM t) SELECT conv_id, turn, CASE WHEN regexp_matches(c, '(?i)think') THEN regexp_replace(regexp_replace(regexp_replace(c, {q(R.THINK_BLOCK)}, '', 'g'), {q(R.THINK_MARK)}, '', 'g'), '^\s+|\s+$', '', 'g') ELSE c END AS content FROM p")
def x19_reasoning_promotion(spark, sf):
    """Reasoning takes the place of empty content; then its marks go."""
    c = _turns(spark, sf).where("text IS NOT NULL").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")).alias("content"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>plan</think> "), "text")).when(F.col("turn") % 4 == 2, " ").alias("reasoning"))
    return c.select("conv_id", "turn", T.promoted(F.col("content"), F.col("reasoning")).alias("content"))


_IP = "CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || user_id WHEN event_id % 4 = 1 THEN '10.1.0.' || user_id WHEN event_id % 4 = 2 THEN '10.2.0.' || user_id WHEN event_id % 3 = 0 THEN '10.3.0.' || user_id ELSE 'anon' END"


def _headers(spark, sf):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    ip = lambda k: F.concat(F.lit(f"10.{k}.0."), u)
    h = F.create_map(F.lit("CF-Connecting-IP"), F.when(i % 4 == 0, F.concat(F.lit(" "), ip(0))).otherwise(" "), F.lit("X-Real-Ip"), F.when(i % 4 == 1, ip(1)), F.lit("x-forwarded-for"), F.when(i % 4 <= 2, F.concat(ip(2), F.lit(", 9.9.9.9"))))
    return table(spark, sf, "events").select("event_id", M.client_ip(h, F.when(i % 3 == 0, ip(3))).alias("ip"))


@query(f"SELECT event_id, {_IP} AS ip FROM events")
def x20_client_ip(spark, sf):
    """The most trustworthy address of a request, whatever the case of its headers."""
    return _headers(spark, sf)


_PADS = [bytes(b ^ x for b in b"salt".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"SELECT event_id, substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({_IP})))), 1, 8) AS tenant FROM events")
def x21_tenant_id(spark, sf):
    """Eight digits of a keyed hash of the address."""
    return _headers(spark, sf).select("event_id", F.substring(B.keyed_hash("ip", "salt"), 1, 8).alias("tenant"))


@query("SELECT event_id, split_part(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'T', 1) AS day FROM events")
def x23_date_normalise(spark, sf):
    """A timestamp's text up to its T."""
    return table(spark, sf, "events").select("event_id", F.split_part(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("T"), F.lit(1)).alias("day"))


@query("SELECT conv_id, turn, try_cast(regexp_extract(x, '\\[\\[(\\d+(?:\\.\\d+)?)\\]\\]', 1) AS double) AS rating FROM (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' Rating: [[' || (turn % 10) || '.5]] or [[1]]' WHEN 1 THEN ' [[x]]' ELSE '' END AS x FROM conversations)".replace("\\\\", "\\"))
def x32_rating(spark, sf):
    """The first number in double brackets."""
    more = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" Rating: [["), (F.col("turn") % 10).cast("string"), F.lit(".5]] or [[1]]"))).when(F.col("turn") % 3 == 1, " [[x]]").otherwise("")
    return _turns(spark, sf).select("conv_id", "turn", T.rating(F.concat("text", more)).alias("rating"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 < 3 THEN turn % 5 ELSE 0 END::int AS choice FROM conversations WHERE text IS NOT NULL")
def x33_judge_choice(spark, sf):
    """The choice in a judge's prose, where it is one of three; else the first."""
    said = F.concat(F.regexp_replace("text", "[{}]", ""), F.lit(' so {"why": "x", "choice": '), (F.col("turn") % 5).cast("string"), F.lit("} it is"))
    return _turns(spark, sf).where("text IS NOT NULL").select("conv_id", "turn", M.judge_choice(said, 3).alias("choice"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'first step|second ' || conv_id WHEN turn % 3 = 1 THEN 'look|do it ' || conv_id || '|check' ELSE 'a|b|c|d' END AS plan FROM conversations")
def x34_plan_parse(spark, sf):
    """The steps of a plan: a JSON array in prose, else lines without their numbers; four at most."""
    i = F.col("conv_id").cast("string")
    array = F.concat(F.lit('Sure:\n["first step", "", "second '), i, F.lit('"] good luck'))
    lines = F.concat(F.lit("1. look\n2) do it "), i, F.lit("\n\n - check"))
    many = F.lit('["a", "b", "c", "d", "e"]')
    c = _turns(spark, sf).select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, array).when(F.col("turn") % 3 == 1, lines).otherwise(many).alias("out"))
    return c.select("conv_id", "turn", F.array_join(M.plan_steps("out", 4), "|").alias("plan"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'just words' ELSE 'first I look' END AS before, CASE turn % 4 WHEN 0 THEN 'find' WHEN 1 THEN 'fetch' WHEN 2 THEN 'sum' END AS name, CASE turn % 4 WHEN 0 THEN '{\"a\": \"}\"}' WHEN 1 THEN '{\"id\": ' || conv_id || '}' WHEN 2 THEN '{\"x\": [1, 2]}' END AS arguments FROM conversations")
def x35_tool_call(spark, sf):
    """A tool call in any of three spellings, and the text before it."""
    i = F.col("conv_id").cast("string")
    k = F.col("turn") % 4
    said = F.when(k == 0, 'first I look [TOOL_CALLS]find[ARGS]{"a": "}"} tail').when(k == 1, F.concat(F.lit('first I look <tool_call>{"name": "fetch", "arguments": {"id": '), i, F.lit("}}</tool_call>"))).when(k == 2, 'first I look {"name": "sum", "arguments": {"x": [1, 2]}} done').otherwise("just words")
    return _turns(spark, sf).select("conv_id", "turn", B.tool_call_udf(said).alias("c")).select("conv_id", "turn", "c.before", "c.name", "c.arguments")


@query("SELECT event_id, '{\"k\": {\"v\": \"' || CASE WHEN event_id % 2 = 0 THEN '}' ELSE '{' END || '\", \"n\": ' || event_id || '}}' AS found FROM events WHERE event_id % 5 < 4 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 4")
def x36_balanced_object(spark, sf):
    """The first balanced object of a text; braces inside quotes don't count."""
    i = F.col("event_id")
    body = F.concat(F.lit('said {"k": {"v": "'), F.when(i % 2 == 0, "}").otherwise("{"), F.lit('", "n": '), i.cast("string"), F.when(i % 5 == 4, "}").otherwise("}} and {more}"))
    return table(spark, sf, "events").select("event_id", B.first_object_udf(body).alias("found"))


@query("SELECT page_id, 'image/png' AS mime, length(html)::int AS size FROM pages WHERE page_id % 3 < 2 AND html IS NOT NULL UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE page_id % 3 = 2 AND html IS NOT NULL")
def x47_data_url(spark, sf):
    """Type and bytes of a data URL; nulls where it is malformed."""
    raw = F.replace(F.base64(F.encode(F.regexp_replace("html", "[^ -~]", "x"), "utf-8")), F.lit("\r\n"), F.lit(""))
    url = F.when(F.col("page_id") % 3 == 2, F.concat(F.lit("data:image/png;base64,*"), raw)).otherwise(F.concat(F.lit("data:image/png;base64,"), raw))
    p = table(spark, sf, "pages").where("html IS NOT NULL").select("page_id", B.data_url(url).alias("d"))
    return p.select("page_id", "d.mime", F.octet_length("d.body").alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 0.1 ELSE 0.2 END::double AS temperature, CASE WHEN event_id % 2 = 0 THEN 99 ELSE 512 END AS max_tokens, CASE WHEN event_id % 2 = 0 THEN 'END|</s>' ELSE '</s>|END' END AS stop, CASE WHEN event_id % 4 = 0 THEN 'on' ELSE 'off' END AS thinking FROM events")
def x48_default_merge(spark, sf):
    """Defaults of an alias under what the caller set: a schema's own default counts as not set, stop words are added."""
    i = F.col("event_id")
    body = table(spark, sf, "events").select("event_id", F.when(i % 3 == 0, F.lit(0.7)).when(i % 3 == 1, F.lit(0.1)).alias("temperature"), F.when(i % 2 == 0, 99).otherwise(2048).alias("max_tokens"), F.when(i % 2 == 0, F.array(F.lit("END"))).otherwise(F.array(F.lit("</s>"), F.lit("END"))).alias("stop"), F.when(i % 4 == 0, F.create_map(F.lit("thinking"), F.lit("on"))).alias("kwargs"))
    merged = M.with_defaults(body, {"temperature": (0.7, 0.2), "max_tokens": (2048, 512)}, ("END", "</s>"), {"thinking": "off"})
    return merged.select("event_id", "temperature", "max_tokens", F.array_join("stop", "|").alias("stop"), F.col("kwargs")["thinking"].alias("thinking"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'BSD-3-Clause' WHEN 2 THEN 'NOASSERTION' ELSE '' END AS spdx FROM documents")
def x49_spdx_spelling(spark, sf):
    """The canonical spelling of a licence; unknown ones in upper case."""
    k = F.col("doc_id") % 4
    key = F.when(k == 0, "apache-2.0").when(k == 1, "bsd-3-clause").when(k == 2, "noassertion")
    known = F.create_map(*[F.lit(x) for s in R.SPDX_SPELLINGS for x in (s.upper(), s)])
    upper = F.upper(F.coalesce(key, F.lit("")))
    return _docs(spark, sf).select("doc_id", F.coalesce(F.element_at(known, upper), upper).alias("spdx"))


@query("SELECT event_id, CASE WHEN (20 - least(event_id % 25, 20)) * 17 < 48 THEN '~' || ((20 - least(event_id % 25, 20)) * 17) || ' h' ELSE '~' || ((20 - least(event_id % 25, 20)) * 17 // 24) || ' jours' END AS eta FROM events")
def x51_campaign_eta(spark, sf):
    """Hours that remain at 17 a domain, as days from 48 on."""
    hours = F.greatest(F.lit(0), 20 - F.col("event_id") % 25) * 17
    return table(spark, sf, "events").select("event_id", F.when(hours < 48, F.concat(F.lit("~"), hours.cast("string"), F.lit(" h"))).otherwise(F.concat(F.lit("~"), F.floor(hours / 24).cast("string"), F.lit(" jours"))).alias("eta"))


@query("SELECT user_id, max(event_id % 5) AS phase, arg_max(event_id, (ts, event_id)) AS iter, bool_or(event_type = 'purchase') AS complete FROM (SELECT *, event_id % 5 AS ph FROM events) GROUP BY user_id")
def x52_log_progress(spark, sf):
    """Phase, last iteration and completion of each log, from its lines."""
    e = table(spark, sf, "events")
    line = F.concat(F.lit("PHASE "), (F.col("event_id") % 5).cast("string"), F.lit(" Iter "), F.col("event_id").cast("string"), F.when(F.col("event_type") == "purchase", " Training complete").otherwise(""))
    lines = e.select("user_id", F.struct("ts", "event_id").alias("at"), line.alias("line"))
    phase = F.regexp_extract("line", r"PHASE (\d+)", 1).cast("long")
    return lines.groupBy("user_id").agg(F.max(phase).alias("phase"), F.max_by(F.regexp_extract("line", r"Iter (\d+)", 1).cast("long"), "at").alias("iter"), F.bool_or(F.contains("line", F.lit("Training complete"))).alias("complete"))


@query("SELECT p_partkey, 10 + ('0x' || substr(sha256('42:r1:' || p_partkey), 1, 7))::bigint % 91 AS r1, round_even(0.5 + (('0x' || substr(sha256('42:c1:' || p_partkey), 1, 7))::bigint % 4501) / 1000.0, 3)::double AS c1 FROM part")
def x55_parameter_draw(spark, sf):
    """Values for a template's parameters, the same for a seed: whole numbers, or three decimals."""
    return table(spark, sf, "part").select("p_partkey", M.drawn("r1", "p_partkey", 10, 100).alias("r1"), M.drawn("c1", "p_partkey", 0.5, 5.0).alias("c1"))


@query("WITH t AS (SELECT doc_id, CASE WHEN length(c) > 3000 THEN substr(c, 1, 3000) || '...' ELSE c END AS c, doc_id % 6 AS k FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM documents WHERE text IS NOT NULL)) SELECT doc_id, CASE WHEN length(c) < 50 THEN '' ELSE CASE k WHEN 0 THEN 'Based on the page content, the following components and specifications are described:' WHEN 1 THEN 'This table shows the following technical content:' WHEN 2 THEN 'The key design considerations described on this page include:' WHEN 3 THEN 'The technical data shown includes:' WHEN 4 THEN 'The key technical points are:' ELSE 'This page contains the following technical content:' END || chr(10) || chr(10) || c END AS answer FROM t".replace("\\\\", "\\"))
def x56_answer_template(spark, sf):
    """An answer out of a page's text by what the question asks for; short pages have none."""
    asked = F.element_at(F.array(*map(F.lit, ("List the components.", "What is its purpose?", "Name design considerations.", "Extract the data.", "Summarize it.", "What is shown?"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf).where("text IS NOT NULL").select("doc_id", M.page_answer(F.col("text"), F.lit("table"), asked).alias("answer"))


@query("SELECT stream, seq, 'data: {\"choices\":[{\"delta\":{\"content\":\"w ' || seq || '\"}}]}' AS event FROM (SELECT user_id AS stream, event_id AS seq FROM events WHERE event_id % 3 <> 2) UNION ALL SELECT user_id, event_id, 'data: [DONE]' FROM events WHERE event_id % 3 = 2")
def m02_event_rewrite(spark, sf):
    """Events of a stream with reasoning promoted and marks gone; what is no such event passes as it is."""
    i = F.col("event_id")
    w = F.concat(F.lit("w "), i.cast("string"))
    delta = F.when(i % 3 == 0, F.struct(F.concat(F.lit("<think>x</think> "), w).alias("content"), F.lit(None).cast("string").alias("reasoning"))).otherwise(F.struct(F.lit("").alias("content"), w.alias("reasoning")))
    event = F.when(i % 3 == 2, "data: [DONE]").otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices")))))
    return table(spark, sf, "events").select(F.col("user_id").alias("stream"), i.alias("seq"), M.rewritten_event(event).alias("event"))


@query("SELECT conv_id, string_agg(regexp_replace(text, '[^a-z ]', '', 'g'), '' ORDER BY turn) AS said, count(*) AS deltas FROM conversations WHERE turn < 3 AND text IS NOT NULL AND turn <> 1 GROUP BY conv_id")
def m03_delta_reader(spark, sf):
    """What a stream says until its end; lines that are no JSON are skipped."""
    content = F.regexp_replace("text", "[^a-z ]", "")
    line = F.when(F.col("turn") == 1, "data: {broken").when(F.col("turn") == 3, "data: [DONE]").otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("delta"))).alias("choices")))))
    lines = _turns(spark, sf).where("text IS NOT NULL").select("conv_id", "turn", line.alias("line"))
    return M.stream_text(lines, "conv_id", "turn", "line")


@query("WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS came, round(value * 100)::bigint * 10000 + 60000000 AS work FROM events), b AS (SELECT *, (sum(work) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - work)::bigint AS before FROM e) SELECT user_id, event_id, max(came - before) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + before - came AS waited FROM b")
def m09_fifo_wait(spark, sf):
    """One request at a time for each worker: how long each waits for those before it.

    A request begins at the latest of arrival k less the work before k, plus the work before it, so
    a running maximum and a running sum replace the replay.
    """
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.round(F.col("value") * 100).cast("long") * 10_000 + 60_000_000).alias("work"), "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = e.withColumn("before", F.sum("work").over(w) - F.col("work"))
    start = F.max(F.col("at") - F.col("before")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    return before.select("user_id", "event_id", (start - F.col("at")).alias("waited"))


@query("SELECT conv_id, turn, 'Attached file: f' || turn || '.txt' || chr(10) || text AS text, length(text) > 400 AS truncated FROM conversations WHERE turn % 6 = 5 AND text IS NOT NULL AND length(text) <= 400 UNION ALL SELECT conv_id, turn, 'Attached file: f' || turn || '.txt' || chr(10) || substr(text, 1, 400), true FROM conversations WHERE turn % 6 = 5 AND length(text) > 400")
def b33_file_blocks(spark, sf):
    """Files among the blocks become text, cut and with a warning where they are long."""
    c = _turns(spark, sf).where("text IS NOT NULL AND turn % 6 = 5").select("conv_id", "turn", _blocks(F.col("turn"), F.col("text")).alias("blocks"))
    done = c.select("conv_id", "turn", F.explode(M.files_as_text("blocks", 400)).alias("b"))
    return done.where("b.truncated IS NOT NULL").select("conv_id", "turn", "b.text", "b.truncated")


@query("SELECT conv_id, turn, 'http://gw/img/' || substr(sha256('data:image/png;base64,' || to_base64(encode(conv_id::varchar))), 1, 16) AS url, 1::bigint AS staged FROM conversations WHERE turn % 3 = 2 AND text IS NOT NULL")
def b34_image_staging(spark, sf):
    """Images in data URLs are put under a key's URL."""
    c = _turns(spark, sf).where("text IS NOT NULL AND turn % 3 = 2")
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(F.col("conv_id").cast("string"), "utf-8")))
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("url")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), url.alias("url")))
    done = c.select("conv_id", "turn", M.staged_images(blocks, "http://gw/img/").alias("blocks"))
    images = F.filter("blocks", lambda b: b["type"] == "image_url")
    return done.select("conv_id", "turn", images[0]["url"].alias("url"), F.size(images).cast("long").alias("staged"))


@query("SELECT conv_id, -1::bigint AS turn, 'Be brief.' AS text FROM conversations GROUP BY conv_id HAVING count_if(role = 'system') = 0")
def b35_default_system(spark, sf):
    """A system message for conversations that have none."""
    c = _turns(spark, sf)
    return c.select("conv_id").distinct().join(c.where("role = 'system'"), "conv_id", "left_anti").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("Be brief.").alias("text"))


@query("SELECT c.conv_id, c.text || chr(10) || chr(10) || d.text AS merged FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND c.turn = 0 AND d.turn = 1 WHERE c.text IS NOT NULL AND d.text IS NOT NULL")
def b36_content_merge(spark, sf):
    """Two contents as one: texts by a blank line, and where one is a list of blocks, all blocks in order."""
    c = _turns(spark, sf).where("text IS NOT NULL AND turn < 2")
    g = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    blocks = lambda c: F.array(F.struct(F.lit("text").alias("type"), F.col(c).alias("text")))
    as_list = F.array_join(F.transform(F.concat(blocks("a"), blocks("b")), lambda x: x["text"]), "\n\n")
    return g.select("conv_id", F.when(F.col("conv_id") % 2 == 0, as_list).otherwise(F.concat("a", F.lit("\n\n"), "b")).alias("merged"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 AND conv_id % 2 = 0 THEN 'vision' ELSE 'alias-' || conv_id % 2 END AS alias FROM conversations")
def b37_vision_redirect(spark, sf):
    """A request with images to an alias that can't see them goes to the one that can."""
    return _turns(spark, sf).select("conv_id", "turn", M.routed_alias(F.concat(F.lit("alias-"), (F.col("conv_id") % 2).cast("string")), F.col("turn") % 3 == 2, ("alias-1",), "vision").alias("alias"))
