"""Queries that build corpora: filters, fallbacks, fan-outs and cascades over whole sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import builders as B
from ..operators import sequences as S
from ..operators import splits
from ..operators.ranking import first_rows
from .corpus import HASH, SQL_STRIP, WORDS
from .registry import query, table
from .sequences import _BINS, _packed

STRIP = SQL_STRIP.format(c="text")


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _manifest_sql(rows: str, cap: int) -> str:
    """Counts of each domain after a cap and a split of 95 to 5."""
    return f"WITH d AS ({rows}), n AS (SELECT domain, count(*) AS n_source FROM d GROUP BY domain) SELECT domain, n_source, least(n_source, {cap}) AS n_used, least(n_source, {cap}) - greatest(1, round_even(least(n_source, {cap}) * 0.05, 0))::bigint AS n_train, greatest(1, round_even(least(n_source, {cap}) * 0.05, 0))::bigint AS n_valid FROM n"


@query(f"SELECT item_id, to_json([{{'role': 'user', 'content': 'Item ' || item_id}}, {{'role': 'assistant', 'content': {STRIP}}}])::varchar AS messages FROM benchmark WHERE {STRIP} <> ''")
def b01_qa_records(spark, sf):
    """Questions and answers that both hold something, as chat records."""
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("question"), "text")
    return B.chat_records(b, "item_id", "question", "text")


_CODE = (("python", "contains(text, 'tion')"), ("rust", "contains(text, 'MIT')"), ("shell", "contains(text, 'der ')"), ("sql", "contains(text, 'les ')"), ("cpp", "contains(text, 'que ')"), ("web", "contains(text, 'License')"), ("all", "text IS NOT NULL"))


@query(_manifest_sql(" UNION ALL ".join(f"SELECT '{d}' AS domain, doc_id FROM documents WHERE {c}" for d, c in _CODE), 120))
def b02_language_domains(spark, sf):
    """One scan feeds seven domains; each is capped, split and told as a row of the manifest."""
    fed = B.fan_out(_docs(spark, sf), {d: F.expr(c) for d, c in _CODE}).select("doc_id", "domain")
    return B.manifest(fed, "domain", "doc_id", 120)


@query(_manifest_sql("SELECT CASE lang WHEN 'fr' THEN 'chat-fr' WHEN 'de' THEN 'math' ELSE 'reasoning' END AS domain, doc_id FROM documents WHERE lang IN ('fr', 'de', 'es')", 80))
def b03_single_filter_domains(spark, sf):
    """Domains of one filter each."""
    named = F.when(F.col("lang") == "fr", "chat-fr").when(F.col("lang") == "de", "math").otherwise("reasoning")
    return B.manifest(_docs(spark, sf).where(F.col("lang").isin("fr", "de", "es")).select("doc_id", named.alias("domain")), "domain", "doc_id", 80)


@query("SELECT doc_id, level FROM (SELECT *, min(level) OVER () AS low FROM (SELECT doc_id, 0 AS level FROM documents WHERE lang = 'rust' UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(text, 'fn main') UNION ALL SELECT doc_id, 2 FROM documents WHERE source = 'src4')) WHERE level = low")
def b04_fallback_levels(spark, sf):
    """The first of three ever looser filters that finds anything."""
    return B.first_level(_docs(spark, sf), [F.col("lang") == "rust", F.contains("text", F.lit("fn main")), F.col("source") == "src4"]).select("doc_id", "level")


@query(f"SELECT doc_id, user_text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {HASH}) AS rn FROM (SELECT doc_id, source, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN {STRIP} ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN source END, '')) AS user_text FROM documents) WHERE user_text IS NOT NULL) WHERE rn <= 15")
def b05_coalesced_domains(spark, sf):
    """The first column that holds something, non-empty rows, a cap for each source."""
    k = F.col("doc_id") % 3
    d = _docs(spark, sf).select("doc_id", "source", F.when(k == 0, T.strip("text")).otherwise("").alias("prompt"), F.when(k == 1, F.col("source")).alias("question"))
    filled = d.select("doc_id", "source", T.first_filled("prompt", "question").alias("user_text")).where("user_text IS NOT NULL")
    return splits.cap(filled, "source", "doc_id", 15).select("doc_id", "user_text")


@query("SELECT doc_id, substr(text, 1, 3000) || CASE WHEN contains(text, 'License') THEN ' [licensed]' ELSE '' END AS answer FROM documents WHERE length(text) > 50")
def b06_answer_length(spark, sf):
    """Answers of more than 50 characters, cut at 3000, with what they name."""
    more = F.when(F.contains("text", F.lit("License")), " [licensed]").otherwise("")
    return _docs(spark, sf).where(F.length("text") > 50).select("doc_id", F.concat(F.substring("text", 1, 3000), more).alias("answer"))


_FILES = "SELECT p_size AS project, p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'config' WHEN 1 THEN 'readme' ELSE 'source' END AS kind, p_name AS body FROM part"


@query(f"WITH f AS ({_FILES}), p AS (SELECT project, min_by(body, k) FILTER (WHERE kind = 'config') AS config, min_by(body, k) FILTER (WHERE kind = 'readme') AS readme FROM f GROUP BY project HAVING count_if(kind = 'config') > 0), s AS (SELECT project, string_agg(body, '+' ORDER BY k) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY k) AS rn FROM f WHERE kind = 'source') WHERE rn <= 2 GROUP BY project) SELECT project, 'project' AS kind, config || '|' || coalesce(readme, '') || '|' || coalesce(sources, '') AS body FROM p LEFT JOIN s USING (project) UNION ALL SELECT project, 'file', body FROM f JOIN p USING (project) WHERE f.kind = 'source'")
def b07_project_trees(spark, sf):
    """A record for each project (its configuration, README and two sources) and one for each source."""
    k = F.col("p_partkey") % 5
    files = table(spark, sf, "part").select(F.col("p_size").alias("project"), F.col("p_partkey").alias("k"), F.when(k == 0, "config").when(k == 1, "readme").otherwise("source").alias("kind"), F.col("p_name").alias("body"))
    return B.project_records(files)


_COMMENTS = "[x FOR x IN string_split(text, chr(10)) IF starts_with(x, 'T')]"


@query(f"SELECT doc_id, CASE WHEN len({_COMMENTS}) > 0 THEN array_to_string(list_slice({_COMMENTS}, 1, 5), ' ') ELSE 'Circuit ' || doc_id END AS description FROM documents WHERE len(string_split(text, chr(10))) BETWEEN 5 AND 500")
def b08_netlist_domain(spark, sf):
    """Netlists of 5 to 500 lines, told by their first five comments, else by their title."""
    lines = F.split("text", "\n")
    told = B.first_comments(lines, "T", 5, " ")
    d = _docs(spark, sf).where(T.line_count("text").between(5, 500))
    return d.select("doc_id", F.coalesce(told, F.concat(F.lit("Circuit "), F.col("doc_id").cast("string"))).alias("description"))


@query("WITH d AS (SELECT doc_id, '-- one ' || doc_id || chr(10) || '-- two' || chr(10) || '-- three' || chr(10) || '-- four' || chr(10) || text AS t, doc_id % 3 AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE k WHEN 0 THEN 'Write a test: ' WHEN 1 THEN 'Write an example: ' ELSE 'Write a script: ' END || 'one ' || doc_id || ' two three' AS instruction FROM d WHERE len(string_split(t, chr(10))) BETWEEN 5 AND 300")
def b09_script_domain(spark, sf):
    """Scripts of 5 to 300 lines, told by their leading comment (three lines), worded by where they are."""
    k = F.col("doc_id") % 3
    path = F.when(k == 0, "tests/a.lua").when(k == 1, "examples/a.lua").otherwise("src/a.lua")
    t = F.concat(F.lit("-- one "), F.col("doc_id").cast("string"), F.lit("\n-- two\n-- three\n-- four\n"), "text")
    d = _docs(spark, sf).where("text IS NOT NULL").select("doc_id", t.alias("t"), path.alias("path")).where(T.line_count("t").between(5, 300))
    word = F.when(F.contains("path", F.lit("test")), "Write a test: ").when(F.contains("path", F.lit("example")), "Write an example: ").otherwise("Write a script: ")
    return d.select("doc_id", F.concat(word, B.leading_comments(F.split("t", "\n"), "-- ", 3)).alias("instruction"))


@query("SELECT doc_id FROM documents WHERE (regexp_matches(source, '^src1') OR regexp_matches(substr(text, 1, 200), '(?i)license|idiot')) AND length(text) > 30")
def b10_keyword_rows(spark, sf):
    """A pattern in the instruction or in the first 200 characters of an answer of more than 30."""
    hit = F.col("source").rlike("^src1") | F.substring("text", 1, 200).rlike("(?i)license|idiot")
    return _docs(spark, sf).where(hit & (F.length("text") > 30)).select("doc_id")


_KEYWORDS = (("frontend", "tion", "der "), ("yaml", "heit|keit", "zzz"), ("iot", "eau", "xxx"), ("audio", "nothing-has-this", "x"))
_KEYED = " UNION ALL ".join(f"SELECT '{d}' AS domain, doc_id FROM documents WHERE regexp_matches(substr(text, 1, 500), '(?i){i}') AND NOT regexp_matches(substr(text, 1, 500), '(?i){x}') AND length(text) >= 30" for d, i, x in _KEYWORDS)


@query(f"WITH m AS ({_manifest_sql(_KEYED, 100)}), a AS (SELECT unnest({[d for d, _, _ in _KEYWORDS]}) AS domain) SELECT domain, coalesce(n_source, 0) AS n_source, CASE WHEN n_source >= 20 THEN n_used ELSE 0 END AS n_used, CASE WHEN coalesce(n_source, 0) < 20 THEN 'INSUFFICIENT' ELSE 'OK' END AS status FROM a LEFT JOIN m USING (domain)")
def b11_keyword_domains(spark, sf):
    """Domains by what their first 500 characters have and have not; those with fewer than 20 rows save nothing."""
    head = F.substring("text", 1, 500)
    rules = {d: head.rlike(f"(?i){i}") & ~head.rlike(f"(?i){x}") & (F.length("text") >= 30) for d, i, x in _KEYWORDS}
    m = B.manifest(B.fan_out(_docs(spark, sf), rules).select("doc_id", "domain"), "domain", "doc_id", 100)
    every = spark.createDataFrame([(d,) for d in rules], "domain string").join(m, "domain", "left")
    n = F.coalesce("n_source", F.lit(0))
    return every.select("domain", n.cast("long").alias("n_source"), F.when(n >= 20, F.col("n_used")).otherwise(0).cast("long").alias("n_used"), F.when(n < 20, "INSUFFICIENT").otherwise("OK").alias("status"))


@query("SELECT source AS domain, count(*) AS n, CASE WHEN count(*) >= 60 THEN 'GOOD' WHEN count(*) >= 30 THEN 'FAIR' ELSE 'INSUFFICIENT' END AS quality FROM documents GROUP BY source UNION ALL SELECT * FROM (VALUES ('closed', 0::bigint, 'SKIPPED'), ('nc', 0::bigint, 'SKIPPED')) t(domain, n, quality)")
def b12_build_report(spark, sf):
    """The quality of each domain, and the domains that a licence skips."""
    n = F.count("*")
    rows = _docs(spark, sf).groupBy(F.col("source").alias("domain")).agg(n.alias("n"), F.when(n >= 60, "GOOD").when(n >= 30, "FAIR").otherwise("INSUFFICIENT").alias("quality"))
    return rows.unionByName(spark.createDataFrame([("closed", 0, "SKIPPED"), ("nc", 0, "SKIPPED")], "domain string, n long, quality string"))


_AXES = {"board": ("uno", "esp32", "pico"), "bus": ("SPI", "I2C", "UART", "CAN"), "task": ("read", "write", "probe")}
_AXES_SQL = ", ".join(f"(SELECT unnest({list(v)}) AS {k})" for k, v in _AXES.items())


@query(f"SELECT prompt FROM (SELECT 'How do I ' || task || ' over ' || bus || ' on ' || board || ' for ' || r_name || '?' AS prompt FROM region, {_AXES_SQL}) ORDER BY sha256('42:' || prompt) LIMIT 100")
def b13_template_rows(spark, sf):
    """All combinations of a template's axes, shuffled, cut to the target."""
    rows = B.combinations(table(spark, sf, "region").select("r_name"), _AXES)
    prompt = F.format_string("How do I %s over %s on %s for %s?", "task", "bus", "board", "r_name")
    return rows.select(prompt.alias("prompt")).orderBy(T.seeded("prompt")).limit(100)


@query("SELECT n, ['uno', 'esp32', 'pico'][1 + ('0x' || substr(sha256('42:board:' || n), 1, 7))::bigint % 3] AS board, 9600 + ('0x' || substr(sha256('42:speed:' || n), 1, 7))::bigint % 105601 AS speed FROM (SELECT unnest(range(0, 200)) AS n)")
def b14_synthetic_configs(spark, sf):
    """Configurations whose parts are drawn by a hash."""
    from ..operators.messages import drawn

    boards = F.array(*map(F.lit, _AXES["board"]))
    rows = spark.range(200).withColumnRenamed("id", "n")
    return rows.select("n", F.element_at(boards, (drawn("board", "n", 0, 2) + 1).cast("int")).alias("board"), drawn("speed", "n", 9600, 115200).alias("speed"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'Wire up SPI for ' WHEN contains(lower(p_name), 'red') THEN 'Wire up I2C for ' ELSE 'Wire up UART for ' END || p_name AS prompt FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red') OR contains(lower(p_name), 'bolt')")
def b15_from_descriptions(spark, sf):
    """A prompt for each project that names an interface, by the first it names."""
    kind = T.first_rule(F.lower("p_name"), (("ring", "SPI"), ("red", "I2C"), ("bolt", "UART")), None)
    p = table(spark, sf, "part").select("p_partkey", "p_name", kind.alias("kind")).where("kind IS NOT NULL")
    return p.select("p_partkey", F.concat(F.lit("Wire up "), "kind", F.lit(" for "), "p_name").alias("prompt"))


_CASCADE = (("A", "contains(text, 'License')"), ("B", "lang = 'de'"), ("C", "contains(text, 'tion')"), ("D", "length(text) > 1500"), ("E", "true"))


@query("SELECT source, status, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {c} THEN '{s}'" for s, c in _CASCADE) + " END AS source, CASE WHEN contains(text, 'idiot') THEN 'contaminated' ELSE 'passed' END AS status FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2")
def b16_exclusive_cascade(spark, sf):
    """Each row belongs to the first source that takes it; what passes and what is contaminated is counted."""
    taken = F.coalesce(*[F.when(F.expr(c), s) for s, c in _CASCADE])
    status = F.when(F.contains("text", F.lit("idiot")), "contaminated").otherwise("passed")
    return _docs(spark, sf).where("text IS NOT NULL").groupBy(taken.alias("source"), status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, prio FROM (SELECT doc_id, prio, row_number() OVER (ORDER BY prio, doc_id) AS rn FROM (SELECT doc_id, CASE WHEN contains(text, 'License') THEN 0 WHEN lang = 'fr' THEN 1 END AS prio FROM documents) WHERE prio IS NOT NULL) WHERE rn <= 130")
def b17_supplement_scan(spark, sf):
    """Rows of one source and then another, until there are enough."""
    prio = F.when(F.contains("text", F.lit("License")), 0).when(F.col("lang") == "fr", 1)
    return _docs(spark, sf).select("doc_id", prio.alias("prio")).where("prio IS NOT NULL").orderBy("prio", "doc_id").limit(130)


_ASCII = r"length(regexp_replace(u, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(u, '[^A-Za-z]', '', 'g')) > 0.97 * length(regexp_replace(u, '[^\p{L}]', '', 'g'))"


@query(f"SELECT conv_id, u AS user_text, a AS assistant_text FROM (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS u, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id) WHERE a IS NOT NULL AND {_ASCII}")
def b18_last_pair(spark, sf):
    """The last question and the last answer of conversations in English letters; system messages don't count."""
    last = lambda r: F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(last("user").alias("user_text"), last("assistant").alias("assistant_text"))
    return g.where(F.col("assistant_text").isNotNull() & T.ascii_share_above(F.col("user_text"), 0.97))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN contains(x, '***') THEN 'java' WHEN contains(x, '%%%') AND contains(x, '###') THEN 'csharp' WHEN NOT contains(x, 'tion') THEN 'few_markers' ELSE 'pass' END AS reason FROM (SELECT coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END, ''), source || ' ' || text) AS x FROM documents WHERE text IS NOT NULL)) GROUP BY reason")
def b19_other_sources(spark, sf):
    """The funnel of another source, whose text is under other names."""
    d = _docs(spark, sf).where("text IS NOT NULL").select(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("output"), F.concat_ws(" ", "source", "text").alias("response"))
    x = T.first_filled("output", "response")
    has = lambda s: F.contains(x, F.lit(s))
    reason = F.when(has("***"), "java").when(has("%%%") & has("###"), "csharp").when(~has("tion"), "few_markers").otherwise("pass")
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH have AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY source), o AS (SELECT source, doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS model, lower({STRIP}) AS k FROM documents WHERE lang <> 'fr' AND {WORDS} BETWEEN 3 AND 400), u AS (SELECT source, k, min((model, doc_id)) AS first FROM o GROUP BY source, k), r AS (SELECT source, first[2] AS doc_id, row_number() OVER (PARTITION BY source ORDER BY first[1], first[2]) AS rn FROM (SELECT source, [first[1], first[2]] AS first FROM u)) SELECT r.source, doc_id FROM r LEFT JOIN have USING (source) WHERE rn <= 12 - coalesce(n, 0)")
def b43_augment_to_minimum(spark, sf):
    """What a label lacks to its minimum is added from the models in order, without repeats."""
    d = _docs(spark, sf)
    have = d.where("lang = 'fr'").groupBy("source").agg(F.count("*").alias("n"))
    offered = d.where("lang <> 'fr'").where(T.word_count("text").between(3, 400))
    model = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    unique = offered.groupBy("source", T.same_text(F.lower(T.strip("text"))).alias("k")).agg(F.min(F.struct(model.alias("model"), "doc_id")).alias("first"))
    ranked = first_rows(unique.select("source", "first.model", "first.doc_id"), ["source"], ["model", "doc_id"], 12)
    return ranked.join(have, "source", "left").where(F.col("rn") <= 12 - F.coalesce("n", F.lit(0))).select("source", "doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 10 THEN 'Improve this training code:' || chr(10) || substr(text, 1, 2000) ELSE 'Write training code for ' || source END AS instruction, 'ml_imports' AS filter_tag FROM documents WHERE contains(text, 'tion') OR length(text) <= 10")
def b45_training_rows(spark, sf):
    """Commits as prompts in the words of this domain, with the tag of the filter in their provenance."""
    d = _docs(spark, sf).where(F.contains("text", F.lit("tion")) | (F.length("text") <= 10))
    said = F.when(F.length("text") > 10, F.concat(F.lit("Improve this training code:\n"), F.substring("text", 1, 2000))).otherwise(F.concat(F.lit("Write training code for "), "source"))
    provenance = F.struct(F.col("source"), F.lit("ml_imports").alias("filter_tag")).alias("p")
    return d.select("doc_id", said.alias("instruction"), provenance).select("doc_id", "instruction", "p.filter_tag")


@query("SELECT page_id, url, CASE WHEN page_id % 10 = 9 THEN 'http 404' ELSE '' END AS error FROM pages WHERE page_id % 2 = 1 OR page_id % 10 = 9")
def b46_download_errors(spark, sf):
    """What is fetched anew, with its error where it fails."""
    p = table(spark, sf, "pages")
    known = p.where("page_id % 2 = 0 AND page_id % 10 <> 9").select("page_id")
    return p.join(known, "page_id", "left_anti").select("page_id", "url", F.when(F.col("page_id") % 10 == 9, "http 404").otherwise("").alias("error"))


_SINKS = {"rust": "lang = 'de'", "shell": "contains(text, 'License')", "docs": "length(text) > 800", "all": "true"}


@query("SELECT domain, doc_id FROM (" + " UNION ALL ".join(f"SELECT * FROM (SELECT '{d}' AS domain, doc_id FROM documents WHERE {c} ORDER BY doc_id LIMIT 60)" for d, c in _SINKS.items()) + ")")
def m15_one_pass_sinks(spark, sf):
    """One scan feeds four domains, each up to its limit."""
    fed = B.fan_out(_docs(spark, sf), {d: F.expr(c) for d, c in _SINKS.items()}).select("domain", "doc_id")
    return first_rows(fed, ["domain"], ["doc_id"], 60).select("domain", "doc_id")


@query("SELECT name, id, prompt FROM (SELECT * FROM (SELECT 'docs' AS name, doc_id AS id, substr(text, 1, 300) AS prompt FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 30) UNION ALL SELECT * FROM (SELECT 'chat', conv_id * 1000 + turn, text FROM conversations WHERE role = 'user' AND length(text) BETWEEN 8 AND 600 ORDER BY conv_id, turn LIMIT 40) UNION ALL SELECT * FROM (SELECT 'bench', item_id, text FROM benchmark WHERE length(text) BETWEEN 8 AND 600 ORDER BY item_id LIMIT 10))")
def d02_source_registry(spark, sf):
    """Sources by name: what is extracted, which rows count, and how many are taken."""
    sources = {
        "docs": ("documents", F.col("doc_id"), F.substring("text", 1, 300), F.contains(F.lower("text"), F.lit("license")), 30),
        "chat": ("conversations", F.expr("conv_id * 1000 + turn"), F.col("text"), (F.col("role") == "user") & F.length("text").between(8, 600), 40),
        "bench": ("benchmark", F.col("item_id"), F.col("text"), F.length("text").between(8, 600), 10),
    }
    return B.from_registry(lambda name: table(spark, sf, name), sources)


@query(f"{_BINS} SELECT doc_id, part, '[Part ' || part || '/' || split_total || ']' || chr(10) || CASE WHEN prev IS NULL THEN chunk ELSE '// ... (continued from previous part)' || chr(10) || array_to_string(list_slice(string_split(prev, chr(10)), greatest(len(string_split(prev, chr(10))) - 9, 1), len(string_split(prev, chr(10)))), chr(10)) || chr(10) || chr(10) || chunk END AS chunk FROM (SELECT *, lag(chunk) OVER (PARTITION BY doc_id ORDER BY part) AS prev FROM b) WHERE split_total > 1")
def d11_record_splitter(spark, sf):
    """Long records as parts: lines packed to a budget, overlapped, and numbered."""
    parts = S.with_overlap(_packed(spark, sf), "doc_id").where("split_total > 1")
    head = F.concat(F.lit("[Part "), F.col("part").cast("string"), F.lit("/"), F.col("split_total").cast("string"), F.lit("]\n"))
    return parts.select("doc_id", "part", F.concat(head, "chunk").alias("chunk"))
