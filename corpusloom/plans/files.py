"""Queries that write files and read them back: scans and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import dedup, splits
from ..operators.ranking import first_rows, numbered_in_order
from ..sources import packages, paged, readers, snapshots, writers
from ..sources.scratch import file_system, scratch
from .corpus import HASH, SQL_STRIP
from .registry import query, table

_ROW = "doc_id long, lang string, source string"


def _rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source")


def _broken(spark, sf, name):
    """JSON lines of the documents; every tenth is no JSON."""
    path = scratch(spark, name)
    line = F.when(F.col("doc_id") % 10 == 0, F.lit('{"doc_id": 1, "lang"')).otherwise(F.to_json(F.struct("doc_id", "lang", "source")))
    _rows(spark, sf).select(line.alias("value")).write.text(path)
    return path


@query("SELECT doc_id, lang, source FROM documents")
def s01_jsonl_strict(spark, sf):
    """JSON lines as written; a bad line would stop the read."""
    path = scratch(spark, "strict")
    _rows(spark, sf).write.json(path)
    return readers.json_lines(spark, path, _ROW)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 <> 0")
def s02_jsonl_permissive(spark, sf):
    """Lines that are no JSON are left out."""
    return readers.json_lines(spark, _broken(spark, sf, "permissive"), _ROW, strict=False)


@query("SELECT lower(r_name) AS domain, n_nationkey AS k, CASE WHEN n_nationkey % 3 = 2 THEN 'ask ' || n_name ELSE n_name END AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey")
def s03_directory_stem(spark, sf):
    """A file for each region, whose name becomes a column; the prompt stands under one of three names."""
    path, k = scratch(spark, "stems"), F.col("n_nationkey") % 3
    message = F.when(k == 2, F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("ask "), "n_name").alias("content"))))
    line = F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.when(k == 0, F.col("n_name")).alias("prompt"), F.when(k == 1, F.col("n_name")).alias("instruction"), message.alias("messages")))
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("r"), line.alias("line"))
    files = rows.groupBy("r").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    writers.row_files(files, path, F.concat("r", F.lit(".jsonl")), F.col("body"))
    read = readers.directory_as_column(spark, path, "k int, prompt string, instruction string, messages array<struct<role:string,content:string>>")
    user = F.filter("messages", lambda m: m["role"] == "user")[0]["content"]
    return read.select("domain", "k", F.coalesce("prompt", "instruction", user).alias("prompt"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def s04_recursive_scan(spark, sf):
    """Files of a kind anywhere below a folder, counted by the folder they are in."""
    path = scratch(spark, "recursive")
    _rows(spark, sf).where("lang IS NOT NULL").write.partitionBy("lang").json(f"{path}/a")
    read = readers.recursive(spark, path, "doc_id long", "*.json")
    return read.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, source, total FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY {HASH}) AS rn FROM documents) WHERE rn <= 25")
def s05_sampled_scan(spark, sf):
    """At most 25 rows of each source by seeded hash, with the number of all."""
    return readers.sampled(_rows(spark, sf), "source", "doc_id", 25).select("doc_id", "source", "total")


@query("SELECT n_nationkey, n_name FROM nation")
def s07_json_array(spark, sf):
    """A file that is one array."""
    path = scratch(spark, "array")
    whole = table(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("body"))
    writers.row_files(whole, path, F.lit("all.json"), F.col("body"))
    return readers.json_array(spark, path, "n_nationkey int, n_name string")


@query("SELECT lower(r_name) AS domain, CASE WHEN r_regionkey % 2 = 0 THEN 'MIT' ELSE 'unknown' END AS license, CASE WHEN r_regionkey % 3 = 0 THEN '2026-01-0' || (r_regionkey + 1) ELSE '2026-04-28' END AS access_date FROM region")
def s08_keyed_manifest(spark, sf):
    """An object of entries by domain; missing fields get defaults."""
    path, k = scratch(spark, "keyed"), F.col("r_regionkey")
    entry = F.struct(F.when(k % 2 == 0, "MIT").alias("license"), F.when(k % 3 == 0, F.concat(F.lit("2026-01-0"), k + 1)).alias("access_date"))
    one = table(spark, sf, "region").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.lower("r_name"), entry))).alias("domains"))).alias("body"))
    writers.row_files(one, path, F.lit("manifest.json"), F.col("body"))
    return readers.keyed_manifest(spark, path, "license: string, access_date: string", defaults={"license": "unknown", "access_date": "2026-04-28"})


@query("SELECT lower(r_name) AS domain, max(n_nationkey) AS n_source, '2026-03-' || lpad(max(n_nationkey)::varchar, 2, '0') AS access_date FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s09_listed_manifest(spark, sf):
    """A list of entries: of a domain the last counts; dates are cut to the day."""
    path = scratch(spark, "listed")
    entry = F.struct("n_nationkey", F.lower("r_name").alias("domain"), F.col("n_nationkey").alias("n_source"), F.concat(F.lit("2026-03-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("T10:00:00")).alias("access_date"))
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.row_files(rows.agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("body")), path, F.lit("list.json"), F.col("body"))
    return readers.listed_manifest(spark, path, "domain string, n_source int, access_date string")


@query("SELECT DISTINCT substr(sha256(text), 1, 16) AS dedup_hash FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL")
def s10_csv_hashes(spark, sf):
    """The hashes of a CSV manifest that are not blank."""
    path = scratch(spark, "csv")
    h = F.when(F.col("doc_id") % 7 == 0, " ").otherwise(T.short_hash("text"))
    table(spark, sf, "documents").select(h.alias("dedup_hash"), "doc_id").write.option("header", True).csv(path)
    return readers.known_hashes(spark, path, "dedup_hash string, doc_id long")


@query("SELECT doc_id, regexp_extract(text, '(MIT|Apache|GNU|CC BY-NC)', 1) AS license FROM documents WHERE regexp_extract(text, '(MIT|Apache|GNU|CC BY-NC)', 1) IN ('MIT', 'Apache')")
def s11_licensed_scan(spark, sf):
    """A Parquet scan that keeps rows of allowed licences."""
    found = F.regexp_extract("text", "(MIT|Apache|GNU|CC BY-NC)", 1)
    return table(spark, sf, "documents").select("doc_id", found.alias("license")).where(F.col("license").isin("MIT", "Apache"))


@query("WITH e AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS prompt FROM documents WHERE lang = 'en'), k AS (SELECT * FROM e WHERE length(prompt) BETWEEN 8 AND 6000 AND (contains(lower(prompt), 'the ') OR contains(lower(prompt), 'license'))), u AS (SELECT min(doc_id) AS doc_id, prompt FROM k GROUP BY prompt) SELECT doc_id, substr(sha256(prompt), 1, 16) AS h FROM u ORDER BY doc_id LIMIT 200".replace("\\\\", "\\"))
def s12_filtered_scan(spark, sf):
    """Extract, bound the length, look for keywords, keep the first of equal prompts, stop at 200; no rows where the source can't be read."""
    d = readers.or_empty(spark, lambda: table(spark, sf, "documents").where("lang = 'en'").select("doc_id", T.strip("text").alias("prompt")), "doc_id long, prompt string")
    low = F.lower("prompt")
    k = d.where(F.length("prompt").between(8, 6000) & T.any_of(low, ("the ", "license"))).select("doc_id", T.short_hash("prompt").alias("h"))
    return k.groupBy("h").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").limit(200).select("doc_id", "h")


_WIKI = r"substr(regexp_replace(regexp_replace(regexp_replace(t, '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '\{\{[^}]*\}\}', '', 'g'), '<[^>]+>', '', 'g'), 1, 3000)"


@query(f"WITH p AS (SELECT item_id, 'Circuit ' || item_id AS title, 'see [[link|label ' || item_id || ']] {{{{tpl}}}} ' || replace(replace(text, chr(10), ' '), '&', 'and') AS t FROM benchmark WHERE item_id % 4 <> 0) SELECT title, {_WIKI} AS text FROM p WHERE length(t) >= 200")
def s14_xml_dump(spark, sf):
    """Pages of an XML dump whose title fits and whose revision is long enough, without markup."""
    path, i = scratch(spark, "xml"), F.col("item_id")
    title = F.concat(F.when(i % 4 == 0, "Talk ").otherwise("Circuit "), i.cast("string"))
    body = F.concat(F.lit("see [[link|label "), i.cast("string"), F.lit("]] {{tpl}} "), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("&"), F.lit("and")))
    table(spark, sf, "benchmark").where("text IS NOT NULL").select(title.alias("title"), F.struct(body.alias("text")).alias("revision")).write.format("xml").option("rootTag", "dump").option("rowTag", "page").save(path)
    pages = readers.xml_pages(spark, path, "title string, revision struct<text: string>")
    kept = pages.where(F.col("title").rlike("^Circuit ") & (F.length("revision.text") >= 200))
    return kept.select("title", T.wiki_clean(F.col("revision.text")).alias("text"))


@query("SELECT doc_id, substr(text, 1, 3000) AS text FROM documents WHERE regexp_matches(source, '^src[0-4]$') AND length(text) >= 200 ORDER BY doc_id LIMIT 500")
def s15_title_scan(spark, sf):
    """Titles that fit a pattern, texts of 200 characters or more, cut at 3000, 500 rows."""
    d = table(spark, sf, "documents").where(F.col("source").rlike("^src[0-4]$") & (F.length("text") >= 200))
    return d.orderBy("doc_id").limit(500).select("doc_id", F.substring("text", 1, 3000).alias("text"))


@query("SELECT doc_id, lang FROM documents WHERE length(text) >= 100 AND (lang IN ('fr', 'es') OR contains(lower(text), 'license')) ORDER BY doc_id LIMIT 3000")
def s16_category_or_keyword(spark, sf):
    """A category of the list, or else a keyword; 100 characters or more, 3000 rows."""
    fits = F.col("lang").isin("fr", "es") | F.contains(F.lower("text"), F.lit("license"))
    return table(spark, sf, "documents").where((F.length("text") >= 100) & fits).orderBy("doc_id").limit(3000).select("doc_id", "lang")


def _tree(spark, sf, name):
    """Texts of the benchmark as a tree of source files, boilerplate among them."""
    path, i = scratch(spark, name), F.col("item_id")
    stem = F.when(i % 5 == 0, "system_stm32f4xx.c").when(i % 5 == 1, "notes.md").when(i % 5 == 2, "main.c").otherwise(F.concat(F.lit("part"), i.cast("string"), F.lit(".cpp")))
    writers.row_files(table(spark, sf, "benchmark").where("text IS NOT NULL"), path, F.concat(F.lit("ex"), i.cast("string"), F.lit("/Src/"), stem), F.encode("text", "utf-8"))
    return path


_STEM = "CASE item_id % 5 WHEN 0 THEN 'system_stm32f4xx.c' WHEN 1 THEN 'notes.md' WHEN 2 THEN 'main.c' ELSE 'part' || item_id || '.cpp' END"


@query(f"SELECT 'ex' || item_id || '/Src/' || {_STEM} AS path, text FROM benchmark WHERE item_id % 5 <> 1 AND text IS NOT NULL")
def s17_source_tree(spark, sf):
    """Source files anywhere below a folder, whole."""
    read = readers.source_tree(spark, _tree(spark, sf, "tree"), "*.c*")
    return read.select(F.regexp_extract("path", "(ex[0-9]+/.*)$", 1).alias("path"), "text")


@query(f"SELECT 'ex' || item_id AS example, {_STEM} AS name, length(text) AS size FROM benchmark WHERE item_id % 5 NOT IN (0, 1) AND text IS NOT NULL")
def s18_example_sources(spark, sf):
    """An example's own sources: C and C++ right in Src, without the vendor's boilerplate."""
    read = readers.source_tree(spark, _tree(spark, sf, "examples"), "*.c*")
    name = F.regexp_extract("path", "/Src/([^/]+)$", 1)
    own = read.withColumn("name", name).where((F.col("name") != "") & ~F.col("name").isin(*R.BOILERPLATE_FILES))
    return own.select(F.regexp_extract("path", "/(ex[0-9]+)/", 1).alias("example"), "name", F.length("text").alias("size"))


@query("WITH p AS (SELECT doc_id, unnest(range(0, greatest(len(a), 1), 5)) AS k, a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), t AS (SELECT doc_id, regexp_replace(array_to_string(list_slice(a, k + 1, k + 5), chr(10)), '^\\s+|\\s+$', '', 'g') AS page FROM p) SELECT doc_id, count(*) AS pages, count_if(length(page) < 100) AS sparse, CASE WHEN sum(length(page)) = 0 THEN 'empty' WHEN count_if(length(page) < 100) > count(*) / 2 THEN 'text_sparse' ELSE 'text' END AS method FROM t GROUP BY doc_id".replace("\\\\", "\\"))
def s19_page_status(spark, sf):
    """Pages of a file (five lines each): which are sparse, and how the file as a whole was read."""
    lines = F.split("text", "\n")
    page = F.explode(F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(5)), lambda i: T.strip(F.array_join(F.slice(lines, i + 1, F.lit(5)), "\n")))).alias("page")
    p = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", page)
    sparse = F.count_if(F.length("page") < 100)
    method = F.when(F.sum(F.length("page")) == 0, "empty").when(sparse > F.count("*") / 2, "text_sparse").otherwise("text")
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), sparse.alias("sparse"), method.alias("method"))


_LONG = "repeat(text, 1 + 2000 // greatest(length(text), 1))"


@query(f"""WITH t AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN {SQL_STRIP.format(c='text')} WHEN 1 THEN 'T & ' || item_id WHEN 2 THEN 'Item ' || item_id WHEN 5 THEN {SQL_STRIP.format(c=_LONG)} END AS t FROM benchmark WHERE text IS NOT NULL)
 SELECT 'f' || item_id AS name, CASE item_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'docx' WHEN 3 THEN 'unknown' WHEN 4 THEN 'text' ELSE 'text' END AS format, CASE item_id % 6 WHEN 3 THEN 'unknown' WHEN 4 THEN 'too_large' ELSE 'ok' END AS status, substr(t, 1, 1500) AS text, coalesce(length(t) > 1500, false) AS truncated, length(t) AS original_chars FROM t""")
def s20_multi_format(spark, sf):
    """Files of several formats as text by their extension (D07), or why not: too large, or of no known format; long texts are cut."""
    path, i = scratch(spark, "formats"), F.col("item_id")
    b = table(spark, sf, "benchmark").where("text IS NOT NULL")
    ext = F.element_at(F.array(*map(F.lit, (".txt", ".html", ".docx", ".xyz", ".md", ".txt"))), (i % 6 + 1).cast("int"))
    body = F.when(i % 6 == 1, F.concat(F.lit("<script>x</script><p>T &amp; "), i.cast("string"), F.lit("</p>"))).when(i % 6 == 4, F.repeat(F.lit("0123456789"), F.lit(5000))).when(i % 6 == 5, F.expr(_LONG.replace("2000 // greatest(length(text), 1)", "cast(2000 div greatest(length(text), 1) as int)"))).otherwise(F.col("text"))
    name = F.concat(F.lit("f"), i.cast("string"), ext)
    writers.row_files(b.where(i % 6 != 2), path, name, F.encode(body, "utf-8"))
    told = F.concat(F.lit(f'<w:document {packages.NAMESPACES["docx"]}><w:body><w:p><w:r><w:t>Item '), i.cast("string"), F.lit("</w:t></w:r></w:p></w:body></w:document>"))
    packages.packages(b.where(i % 6 == 2), path, name, "docx", F.create_map(F.lit("word/document.xml"), told))
    return readers.binary_documents(spark, path, most=40_000, cut=1500).select(F.regexp_extract("path", "/(f[0-9]+)[.]", 1).alias("name"), "format", "status", "text", "truncated", "original_chars")


@query("SELECT label, count(*) AS n, len(any_value(embedding))::int AS width, round_even(sum(list_sum([x * x FOR x IN embedding::double[]])), 4)::double AS energy FROM embeddings GROUP BY label")
def s22_embedding_matrix(spark, sf):
    """A matrix with labels: rows, width and squared norm of each label."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.size(F.first("embedding")).alias("width"), F.bround(F.sum(square), 4).alias("energy"))


_YAML = "default: direct\npolicies:\n  en: validate\n  fr: deliberate\n  de: mixture\n  # no policy\nlimits:\n  es: sequential\n"


@query("SELECT * FROM (VALUES ('en', 'validate'), ('fr', 'deliberate'), ('de', 'mixture')) t(domain, policy)")
def s23_yaml_config(spark, sf):
    """The entries under one key of a configuration file."""
    path = scratch(spark, "yaml")
    writers.row_files(spark.createDataFrame([(_YAML,)], "body string"), path, F.lit("policies.yaml"), F.col("body"))
    return readers.yaml_map(spark, path, "policies", "domain", "policy")


_LOG = "'PHASE 1' || chr(10) || 'Iter ' || (event_id % 90) || ': Train loss 2.5' || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'PHASE 2' || chr(10) || 'Iter ' || (event_id % 500) || ': Train loss 1.25' || chr(10) || 'Val loss 0.4' ELSE 'no more' END || chr(10) || (event_id % 60) || '.5 min' || chr(10) || '3 min'"


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.25 ELSE 2.5 END::double AS train_loss, CASE WHEN event_id % 3 = 0 THEN 0.4 END::double AS val_loss, (CASE WHEN event_id % 3 = 0 THEN event_id % 500 ELSE event_id % 90 END)::int AS iter, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS phase, (event_id % 60 + 0.5)::double AS minutes FROM events")
def s24_training_log(spark, sf):
    """The last losses, iteration and phase of a log (X52), and the first time that it names."""
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    more = F.when(i % 3 == 0, F.concat(F.lit("PHASE 2\nIter "), s(i % 500), F.lit(": Train loss 1.25\nVal loss 0.4"))).otherwise("no more")
    log = F.concat(F.lit("PHASE 1\nIter "), s(i % 90), F.lit(": Train loss 2.5\n"), more, F.lit("\n"), s(i % 60), F.lit(".5 min\n3 min"))
    return readers.training_log(table(spark, sf, "events").select("event_id", log.alias("text"))).drop("text")


@query("SELECT doc_id, lang FROM documents WHERE CASE WHEN (SELECT count(*) FROM documents WHERE lang = 'pt' AND length(text) > 50) > 0 THEN lang = 'pt' AND length(text) > 50 ELSE lang = 'es' AND length(text) > 500 END")
def s25_primary_or_fallback(spark, sf):
    """The primary source, or, where it has no row, the fallback with a filter of its own."""
    d = table(spark, sf, "documents")
    return readers.primary_or_fallback(d.where("lang = 'pt' AND length(text) > 50").select("doc_id", "lang"), lambda: d.where("lang = 'es' AND length(text) > 500").select("doc_id", "lang"))


_BAND = "CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 500 THEN 1 WHEN n_chars < 1000 THEN 2 WHEN n_chars < 2000 THEN 3 WHEN n_chars < 4000 THEN 4 WHEN n_chars < 8000 THEN 5 WHEN n_chars < 16000 THEN 6 ELSE 7 END"


@query(f"WITH u AS (SELECT min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)), r AS (SELECT doc_id, {_BAND} AS band, row_number() OVER (PARTITION BY {_BAND} ORDER BY doc_id) AS rn FROM u) SELECT doc_id, band FROM r WHERE rn <= 40 ORDER BY band, doc_id LIMIT 250")
def s27_size_bands(spark, sf):
    """Eight size bands, at most 40 distinct texts of each, 250 in all."""
    u = table(spark, sf, "documents").where("text IS NOT NULL").groupBy(T.same_text("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))
    capped = first_rows(u.withColumn("band", F.expr(_BAND)), ["band"], ["doc_id"], 40)
    return capped.orderBy("band", "doc_id").limit(250).select("doc_id", "band")


_TOPICS = (("licence", "text LIKE '%License%'"), ("french", "lang = 'fr'"), ("first", "source = 'src1'"))


@query("SELECT doc_id, min(topic) AS topic FROM (" + " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{t}' AS topic FROM documents WHERE {c} ORDER BY doc_id LIMIT 60)" for t, c in _TOPICS) + ") GROUP BY doc_id")
def s28_topic_fan_out(spark, sf):
    """A bounded search for each topic; what several find is one row."""
    d = table(spark, sf, "documents")
    every = None
    for topic, condition in _TOPICS:
        one = d.where(condition).orderBy("doc_id").limit(60).select("doc_id", F.lit(topic).alias("topic"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("doc_id").agg(F.min("topic").alias("topic"))


_GEN = "CASE turn % 3 WHEN 0 THEN '- {\"text\": \"' || w || '\"},' WHEN 1 THEN '{\"prompt\": \"' || w || '\"}' ELSE 'Sure, ' || w END"


@query(f"WITH l AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '[^A-Za-z \\n]', '', 'g'), chr(10))) AS w FROM conversations WHERE role = 'assistant'), j AS (SELECT conv_id % 2 AS model, regexp_replace(w, '^\\s+|\\s+$', '', 'g') AS text FROM l WHERE turn % 3 < 2) SELECT text_key, min(model) AS model FROM (SELECT lower(text) AS text_key, model FROM j WHERE text <> '' AND len(string_split_regex(text, '\\s+')) BETWEEN 3 AND 500) GROUP BY text_key".replace("\\\\", "\\"))
def s29_generated_rows(spark, sf):
    """Rows out of what models wrote, tagged with the model, without repeats."""
    w = F.explode(F.split(F.regexp_replace("text", r"[^A-Za-z \n]", ""), "\n")).alias("w")
    said = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", w)
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('- {"text": "'), "w", F.lit('"},'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"prompt": "'), "w", F.lit('"}'))).otherwise(F.concat(F.lit("Sure, "), "w"))
    found = T.json_line_text(line)
    rows = said.select((F.col("conv_id") % 2).alias("model"), T.strip(found).alias("text")).where((F.col("text") != "") & T.word_count("text").between(3, 500))
    return rows.groupBy(F.lower("text").alias("text_key")).agg(F.min("model").alias("model"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def k01_jsonl_sink(spark, sf):
    """JSON lines in UTF-8, written over what was there, and read back."""
    path = scratch(spark, "sink")
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    for part in (d.limit(3), d):
        part.write.mode("overwrite").json(path)
    return readers.json_lines(spark, path, "doc_id long, text string")


@query(f"SELECT lang AS domain, CASE WHEN rn <= greatest(1, round_even(n * 0.05, 0)) THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {HASH}) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2")
def k02_split_sink(spark, sf):
    """A folder for each domain and split; the counts are those of the files."""
    path = scratch(spark, "splits")
    split = splits.split_by_share(_rows(spark, sf).where("lang IS NOT NULL"), ["lang"], "doc_id").select("doc_id", F.col("lang").alias("domain"), "split")
    writers.json_by_split(split, path)
    return spark.read.schema("doc_id long, domain string, split string").json(path).groupBy("domain", "split").agg(F.count("*").alias("n"))


@query("SELECT doc_id % 3 AS part, substr(sha256(text), 1, 16) AS dedup_hash, source, n_chars FROM documents WHERE text IS NOT NULL")
def k03_manifest_csv(spark, sf):
    """Fixed columns with a header, a folder for each split; writing again changes nothing."""
    path = scratch(spark, "manifest")
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(T.short_hash("text").alias("dedup_hash"), "source", "n_chars", (F.col("doc_id") % 3).alias("part"))
    for _ in range(2):
        writers.csv_manifest(d, path, ["dedup_hash", "source", "n_chars"], "part")
    return readers.csv_rows(spark, path, "dedup_hash string, source string, n_chars long, part long")


@query("SELECT event_type, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'time of the append' END AS timestamp, count(*) * 2 AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def k04_audit_append(spark, sf):
    """Events appended twice; every third has no time and gets that of the append; nothing is overwritten."""
    path = scratch(spark, "audit")
    time = F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    e = table(spark, sf, "events").where("event_type = 'error'").select("event_id", "event_type", time.alias("timestamp"))
    since = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    for _ in range(2):
        writers.append_audit(e, path)
    back = spark.read.schema("event_id long, event_type string, timestamp string").json(path)
    now = F.col("timestamp").between(F.lit(since), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    told = F.when((F.col("event_id") % 3 == 0) & now, "time of the append").otherwise(F.col("timestamp"))
    return back.groupBy("event_type", told.alias("timestamp")).agg(F.count("*").alias("n"))


@query("SELECT 'f' || item_id || '.txt' AS name, sha256(text) AS digest, CASE WHEN item_id % 7 = 3 THEN 'missing' WHEN item_id % 7 = 5 THEN 'changed' ELSE 'verified' END AS status FROM benchmark WHERE text IS NOT NULL")
def k05_file_digests(spark, sf):
    """The digest of each file's bytes, held against the files as they are later: some have changed, some are gone."""
    path, i = scratch(spark, "digests"), F.col("item_id")
    b = table(spark, sf, "benchmark").where("text IS NOT NULL")
    name = F.concat(F.lit("f"), i.cast("string"), F.lit(".txt"))
    writers.row_files(b, f"{path}/then", name, F.encode("text", "utf-8"))
    writers.file_digests(spark, f"{path}/then").write.json(f"{path}/manifest")
    later = F.encode(F.when(i % 7 == 5, F.concat("text", F.lit("."))).otherwise(F.col("text")), "utf-8")
    writers.row_files(b.where(i % 7 != 3), f"{path}/now", name, later)
    manifest = spark.read.schema("name string, digest string").json(f"{path}/manifest")
    return writers.verified(manifest, writers.file_digests(spark, f"{path}/now"))


_PARTS = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * k}, 8))::bigint), 0)::bigint AS s{k}" for k in range(8))


@query(f"WITH r AS (SELECT sha256('{{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}}') AS h FROM documents WHERE source IS NOT NULL), s AS (SELECT count(*) AS n, {_PARTS} FROM r) SELECT n, sha256(n || ':' || {' || chr(58) || '.join(f's{k}' for k in range(8))}) AS digest, true AS verified FROM s")
def k05_audit_digest(spark, sf):
    """One digest of all rows in any order; the same rows dealt otherwise verify."""
    d = table(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", "source")
    one, other = writers.content_digest(d), writers.content_digest(d.repartition(3, "source")).select(F.col("digest").alias("again"))
    return one.crossJoin(other).select("n", "digest", (F.col("digest") == F.col("again")).alias("verified"))


@query("SELECT source AS domain, count(*) AS n_used FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('src1', 1::bigint), ('src2', 2::bigint), ('new', 3::bigint)) t(domain, n_used)")
def k06_manifest_upsert(spark, sf):
    """Rows of a manifest in a file give way to new ones of their domain."""
    path = scratch(spark, "upsert")
    table(spark, sf, "documents").groupBy(F.col("source").alias("domain")).agg(F.count("*").alias("n_used")).write.json(path)
    old = spark.read.schema("domain string, n_used long").json(path)
    return dedup.upsert(old, spark.createDataFrame([("src1", 1), ("src2", 2), ("new", 3)], "domain string, n_used long"), ["domain"])


_MANIFEST_SQL = "SELECT source AS domain, count(*) AS n_used FROM documents GROUP BY 1"


@query(f"WITH one AS ({_MANIFEST_SQL}), two AS (SELECT * FROM one WHERE domain NOT IN ('src1', 'src2') UNION ALL SELECT * FROM (VALUES ('src1', 1::bigint), ('src2', 2::bigint), ('new', 3::bigint)) t(domain, n_used)), three AS (SELECT * FROM two WHERE n_used <= 3) SELECT 1 AS version, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM three")
def k06_manifest_versions(spark, sf):
    """A manifest that is upserted and written back, version by version; a writer that read an old version is refused and goes again."""
    manifest, schema = snapshots.SnapshotTable(spark, scratch(spark, "manifest")), "domain string, n_used long"
    one = table(spark, sf, "documents").groupBy(F.col("source").alias("domain")).agg(F.count("*").alias("n_used"))
    manifest.commit(one, after=0)
    new = spark.createDataFrame([("src1", 1), ("src2", 2), ("new", 3)], schema)
    snapshots.changed(manifest, schema, lambda old: dedup.upsert(old, new, ["domain"]))
    try:
        manifest.commit(one.where("false"), after=1)
    except snapshots.Conflict:
        snapshots.changed(manifest, schema, lambda old: old.where("n_used <= 3"))
    versions = [manifest.read(schema, n).select(F.lit(n).alias("version"), "domain", "n_used") for n in sorted(manifest.versions())]
    return reduce(lambda a, b: a.unionByName(b), versions)


@query("SELECT n_nationkey, n_name, 3 AS generation FROM nation WHERE n_regionkey <> 2")
def s06_latest_version(spark, sf):
    """The latest of three generations of a file, by name."""
    path, n = scratch(spark, "generations"), table(spark, sf, "nation")
    kept = {"rows-20240901": (1, n), "rows-20241115": (3, n.where("n_regionkey <> 2")), "rows-20241002": (2, n.limit(1))}
    for name, (generation, rows) in kept.items():
        rows.select("n_nationkey", "n_name", F.lit(generation).alias("generation")).write.json(f"{path}/{name}")
    return spark.read.schema("n_nationkey long, n_name string, generation int").json(readers.latest(spark, f"{path}/rows-*"))


@query("SELECT lang AS domain, count(*) AS done, 'TRAINING' AS status FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def k15_atomic_state(spark, sf):
    """A campaign's state, as it is after a writer was killed before its pointer was in place, and after the latest pointer was damaged."""
    path, schema = scratch(spark, "state"), "domain string, done long, status string"
    state = snapshots.SnapshotTable(spark, path)
    idle = state.read(schema)
    d = table(spark, sf, "documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("domain"))
    state.commit(d.agg(F.count("*").alias("done"), F.lit("TRAINING").alias("status")).unionByName(idle), after=0)
    # Killed between files and pointer: files that no pointer names.
    d.agg(F.lit(0).cast("long").alias("done"), F.lit("HALF").alias("status")).write.parquet(f"{path}/data/killed")
    later = state.commit(state.read(schema).withColumn("status", F.lit("DONE")), after=1)
    store, at = file_system(path)
    for broken in (f"version-{later:012d}.json", f".version-{later:012d}.json.crc"):
        if store.get_file_info(f"{at}/pointers/{broken}").is_file:
            store.delete_file(f"{at}/pointers/{broken}")
    with store.open_output_stream(f"{at}/pointers/version-{later:012d}.json", compression=None) as f:
        f.write(b'{"version": 2, "fol')
    return state.read(schema)


#: Ranges are of five pages from the second page on; every other range has a broken third page.
_PAGED_SQL = """p AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS "offset" FROM pages), r AS (SELECT *, "offset" // 20 AS page, ("offset" // 20 - 1) // 5 AS span, ("offset" // 20 - 1) % 5 AS place FROM p WHERE "offset" >= 27)"""


@query(f"""WITH {_PAGED_SQL} SELECT "offset", page_id, url, NULL::varchar AS error FROM r WHERE span % 2 = 1 OR place < 2
 UNION ALL SELECT min("offset"), NULL, NULL, 'JSONDecodeError' FROM r WHERE span % 2 = 0 AND place = 2 GROUP BY span""")
def s13_paged_source(spark, sf):
    """Records of a paged source from an offset on, by ranges of pages; a broken page ends its own range only."""
    path, n = scratch(spark, "paged"), F.col("offset")
    rows = numbered_in_order(table(spark, sf, "pages").select("page_id", "url"), [], "page_id", "offset")
    page, total = F.floor(n / 20).alias("page"), rows.count()
    answers = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("offset", "page_id", "url"))).alias("items"))
    body = F.to_json(F.struct(F.lit(total).alias("total"), F.transform("items", lambda x: F.struct(x["page_id"].alias("page_id"), x["url"].alias("url"))).alias("items")))
    broken = (F.floor((F.col("page") - 1) / 5) % 2 == 0) & ((F.col("page") - 1) % 5 == 2)
    writers.row_files(answers, path, F.concat(F.lit("page-"), (F.col("page") * 20).cast("string"), F.lit(".json")), F.encode(F.when(broken, F.substring(body, 1, 30)).otherwise(body), "utf-8"))
    paged.register(spark)
    read = spark.read.format("paged").schema("offset long, page_id long, url string, error string").option("limit", 20).option("pagesPerTask", 5).load(path)
    return read.where("offset >= 27")


@query("SELECT count(DISTINCT sha256(text)) AS kept, count(*) AS offered, (SELECT count(DISTINCT sha256(text)) FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100 AND text IS NOT NULL)) AS new FROM documents WHERE text IS NOT NULL")
def k16_content_addressed(spark, sf):
    """A row for each text but for its identifiers; what is known is not written again."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    uuid = F.concat(F.lit("(uuid "), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), F.lit("-0000-1111-2222-333344445555)"))
    rows = d.select("doc_id", F.concat("text", uuid).alias("body"))
    kept = writers.content_addressed(rows, "body").agg(F.count("*").alias("kept"))
    known = writers.content_addressed(rows.where("doc_id < 100"), "body")
    new = writers.content_addressed(rows, "body", known).agg(F.count("*").alias("new"))
    return kept.crossJoin(rows.agg(F.count("*").alias("offered"))).crossJoin(new).select("kept", "offered", "new")


@query("SELECT conv_id, turn, 'data: {\"id\":' || conv_id || ',\"choices\":[{\"delta\":{\"content\":' || to_json(regexp_replace(text, '[^A-Za-z .]', '', 'g')) || '}}]}' || chr(10) || chr(10) || 'data: {\"choices\":[{\"delta\":{},\"finish_reason\":\"stop\"}],\"usage\":{\"completion_tokens\":' || length(text) || '}}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) AS chunk FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def k17_sse_chunks(spark, sf):
    """Content, then the finish with usage, then the mark of the end."""
    c = table(spark, sf, "conversations").where("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", F.length("text").alias("n"), F.regexp_replace("text", "[^A-Za-z .]", "").alias("content"))
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(F.struct(F.struct("content").alias("delta"))).alias("choices")))
    return c.select("conv_id", "turn", F.concat(F.lit("data: "), body, F.lit("\n\n"), writers.sse_finish(F.lit("stop"), F.col("n"))).alias("chunk"))


@query("SELECT event_id AS trace_id, 'chat' AS name, event_id % 7 AS prompt_tokens, event_id % 11 AS completion_tokens, event_id % 7 + event_id % 11 AS total_tokens, round_even(value * 10, 0)::bigint AS latency_ms, event_type || ',user-' || user_id AS tags FROM events WHERE event_type <> 'error'")
def k19_trace_rows(spark, sf):
    """A trace for each answered request: usage, latency and tags; none where tracing is off."""
    path, i = scratch(spark, "traces"), F.col("event_id")
    usage = F.struct((i % 7).alias("prompt_tokens"), (i % 11).alias("completion_tokens"), (i % 7 + i % 11).alias("total_tokens"))
    t = table(spark, sf, "events").where("event_type <> 'error'").select(i.alias("trace_id"), F.lit("chat").alias("name"), usage.alias("usage"), F.bround(F.col("value") * 10).cast("long").alias("latency_ms"), F.array("event_type", F.concat(F.lit("user-"), "user_id")).alias("tags"))
    t.write.json(path)
    back = spark.read.schema(t.schema).json(path)
    return back.select("trace_id", "name", "usage.*", "latency_ms", F.array_join("tags", ",").alias("tags"))


@query(f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH}) AS rn, count(*) OVER () AS n FROM documents WHERE lang = 'fr') SELECT doc_id, CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'valid' END AS split, 'pages/' || doc_id || '.png' AS image, 'What does page ' || doc_id || ' show?' AS question FROM p")
def k21_vlm_dataset(spark, sf):
    """Question, answer, images and provenance as JSON lines, nine to one."""
    path = scratch(spark, "vlm")
    d = splits.split_at_floor(_rows(spark, sf).where("lang = 'fr'"), [], "doc_id", [("train", 0.9)], "valid", least=0)
    i = F.col("doc_id").cast("string")
    rows = d.select("doc_id", "split", F.concat(F.lit("What does page "), i, F.lit(" show?")).alias("question"), F.array(F.concat(F.lit("pages/"), i, F.lit(".png"))).alias("images"), F.struct("source", "lang").alias("_provenance"))
    rows.write.partitionBy("split").json(path)
    back = spark.read.schema("doc_id long, question string, images array<string>, _provenance struct<source: string, lang: string>, split string").json(path)
    return back.select("doc_id", "split", F.col("images")[0].alias("image"), "question")


_LEDGER = "page_id, url, upper(sha256(html)) AS sha256, length(html) AS file_size, CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS http_status"


@query(f"WITH l AS (SELECT {_LEDGER} FROM pages WHERE page_id % 2 = 0), f AS (SELECT {_LEDGER} FROM pages WHERE url NOT IN (SELECT url FROM l)) SELECT page_id, url, lower(sha256) AS sha256, file_size, http_status FROM l UNION ALL SELECT page_id, url, lower(sha256), file_size, http_status FROM f WHERE http_status = 200")
def k22_download_ledger(spark, sf):
    """Known URLs are not fetched again; new rows are appended, failures only reported."""
    path = scratch(spark, "ledger")
    p = table(spark, sf, "pages")
    row = [F.col("page_id"), F.col("url"), F.sha2(F.encode("html", "utf-8"), 256).alias("sha256"), F.length("html").alias("file_size"), F.when(F.col("page_id") % 10 == 9, 404).otherwise(200).alias("http_status")]
    p.where("page_id % 2 = 0").select(*row).write.json(path)
    schema = "page_id long, url string, sha256 string, file_size int, http_status int"
    known = spark.read.schema(schema).json(path)
    dedup.not_known(p, known, ["url"]).select(*row).where("http_status = 200").write.mode("append").json(path)
    return spark.read.schema(schema).json(path)
