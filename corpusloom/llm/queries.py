"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, html_text, jaccard, language, packing, quality, rans, token_counts, toxicity, urls, vector_codes, warc
from .common import table
from .tokens import tokenizer_path

#: (action, host, path)
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in pieces of at most 2048 ids, with its place in a sequence."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _id_remainder(n: int):
    """crc32 of the id's text, modulo n: what decides whether a row may be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.where(_id_remainder(3) != 1)))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_id_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the rANS files that were written from it."""
    return rans.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, from its host's winning containers."""
    read = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_html=False)
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document's shingle set and the component that its links reach."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), percent=80, size=5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality counts and the verdict on every document."""
    judged = quality.quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs, _id_remainder(4) != 2))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(_id_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    rules = [urls.prefix_rule(*r) for r in URL_RULES] + urls.spam_rules()
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _op8_sql() -> str:
    host = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{a}' AS ra" for a, h, p in URL_RULES)
    spam = "|".join(urls.SPAM_HOST_WORDS)
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT row_number() OVER () AS n, page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    r AS ({fits}),
    m AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(ra, length(rh || rp)) AS action
          FROM b JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
    SELECT page_id, host, path, rule,
           coalesce(action, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])({spam})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
    FROM b LEFT JOIN m USING (n)"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie inside phrases of the benchmark."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.concat_ws(",", F.array_sort("items"))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives that were written."""
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and error of every embedding, 16 parts by 64 entries, after two rounds."""
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, size=64, rounds=2)
    coded = vector_codes.with_label_errors(found.rows)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _floor_mean(column: str) -> str:
    return f"CAST(floor(sum({column}) / count(*)) AS BIGINT)"


def _op11_sql(parts: int = 16, size: int = 64, rounds: int = 2, width: int = 4) -> str:
    cut = ", ".join(f"CAST(floor(256 * CAST(embedding[{width} * part + {d + 1}] AS DOUBLE)) AS BIGINT) AS x{d}" for d in range(width))
    far = " + ".join(f"(k.x{d} - b.x{d}) * (k.x{d} - b.x{d})" for d in range(width))
    steps = [
        "e AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"k AS MATERIALIZED (SELECT vec_id, label, part, {cut} FROM e, range({parts}) r(part))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT {size})",
        f"b0 AS MATERIALIZED (SELECT part, entry, {', '.join(f'x{d}' for d in range(width))} FROM k JOIN f USING (vec_id))",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT k.vec_id, k.part, min(({far}) * {size} + b.entry) AS best FROM k JOIN b{n} b ON k.part = b.part GROUP BY ALL)")
        if n < rounds:
            means = ", ".join(f"{_floor_mean(f'x{d}')} AS y{d}" for d in range(width))
            steps.append(f"m{n} AS (SELECT part, best % {size} AS entry, {means} FROM a{n} JOIN k USING (vec_id, part) GROUP BY ALL)")
            now = ", ".join(f"coalesce(y{d}, x{d}) AS x{d}" for d in range(width))
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, {now} FROM b{n} LEFT JOIN m{n} USING (part, entry))")
    flat = ", ".join(f"x{d}" for d in range(width))
    steps.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', best % {size}), '' ORDER BY part) AS code, CAST(sum(best // {size}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"s AS (SELECT sha256(string_agg(concat_ws(',', {flat}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN e USING (vec_id), s"


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding of 64 components, of 40 after five rounds."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    found = clustering.cluster_vectors(table(spark, sf_dir, "embeddings"), order, k=40, dims=64, rounds=5)
    return clustering.with_inertia(found)


def _op12_sql(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    far = "list_inner_product(e.v, e.v) - 2 * list_inner_product(e.v, c.v) + list_inner_product(c.v, c.v)"
    steps = [
        f"e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM e ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, min(CAST({far} AS BIGINT) * {k} + cluster) AS best FROM e, c{n} c GROUP BY vec_id)")
        if n < rounds:
            steps.append(f"u{n} AS (SELECT best % {k} AS cluster, unnest(v) AS x, unnest(range({dims})) AS d FROM a{n} JOIN e USING (vec_id))")
            steps.append(f"w{n} AS (SELECT cluster, d, floor(sum(x) / count(*)) AS x FROM u{n} GROUP BY ALL)")
            steps.append(f"m{n} AS (SELECT cluster, list(x ORDER BY d) AS w FROM w{n} GROUP BY cluster)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(w, v) AS v FROM c{n} LEFT JOIN m{n} USING (cluster))")
    return f"""WITH {', '.join(steps)},
    r AS (SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance FROM a{rounds})
    SELECT vec_id, r.cluster, distance, CAST(sum(distance) OVER (PARTITION BY r.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
    FROM r JOIN c{rounds} c ON r.cluster = c.cluster"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes and tokens of every document, and whether they are more than 512 tokens."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_token_files, op4_html_extraction, op5_jaccard_join, op6_quality_rules, op7_language_id, op8_url_filter, op9_decontamination, op10_warc, op11_vector_codes, op12_centroid_clusters, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": _op8_sql(), "op11_vector_codes": _op11_sql(), "op12_centroid_clusters": _op12_sql()}
