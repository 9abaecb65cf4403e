"""Queries on office and PDF files that are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import listing, office, packages, pdf, readers, writers
from ..sources.scratch import scratch
from .corpus import SQL_GUESS, VALUES
from .registry import query, table

#: The lines of a text, each squeezed, without empty ones.
SQL_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\x00-\x20]+', ' ', 'g'))), lambda x: x <> '')"


def _lines(c="text"):
    squeezed = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\x00-\\x20]+", " ")))
    return F.filter(squeezed, lambda x: x != "")


def _name(number, ext):
    return F.concat(F.lit("f"), number.cast("string"), F.lit("." + ext))


def _number():
    return F.regexp_extract("path", r"/f([0-9]+)[.][a-z]+$", 1).cast("long")


def _texts(spark, path):
    return office.texts(office.blocks(listing.files(spark, path)))


def _text_document():
    """Parts of a text document for a row of documents: a table, two headings, a paragraph for each line in two runs."""
    ns = packages.NAMESPACES["docx"]
    run = lambda t: F.concat(F.lit('<w:r><w:t xml:space="preserve">'), packages.escaped(t), F.lit("</w:t></w:r>"))
    p = lambda style, t: F.concat(F.lit(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>'), run(F.substring(t, 1, 9)), run(F.substr(t, F.lit(10))), F.lit("</w:p>"))
    cell = lambda t: F.concat(F.lit("<w:tc><w:p>"), run(t), F.lit("</w:p></w:tc>"))
    row = lambda a, b: F.concat(F.lit("<w:tr>"), cell(F.lit(a)), cell(b), F.lit("</w:tr>"))
    body = F.concat(
        F.lit(f"<w:document {ns}><w:body><w:tbl>"), row("source", F.coalesce("source", F.lit("none"))), row("chars", F.coalesce(F.length("text"), F.lit(0)).cast("string")), F.lit("</w:tbl>"),
        p("H1", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))), p("H7", F.coalesce("lang", F.lit("none"))),
        F.array_join(F.transform(_lines(), lambda x: p("Body", x)), ""), F.lit("<w:p/></w:body></w:document>"),
    )
    style = lambda i, name: f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/></w:style>'
    styles = f"<w:styles {ns}>{style('H1', 'heading 1')}{style('H7', 'heading 7')}{style('Body', 'Body Text')}</w:styles>"
    return F.create_map(F.lit("word/document.xml"), body, F.lit("word/_rels/document.xml.rels"), packages.relationships([("styles", "styles.xml")]), F.lit("word/styles.xml"), F.lit(styles))


_DOCX_SQL = f"SELECT doc_id, 'ok' AS status, array_to_string(['# Document ' || doc_id, '###### ' || coalesce(lang, 'none')] || {SQL_LINES} || ['source | ' || coalesce(source, 'none'), 'chars | ' || coalesce(length(text), 0)], chr(10) || chr(10)) AS text FROM documents"


@query(_DOCX_SQL)
def s21_text_documents(spark, sf):
    """Text documents with heading levels, paragraphs of several runs and a table, read back as marked-up text."""
    path = scratch(spark, "docx")
    packages.packages(table(spark, sf, "documents"), path, _name(F.col("doc_id"), "docx"), "docx", _text_document())
    return _texts(spark, path).select(_number().alias("doc_id"), "status", "text")


@query("""WITH p AS (SELECT *, p_partkey // 100 AS book, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS rn FROM part),
 s AS (SELECT book, string_agg(p_brand || ' | ' || p_name || ' | ' || p_size || ' |  | ' || CAST(p_retailprice AS VARCHAR), chr(10) ORDER BY p_partkey) AS names, string_agg(CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || ' | ' || strftime(DATE '1899-12-30' + CAST(40000 + p_partkey % 1000 AS INTEGER), '%Y-%m-%d 00:00:00'), chr(10) ORDER BY p_partkey) AS sizes FROM p GROUP BY book)
 SELECT book, 'ok' AS status, 2 AS units, '## Sheet: Names' || chr(10) || names || chr(10) || chr(10) || '## Sheet: Sizes & dates' || chr(10) || sizes AS text FROM s""")
def s21_workbooks(spark, sf):
    """Workbooks of two sheets (a hundred parts each): shared and inline texts, numbers, an empty column, truth values, dates."""
    path, ns = scratch(spark, "xlsx"), packages.NAMESPACES["xlsx"]
    p = table(spark, sf, "part").withColumn("book", F.floor(F.col("p_partkey") / 100))
    rows = p.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_brand", "p_name", "p_size", "p_retailprice"))).alias("x"))
    brands = F.array_distinct(F.transform("x", lambda r: r["p_brand"]))
    text = lambda c: F.concat(F.lit("<v>"), c.cast("string"), F.lit("</v></c>"))
    cell = lambda col, i, kind, c: F.concat(F.lit(f'<c r="{col}'), i.cast("string"), F.lit(f'"{kind}>'), text(c))
    inline = lambda col, i, c: F.concat(F.lit(f'<c r="{col}'), i.cast("string"), F.lit('" t="inlineStr"><is><t xml:space="preserve">'), packages.escaped(c), F.lit("</t></is></c>"))
    sheet = lambda last, cells: F.concat(F.lit(f'<worksheet {ns}><dimension ref="A1:{last}'), F.size("x").cast("string"), F.lit('"/><sheetData>'), F.array_join(F.transform("x", lambda r, i: F.concat(F.lit("<row>"), cells(r, i + 1), F.lit("</row>"))), ""), F.lit("</sheetData></worksheet>"))
    names = sheet("E", lambda r, i: F.concat(cell("A", i, ' t="s"', F.array_position(F.col("brands"), r["p_brand"]) - 1), inline("B", i, r["p_name"]), cell("C", i, "", r["p_size"]), cell("E", i, "", r["p_retailprice"])))
    sizes = sheet("B", lambda r, i: F.concat(cell("A", i, ' t="b"', (r["p_size"] > 25).cast("int")), cell("B", i, ' s="1"', 40000 + r["p_partkey"] % 1000)))
    shared = F.concat(F.lit(f"<sst {ns}>"), F.array_join(F.transform("brands", lambda b: F.concat(F.lit("<si><r><t>"), packages.escaped(F.substring(b, 1, 3)), F.lit("</t></r><r><t>"), packages.escaped(F.substr(b, F.lit(4))), F.lit("</t></r></si>"))), ""), F.lit("</sst>"))
    book = f'<workbook {ns}><sheets><sheet name="Names" sheetId="9" r:id="rId2"/><sheet name="Sizes &amp; dates" sheetId="2" r:id="rId1"/></sheets></workbook>'
    styles = f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    rels = packages.relationships([("worksheet", "worksheets/a.xml"), ("worksheet", "/xl/worksheets/b.xml"), ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")])
    parts = F.create_map(F.lit("xl/workbook.xml"), F.lit(book), F.lit("xl/_rels/workbook.xml.rels"), rels, F.lit("xl/worksheets/b.xml"), names, F.lit("xl/worksheets/a.xml"), sizes, F.lit("xl/sharedStrings.xml"), shared, F.lit("xl/styles.xml"), F.lit(styles))
    packages.packages(rows.withColumn("brands", brands), path, _name(F.col("book"), "xlsx"), "xlsx", parts)
    return _texts(spark, path).select(_number().alias("book"), "status", "units", "text")


@query(f"""WITH c AS (SELECT conv_id, turn // 20 AS block, row_number() OVER (PARTITION BY conv_id, turn // 20 ORDER BY turn, role, text) AS n, role, {SQL_LINES} AS lines FROM conversations)
 SELECT conv_id * 1000 + block AS deck, count(*)::int AS units, string_agg('## Slide ' || n || chr(10) || array_to_string(list_filter([role], lambda x: x <> '') || lines, chr(10)), chr(10) || chr(10) ORDER BY n) AS text FROM c GROUP BY conv_id, block""")
def s21_slides(spark, sf):
    """Slides of a presentation (a conversation's turns, twenty at most) in its own order, not in that of the files' names."""
    path, ns = scratch(spark, "pptx"), packages.NAMESPACES["pptx"]
    c = table(spark, sf, "conversations").withColumns({"deck": F.col("conv_id") * 1000 + F.floor(F.col("turn") / 20), "lines": _lines()})
    decks = c.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "lines"))).alias("x"))
    p = lambda t: F.concat(F.lit("<a:p><a:r><a:t>"), packages.escaped(t), F.lit("</a:t></a:r></a:p>"))
    shape = lambda body: F.concat(F.lit("<p:sp><p:txBody>"), body, F.lit("</p:txBody></p:sp>"))
    slide = lambda s: F.concat(F.lit(f"<p:sld {ns}><p:cSld><p:spTree>"), shape(p(F.coalesce(s["role"], F.lit("")))), F.lit("<p:pic/>"), shape(F.array_join(F.transform(s["lines"], p), "")), F.lit("</p:spTree></p:cSld></p:sld>"))
    file = lambda i: F.concat(F.lit("slides/slide"), (F.size("x") - i).cast("string"), F.lit(".xml"))
    slides = F.map_from_arrays(F.transform("x", lambda s, i: F.concat(F.lit("ppt/"), file(i))), F.transform("x", slide))
    ids = F.array_join(F.transform("x", lambda s, i: F.concat(F.lit('<p:sldId r:id="rId'), (i + 1).cast("string"), F.lit('"/>'))), "")
    main = F.concat(F.lit(f"<p:presentation {ns}><p:sldIdLst>"), ids, F.lit("</p:sldIdLst></p:presentation>"))
    rels = packages.relationships(F.transform("x", lambda s, i: F.struct(F.lit("slide").alias("kind"), file(i).alias("target"))))
    parts = F.map_concat(slides, F.create_map(F.lit("ppt/presentation.xml"), main, F.lit("ppt/_rels/presentation.xml.rels"), rels))
    packages.packages(decks, path, _name(F.col("deck"), "pptx"), "pptx", parts)
    return _texts(spark, path).select(_number().alias("deck"), "units", "text")


_FAULT_SQL = "CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 4 THEN CASE WHEN length(url) * 20000 > 400000 THEN 'too_large' ELSE 'ok' END ELSE 'damaged' END"


@query(f"SELECT page_id, {_FAULT_SQL} AS status, CASE WHEN page_id % 6 = 0 THEN 'Page ' || page_id WHEN {_FAULT_SQL} = 'ok' THEN repeat(url, 20000) ELSE '' END AS text FROM pages WHERE url IS NOT NULL")
def s21_damaged_packages(spark, sf):
    """Packages that are none, lack their main part, declare entities, unpack to too much or break off, beside whole ones."""
    path, ns, i = scratch(spark, "damaged"), packages.NAMESPACES["docx"], F.col("page_id")
    p = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", "url")
    body = lambda t: F.concat(F.lit(f"<w:document {ns}><w:body><w:p><w:r><w:t>"), t, F.lit("</w:t></w:r></w:p></w:body></w:document>"))
    told = F.concat(F.lit("Page "), i.cast("string"))
    text = F.when(i % 6 == 4, F.repeat(packages.escaped("url"), F.lit(20_000))).otherwise(told)
    xml = F.when(i % 6 == 2, F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE w [<!ENTITY a "b">]>'), body(F.lit("&a;")))).when(i % 6 == 3, F.substring(body(text), 1, 120)).otherwise(body(text))
    part = F.when(i % 6 == 1, "word/other.xml").otherwise("word/document.xml")
    packages.packages(p.where(i % 6 < 5), path, _name(i, "docx"), "docx", F.create_map(part, xml))
    writers.row_files(p.where(i % 6 == 5), path, _name(i, "docx"), F.concat(F.lit("PK"), "url"))
    read = office.texts(office.blocks(listing.files(spark, path), most_unpacked=400_000))
    return read.select(_number().alias("page_id"), "status", "text")


_PAGES_SQL = f"WITH d AS (SELECT doc_id, lang, source, {SQL_LINES} AS lines FROM documents), p AS (SELECT doc_id, lang, source, unnest(range(0, greatest(len(lines), 1), 20)) AS k, lines FROM d), t AS (SELECT doc_id, source, CAST(k // 20 + 1 AS INTEGER) AS page, array_to_string(lines[k + 1 : k + 20], chr(10)) AS text FROM p)"


def _pdf_files(spark, sf, where=""):
    """A PDF for each document, twenty lines a page; plain, packed and without a good table by turns; every 17th is cut off at its head."""
    path, i = scratch(spark, "pdf"), F.col("doc_id")
    d = table(spark, sf, "documents").withColumn("lines", _lines())
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)), F.lit(20)), lambda k: F.slice("lines", k + 1, F.lit(20)))
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), _name(i, "pdf"))
    packages.pdf_files(d.where(i % 17 != 16), path, name, pages, i % 3 == 1, i % 3 == 2)
    writers.row_files(d.where(i % 17 == 16), path, name, F.concat(F.lit("%PDF-1.7 cut off "), i.cast("string")))
    return path


@query(_PAGES_SQL + " SELECT doc_id, 'ok' AS status, page, text FROM t WHERE doc_id % 17 <> 16 UNION ALL SELECT doc_id, 'damaged', NULL, NULL FROM documents WHERE doc_id % 17 = 16")
def s19_pdf_pages(spark, sf):
    """The text of every page of binary PDFs, in the order of the page tree; damaged files have a status."""
    return pdf.pages(listing.files(spark, _pdf_files(spark, sf))).select(_number().alias("doc_id"), "status", "page", "text")


_METHOD_SQL = f"""{_PAGES_SQL}, f AS (SELECT doc_id, source, count(*) AS page_count, string_agg(page, ',' ORDER BY page) FILTER (length(text) < 100) AS sparse, count_if(length(text) < 100) AS n_sparse, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM t WHERE doc_id % 17 <> 16 GROUP BY ALL),
 m AS (SELECT doc_id, source, page_count, coalesce(sparse, '') AS sparse_pages, CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 'empty' WHEN n_sparse * 2 > page_count THEN 'text_sparse' ELSE 'text' END AS method, text FROM f UNION ALL SELECT doc_id, source, 0, '', 'error', '' FROM documents WHERE doc_id % 17 = 16)"""


@query(_METHOD_SQL + " SELECT doc_id, page_count, sparse_pages, method FROM m")
def s19_pdf_methods(spark, sf):
    """How each PDF was read: its pages, the sparse ones and the method."""
    read = pdf.by_file(pdf.pages(listing.files(spark, _pdf_files(spark, sf))))
    return read.select(_number().alias("doc_id"), "page_count", F.array_join("sparse_pages", ",").alias("sparse_pages"), "method")


_CLEAN = VALUES["x01_page_clean"][1]


@query(f"{_METHOD_SQL}, c AS (SELECT doc_id, source, page_count, method, {_CLEAN} AS text FROM m), g AS (SELECT *, CASE WHEN text <> '' THEN {SQL_GUESS} ELSE '' END AS language FROM c) SELECT coalesce(source, 'none') AS source, count(*) AS files, count_if(method = 'error') AS errors, sum(page_count)::bigint AS pages, sum(length(text))::bigint AS chars, count_if(language = 'fr') AS french, count_if(language = 'de') AS german, count_if(text <> '') AS written FROM g GROUP BY 1")
def b41_batch_extract(spark, sf):
    """All PDFs of each source's folder: cleaned texts as files, the results as a list beside them."""
    path = _pdf_files(spark, sf)
    read = pdf.by_file(pdf.pages(listing.files(spark, path))).withColumn("source", F.regexp_extract("path", "/([^/]+)/f[0-9]+[.]pdf$", 1))
    clean = read.withColumn("clean", T.clean_pages(F.col("text"))).withColumn("language", F.when(F.col("clean") != "", T.guess_language("clean")).otherwise(""))
    out = scratch(spark, "extracted")
    kept = clean.select("source", _number().alias("n"), "page_count", "method", "sparse_pages", "language", F.length("clean").alias("chars"), "clean")
    kept.drop("clean").write.partitionBy("source").json(f"{out}/metadata")
    writers.row_files(kept.where("clean <> ''"), f"{out}/texts", F.concat("source", F.lit("/"), _name(F.col("n"), "txt")), F.encode("clean", "utf-8"))
    listed = spark.read.schema("n long, page_count long, method string, language string, chars long, source string").json(f"{out}/metadata")
    told = listed.groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("method") == "error").alias("errors"), F.sum("page_count").alias("pages"), F.sum("chars").alias("chars"), F.count_if(F.col("language") == "fr").alias("french"), F.count_if(F.col("language") == "de").alias("german"))
    texts = readers.source_tree(spark, f"{out}/texts", "*.txt").groupBy(F.regexp_extract("path", "/([^/]+)/f[0-9]+[.]txt$", 1).alias("source")).agg(F.count("*").alias("written"))
    return told.join(texts, "source", "left").select(*told.columns, F.coalesce("written", F.lit(0)).alias("written"))
