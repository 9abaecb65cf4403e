"""Office packages and PDF files: whole, odd and damaged ones."""

import io
import random
import zipfile
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from corpusloom.sources import office, packages, pdf, writers


def package(kind, parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        main = packages.MAIN[kind]
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="x/officeDocument" Target="/{main}"/></Relationships>')
        for name, xml in parts.items():
            z.writestr(name, xml)
    return raw.getvalue()


def document(body):
    return package("docx", {"word/document.xml": f"<w:document {packages.NAMESPACES['docx']}><w:body>{body}</w:body></w:document>"})


def read(spark, files, **limits):
    df = spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content binary")
    return {r.path: (r.status, r.text, r.units) for r in office.texts(office.blocks(df, **limits)).collect()}


def test_paragraphs_and_tables(spark):
    p = lambda t: f"<w:p><w:r>{t}</w:r></w:p>"
    body = "<w:tbl><w:tr><w:tc>" + p("<w:t>a</w:t>") + p("<w:t>b</w:t>") + "</w:tc><w:tc/></w:tr><w:tr><w:tc/><w:tc/></w:tr></w:tbl>"
    body += p("<w:t>one</w:t><w:tab/><w:t>two</w:t>") + "<w:p/>" + '<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:br/><w:t>next</w:t></w:r></w:p>'
    got = read(spark, {"x/a.docx": document(body), "x/empty.docx": document(""), "x/A.DOCX": document(p("<w:t> z </w:t>"))})
    assert {k: (v[0], v[2]) for k, v in got.items()} == {"x/a.docx": ("ok", 3), "x/empty.docx": ("ok", 0), "x/A.DOCX": ("ok", 1)} and got["x/A.DOCX"][1] == "z"
    assert got["x/a.docx"][1] == "one\ttwo\n\nlink\nnext\n\na\nb |"


def test_heading_levels():
    styles = "".join(f'<w:style w:styleId="s{k}"><w:name w:val="{name}"/></w:style>' for k, name in enumerate(("heading 1", "Heading 3", "heading 9", "Heading", "Normal")))
    ns = packages.NAMESPACES["docx"]
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="s{k}"/></w:pPr><w:r><w:t>t{k}</w:t></w:r></w:p>' for k in range(6))
    raw = package("docx", {"word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": '<R><Relationship Id="q" Type="y/styles" Target="../word/st.xml"/></R>', "word/st.xml": f"<w:styles {ns}>{styles}</w:styles>"})
    assert [b[2] for b in office.document_blocks(office.Package(raw))] == [1, 3, 6, 1, 0, 0]


def test_cells():
    ns = packages.NAMESPACES["xlsx"]
    rows = '<row><c r="B1"><v>7</v></c><c r="AA1" t="str"><v>x</v></c></row><row><c><v>1.50</v></c><c t="e"><v>#N/A</v></c><c t="b"><v>0</v></c></row><row/><row><c r="C4"/></row>'
    raw = package("xlsx", {"xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Type="y/worksheet" Target="w.xml"/></R>', "xl/w.xml": f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"})
    got = [b[3] for b in office.workbook_blocks(office.Package(raw))]
    assert got[0] == "Sheet: S" and got[1].split(" | ") == ["", "7"] + [""] * 24 + ["x"] and got[2:] == ["1.5 | #N/A | False"]
    assert office._column("A1") == 0 and office._column("AB12") == 27 and office._column("7") == -1


def test_statuses(spark):
    good = document("<w:p><w:r><w:t>x</w:t></w:r></w:p>")
    files = {"none.docx": None, "empty.docx": b"", "text.xlsx": b"no zip", "cut.docx": good[: len(good) // 2], "other.xlsx": good, "lol.docx": package("docx", {"word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'}), "big.docx": b"x" * 5000, "bomb.docx": package("docx", {"word/document.xml": "<a>" + " " * 100_000 + "</a>"}), "good.docx": good}
    got = read(spark, files, most_bytes=4000, most_unpacked=50_000)
    assert {k: v[0] for k, v in got.items()} == {"none.docx": "damaged", "empty.docx": "damaged", "text.xlsx": "damaged", "cut.docx": "damaged", "other.xlsx": "damaged", "lol.docx": "damaged", "big.docx": "too_large", "bomb.docx": "too_large", "good.docx": "ok"}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_damage_never_escapes(seed):
    r = random.Random(seed)
    raw = bytearray(document("<w:p><w:r><w:t>" + "word " * 50 + "</w:t></w:r></w:p>"))
    for _ in range(r.randint(1, 8)):
        raw[r.randrange(len(raw))] = r.randrange(256)
    try:
        list(office.document_blocks(office.Package(bytes(raw))))
    except (office.Damaged, KeyError, IndexError, ValueError, OverflowError):
        pass


PAGES = [["Grüße (an) \\ alle", "second line"], [], ["中文 text", "x" * 300]]


def texts(raw):
    file = pdf.Pdf(raw)
    return [file.text(*p) for p in file.pages()]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("broken", [False, True])
def test_pages_in_order(packed, broken):
    assert texts(packages._pdf(PAGES, packed, broken)) == ["\n".join(p) for p in PAGES]


def handmade(content, head=b"", extra=b"", resources=b"<< /Font << /F 4 0 R >> >>", kids=b"[3 0 R]"):
    objects = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids " + kids + b" /Resources " + resources + b" >> endobj", b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R >> endobj", b"4 0 obj << /Type /Font /Subtype /Type1 >> endobj", b"5 0 obj << " + head + b" /Length %d >> stream\n" % len(content) + content + b"\nendstream endobj", extra]
    return b"%PDF-1.4\n" + b"\n".join(objects) + b"\ntrailer << /Root 1 0 R >>"


def test_operators_and_strings():
    shown = rb"BT /F 12 Tf 10 TL (a\(b\)\\ (c) \101\n) Tj T* [(wo) -30 (rd) -400 (next)] TJ (line) ' 1 2 (other) "
    shown += rb'" 0 -5 Td <4d6F7> Tj 30 0 Td (right) Tj ET BI /W 1 ID \x00(no) EI BT 1 0 0 1 0 99 Tm (top) Tj ET'
    assert texts(handmade(shown)) == ["a(b)\\ (c) A\n\nword next\nline\nother\nMop right\ntop"]


def test_filters():
    plain = b"BT (words) Tj ET"
    assert texts(handmade(plain.hex().encode() + b">", b"/Filter /AHx")) == ["words"]
    assert texts(handmade(zlib.compress(plain).hex().encode() + b">", b"/Filter [/ASCIIHexDecode /FlateDecode]")) == ["words"]
    assert texts(handmade(zlib.compress(plain * 200)[:-20], b"/Filter /FlateDecode"))[0].startswith("words")
    assert texts(handmade(b"\xff\xd8", b"/Filter /DCTDecode")) == [""]


def test_row_filters():
    r = random.Random(1)
    rows = [bytes(r.randrange(256) for _ in range(6)) for _ in range(10)]
    coded, above = b"", bytes(6)
    for k, row in enumerate(rows):
        kind, out = k % 5, bytearray()
        for x in range(6):
            left, up, corner = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            near = left + up - corner
            paeth = left if abs(near - left) <= abs(near - up) and abs(near - left) <= abs(near - corner) else up if abs(near - up) <= abs(near - corner) else corner
            out.append((row[x] - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        coded += bytes([kind]) + bytes(out)
        above = row
    assert pdf._unpredicted(coded, {"Predictor": 15, "Columns": 6}) == b"".join(rows)


def test_loops_end():
    assert texts(handmade(b"", kids=b"[2 0 R 3 0 R 2 0 R]")) == [""]
    with pytest.raises((pdf.Damaged, TypeError, KeyError)):
        pdf.Pdf(b"%PDF-1.4 1 0 obj 2 0 R endobj 2 0 obj 1 0 R endobj trailer << /Root 1 0 R >>").pages().__next__()


def test_later_object_of_a_number_counts():
    raw = handmade(b"BT (old) Tj ET") + b"\n5 0 obj << /Length 14 >> stream\nBT (new) Tj ET\nendstream endobj"
    assert texts(raw) == ["new"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_damaged_files_never_escape(seed, packed):
    r = random.Random(seed)
    raw = bytearray(packages._pdf(PAGES, packed, r.random() < 0.3))
    for _ in range(r.randint(1, 12)):
        raw[r.randrange(len(raw))] = r.randrange(256)
    try:
        texts(bytes(raw[: r.choice([len(raw), r.randrange(len(raw))])]))
    except (pdf.Damaged, KeyError, IndexError, TypeError, ValueError, AttributeError, OverflowError, RecursionError):
        pass


def test_rows_of_pages(spark):
    files = {"a.pdf": packages._pdf(PAGES, True, False), "none.pdf": None, "text.pdf": b"hello", "locked.pdf": handmade(b"").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), "nopages.pdf": handmade(b"", kids=b"[]")}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = sorted((tuple(r) for r in pdf.pages(df).collect()), key=str)
    assert got == sorted([("a.pdf", "ok", k, "\n".join(p)) for k, p in enumerate(PAGES, 1)] + [("none.pdf", "damaged", None, None), ("text.pdf", "damaged", None, None), ("locked.pdf", "encrypted", None, None), ("nopages.pdf", "ok", None, None)], key=str)
    by = {r.path: (r.method, r.page_count, r.sparse_pages) for r in pdf.by_file(pdf.pages(df)).collect()}
    assert by == {"a.pdf": ("text_sparse", 3, [1, 2]), "none.pdf": ("error", 0, []), "text.pdf": ("error", 0, []), "locked.pdf": ("error", 0, []), "nopages.pdf": ("empty", 0, [])}


def test_a_font_of_many_pages_is_read_once(monkeypatch):
    made = []

    class Counted(pdf.Font):
        def __init__(self, *a):
            made.append(1)
            super().__init__(*a)

    monkeypatch.setattr(pdf, "Font", Counted)
    for packed, broken in ((False, False), (True, False), (False, True)):
        made.clear()
        f = pdf.Pdf(packages._pdf([["eins äß", "zwei"], ["drei"], [f"x{k}" for k in range(300)]], packed, broken))
        assert [f.text(*p) for p in f.pages()] == ["eins äß\nzwei", "drei", "\n".join(f"x{k}" for k in range(300))]
        assert len(made) == 1


def test_codes_of_every_size_and_a_last_half_one():
    font = pdf.Font.__new__(pdf.Font)
    for size in (1, 2, 3):
        font.size, font.codes = size, {int.from_bytes(b"\1" * size, "big"): "a", 2: "b"}
        assert font.read(b"\1" * 6 + b"\2") == "a" * (6 // size) + "b" and font.read(b"") == ""
    assert pdf.Font._map(font, b"beginbfchar <00 01> <00410042> <02>\n<0043> endbfchar") is None
    assert font.codes[1] == "AB" and font.codes[2] == "C"


def test_files_are_made_from_a_few_rows_at_a_time(spark, tmp_path):
    b = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(writers.few_rows(iter([b, b.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == writers.FEW_ROWS and [x for p in parts for x in p["x"].to_pylist()] == list(range(1000))
    # What the writing task is given, as a step before it sees it.
    seen = spark.range(2000, numPartitions=1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows] * b.num_rows}) for b in bs), "n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    name = F.concat(F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    assert writers.row_files(seen, f"file://{tmp_path}", name, F.col("n").cast("string").cast("binary")) == 2000
    assert max(int(p.read_text()) for p in tmp_path.glob("*.txt")) <= writers.BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
