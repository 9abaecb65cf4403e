"""Writing of zip packages and PDF files, a file for each row."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .writers import few_rows, row_files

# Names of the format.
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
NAMESPACES = {
    "docx": 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"',
    "xlsx": f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_DOC}"',
    "pptx": f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_DOC}"',
}


def escaped(c: Column | str) -> Column:
    """Text as it stands in XML; characters that XML doesn't allow are left out."""
    legal = F.regexp_replace(c, "[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    return F.replace(F.replace(F.replace(legal, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def relationships(targets: list[tuple[str, str]] | Column) -> Column:
    """A part of relationships rId1, rId2, ... to (kind, target); ``targets`` may be a column of such structs."""
    if not isinstance(targets, Column):
        targets = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target")) for k, t in targets])
    one = F.transform(targets, lambda x, i: F.concat(F.lit('<Relationship Id="rId'), (i + 1).cast("string"), F.lit(f'" Type="{_DOC}/'), x["kind"], F.lit('" Target="'), x["target"], F.lit('"/>')))
    return F.concat(F.lit(_HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'), F.array_join(one, ""), F.lit("</Relationships>"))


def packages(df: DataFrame, out: str, name: Column, kind: str, parts: Column) -> int:
    """Write each row as a package ``out``/``name`` of the parts (a map of name to XML without its
    declaration); how many. The package's own relationships are added."""
    whole = F.map_concat(F.create_map(F.lit("_rels/.rels"), relationships([("officeDocument", MAIN[kind])])), F.transform_values(parts, lambda k, v: F.when(v.startswith("<?xml"), v).otherwise(F.concat(F.lit(_HEAD), v))))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            bodies = []
            for entries in b["parts"].to_pylist():
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    for part, xml in sorted(entries):
                        z.writestr(part, xml)
                bodies.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([b["name"], pa.array(bodies, pa.binary())], ["name", "body"])

    made = df.select(name.alias("name"), whole.alias("parts")).mapInArrow(zipped, "name string, body binary")
    return row_files(made, out, F.col("name"), F.col("body"))


def _pdf(pages: list[list[str]], packed: bool, broken: bool) -> bytes:
    """A PDF of pages of lines in a font whose codes are UTF-16 units.

    ``packed``: objects in compressed object streams and a cross-reference stream; ``broken``: a
    cross-reference table that points nowhere.
    """
    signs = sorted({c for page in pages for line in page for c in line if ord(c) < 1 << 16})
    cmap = "".join(f"<{ord(c):04x}> <{ord(c):04x}>\n" for c in signs)
    objects: dict[int, tuple[bytes, bytes | None]] = {
        1: (b"<< /Type /Catalog /Pages 2 0 R >>", None),
        2: (f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{5 + 2 * k} 0 R' for k in range(len(pages)))}] >>".encode(), None),
        3: (b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /ToUnicode 4 0 R >>", None),
        4: (b"<< >>", f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(signs)} beginbfchar\n{cmap}endbfchar".encode()),
    }
    for k, lines in enumerate(pages):
        shown = " T* ".join(f"<{line.encode('utf-16-be', 'ignore').hex()}> Tj" for line in lines)
        objects[5 + 2 * k] = (f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {6 + 2 * k} 0 R >>".encode(), None)
        objects[6 + 2 * k] = (b"<< >>", f"BT /F1 11 Tf 13 TL 50 800 Td {shown} ET".encode())
    out, at, inside = io.BytesIO(b"%PDF-1.7\n"), {}, {}
    out.seek(0, 2)

    def put(n: int, head: bytes, stream: bytes | None) -> None:
        at[n] = out.tell()
        if stream is None:
            out.write(b"%d 0 obj\n%s\nendobj\n" % (n, head))
            return
        body = zlib.compress(stream)
        out.write(b"%d 0 obj\n%s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, head.removesuffix(b">>"), len(body), body))

    plain = [n for n, (_, stream) in objects.items() if stream is None] if packed else []
    for n, (head, stream) in objects.items():
        if n not in plain:
            put(n, head, stream)
    last = max(objects) + 1
    if packed:
        bodies = [objects[n][0] for n in plain]
        starts = [0, *accumulate(len(b) + 1 for b in bodies[:-1])]
        index = " ".join(f"{n} {s}" for n, s in zip(plain, starts, strict=True)).encode() + b" "
        put(last, b"<< /Type /ObjStm /N %d /First %d >>" % (len(plain), len(index)), index + b" ".join(bodies))
        inside = {n: k for k, n in enumerate(plain)}
        start = out.tell()
        entries = [b"\0" * 6] + [(b"\2" + last.to_bytes(4, "big") + bytes([inside[n] % 256])) if n in inside else b"\1" + at.get(n, start).to_bytes(4, "big") + b"\0" for n in range(1, last + 2)]
        put(last + 1, b"<< /Type /XRef /Size %d /W [1 4 1] /Root 1 0 R >>" % (last + 2), b"".join(entries))
    else:
        start = out.tell()
        out.write(b"xref\n0 %d\n0000000000 65535 f \n" % last + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, last)))
        out.write(b"trailer << /Size %d /Root 1 0 R >>\n" % last)
    out.write(b"startxref\n%d\n%%%%EOF\n" % (start + 7 if broken else start))
    return out.getvalue()


def pdf_files(df: DataFrame, out: str, name: Column, pages: Column, packed: Column, broken: Column) -> int:
    """Write each row as a PDF ``out``/``name`` of ``pages`` (arrays of lines); how many."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            bodies = [_pdf(*x) for x in zip(*(b[c].to_pylist() for c in ("pages", "packed", "broken")), strict=True)]
            yield pa.RecordBatch.from_arrays([b["name"], pa.array(bodies, pa.binary())], ["name", "body"])

    files = df.select(name.alias("name"), pages.alias("pages"), packed.alias("packed"), broken.alias("broken"))
    return row_files(files.mapInArrow(made, "name string, body binary"), out, F.col("name"), F.col("body"))
