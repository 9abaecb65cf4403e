"""Office files (OOXML packages) as rows of blocks: one row for each paragraph, table row or slide line.

A package is a zip directory of XML parts. Which part is which is found by relationships, not
by name. Each file is read in one task and gives its blocks one after another; the text of a file
is put together by Spark.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .listing import bodies, to_read

#: Larger files, and packages whose parts are larger in all, aren't opened.
MOST_BYTES = 25 << 20
MOST_UNPACKED = 400 << 20
#: Blocks in one Arrow batch.
BATCH_BLOCKS = 2000

# Names of the format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

SCHEMA = "path string, status string, unit int, place int, kind string, level int, text string"


class Damaged(Exception):
    """The package can't be read as what it says it is."""


class Package:
    """The parts of a zip package, looked up by relationship."""

    def __init__(self, raw: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
            raise Damaged(str(e)) from None
        self.unpacked = sum(i.file_size for i in self.zip.infolist())

    def xml(self, part: str) -> ElementTree.Element:
        try:
            raw = self.zip.read(part)
            if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                raise Damaged(f"{part} declares entities")
            return ElementTree.fromstring(raw)
        except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, EOFError, RuntimeError, OSError) as e:
            raise Damaged(f"{part}: {e}") from None
        except Exception as e:  # zlib.error has no base of its own
            raise Damaged(f"{part}: {e}") from None

    def related(self, part: str) -> dict[str, tuple[str, str]]:
        """The kind (its last word) and the target of each relationship of a part, by id."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{name}.rels")
        if rels not in self.zip.namelist():
            return {}
        found = {}
        for r in self.xml(rels):
            target = r.get("Target", "")
            at = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            found[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], at)
        return found

    def of_kind(self, part: str, kind: str) -> str | None:
        return next((at for k, at in self.related(part).values() if k == kind), None)

    def main(self, root: str) -> tuple[str, ElementTree.Element]:
        """The name and the root of the main part, which must be of the kind."""
        part = self.of_kind("", "officeDocument")
        if part is None:
            raise Damaged("no main part")
        found = self.xml(part)
        if found.tag != root:
            raise Damaged(f"{found.tag} is no {root}")
        return part, found


def _paragraph(p: ElementTree.Element) -> str:
    """The text of a paragraph of a text document: runs, tabs and breaks in order."""
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    runs = (r for e in p for r in ([e] if e.tag == f"{_W}r" else e.findall(f"{_W}r") if e.tag == f"{_W}hyperlink" else []))
    return "".join(t.text or "" if t.tag == f"{_W}t" else signs.get(t.tag, "") for r in runs for t in r)


def document_blocks(package: Package) -> Iterator[tuple]:
    """Paragraphs with their heading levels, then the rows of tables, their cells joined by bars."""
    main, root = package.main(f"{_W}document")
    styles = package.of_kind(main, "styles")
    level = {}
    for s in package.xml(styles).findall(f"{_W}style") if styles else []:
        name = (s.find(f"{_W}name").get(f"{_W}val", "") if s.find(f"{_W}name") is not None else "").lower()
        if name.startswith("heading"):
            n = name.removeprefix("heading").strip()
            level[s.get(f"{_W}styleId")] = min(int(n), 6) if n.isdigit() else 1
    body = root.find(f"{_W}body")
    if body is None:
        raise Damaged("no body")
    for unit, p in enumerate(body.findall(f"{_W}p")):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if text := _paragraph(p).strip():
            yield unit, "paragraph", level.get(style.get(f"{_W}val"), 0) if style is not None else 0, text
    for row in body.iterfind(f"{_W}tbl/{_W}tr"):
        cells = ["\n".join(_paragraph(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            yield 0, "row", 0, " | ".join(cells)


def _column(ref: str) -> int:
    """The number of a cell's column from its letters, from 0; -1 if it has none."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook_blocks(package: Package) -> Iterator[tuple]:
    """The sheets in the workbook's order: each one's title, then its rows that have a value."""
    main, book = package.main(f"{_S}workbook")
    shared_part, styles = package.of_kind(main, "sharedStrings"), package.of_kind(main, "styles")
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in package.xml(shared_part).findall(f"{_S}si")] if shared_part else []
    dates = [int(x.get("numFmtId", 0)) in _DATE_FORMATS for x in package.xml(styles).iterfind(f"{_S}cellXfs/{_S}xf")] if styles else []

    def value(c: ElementTree.Element) -> str:
        kind, v = c.get("t", "n"), c.findtext(f"{_S}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None:
            return ""
        if kind == "s":
            return shared[int(v)]
        if kind == "b":
            return str(v == "1")
        if kind != "n":
            return v
        if dates and dates[int(c.get("s", 0))]:
            return str(datetime(1899, 12, 30) + timedelta(days=float(v)))
        return str(int(v)) if v.lstrip("-").isdigit() else str(float(v))

    related = package.related(main)
    for unit, sheet in enumerate(book.iterfind(f"{_S}sheets/{_S}sheet")):
        yield unit, "sheet", 2, "Sheet: " + sheet.get("name", "")
        root = package.xml(related[sheet.get(f"{_R}id")][1])
        size = root.find(f"{_S}dimension")
        width = _column(size.get("ref", "").rpartition(":")[2]) + 1 if size is not None else 0
        for row in root.iterfind(f"{_S}sheetData/{_S}row"):
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                at = _column(c.get("r", ""))
                cells.extend([""] * ((at if at >= 0 else len(cells)) - len(cells)))
                cells.append(value(c))
            if any(cells):
                yield unit, "row", 0, " | ".join(cells + [""] * (width - len(cells)))


def slide_blocks(package: Package) -> Iterator[tuple]:
    """The slides in the presentation's order: a title with the number, then the paragraphs of their shapes."""
    main, show = package.main(f"{_P}presentation")
    related = package.related(main)
    for unit, slide in enumerate(show.iterfind(f"{_P}sldIdLst/{_P}sldId")):
        yield unit, "slide", 2, f"Slide {unit + 1}"
        for p in package.xml(related[slide.get(f"{_R}id")][1]).iterfind(f"{_P}cSld/{_P}spTree/{_P}sp/{_P}txBody/{_A}p"):
            if text := "".join(r.findtext(f"{_A}t") or "" for r in p.findall(f"{_A}r")).strip():
                yield unit, "line", 0, text


_READERS = {"docx": document_blocks, "xlsx": workbook_blocks, "pptx": slide_blocks}


def blocks(files: DataFrame, most_bytes: int = MOST_BYTES, most_unpacked: int = MOST_UNPACKED) -> DataFrame:
    """A row for each block of the office files (path and content, or path alone): the unit it is in (paragraph, sheet or
    slide, from 0), its place in the file, its kind, heading level and text.

    A file without blocks, one that is too large (packed or unpacked) and one that is damaged has a
    single row with its status and no place; a damaged file gives no text, however far it could be
    read. A null content is a damaged one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = zip(*rows[:BATCH_BLOCKS], strict=True)
            del rows[:BATCH_BLOCKS]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for path, raw in bodies(batches, most_bytes):
            status, found = "ok", []
            if len(raw or b"") > most_bytes:
                status = "too_large"
            else:
                try:
                    package = Package(raw or b"")
                    if package.unpacked > most_unpacked:
                        status = "too_large"
                    else:
                        found = list(_READERS[path.rpartition(".")[2].lower()](package))
                except (Damaged, KeyError, IndexError, ValueError, OverflowError):
                    status = "damaged"
            rows += [(path, status, u, k, *rest) for k, (u, *rest) in enumerate(found)] or [(path, status, None, None, None, None, None)]
            while len(rows) >= BATCH_BLOCKS:
                yield told()
        while rows:
            yield told()

    return to_read(files).mapInArrow(run, SCHEMA)


def texts(found: DataFrame) -> DataFrame:
    """path, status, text and units (paragraphs, sheets or slides) of each file, from its blocks.

    Titles get their signs. Paragraphs stand apart by an empty line, as do sheets and slides; rows
    and lines follow each other. A file's blocks are at most what its 25 MB unpack to.
    """
    apart = F.col("kind").isin("paragraph") | F.col("path").rlike(r"(?i)docx$") | (F.col("kind").isin("sheet", "slide") & (F.col("place") > 0))
    told = F.concat(F.when(apart & (F.col("place") > 0), "\n\n").when(F.col("place") > 0, "\n").otherwise(""), F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise(""), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", told.alias("t"))))), lambda x: x["t"])
    whole = F.regexp_replace(F.regexp_replace(F.array_join(ordered, ""), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return found.groupBy("path").agg(F.first("status").alias("status"), F.regexp_replace(whole, r"^\s+|\s+$", "").alias("text"), F.coalesce(F.max("unit") + 1, F.lit(0)).alias("units"))
