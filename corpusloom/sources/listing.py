"""Files below a folder, listed and opened by tasks.

Spark's own readers of files keep every name, size and place on the driver, so its memory grows
with the number of files. Here a folder's entries are rows from the start: a task lists a folder
and writes what it finds, its folders are dealt out to the next tasks, and files are opened where
they are read, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import lru_cache, reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import file_system, kept

#: Entries of one Arrow batch while a folder is listed.
LIST_ROWS = 4096
#: Bytes of whole files in one Arrow batch, and the file that goes beyond them.
BATCH_BYTES = 4 << 20
#: Files that a task opens, at most on average.
FILES_A_TASK = 2048

# Endings of packed files, signs that an address spells as they are.
_PACKED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
_PLAIN = "/@:,;$&+=_-!.~'()*"


def hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(path: str) -> Iterator[tuple[str, int, bool]]:
    """Name, length and whether it is a folder, of each entry of a folder; a local one's are never held at once."""
    import os

    from pyarrow import fs

    store, at = file_system(quote(path, safe=":/"))
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(at) as there:
            for e in there:
                folder = e.is_dir()
                yield e.name, 0 if folder else e.stat().st_size, folder
    else:
        for e in store.get_file_info(fs.FileSelector(at)):
            folder = e.type == fs.FileType.Directory
            yield e.base_name, 0 if folder else e.size, folder


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of every file below a folder whose name matches (``*``, ``?`` and ``[...]``), without
    hidden ones. Paths are spelled as Spark's reader of binary files spells them."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, kinds = ["path", "length", "folder"], [pa.string(), pa.int64(), pa.bool_()]
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)
            rows.clear()
            return batch

        for b in batches:
            for parent in b["path"].to_pylist():
                for name, length, is_folder in _entries(parent):
                    if not hidden(name) and (is_folder or fnmatchcase(name, pattern)):
                        rows.append((f"{parent}/{name}", length, is_folder))
                    if len(rows) >= LIST_ROWS:
                        yield told()
        if rows:
            yield told()

    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    folders, levels = spark.range(1).select(F.lit(root).alias("path")).coalesce(1), []
    while True:
        level = kept(folders.mapInArrow(entries, "path string, length long, folder boolean"), "listing")
        levels.append(level.where("NOT folder").select("path", "length"))
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), levels)
        folders = folders.repartition("path")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path of every file below a folder, dealt out for reading by :func:`bodies`. Empty files are left out, as by Spark's readers."""
    found = listed(spark, folder, pattern).where("length > 0")
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.greatest("length", F.lit(max(1, most // FILES_A_TASK)))), F.lit(0))).first()
    parts = max(1, -(-size // most), min(n, 2 * spark.sparkContext.defaultParallelism))
    return found.select("path").repartition(parts, "path")


@lru_cache(64)
def _store(folder: str):
    return file_system(quote(folder, safe=":/"))


def body(path: str, most: int | None = None, compression: str | None = None) -> bytes:
    """The bytes of a file, those beyond ``most`` + 1 left unread: enough to tell that it is too large."""
    folder, _, name = path.rpartition("/")
    store, at = _store(folder)
    with store.open_input_stream(f"{at}/{name}", compression=compression) as f:
        return f.read() if most is None else f.read(most + 1)


def _address(path: str) -> str:
    """The path as ``_metadata.file_path`` has it: signs of ASCII that aren't for addresses are escaped."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:" + "".join(c if c > "\x7f" else quote(c, safe=_PLAIN) for c in rest)


def bodies(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes | None]]:
    """Path and bytes of each row, opened one at a time where the rows have no content of their own."""
    for b in batches:
        if "content" in b.schema.names:
            yield from ((p.as_py(), c.as_py()) for p, c in zip(b["path"], b["content"], strict=True))
        else:
            yield from ((p, body(p, most)) for p in b["path"].to_pylist())


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each path, as a column of file metadata spells it, and what is in the file, unpacked where its name says that it is packed."""
    rows: list[tuple[str, bytes]] = []

    def told() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])
        rows.clear()
        return batch

    size = 0
    for b in batches:
        for path in b["path"].to_pylist():
            rows.append((_address(path), body(path, compression=_PACKED.get(path.rpartition(".")[2]))))
            size += len(rows[-1][1])
            if size >= BATCH_BYTES or len(rows) >= LIST_ROWS:
                yield told()
                size = 0
    if rows:
        yield told()


def to_read(df: DataFrame) -> DataFrame:
    """The columns of files that :func:`bodies` takes."""
    return df.select(*[c for c in ("path", "content") if c in df.columns])
