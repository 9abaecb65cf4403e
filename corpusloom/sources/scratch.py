"""Folders for what a query writes and reads back."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"corpusloom-files-{uuid.uuid4().hex}"
_roots: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in ``spark.checkpoint.dir``, which all executors share; only in
    local mode, where that is unset, on this machine. It is deleted when the driver's Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared")
    root = root.rstrip("/")
    _roots.add(root)
    return f"{root}/{_RUN}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor costs later steps nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _end_of_run() -> None:
    for root in _roots:
        store, at = file_system(f"{root}/{_RUN}")
        try:
            store.delete_dir(at)
        except OSError:
            pass


atexit.register(_end_of_run)
