"""What the operators of this subpackage share: shared folders, staging, files."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts are long, so a batch is kept to a few MB.
BATCH_ROWS = 256


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as a URI.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset (local
    mode, tests) a folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared")


_RUN = f"corpusloom-{uuid.uuid4().hex}"
_roots: set[str] = set()


def _end_of_run() -> None:
    for root in _roots:
        try:
            drop_dir(f"{root}/{_RUN}")
        except OSError:
            pass


atexit.register(_end_of_run)


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses.

    All paths of a driver are in one folder, which is deleted when the driver's Python ends;
    results that are to stay are written elsewhere by then.
    """
    root = shared_root(spark)
    _roots.add(root)
    return f"{root}/{_RUN}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The files are whole once the write has committed, so a lost executor costs
    later steps nothing.
    """
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`staged`, with the path, for :func:`drop_dir`."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(uri: str):
    """A pyarrow file system and the path in it; works for local and remote stores."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def drop_dir(uri: str) -> None:
    """Delete a staging folder that no later step reads."""
    store, path = file_system(uri)
    store.delete_dir(path)


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with this share of the rows or more is hot: there are at most so many of them.
HOT_KEYS = 1000


def left_join_hot(rows: DataFrame, known: DataFrame, key: str, total: int, spread: Column, joins: Column | None = None) -> DataFrame:
    """``rows`` with the columns of ``known``, which has one row for each value of ``key``, with
    ``n``, how many of ``rows`` have it; columns of keys that ``known`` lacks are null.

    ``known`` is broadcast for keys that a thousandth of the ``total`` rows or more have, a thousand
    keys at most; for the others it is shuffled. Rows of hot keys, and those for which ``joins``
    does not hold, are dealt out by ``spread``, which differs between rows, so no task gets them all.
    """
    wanted = [c for c in known.columns if c not in (key, "n")]
    hot_now = F.col("n") * HOT_KEYS >= F.lit(total)
    hot = known.where(hot_now).select(F.col(key).alias("_hot_key"), F.struct(*wanted).alias("_hot"))
    rest = known.where(~hot_now).select(F.concat(F.lit("k"), F.hex(key) if known.schema[key].dataType.simpleString() == "binary" else F.col(key).cast("string")).alias("_key"), F.struct(*wanted).alias("_rest"))
    joins = F.lit(True) if joins is None else joins
    own = F.hex(key) if rows.schema[key].dataType.simpleString() == "binary" else F.col(key).cast("string")
    met = rows.join(F.broadcast(hot), (F.col(key) == F.col("_hot_key")) & joins, "left")
    stay = F.col("_hot").isNotNull() | F.col(key).isNull() | ~joins
    met = met.withColumn("_key", F.when(stay, F.concat(F.lit("s"), spread.cast("string"))).otherwise(F.concat(F.lit("k"), own)))
    met = met.join(rest, "_key", "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_rest.{c}")).alias(c) for c in wanted])
