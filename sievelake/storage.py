"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_count = itertools.count()

#: Removes a query's shuffle files when it has ended, in place of some time after the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes up to which a table whose rows were counted is broadcast; beyond it, both sides are shuffled.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local master may leave it unset; a temporary folder is then made and set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sievelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


_open: dict[str, SparkSession] = {}


def _delete_rest() -> None:
    for path, spark in _open.items():
        try:
            _delete(spark, path)
        except Exception:  # its session has ended before
            if path.startswith("/"):
                shutil.rmtree(path, ignore_errors=True)
            elif path.startswith("file:"):
                shutil.rmtree(unquote(urlsplit(path).path), ignore_errors=True)


atexit.register(_delete_rest)


def written(df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, with a folder for each value of ``by``, and read it back.

    The table is deleted by :func:`discard`, or when the driver ends; the shuffle files that it was made of, at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievelake/{name}-{next(_count)}-{uuid.uuid4().hex}"
    _open[path] = spark
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`, once all that was made of them is itself written."""
    for table in tables:
        path = table.written_to
        _delete(_open.pop(path), path)


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt out to all cores if it is too small to have a partition for half of them."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() <= cores // 2 else table


def sized_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its counted rows take at most BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
