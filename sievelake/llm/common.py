"""Helpers that the corpus operators share: tables, cut lineage, names that can't clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.storage import discard, shared_dir, sized_broadcast, spread, written  # noqa: F401

#: Stands for a missing doc_id inside an operator, so that such rows sort last and join like any other.
#: An id that isn't a whole number counts as missing, and so does this one.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_or_last(column: str = "doc_id") -> Column:
    return F.coalesce(whole_id(column), F.lit(NO_ID))


def whole_id(column: str = "doc_id") -> Column:
    """The id as a number; null where it isn't one."""
    return F.col(column).try_cast("bigint")


def null_id(column: Column) -> Column:
    """Undo :func:`id_or_last`."""
    return F.when(column == F.lit(NO_ID), F.lit(None).cast("bigint")).otherwise(column)


def full_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of a batch that is handed to Python; it bounds the memory of a worker, not what is processed.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit for Arrow batches, which counts rows by default, to BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
