"""Inventories of files, and tables seen as such: skips, counters, exact duplicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.hashing import content_sha256

KEPT, LINK, EXTENSION, OVERSIZED, ERROR = "ok", "symlink", "extension", "oversized", "error"


def path_parts(path: Column) -> Column:
    """What paths are ordered by: their components, so that a/b comes before a.txt."""
    return F.split(path, "/")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """(path, ext, size_bytes, is_symlink, sha256) of a table of documents: source/doc_id.lang."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return docs.select(path.alias("path"), F.lower("lang").alias("ext"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.lit(False).alias("is_symlink"), content_sha256(F.col("text")).alias("sha256"))


def skip_status(*, follow_symlinks: bool = True, max_file_size: int | None = None, extensions: Iterable[str] | None = None) -> Column:
    """Why a file is skipped.  A link is tested first, then the extension, then the size."""
    if max_file_size is not None and 0 > max_file_size:
        raise ValueError(f"the size limit is {max_file_size}; it can't be negative")
    status = F.lit(None).cast("string")
    if not follow_symlinks:
        status = F.when(F.col("is_symlink"), LINK)
    if extensions is not None:
        listed = sorted(extensions)
        other = ~F.col("ext").isin(listed) if listed else F.lit(True)
        status = F.coalesce(status, F.when(other, EXTENSION))
    if max_file_size is not None:
        status = F.coalesce(status, F.when(F.col("size_bytes") > max_file_size, OVERSIZED))
    unreadable = F.when(F.col("sha256").isNull(), ERROR)
    return F.coalesce(status, unreadable, F.lit(KEPT))


def with_status(files: DataFrame, **filters) -> DataFrame:
    return files.withColumn("status", skip_status(**filters))


def scan_counters(files: DataFrame) -> DataFrame:
    """One row of counters for files with a status; other extensions count nowhere."""
    tally = lambda status: F.count_if(F.col("status") == status).cast("bigint")
    return files.agg(
        tally(KEPT).alias("file_count"),
        F.coalesce(F.sum(F.when(F.col("status") == KEPT, F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("total_bytes"),
        tally(ERROR).alias("skipped_count"),
        tally(OVERSIZED).alias("skipped_oversized"),
        tally(LINK).alias("skipped_symlinks"),
    )


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(sha256, members, size) of contents that two kept files or more have; members in path order."""
    kept = files.where(F.col("status") == KEPT) if "status" in files.columns else files
    grouped = kept.groupBy("sha256").agg(F.collect_list(F.struct(path_parts(F.col("path")).alias("parts"), "path")).alias("found"))
    return grouped.where(F.size("found") > 1).select("sha256", F.array_sort("found")["path"].alias("members"), F.size("found").cast("bigint").alias("size"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """(sha256, path) of the same, without a list for a group: the form for groups of any size."""
    kept = files.where(F.col("status") == KEPT) if "status" in files.columns else files
    shared = kept.groupBy("sha256").agg(F.count("*").alias("__n")).where("__n > 1").select("sha256")
    return kept.join(shared, "sha256").select("sha256", "path")


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Largest first, then by first member as a string."""
    return groups.orderBy(F.desc("size"), F.col("members")[0])
