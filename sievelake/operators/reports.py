"""Summaries of a scan and differences of two, as tables and for scan files."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(counters: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the counters of a scan and those of its duplicate groups (any table with a ``size``)."""
    size = F.col("size").cast("bigint")
    of_groups = groups.agg(F.count("*").alias("duplicate_group_count"), F.coalesce(F.sum(size), F.lit(0)).alias("duplicate_file_count"), F.coalesce(F.max(size), F.lit(0)).alias("largest_group_size"))
    both = counters.select("file_count", "total_bytes").crossJoin(of_groups)
    mean = F.when(F.col("file_count") > 0, F.col("total_bytes").cast("double") / F.col("file_count")).otherwise(F.lit(0.0))
    return both.select("file_count", "total_bytes", "duplicate_group_count", "duplicate_file_count", (F.col("file_count") - F.col("duplicate_file_count")).alias("unique_file_count"), mean.alias("avg_file_size"), "largest_group_size")


def _keyed(groups: DataFrame) -> DataFrame:
    """One row for each key; the key of a group is its sorted members, joined by a bar."""
    return groups.select(F.array_join(F.array_sort("members"), "|").alias("group_key"), "members").groupBy("group_key").agg(F.max("members").alias("members"))


def diff_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, group_key, members): added, removed and unchanged groups; unchanged ones as they were in ``old``."""
    a, b = _keyed(old).alias("a"), _keyed(new).alias("b")
    status = F.when(F.col("a.group_key").isNull(), "added").when(F.col("b.group_key").isNull(), "removed").otherwise("unchanged")
    joined = a.join(b, F.col("a.group_key") == F.col("b.group_key"), "full_outer")
    return joined.select(status.alias("status"), F.coalesce("a.group_key", "b.group_key").alias("group_key"), F.coalesce("a.members", "b.members").alias("members"))


def diff_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added_files, removed_files) from two rows of counters; files added may be negative."""
    a, b = old.select(F.col("file_count").alias("o")), new.select(F.col("file_count").alias("n"))
    return a.crossJoin(b).select((F.col("n") - F.col("o")).alias("added_files"), F.greatest(F.lit(0).cast("bigint"), F.col("o") - F.col("n")).alias("removed_files"))


@dataclass(frozen=True)
class ReportSummary:
    file_count: int
    total_bytes: int
    duplicate_group_count: int
    duplicate_file_count: int
    unique_file_count: int
    avg_file_size: float
    largest_group_size: int

    def to_json(self) -> dict:
        return asdict(self) | {"avg_file_size": round(self.avg_file_size, 2)}


@dataclass(frozen=True)
class DiffResult:
    added_files: int
    removed_files: int
    added_duplicate_groups: list[list[str]]
    removed_duplicate_groups: list[list[str]]
    unchanged_duplicate_groups: list[list[str]]

    def to_json(self) -> dict:
        return asdict(self)


def generate_report(scan_data: dict) -> ReportSummary:
    """The report of a scan file that was read into a dictionary; a missing key is a KeyError."""
    files, total, sizes = scan_data["file_count"], scan_data["total_bytes"], [len(g) for g in scan_data["duplicates"]]
    return ReportSummary(
        avg_file_size=total / files if files > 0 else 0.0, duplicate_file_count=sum(sizes), duplicate_group_count=len(sizes),
        file_count=files, largest_group_size=max(sizes, default=0), total_bytes=total, unique_file_count=files - sum(sizes),
    )


def diff_scans(old_data: dict, new_data: dict) -> DiffResult:
    """The difference of two scan files that were read into dictionaries."""
    old, new = ({"|".join(sorted(g)): g for g in scan["duplicates"]} for scan in (old_data, new_data))
    pick = lambda groups, keys: [groups[k] for k in sorted(keys)]
    before, after = (scan["file_count"] for scan in (old_data, new_data))
    return DiffResult(after - before, max(0, before - after), pick(new, new.keys() - old.keys()), pick(old, old.keys() - new.keys()), pick(old, old.keys() & new.keys()))
