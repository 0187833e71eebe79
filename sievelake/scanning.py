"""Scans of a directory for duplicate files."""

from __future__ import annotations

import logging
import sys
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sievelake.operators import inventory
from sievelake.sources.file_tree import list_files, read_tree
from sievelake.storage import written
from sievelake.version import __version__

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ScanMetadata:
    """Where a scan comes from; what is None stays out of the JSON."""

    tool_version: str
    scanned_root: str
    timestamp: str
    extensions_filter: tuple[str, ...] | None = None
    max_file_size: int | None = None

    def to_json(self) -> dict:
        known = {name: value for name, value in vars(self).items() if value is not None}
        return {name: list(value) if isinstance(value, tuple) else value for name, value in known.items()}


@dataclass(frozen=True)
class ScanResult:
    file_count: int
    total_bytes: int
    duplicates: list[list[str]]
    skipped_count: int = 0
    skipped_oversized: int = 0
    skipped_symlinks: int = 0
    metadata: ScanMetadata | None = None

    def to_json(self) -> dict:
        names = ("file_count", "total_bytes", "skipped_count", "skipped_oversized", "skipped_symlinks")
        out = {n: getattr(self, n) for n in names} | {"duplicates": list(map(list, self.duplicates))}
        return out if self.metadata is None else out | {"metadata": self.metadata.to_json()}


def progress_bar(done: int, total: int, width: int = 30, stream=None) -> None:
    """A bar on one line of stderr; nothing if there is nothing to do."""
    if total:
        full = width * done // total
        end = "\n" if done >= total else ""
        print(f"\r[{'#' * full}{'-' * (width - full)}] {100 * done // total}% ({done}/{total})", end=end, file=stream or sys.stderr, flush=True)


def checked_root(root: str | Path) -> Path:
    folder = Path(root).resolve()
    if folder.is_dir():
        return folder
    raise NotADirectoryError(f"{folder} is no folder") if folder.exists() else FileNotFoundError(f"there is no folder {folder} to scan")


def _watched(spark: SparkSession, work, total: int):
    """The result of ``work``, a function that runs Spark jobs; a bar shows meanwhile which share of their tasks has ended."""
    group, done = f"scan-{uuid.uuid4().hex}", {}

    def run():
        spark.sparkContext.setJobGroup(group, "scan")
        try:
            done["result"] = work()
        except BaseException as error:
            done["error"] = error

    worker, tracker, shown = InheritableThread(target=run, session=spark), spark.sparkContext.statusTracker(), -1
    worker.start()
    while worker.is_alive():
        worker.join(0.1)
        stages = [info for job in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(job)) for s in j.stageIds if (info := tracker.getStageInfo(s))]
        tasks = sum(s.numTasks for s in stages)
        now = min(total - 1, total * sum(s.numCompletedTasks for s in stages) // tasks) if tasks else 0
        if now > shown:
            progress_bar(now, total)
            shown = now
    if "error" in done:
        raise done["error"]
    progress_bar(total, total)
    return done["result"]


def _tell_skips(files: DataFrame, counters: Row) -> None:
    """Log lines about what was not read."""
    shown = {inventory.ERROR: logging.WARNING, inventory.OVERSIZED: logging.DEBUG, inventory.LINK: logging.DEBUG}
    wanted = [status for status, level in shown.items() if log.isEnabledFor(level)]
    says = {inventory.ERROR: "can't be read, so it is skipped", inventory.OVERSIZED: "is above the size limit", inventory.LINK: "is a link"}
    if any(counters[c] for c in ("skipped_count", "skipped_oversized", "skipped_symlinks")):
        for row in files.where(F.col("status").isin(wanted)).select("path", "status", "size_bytes").toLocalIterator():
            size = f" ({row.size_bytes} bytes)" if row.size_bytes is not None else ""
            log.log(shown[row.status], "%s%s %s", row.path, size, says[row.status])
    for counter, what in (("skipped_count", "unreadable files"), ("skipped_oversized", "files above the size limit"), ("skipped_symlinks", "links")):
        if counters[counter]:
            log.info("%d %s were skipped", counters[counter], what)


def scan(*, spark: SparkSession | None = None, progress: bool = False, follow_symlinks: bool = True, max_file_size: int | None = None, extensions: set[str] | None = None, root: str | Path) -> ScanResult:
    """List and hash the files below ``root``; count skips; group equal contents."""
    root = checked_root(root)
    if max_file_size is not None and 0 > max_file_size:
        raise ValueError(f"the size limit is {max_file_size}; it can't be negative")
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        tree = read_tree(spark, root, extensions=extensions, max_file_size=max_file_size, follow_symlinks=follow_symlinks)
        read = lambda: written(tree, "scan")  # noqa: E731  # each file is read once
        files = _watched(spark, read, total) if progress and (total := len(list_files(root))) else read()
    except (PySparkException, PermissionError) as error:
        if isinstance(error, PermissionError) or "PermissionError" in str(error):
            log.error("%s can't be listed: %s", root, error)
            raise PermissionError(f"{root} can't be listed") from error
        raise
    counters = inventory.scan_counters(files).first()
    _tell_skips(files, counters)
    groups = inventory.ordered_groups(inventory.duplicate_groups(files)).select("members").collect()
    log.debug("%d groups of equal files", len(groups))
    listed = tuple(sorted(extensions)) if extensions else None
    metadata = ScanMetadata(__version__, str(root), datetime.now(timezone.utc).isoformat(), listed, max_file_size)
    return ScanResult(**counters.asDict(), duplicates=[list(g.members) for g in groups], metadata=metadata)
