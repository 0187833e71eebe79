"""Scan results as JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("file_count", "total_bytes", "duplicates")
SCHEMA = (
    "file_count bigint, total_bytes bigint, duplicates array<array<string>>, skipped_count bigint, skipped_oversized bigint, skipped_symlinks bigint, "
    "metadata struct<tool_version string, scanned_root string, timestamp string, extensions_filter array<string>, max_file_size bigint>, signature string"
)


def load_scan_file(path: str | Path) -> dict:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    for key in REQUIRED:
        if key not in data:
            raise KeyError(f"the scan file has no {key}")
    return data


def read_scans(spark: SparkSession, *paths: str | Path) -> DataFrame:
    """One row for each scan file; files that lack a required key raise a KeyError."""
    for path in paths:
        load_scan_file(path)
    return spark.read.schema(SCHEMA).json([str(p) for p in paths], multiLine=True)


def to_text(data: dict) -> str:
    return json.dumps(data, indent=2, sort_keys=True)


def save_json(data: dict, path: str | Path) -> Path:
    path = Path(path).resolve()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(to_text(data), encoding="utf-8")
    return path
