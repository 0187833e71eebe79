"""A Spark data source that lists a directory tree and hashes its files on the executors.

Unlike Spark's binary files it lists dotfiles and empty files, doesn't enter linked directories and
doesn't hold a file's content in memory.  The folder must be mounted wherever executors run.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievelake.functions.hashing import sha256_file

SCHEMA = "path string, ext string, size_bytes bigint, is_symlink boolean, sha256 string, status string"
FILES_IN_PARTITION = 512


def list_files(root: Path) -> list[Path]:
    """Files below ``root`` in the order of their path components; links to nothing aren't files."""
    return sorted(p for p in root.rglob("*") if p.is_file())


def extension(path: Path) -> str:
    return path.suffix.lower().lstrip(".")


class _Files(InputPartition):
    def __init__(self, names: list[bytes]):
        self.names = names  # as the file system has them; they needn't be UTF-8


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = Path(options["path"])
        self.chunk = int(options.get("filesinpartition", FILES_IN_PARTITION))
        self.hashed = options.get("hash", "true") == "true"
        self.follow = options.get("followsymlinks", "true") == "true"
        self.largest = int(options["maxfilesize"]) if "maxfilesize" in options else None
        self.extensions = set(json.loads(options["extensions"])) if "extensions" in options else None

    def partitions(self) -> list[InputPartition]:
        names = [os.fsencode(p.relative_to(self.root)) for p in list_files(self.root)]
        return [_Files(names[i : i + self.chunk]) for i in range(0, len(names), self.chunk)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            path = self.root / os.fsdecode(name)
            link, ext = path.is_symlink(), extension(path)
            size = digest = None
            if link and not self.follow:
                status = "symlink"
            elif self.extensions is not None and ext not in self.extensions:
                status = "extension"
            else:
                try:
                    size = path.stat().st_size
                    status = "oversized" if self.largest is not None and size > self.largest else "ok"
                    if status == "ok" and self.hashed:
                        digest = sha256_file(path)
                except OSError:
                    status = "error"
            yield name.decode("utf-8", "replace"), ext.encode("utf-8", "replace").decode(), size, link, digest, status


class FileTree(DataSource):
    """Options: path; extensions (a JSON list, which may be empty), maxFileSize, followSymlinks, hash, filesInPartition."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str | Path, *, files_in_partition: int = FILES_IN_PARTITION, hashed: bool = True, follow_symlinks: bool = True, max_file_size: int | None = None, extensions: set[str] | None = None):
    """The files below ``root`` as a table, with why each is skipped."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format("file_tree").option("path", str(root)).option("followSymlinks", str(follow_symlinks).lower()).option("hash", str(hashed).lower()).option("filesInPartition", files_in_partition)
    if extensions is not None:
        reader = reader.option("extensions", json.dumps(sorted(extensions)))
    if max_file_size is not None:
        reader = reader.option("maxFileSize", max_file_size)
    return reader.load()
