"""Content hashes of files and columns."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

READ_BYTES = 1 << 20


def sha256_file(path: str | Path) -> str:
    """Hex digest of a file's bytes, read in pieces of a mebibyte."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while piece := file.read(READ_BYTES):
            digest.update(piece)
    return digest.hexdigest()


def content_sha256(content: Column) -> Column:
    """Hex digest of a string (as UTF-8) or binary column."""
    return F.sha2(content, 256)
