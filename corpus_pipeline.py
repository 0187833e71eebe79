"""The corpus pipeline: quality, repeated lines, near duplicates, mixing, packing, each over all its predecessor kept.

Defined results of all stages: an empty table gives an empty table; texts may be of any length; columns
besides those of ``documents``, of whatever name, are passed through by all stages but the last, which
has columns of its own; null ids come last in any order and stay null.  What a stage does with null and
empty texts, ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import lines, mixing, neardup, packing, quality
from sievelake.llm.common import discard, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, and with them null, empty and blank texts.

    Equal texts have equal scores, so repeated rows stay or go together.
    """
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for edits within the bound, go; so do documents without any other line.

    Earlier is by (doc_id, hash of the text, number of the line), so repeated rows keep the same lines.
    """
    return lines.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each group of near duplicates, by (doc_id, hash of the text), stays.

    Repeated rows are a group; texts without words are in none and stay.
    """
    return neardup.drop_near_duplicates(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as often as their rate says; no rate is below 1, so no document goes.

    Null and empty texts have no tokens and stay as they are; repeated rows are mixed each by itself.
    """
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"), min_rate=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, sequence, offset): where the words of each document lie in the sequences.

    Texts without words have no row; repeated rows are packed each by itself.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL can't express the fits, the sketches or the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "written_to"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
