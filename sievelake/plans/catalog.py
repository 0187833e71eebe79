"""Registered queries over the reference's operators, with their SQL.

Each runs over its whole table, with the slots and the threshold of the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.hashing import content_sha256
from sievelake.functions.shingles import BLANK_SLOT, PRIME, SPACE, distinct_ngrams, hash_family, ngram_counts, token_hash_column
from sievelake.operators import inventory, minhash, reports
from sievelake.storage import spread

SLOTS, SIMILAR = minhash.NUM_PERM, minhash.THRESHOLD
EARLIER = {"extensions": ("de", "en"), "max_file_size": 4000}
LATER = {"max_file_size": 3000}


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return inventory.with_status(inventory.documents_as_files(_docs(spark, sf_dir)), **filters)


def _listed(files: DataFrame) -> DataFrame:
    return files.where(F.col("status") == inventory.KEPT).select("path", "ext", "size_bytes")


def near_dup_groups(spark: SparkSession, sf_dir: str, num_perm: int = minhash.NUM_PERM, threshold: float = minhash.THRESHOLD) -> DataFrame:
    return minhash.near_duplicate_groups(spread(_docs(spark, sf_dir)), "doc_id", "text", num_perm=num_perm, threshold=threshold)


def _groups(files: DataFrame) -> DataFrame:
    return inventory.duplicate_groups(files)


def _exact_dup_groups(s: SparkSession, d: str) -> DataFrame:
    return _groups(_files(s, d)).select("sha256", "size", F.array_join("members", "|").alias("members"))


def _scan_summary(s: SparkSession, d: str) -> DataFrame:
    return inventory.scan_counters(_files(s, d, **EARLIER))


def _report(s: SparkSession, d: str) -> DataFrame:
    files = _files(s, d)
    return reports.report(inventory.scan_counters(files), _groups(files))


def _diff_groups(s: SparkSession, d: str) -> DataFrame:
    return reports.diff_groups(_groups(_files(s, d, **EARLIER)), _groups(_files(s, d, **LATER))).select("status", "group_key")


def _diff_counts(s: SparkSession, d: str) -> DataFrame:
    return reports.diff_counts(inventory.scan_counters(_files(s, d, **EARLIER)), inventory.scan_counters(_files(s, d, **LATER)))


def _ngrams(s: SparkSession, d: str) -> DataFrame:
    return ngram_counts(spread(_docs(s, d)), "doc_id", "text")


def _token_hash(s: SparkSession, d: str) -> DataFrame:
    grams = distinct_ngrams(spread(_docs(s, d)), "text")
    return grams.select("gram", token_hash_column(F.col("gram")).alias("h"))


def _signature(s: SparkSession, d: str) -> DataFrame:
    return minhash.signature_rows(spread(_docs(s, d)), "doc_id", "text", num_perm=SLOTS)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return minhash.similar_pairs(spread(_docs(s, d)), "doc_id", "doc_id", "text", num_perm=SLOTS, threshold=SIMILAR)


def _page_copies(s: SparkSession, d: str) -> DataFrame:
    pages = _docs(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), content_sha256(F.col("html")).alias("sha256"))
    return inventory.duplicate_members(pages)


def _turn_copies(s: SparkSession, d: str) -> DataFrame:
    turns = _docs(s, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), content_sha256(F.col("text")).alias("sha256"))
    return inventory.duplicate_members(turns)


QUERIES = {
    "file_inventory": lambda s, d: _listed(_files(s, d)),
    "ext_filter": lambda s, d: _listed(_files(s, d, extensions=("fr", "es"))),
    "size_filter": lambda s, d: _listed(_files(s, d, max_file_size=2000)),
    "content_sha256": lambda s, d: _docs(s, d).select("doc_id", content_sha256(F.col("text")).alias("sha256")),
    "exact_dup_members": lambda s, d: inventory.duplicate_members(_files(s, d)),
    "exact_dup_groups": _exact_dup_groups,
    "page_copies": _page_copies,
    "turn_copies": _turn_copies,
    "scan_summary": _scan_summary,
    "report_summary": _report,
    "scan_diff_groups": _diff_groups,
    "scan_diff_counts": _diff_counts,
    "ngrams": _ngrams,
    "token_hash": _token_hash,
    "minhash_signature": _signature,
    "near_dup_pairs": _pairs,
    "near_dup_groups": lambda s, d: near_dup_groups(s, d, SLOTS, SIMILAR),
}

_FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS path, lower(lang) AS ext, strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha256 FROM documents)"
_EARLIER = "ext IN ('de', 'en') AND size_bytes <= 4000"
_LATER = "size_bytes <= 3000"
_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in SPACE) + "]"


def _group_sql(where: str = "true", key: str = "string_split(path, '/')") -> str:
    return f"SELECT sha256, count(*) AS size, string_agg(path, '|' ORDER BY {key}) AS members FROM files WHERE {where} GROUP BY sha256 HAVING count(*) > 1"


_GRAMS = f"""ready AS (SELECT doc_id, regexp_replace(lower(text), '^{_CLASS}+|{_CLASS}+$', '', 'g') AS t FROM documents),
    places AS (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM ready WHERE t <> ''),
    grams AS (SELECT doc_id, substr(t, i, 3) AS gram FROM places)"""
_HASH = "('0x' || substr(md5(gram), 7, 2) || substr(md5(gram), 5, 2) || substr(md5(gram), 3, 2) || substr(md5(gram), 1, 2))::BIGINT"
_FAMILY = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(zip(*hash_family(SLOTS))))
_SIGNED = f"""{_GRAMS},
    hashes AS (SELECT doc_id, {_HASH} AS h FROM (SELECT DISTINCT doc_id, gram FROM grams)),
    family(slot, a, b) AS (VALUES {_FAMILY}),
    made AS (SELECT doc_id, slot, min((a * h + b) % {PRIME})::BIGINT AS value FROM hashes, family GROUP BY doc_id, slot),
    signed AS (SELECT doc_id, slot, value FROM made UNION ALL SELECT doc_id, slot, {BLANK_SLOT} FROM documents, family WHERE doc_id NOT IN (SELECT doc_id FROM made))"""
_PAIRS = f"""{_SIGNED},
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS matches FROM signed x JOIN signed y ON x.slot = y.slot AND x.value = y.value AND x.doc_id < y.doc_id
              GROUP BY ALL HAVING count(*) / {SLOTS} >= {SIMILAR})"""

SQL = {
    "file_inventory": f"WITH {_FILES} SELECT path, ext, size_bytes FROM files",
    "ext_filter": f"WITH {_FILES} SELECT path, ext, size_bytes FROM files WHERE ext IN ('fr', 'es')",
    "size_filter": f"WITH {_FILES} SELECT path, ext, size_bytes FROM files WHERE size_bytes <= 2000",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "exact_dup_members": f"WITH {_FILES} SELECT sha256, path FROM files QUALIFY count(*) OVER (PARTITION BY sha256) > 1",
    "exact_dup_groups": f"WITH {_FILES} {_group_sql()}",
    "page_copies": "SELECT sha256(html) AS sha256, page_id::VARCHAR AS path FROM pages QUALIFY count(*) OVER (PARTITION BY sha256(html)) > 1",
    "turn_copies": "SELECT sha256(text) AS sha256, conv_id || '/' || turn AS path FROM conversations QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1",
    "scan_summary": f"""WITH {_FILES}, passed AS (SELECT * FROM files WHERE ext IN ('de', 'en'))
        SELECT count(*) FILTER (size_bytes <= 4000) AS file_count, coalesce(sum(size_bytes) FILTER (size_bytes <= 4000), 0)::BIGINT AS total_bytes, 0::BIGINT AS skipped_count,
               count(*) FILTER (size_bytes > 4000) AS skipped_oversized, 0::BIGINT AS skipped_symlinks FROM passed""",
    "report_summary": f"""WITH {_FILES}, groups AS ({_group_sql()}), g AS (SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS d, coalesce(max(size), 0) AS m FROM groups),
        f AS (SELECT count(*) AS n, sum(size_bytes)::BIGINT AS b FROM files)
        SELECT f.n AS file_count, f.b AS total_bytes, g.n AS duplicate_group_count, g.d AS duplicate_file_count, f.n - g.d AS unique_file_count,
               f.b::DOUBLE / f.n AS avg_file_size, g.m AS largest_group_size FROM f, g""",
    "scan_diff_groups": f"""WITH {_FILES}, o AS (SELECT DISTINCT members AS k FROM ({_group_sql(_EARLIER, "path")})), n AS (SELECT DISTINCT members AS k FROM ({_group_sql(_LATER, "path")}))
        SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'unchanged' END AS status, coalesce(o.k, n.k) AS group_key FROM o FULL JOIN n ON o.k = n.k""",
    "scan_diff_counts": f"""WITH {_FILES}, c AS (SELECT count(*) FILTER ({_EARLIER}) AS o, count(*) FILTER ({_LATER}) AS n FROM files)
        SELECT n - o AS added_files, greatest(0, o - n) AS removed_files FROM c""",
    "ngrams": f"WITH {_GRAMS} SELECT doc_id, gram, count(*) AS cnt FROM grams GROUP BY ALL",
    "token_hash": f"WITH {_GRAMS} SELECT gram, {_HASH} AS h FROM (SELECT DISTINCT gram FROM grams)",
    "minhash_signature": f"WITH {_SIGNED} SELECT doc_id, slot, value FROM signed",
    "near_dup_pairs": f"WITH {_PAIRS} SELECT a, b, matches, round_even(matches / {SLOTS}, 4) AS similarity FROM pairs",
    "near_dup_groups": f"""WITH RECURSIVE {_PAIRS},
        edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT a AS member, a AS low FROM edges UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.member),
        least AS (SELECT member, min(low) AS group_min FROM reach GROUP BY member)
        SELECT group_min, member, count(*) OVER (PARTITION BY group_min) AS group_size FROM least""",
}
