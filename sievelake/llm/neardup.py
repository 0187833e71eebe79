"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sketches follow Dahlgaard, Knudsen and Thorup (2017): in round i every shingle is thrown into one of
``t`` bins and a bin keeps the smallest value of the earliest round that reached it; from round t on
all shingles go to bin i - t, so every coordinate is filled, and coordinates agree with probability
equal to the Jaccard similarity with the concentration of independent draws.  Equal bands make
candidates, each verified by the exact Jaccard similarity of the shingle sets (runs of ``width``
case-folded words; a shorter text is one shingle).  Groups are connected components.

Documents with equal shingle sets are collapsed first.  In a bucket every member is first compared
with one leader; members that this doesn't connect are then compared with each other, so that the
components are those of all candidate pairs, while a bucket of thousands of copies needs no square
of comparisons.

Scale: texts aren't shuffled for sketching; band keys are 16 bytes a row, and only documents in a
shared bucket are read again for verification.

Defined results
* null, empty and wordless texts have no shingles: they are in no group and always stay;
* null doc_id: last in the order; the earliest (doc_id, hash of the text) of a group stays;
* repeated rows (same doc_id and text) are a group and one row of them stays;
* an empty table gives no rows; other columns are passed through by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sievelake.operators.components import connected_components

from .common import bounded_batches, discard, fresh, id_or_last, null_id, sized_broadcast, written
from .kernels import buffers, mix64, row_bounds, shingles, slices, sorted_leaders, span_hashes, words

WIDTH = 3
BANDS = 40
ROWS = 4
THRESHOLD = 0.5
SLICE = 1 << 20

_EMPTY = np.uint64(2**64 - 1)
_ROUND = np.uint64(0xA24BAED4963EE407)


def document_shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each text, sorted by row."""
    start, end, row = words(data, off)
    hashes = span_hashes(data, start, end)
    found, at, _ = shingles(hashes, row, width)
    bounds = row_bounds(row, len(off))
    count = np.diff(bounds[: len(off)])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        with np.errstate(over="ignore"):
            whole = [mix64(np.array([sum(int(h) * (2 * k + 3) for k, h in enumerate(hashes[bounds[r] : bounds[r + 1]])) & (2**64 - 1)], np.uint64))[0] for r in short]
        found, at = np.r_[found, np.array(whole, np.uint64)], np.r_[at, short]
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
    return found[new], at[new]


def sketch(hashes: np.ndarray, row: np.ndarray, n: int, t: int) -> np.ndarray:
    """The fast similarity sketch of each of n rows; rows without shingles keep empty coordinates."""
    out = np.full(n * t, _EMPTY, np.uint64)
    base = row * t
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(hashes):
                break
            x = mix64(hashes + np.uint64(i + 1) * _ROUND)
            at = ((x >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
            np.minimum.at(out, base + at, np.uint64(i) << np.uint64(40) | x & np.uint64((1 << 40) - 1))
            open_ = (out.reshape(n, t) == _EMPTY).any(1)
            if i < 8 or i % 8 == 0 or i >= t:
                more = open_[base // t]
                hashes, base = hashes[more], base[more]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = sketches.reshape(len(sketches), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ROUND, cut.shape[:2])
        for k in range(rows):
            key = mix64(key ^ cut[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
    return key


def _sketch_rows(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for a, b in slices(off, SLICE):
                h, row = document_shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], width)
                n = b - a
                size = np.bincount(row, minlength=n)
                total = np.zeros(len(h) + 1, np.uint64)
                with np.errstate(over="ignore"):
                    np.cumsum(mix64(h), out=total[1:])
                    edge = np.r_[0, np.cumsum(size)]
                    fp = mix64(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64))
                keys = band_keys(sketch(h, row, n, bands * rows), bands, rows)
                some = np.flatnonzero(size)
                flat = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * bands, np.ascontiguousarray(keys[some]).view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + some]), pa.array(th[a + some]), pa.array(fp[some].view(np.int64)), pa.array(size[some].astype(np.int32)), flat], ["id", "th", "node", "size", "bands"])

    return run


@F.arrow_udf(DoubleType())
def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
    i, j = (np.r_[0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))] for c in (a, b))
    out = np.zeros(len(a))
    for k in range(len(a)):
        p, q = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
        if len(p) > len(q):
            p, q = q, p
        both = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))
        out[k] = both / (len(p) + len(q) - both)
    return pa.array(out)


def _set_rows(width: int):
    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            node = batch.column("node")
            for a, b in slices(off, SLICE):
                h, row = document_shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], width)
                h = h.view(np.int64)[np.lexsort((h.view(np.int64), row))]
                sets = pa.ListArray.from_arrays(row_bounds(row, b - a).astype(np.int32), h)
                yield pa.RecordBatch.from_arrays([node.slice(a, b - a), sets], ["node", "shingles"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(id_or_last().alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).where("text is not null")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.where(_jaccard("sa", "sb") >= threshold).select("a", "b")


def near_duplicate_members(docs: DataFrame, *, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, first) for every row of ``docs`` that is in a group of two rows or more; a written table."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    kind = "id long, th long, node long, size int, bands array<long>"
    sketched = written(keyed.mapInArrow(_sketch_rows(width, bands, rows), kind), "sketches")
    distinct = sketched.groupBy("node").agg(F.min(F.struct("id", "th", "bands")).alias("m")).select("node", "m.*")
    key = distinct.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    buckets = written(key.mapInArrow(sorted_leaders, "key long, node long, leader long"), "buckets")
    wanted = buckets.select("node").distinct().join(sketched.select("node", "id", "th"), "node").groupBy("node").agg(F.min(F.struct("id", "th")).alias("m"))
    wanted = written(wanted.select("node", "m.*"), "candidates")
    sets = written(keyed.join(sized_broadcast(wanted, 60), ["id", "th"]).mapInArrow(_set_rows(width), "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    tried = written(buckets.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs")
    edges = written(_verified(tried, sets, threshold), "star-edges")
    label = written(connected_components(edges), "labels")
    labelled = buckets.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    split = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    open_ = written(labelled.join(split, "key"), "open-buckets")
    x, y = open_.alias("x"), open_.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = written(_verified(cross.join(tried, ["a", "b"], "left_anti"), sets, threshold), "cross-edges")
    discard(wanted, sets, tried, buckets, open_)
    if more.count():
        first, label = label, written(connected_components(edges.union(more)), "labels")
        discard(first)
    member = sketched.select("id", "th", "node").join(label, "node", "left").select("id", "th", F.coalesce("component", "node").alias("c"))
    groups = member.groupBy("c").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = written(member.join(groups.select("c", "first"), "c").select("id", "th", "first"), "near-members")
    discard(sketched, edges, more, label)
    return found


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, group_id, kept) of the documents in a group of two or more; group_id is the doc_id that stays."""
    found = near_duplicate_members(docs, **options)
    return found.select(null_id(F.col("id")).alias("doc_id"), null_id(F.col("first.id")).alias("group_id"), (F.struct("id", "th") == F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, with all their columns."""
    found = near_duplicate_members(docs, **options)
    i, t = fresh(docs, "id", "th")
    names = lambda df: df.select(F.col("id").alias(i), F.col("th").alias(t))
    losers = written(names(found.where(F.struct("id", "th") != F.col("first"))).distinct(), "losers")
    twice = written(names(found.where(F.struct("id", "th") == F.col("first"))).groupBy(i, t).count().where("count > 1").drop("count"), "repeated")
    kept = docs.withColumns({i: id_or_last(), t: F.xxhash64(F.col("text").cast("string"))}).join(sized_broadcast(losers, 40), [i, t], "left_anti")
    if twice.count():
        rest = kept.join(twice, [i, t], "left_anti")
        kept = rest.union(kept.join(twice, [i, t], "left_semi").dropDuplicates([i, t]).select(*rest.columns))
    return kept.select(*docs.columns)
