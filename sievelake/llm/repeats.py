"""Passages that repeat across documents, by suffix arrays of anchored contexts.

A window of ``min_words`` words is repeated if it occurs in two different documents.  The result
gives, for each document, the maximal ranges of words that repeated windows cover.

1. Each window elects an anchor, its leftmost smallest hash of ``gram`` words (winnowing), so equal
   windows elect equal anchors at equal places, and an anchor with its context of all windows that
   may elect it decides about these windows alone.  Anchors found in one document only are dropped.
2. Contexts are sharded by anchor, about ``shard_words`` words to a shard.  Equal contexts are represented by one, with the smallest and
   largest document that has it.  Each shard's contexts are concatenated and their suffixes ordered
   by external induced sorting (:mod:`.induced`), whose queues spill to the shared folder and carry
   common prefixes; neighbours that share ``min_words`` words are repeated if their documents differ.
   An anchor with more than ``shard_words`` words of different contexts would fill a task by itself; the
   windows of its contexts are hashed and grouped instead, with partial aggregates before the shuffle.
3. The ranges are brought back to all holders of a context and merged.

Only step 1 sees all words; it is one narrow pass that leaves about one anchor in 18 words.

A word is a maximal run of bytes other than ASCII white space; words are compared exactly, by 64-bit
hashes.

Defined results
* null, empty, blank and shorter texts have no windows and no rows;
* rows that share doc_id and text are one document, so repeated rows alone aren't a repeat; null
  doc_ids are one doc_id in this respect, and come out as null;
* a passage that repeats only within its document isn't reported;
* an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, id_or_last, null_id, shared_dir, sized_broadcast, written
from .induced import BLOCK_ITEMS, HELD_ITEMS, Scratch, common_runs, suffix_blocks
from .kernels import BYTE_MIX, SPACE_BYTE, _powers, buffers, mix64, row_bounds, shingles, slices, span_hashes, words

MIN_WORDS = 50
GRAM = 16
SHARD_WORDS = 1_000_000

_AT = np.uint64((1 << 28) - 1)


def _anchors(hashes: np.ndarray, row: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the anchors that the windows of each text elect."""
    h, at_row, first = shingles(hashes, row, gram)
    span = min_words - gram + 1
    if len(h) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
    low, width = key, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    chosen = np.unique(low[at_row[: len(low)] == at_row[span - 1 :]] & _AT).astype(np.int64)
    return h[chosen], first[chosen]


def _anchor_rows(min_words: int, gram: int):
    before, after = min_words - gram, min_words

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            ids, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "d"))
            for a, b in slices(off):
                part = data[off[a] : off[b]]
                start, end, row = words(part, off[a : b + 1] - off[a], ~SPACE_BYTE)
                hashes = span_hashes(part, start, end, BYTE_MIX)
                fp, at = _anchors(hashes, row, min_words, gram)
                edge = row_bounds(row, b - a)
                lo, hi = np.maximum(at - before, edge[row[at]]), np.minimum(at + after, edge[row[at] + 1])
                up, down = _powers(len(hashes) + 1)
                with np.errstate(over="ignore"):
                    total = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])]
                    ctx = mix64((total[hi] - total[lo]) * down[lo] + ((hi - lo) * 1000 + at - lo).astype(np.uint64))
                cols = [fp.view(np.int64), ctx.view(np.int64), docs[a + row[at]], ids[a + row[at]], (lo - edge[row[at]]).astype(np.int32), (hi - lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["fp", "ctx", "d", "id", "start", "size"])

    return run


def _context_words(batches):
    """Word hashes of the listed contexts of each document."""
    names = ["fp", "ctx", "lo", "hi", "crowded", "words"]
    for batch in batches:
        data, off = buffers(batch.column("text"))
        wanted = batch.column("wanted")
        for a, b in slices(off):
            part = data[off[a] : off[b]]
            start, end, row = words(part, off[a : b + 1] - off[a], ~SPACE_BYTE)
            hashes, edge = span_hashes(part, start, end, BYTE_MIX).view(np.int64), row_bounds(row, b - a)
            lists = wanted.slice(a, b - a)
            flat, of = lists.flatten(), np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
            bound = np.r_[0, np.cumsum(size)]
            at = np.arange(bound[-1]) - np.repeat(bound[:-1] - begin - edge[of], size)
            out = [*(flat.field(c) for c in names[:-1]), pa.ListArray.from_arrays(bound.astype(np.int32), hashes[at])]
            yield pa.RecordBatch.from_arrays(out, names)


def _shard_rows(min_words: int, shared: str, block_items: int, held_items: int):
    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()
        lists = table.column("words").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
        end = np.cumsum(size + 1)
        begin = end - size - 1
        text = np.zeros(end[-1], np.int64)  # 0 follows each context
        inside = np.ones(len(text), bool)
        inside[end - 1] = False
        text[inside] = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1] + 1
        del inside, lists
        scratch, hits = Scratch(shared, f"sievelake/suffixes-{uuid.uuid4().hex}"), [np.zeros(0, np.int64)]
        try:
            for order, common in suffix_blocks(text, scratch, bound=min_words, block_items=block_items, held_items=held_items):
                context = np.searchsorted(end, order, side="right")
                group = common_runs(common, end[context] - 1 - order, min_words)
                order, context, group = (c[group >= 0] for c in (order, context, group))
                if len(order):
                    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                    least, most = np.minimum.reduceat(lo[context], at), np.maximum.reduceat(hi[context], at)
                    hits.append(order[np.repeat(least != most, np.diff(np.r_[at, len(order)]))])
        finally:
            scratch.close()
        hit = np.sort(np.concatenate(hits))
        context = np.searchsorted(end, hit, side="right")
        # windows of one context that overlap or touch make one range
        new = np.r_[True, (np.diff(hit) > min_words) | (context[1:] != context[:-1])][: len(hit)]
        first, last = hit[new], hit[np.r_[new[1:], True][: len(hit)]]
        of = np.searchsorted(end, first, side="right")
        cols = [table.column("fp").to_numpy()[of], table.column("ctx").to_numpy()[of], (first - begin[of]).astype(np.int32), (last - begin[of] + min_words).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["fp", "ctx", "a", "b"])

    return run


def _window_rows(min_words: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            hashes, size = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            count = np.maximum(size - min_words + 1, 0)
            of = np.repeat(np.arange(len(size)), count)
            a = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            begin = (np.cumsum(size) - size)[of] + a
            up, down = _powers(len(hashes) + 1)
            with np.errstate(over="ignore"):
                total = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])]
                window = mix64((total[begin + min_words] - total[begin]) * down[begin])
            of = pa.array(of)
            cols = [*(batch.column(c).take(of) for c in ("fp", "ctx", "lo", "hi")), pa.array(window.view(np.int64)), pa.array(a.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["fp", "ctx", "lo", "hi", "window", "a"])

    return run


def _crowded_ranges(once: DataFrame, min_words: int) -> DataFrame:
    """(fp, ctx, a, b) as of a shard; all windows of a context have its anchor, so those that are repeated make one range."""
    windows = written(once.mapInArrow(_window_rows(min_words), "fp long, ctx long, lo long, hi long, window long, a int"), "windows")
    repeated = written(windows.groupBy("fp", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("fp", "window"), "repeated-windows")
    found = windows.join(sized_broadcast(repeated, 48), ["fp", "window"]).groupBy("fp", "ctx").agg(F.min("a").alias("a"), (F.max("a") + min_words).cast("int").alias("b"))
    out = written(found, "crowded-ranges")
    discard(windows, repeated)
    return out


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, block_items: int = BLOCK_ITEMS, held_items: int = HELD_ITEMS) -> DataFrame:
    """(doc_id, start, words): maximal ranges covered by windows of ``min_words`` words that another document has."""
    if not 1 <= gram <= min_words < 1000:
        raise ValueError("1 <= gram <= min_words < 1000 is needed")
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col("text").cast("string")
    keyed = docs.select(id_or_last().alias("id"), text.alias("text")).where("text is not null").select(F.xxhash64("id", "text").alias("d"), "id", "text")
    anchors = written(keyed.mapInArrow(_anchor_rows(min_words, gram), "fp long, ctx long, d long, id long, start int, size int"), "anchors")
    hot = written(anchors.groupBy("fp").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo != hi").select("fp"), "hot-anchors")
    held = written(anchors.join(sized_broadcast(hot, 48), "fp"), "held-contexts")
    discard(anchors, hot)
    context = held.groupBy("fp", "ctx", "size").agg(F.min(F.struct("d", "start")).alias("rep"), F.max("d").alias("hi")).withColumn("lo", F.col("rep.d"))
    several = context.groupBy("fp").agg(F.count("*").alias("contexts"))
    context = written(context.join(several, "fp"), "contexts")
    crowded = F.col("contexts") * (2 * min_words - gram) > shard_words
    wanted = context.where("contexts > 1").groupBy(F.col("rep.d").alias("d")).agg(F.collect_list(F.struct("fp", "ctx", "lo", "hi", crowded.alias("crowded"), "rep.start", "size")).alias("wanted"))
    wanted = written(wanted, "wanted-contexts")
    kind = "fp long, ctx long, lo long, hi long, crowded boolean, words array<long>"
    once = written(keyed.join(sized_broadcast(wanted, 400), "d").mapInArrow(_context_words, kind), "context-words")
    sizes = {r.crowded: r["count"] for r in once.groupBy("crowded").count().collect()}
    shards = once.where("not crowded").drop("crowded").repartition(max(1, -(-sizes.get(False, 0) * (2 * min_words - gram) // shard_words)), "fp")
    ranges = shards.mapInArrow(_shard_rows(min_words, shared_dir(spark), block_items, held_items), "fp long, ctx long, a int, b int")
    if sizes.get(True):
        ranges = ranges.union(_crowded_ranges(once.where("crowded"), min_words))
    alone = context.where(f"contexts = 1 and size >= {min_words}").select("fp", "ctx", F.lit(0).alias("a"), F.col("size").alias("b"))
    ranges = written(ranges.union(alone), "context-ranges")
    discard(context, wanted, once)
    spans = held.join(ranges, ["fp", "ctx"]).select("id", "d", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).groupBy("id", "d", "a").agg(F.max("b").alias("b"))
    order = Window.partitionBy("id", "d").orderBy("a")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("id", "d", "island").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    return merged.select(null_id(F.col("id")).alias("doc_id"), F.col("start").cast("bigint").alias("start"), (F.col("end") - F.col("start")).cast("bigint").alias("words"))
