"""Best-fit packing of documents into fixed-length sequences by exact-complement hashing.

Lengths are counted over all documents, so the planner works on a histogram whose size is bounded by
the capacity and not by the data.  For each length, longest first, it looks up the gap that is left
in a table of single lengths, of pair sums and of triple sums, and consumes combinations that fill
the gap exactly for as many sequences as the availability counts allow.  What remains is packed by
best fit, longest first.  The plan (intervals of ranks per length) is then applied to the rows, which
are ranked within their length in salted groups, so no length is ranked by one task.

A text of more than ``capacity`` words is cut into pieces that are packed on their own; no word is
lost.  A word is a maximal run of characters other than ASCII white space.

Scale: one narrow pass over the texts; what is shuffled is about 40 bytes a piece.

Defined results
* a null or empty or blank text has no words, takes no place and has no row in the result;
* a null doc_id is carried through; repeated rows are separate documents, each is placed;
* an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_id, written

CAPACITY = 2048
SALTS = 64


@dataclass
class Plan:
    """Per (length, first rank): entries saying where the items of these ranks go."""

    key: np.ndarray  # length * 2**40 + first rank, sorted
    copies: np.ndarray  # items of the length in each of the sequences
    base: np.ndarray  # id of the first sequence
    offset: np.ndarray  # where the first item begins in its sequence
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 40) + rank, "right") - 1
        within = (length << 40) + rank - self.key[at]
        return self.base[at] + within // self.copies[at], self.offset[at] + within % self.copies[at] * length


class _Sums:
    """Which sums of two and of three available lengths exist; brought up to date as lengths run out."""

    def __init__(self, count: np.ndarray):
        self.count, self.known = count, None

    def refresh(self) -> None:
        have = self.count > 0
        if self.known is None or not np.array_equal(have, self.known):
            self.known = have
            n = 1 << (4 * len(have)).bit_length()
            f = np.fft.rfft(have.astype(float), n)
            self.two = np.fft.irfft(f * f, n)[: len(have)] > 0.5
            self.three = np.fft.irfft(np.fft.rfft(self.two.astype(float), n) * f, n)[: len(have)] > 0.5

    def pair(self, total: int) -> tuple[int, int] | None:
        a = np.arange(total // 2, 0, -1)
        hit = np.flatnonzero((self.count[a] > 0) & (self.count[total - a] > 0) & ((a * 2 != total) | (self.count[a] > 1)))
        return (int(total - a[hit[-1]]), int(a[hit[-1]])) if len(hit) else None

    def complement(self, gap: int):
        """Combinations that add up to ``gap``, one at a time, until there is none."""
        if self.count[gap] > 0:
            yield (gap,)
        self.refresh()
        if self.two[gap] and (found := self.pair(gap)):
            yield found
        if self.three[gap]:
            for c in np.flatnonzero(self.count[1 : gap - 1] > 0)[::-1] + 1:
                if self.two[gap - c]:
                    self.count[c] -= 1
                    found = self.pair(gap - int(c))
                    self.count[c] += 1
                    if found:
                        yield (int(c), *found)
                        return


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Where ``counts[length]`` items of each length go."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        count[length] = n
    patterns: list[tuple[list[tuple[int, int]], int]] = []  # [(length, copies)], how many sequences
    if count[capacity]:
        patterns.append(([(capacity, 1)], int(count[capacity])))
        count[capacity] = 0
    sums = _Sums(count)
    left: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while count[length]:
            count[length] -= 1
            found = next(sums.complement(capacity - length), None)
            count[length] += 1
            if not found:
                break
            need: dict[int, int] = defaultdict(int)
            for x in (length, *found):
                need[x] += 1
            times = min(int(count[x]) // k for x, k in need.items())
            for x, k in need.items():
                count[x] -= k * times
            patterns.append((list(need.items()), times))
        if count[length]:
            left[length], count[length] = int(count[length]), 0
    patterns += _best_fit(left, capacity)
    rows, used, base = [], defaultdict(int), 0
    for items, times in patterns:
        offset = 0
        for length, copies in items:
            rows.append(((length << 40) + used[length], copies, base, offset))
            used[length] += copies * times
            offset += copies * length
        base += times
    rows.sort()
    return Plan(*(np.array([r[i] for r in rows], dtype=np.int64) for i in range(4)), sequences=base)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first; sequences in the same state are handled together."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = int(fits[0]) + length
                items, times = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
            else:
                gap, items, times = capacity, [], -(-n // (capacity // length))
            each = gap // length
            whole = min(times, n // each)
            states = [(whole, each), (1 if whole < times and n > whole * each else 0, n - whole * each)]
            used = 0
            for many, copies in states:
                if many and copies:
                    open_[gap - copies * length].append(([*items, (length, copies)], many))
                    gaps[gap - copies * length] = True
                    n -= many * copies
                    used += many
            if used < times and items:
                open_[gap].append((items, times - used))
                gaps[gap] = True
    return [state for group in open_.values() for state in group]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("bigint")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """(doc_id, start, length, sequence, offset): which words of each document go where."""
    if not 1 <= capacity < 1 << 20:
        raise ValueError("capacity must be between 1 and 2**20 - 1")
    text = F.col("text").cast("string")
    sized = docs.select(whole_id().alias("doc_id"), F.xxhash64(text).alias("h"), word_count(text).alias("words")).where("words > 0")
    pieces = sized.select("doc_id", "h", "words", F.explode(F.sequence(F.lit(0), F.expr(f"(words - 1) div {capacity}"))).alias("k"))
    start = F.col("k").cast("bigint") * capacity
    items = written(
        pieces.select("doc_id", "h", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("words") - start).alias("length"), F.pmod(F.xxhash64("doc_id", "h", "k"), F.lit(salts)).cast("int").alias("salt")),
        "packing-items",
    )
    counted = items.groupBy("length", "salt").count().collect()  # at most capacity * salts rows
    counts: dict[int, int] = defaultdict(int)
    before = np.zeros((capacity + 1, salts), dtype=np.int64)
    for row in sorted(counted):
        before[row.length, row.salt] = counts[row.length]
        counts[row.length] += row["count"]
    plan = plan_packing(counts, capacity)

    @F.arrow_udf("struct<sequence bigint, offset bigint>")
    def place(length: pa.Array, salt: pa.Array, rank: pa.Array) -> pa.Array:
        size = length.to_numpy(zero_copy_only=False)
        sequence, offset = plan.place(size, before[size, salt.to_numpy(zero_copy_only=False)] + rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "h", "start")
    ranked = items.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    placed = ranked.withColumn("at", place("length", "salt", "rank"))
    return placed.select("doc_id", "start", "length", F.col("at.sequence").alias("sequence"), F.col("at.offset").alias("offset"))
