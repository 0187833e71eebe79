"""Line deduplication by a deletion-neighbourhood join.

A line goes if the same line, or one within the edit bound, first occurs earlier.  The bound of two
lines is one character edit for each ``chars_per_edit`` characters of the shorter one, up to
``max_edits``; so very short lines match exactly only.  Order is (doc_id, hash of the text, number of
the line); lines are compared without ASCII white space at their ends.

Of k edits, one of ceil((k + 1) / 2) parts of the shorter line gets one at most.  So each line emits,
for each of its parts, the part and the part less each one of its characters; and, as the longer line
of a pair, the same for each window where such a part may lie.  Two lines within the bound share a
variant; equal hashed variants are joined and the edit distance is verified.  With a bound of one edit
the part is the whole line.

Long lines have many variants, so these are made only for lines that can match: k edits leave one of
k + 1 parts unchanged, so a line that shares no such part, in a window where it may lie (Li et al.,
2011), with a different line has no partner.  This loses nothing.

Scale: lines are reduced to hashes before any shuffle and hot lines are combined before it; texts
move only if the tables of decisions are too large to broadcast (their rows are counted).

Defined results
* a null, empty or blank text has no lines: its row is returned as it is; blank lines always stay;
* null doc_id: such rows come last in the order; rows that share doc_id and text are treated alike,
  so repeated rows all keep the same lines; a line may be of any length;
* a document all of whose lines go is left out; other columns are passed through, and ``n_chars``,
  if there is one, counts the new text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded_batches, discard, fresh, id_or_last, sized_broadcast, written
from .kernels import BYTE_MIX, SPACE_BYTE, _powers, buffers, mix64, slices, span_hashes, spans, words

MAX_EDITS = 1
CHARS_PER_EDIT = 12
#: Variants that leave a worker in one batch.
HELD_VARIANTS = 1 << 18

_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
_SPACES = " \t\r\f\v"


def _spans(data: np.ndarray, off: np.ndarray):
    """(start, end, row, number) of every line that isn't blank, without white space at its ends."""
    start, end, row = words(data, off, _NOT_NEWLINE)
    solid = np.flatnonzero(~SPACE_BYTE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = a < b
    start, end, row = solid[a[some]], solid[b[some] - 1] + 1, row[some]
    first = np.searchsorted(row, row)
    return start, end, row, np.arange(len(row)) - first


@functools.cache
def _windows(edits: int, parts: int, own: int, change: int) -> tuple[tuple[int, int, int], ...]:
    """(part, shift, change of its length) wherever a part with ``own`` edits at most may lie in a line longer by ``change``."""
    found = []
    for i in range(parts):
        for delta in range(-own, own + 1):
            for shift in range(-edits, edits + 1):
                rest = change - shift - delta
                if abs(shift) + abs(delta) + abs(rest) <= edits and (i or not shift) and (i < parts - 1 or not rest):
                    found.append((i, shift, delta))
    return tuple(found)


def _salted(hashes: np.ndarray, part: int, length) -> np.ndarray:
    """Keys of a part of lines of a length; which one it is belongs to the key."""
    with np.errstate(over="ignore"):
        return mix64(hashes + np.asarray(length, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part + 1) * np.uint64(0x5BD1E9955BD1E995))


def _part_keys(data, start, end, max_edits, chars_per_edit):
    """Code points of each line, and its keys of unchanged parts; 0 where there are fewer.

    First those of the line's own parts, then those of the windows where parts of shorter lines may lie.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    lo = np.searchsorted(lead, start)
    n = np.searchsorted(lead, end) - lo
    lead = np.r_[lead, len(data)]
    hashed = spans(data, BYTE_MIX)
    own, other = [], []
    for change in range(max_edits + 1):
        length = n - change  # of the shorter line
        edits = np.minimum(max_edits, length // chars_per_edit)
        for k in range(max(1, change), max_edits + 1):
            use = np.flatnonzero((edits == k) & (length > 0))
            for i, shift, _ in _windows(k, k + 1, 0, change) if len(use) else ():
                m = length[use]
                a, b = m * i // (k + 1) + shift, m * (i + 1) // (k + 1) + shift
                ok = (a >= 0) & (b <= n[use])
                at = use[ok]
                key = np.zeros(len(n), np.uint64)
                key[at] = _salted(hashed(lead[lo[at] + a[ok]], lead[lo[at] + b[ok]]), i, m[ok])
                other.append(key)
                if not change and not shift:
                    own.append(key)
    none = [np.zeros(len(n), np.uint64)]
    return n, np.stack(own or none, 1).view(np.int64), np.stack(other or none, 1).view(np.int64)


def _line_rows(max_edits: int, chars_per_edit: int):
    names = ["id", "th", "no", "h", "n", "own", "other"]

    def listed(keys):
        some = keys != 0
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(some.sum(1))].astype(np.int32), keys[some])

    def rows(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            ids, th = batch.column("id").to_numpy(zero_copy_only=False), batch.column("th").to_numpy(zero_copy_only=False)
            for a, b in slices(off):
                part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                start, end, row, no = _spans(part, o)
                n, own, other = _part_keys(part, start, end, max_edits, chars_per_edit)
                h = span_hashes(part, start, end, BYTE_MIX).view(np.int64)
                cols = [ids[a + row], th[a + row], no.astype(np.int32), h, n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), listed(own), listed(other)], names)

    return rows


def _variants(text: str, max_edits: int, chars_per_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line's parts with one deletion at most: as the shorter line of a pair, and as the longer one."""
    data = np.frombuffer(text.encode(), np.uint8)
    up, down = _powers(len(data) + 1)
    lead = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    n = len(lead) - 1
    with np.errstate(over="ignore"):
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(BYTE_MIX[data] * up[: len(data)])]

    def whole(a, b):
        a, b = lead[a], lead[b]
        with np.errstate(over="ignore"):
            return mix64((total[b] - total[a]) * down[a] + np.uint64(b - a))[None] if b > a else np.zeros(1, np.uint64)

    def shorter(a, b):
        at, after, first, last = lead[a:b], lead[a + 1 : b + 1], lead[a], lead[b]
        size = after - at
        with np.errstate(over="ignore"):
            kept = (total[at] - total[first]) + (total[last] - total[after]) * down[size]
            return np.where(last - first > size, mix64(kept * down[first] + (last - first - size).astype(np.uint64)), np.uint64(0))

    own, other = [], []
    for change in range(max_edits + 1):
        m = n - change
        k = min(max_edits, m // chars_per_edit) if m > 0 else 0
        if k < max(1, change):
            continue
        parts = k // 2 + 1
        for i, shift, delta in _windows(k, parts, 1, change):
            a, b = m * i // parts + shift, m * (i + 1) // parts + shift + delta
            if 0 <= a <= b <= n:
                found = whole(a, b) if delta < 0 else shorter(a, b) if delta > 0 else np.r_[whole(a, b), shorter(a, b)]
                other.append(_salted(found, i, m))
        if not change:
            for i in range(parts):
                a, b = m * i // parts, m * (i + 1) // parts
                own.append(_salted(np.r_[whole(a, b), shorter(a, b)], i, m))
    return tuple(np.unique(np.concatenate(x)).view(np.int64) if x else np.zeros(0, np.int64) for x in (own, other))


def _chosen_lines(max_edits: int, chars_per_edit: int):
    """For the lines whose numbers are listed in ``nos``: their text and their variants."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for i, t, text, nos in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "text", "nos"))):
                solid = [x for x in (line.strip(_SPACES) for line in text.split("\n")) if x]
                for no in nos:
                    own, other = _variants(solid[no], max_edits, chars_per_edit)
                    data = np.frombuffer(solid[no].encode(), np.uint8)
                    h = int(span_hashes(data, np.array([0]), np.array([len(data)]), BYTE_MIX).view(np.int64)[0])
                    out.append((i, t, no, h, len(solid[no]), solid[no], own, other))
                    held += len(own) + len(other)
                    if held > HELD_VARIANTS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "th", "no", "h", "n", "line", "own", "other"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "th", "no", "h", "n", "line", "own", "other"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(id_or_last().alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def first_lines(docs: DataFrame, *, max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> tuple[DataFrame, list[DataFrame]]:
    """(id, th, no) of the lines that stay, one row for each distinct line; the written tables it is made of."""
    if max_edits < 0 or chars_per_edit < 1:
        raise ValueError("max_edits must be 0 or more, chars_per_edit 1 or more")
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    rows = keyed.where("text is not null").mapInArrow(_line_rows(max_edits, chars_per_edit), "id long, th long, no int, h long, n int, own array<long>, other array<long>")
    firsts = rows.groupBy("h", "n").agg(F.min(F.struct("id", "th", "no", "own", "other")).alias("first"))
    distinct = written(firsts.select("h", "n", "first.*"), "lines-distinct")
    if not max_edits:
        return distinct.select("id", "th", "no"), [distinct]
    place = ["id", "th", "no", "h"]
    parts = distinct.select(*place, F.lit(True).alias("own"), F.explode("own").alias("k")).union(distinct.select(*place, F.lit(False), F.explode("other")))
    shared = parts.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bool_or("own").alias("own")).where("lo != hi and own").select("k")
    able = written(parts.join(shared, "k").select("id", "th", "no").distinct().groupBy("id", "th").agg(F.collect_list("no").alias("nos")), "lines-able")
    kind = "id long, th long, no int, h long, n int, line string, own array<long>, other array<long>"
    chosen = written(keyed.join(sized_broadcast(able, 80), ["id", "th"]).mapInArrow(_chosen_lines(max_edits, chars_per_edit), kind), "lines-variants")
    x, y = chosen.select("h", F.explode("own").alias("v")), chosen.select("h", F.explode("other").alias("v"))
    pairs = x.alias("a").join(y.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.h") != F.col("b.h"))).select(F.least("a.h", "b.h").alias("p"), F.greatest("a.h", "b.h").alias("q")).distinct()
    line = chosen.select("h", F.struct("id", "th", "no").alias("at"), "line")
    both = pairs.join(line.select(F.col("h").alias("p"), F.col("at").alias("at_p"), F.col("line").alias("line_p")), "p").join(line.select(F.col("h").alias("q"), F.col("at").alias("at_q"), F.col("line").alias("line_q")), "q")
    bound = F.least(F.lit(max_edits), F.floor(F.least(F.length("line_p"), F.length("line_q")) / chars_per_edit))
    near = both.withColumn("edits", F.levenshtein("line_p", "line_q", max_edits)).where((F.col("edits") >= 0) & (F.col("edits") <= bound))
    later = written(near.select(F.greatest("at_p", "at_q").alias("at")).select("at.*").distinct(), "lines-later")
    discard(able, chosen)
    return distinct.select("id", "th", "no").join(sized_broadcast(later, 40), ["id", "th", "no"], "left_anti"), [distinct, later]


def _without(t: str | None, kept: list[int] | None) -> str | None:
    if t is None or not t.strip(_SPACES + "\n"):
        return t
    if not kept:
        return None
    keep, no, lines = set(kept), -1, []
    for line in t.split("\n"):
        solid = bool(line.strip(_SPACES))
        no += solid
        if not solid or no in keep:
            lines.append(line)
    return t if len(keep) == no + 1 else "\n".join(lines)


@F.arrow_udf(StringType())
def _rebuilt(text: pa.Array, kept: pa.Array) -> pa.Array:
    """The text less the lines that aren't in ``kept``; null if no line is left of some."""
    part = lambda i: map(_without, text.slice(i, 256).to_pylist(), kept.slice(i, 256).to_pylist())
    return pa.concat_arrays([pa.array(part(i), pa.string()) for i in range(0, len(text), 256)] or [pa.array([], pa.string())])


def dedup_lines(docs: DataFrame, *, max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``docs`` without repeated lines; the columns are those of ``docs``."""
    kept, tables = first_lines(docs, max_edits=max_edits, chars_per_edit=chars_per_edit)
    i, t, k, new = fresh(docs, "id", "th", "kept", "new")
    lists = written(kept.groupBy("id", "th").agg(F.collect_list("no").alias("nos")).select(F.col("id").alias(i), F.col("th").alias(t), F.col("nos").alias(k)), "lines-kept")
    discard(*tables)
    text = F.col("text").cast("string")
    joined = docs.withColumns({i: id_or_last(), t: F.xxhash64(text)}).join(sized_broadcast(lists, 100), [i, t], "left")
    blank = text.isNull() | (F.length(F.btrim(text, F.lit(_SPACES + "\n"))) == 0)
    done = joined.withColumn(new, _rebuilt(text, F.col(k))).where(blank | F.col(new).isNotNull())
    changed = {"text": F.when(blank, F.col("text")).otherwise(F.col(new))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(blank | (F.col(new) == text), F.col("n_chars")).otherwise(F.length(new)).cast(kind)
    return done.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))
