"""Language-model scoring with a weighted backoff automaton.

Word n-grams up to order three are counted over all documents and smoothed by absolute discounting.
By default every n-gram is kept, however rare it is and however large the corpus, and the automaton is
never in one place.  Texts are cut into slices; the pairs and triples of a slice are sent, distinct and counted,
to the shards that their keys hash to, which return how often each occurs in all slices.  That gives a slice the
part of the automaton that its texts can reach: a state for each context, an arc for each n-gram that was counted,
and a failure arc to the next shorter context.  The texts are traversed once.  An arc costs the
count of its n-gram less the discount, over the count of its context.  Failure arcs are noted with the text that
takes them, and the exact backoff weights of the states that are left by them are worked out from
all counts afterwards.  Texts that the model was counted over have an arc for each word; others (``texts``) fail, too.

``min_share`` asks for a bounded automaton instead, which one machine holds, and which scores texts
that it was not counted over, too.  It keeps n-grams whose share of all words is at least
``min_share``, with exact backoff weights, to which the pruned mass goes.  Pruning is done level by
level, which is exact: an n-gram can't be more frequent than its parts.  The kept contexts are its
states.  An arc reads a word, adds its log-probability and leads to the longest context that follows;
a state without an arc for the word takes its failure arc to the next shorter context, adding the
backoff weight.  The texts of a batch advance together, each carrying its state.

Scale: a task holds one slice of texts or one shard of keys, both of fixed size, whose numbers grow
with the corpus.  Pairs and triples are known by 64 bits of hash, and what is shuffled are these keys,
combined per slice, one count for each on the way back, and the compressed slices.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, with ASCII case folded.

Defined results
* null, empty and wordless texts: no tokens, log-probability 0, perplexity null;
* null doc_id and repeated rows: scored (and counted) like any other; an id that isn't a whole number comes out as null;
* an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, whole_id, written
from .kernels import buffers, mix64, slices, span_hashes, words

MIN_SHARE = 1e-6
DISCOUNT = 0.75
#: Bytes of text of a slice, and of all texts for each shard; they bound what a task holds.
SLICE_BYTES = 5 << 20
SHARD_BYTES = 8 << 20
#: Keys that a task holds before it combines them, and distinct ones before it passes them on.
HELD = 1 << 21


class HashIndex:
    """Positions of distinct int64 keys, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.keys = np.zeros(self.mask + 1, np.int64)
        self.at = np.full(self.mask + 1, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several, the last one stays
            self.keys[slot] = np.where(self.at[slot] == left, keys[left], self.keys[slot])
            placed = self.at[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask
        used = np.flatnonzero(self.at >= 0)
        self.keys[used] = keys[self.at[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        slot = self._slot(keys)
        out = self.at[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.at[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out


def _tokens(column):
    """(word hash, row) of every word of the texts of a batch."""
    data, off = buffers(column)
    for a, b in slices(off):
        part = data[off[a] : off[b]]
        start, end, row = words(part, off[a : b + 1] - off[a])
        yield span_hashes(part, start, end).view(np.int64), row + a


class _Combined:
    """Counts of keys, combined as they come; flushed when there are many distinct ones."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray):
        if len(keys):
            k, c = np.unique(keys, return_counts=True)
            self.keys.append(k)
            self.counts.append(c)
            self.held += len(k)
            if self.held > HELD:
                self._merge()
                if self.held > HELD // 2:
                    yield self._out()

    def _merge(self):
        k, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.held = [k], [c], len(k)

    def _out(self):
        batch = pa.RecordBatch.from_arrays([pa.array(self.keys[0]), pa.array(self.counts[0].astype(np.int64))], ["key", "n"])
        self.keys, self.counts, self.held = [], [], 0
        return batch

    def rest(self):
        if self.held:
            self._merge()
            yield self._out()


def _counted(texts: DataFrame, keys_of, name: str, least: float = 0) -> DataFrame:
    def run(batches):
        combined = _Combined()
        for batch in batches:
            for keys in keys_of(batch.column("text")):
                yield from combined.add(keys)
        yield from combined.rest()

    return written(texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), name)


def _arrays(counts: DataFrame, least: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """The kept counts, by key; ``counts`` is read for the last time."""
    table = counts.where(F.col("n") >= least).toArrow().sort_by("key")
    discard(counts)
    return table.column("key").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)


def _word_ids(column, vocabulary: HashIndex, start_id: int):
    """Ids (-1: unknown) with a start symbol before each text, and the text of each."""
    for hashes, row in _tokens(column):
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        yield np.insert(vocabulary.find(hashes).astype(np.int64), at, start_id), np.insert(row, at, row[at])


@dataclass
class BackoffAutomaton:
    """States: 0 no context, 1 + w after word w (the last is the start symbol), then kept pairs."""

    vocabulary: HashIndex
    size: int  # words; the start symbol has this id
    first: np.ndarray  # log-probability of each word without context
    unknown: float
    arcs: HashIndex  # state * (size + 1) + word
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray

    def score(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability, words) of each text: one traversal, all texts of the batch in step."""
        n = len(column)
        ids, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for hashes, row in _tokens(column):
            ids.append(self.vocabulary.find(hashes))
            rows.append(row.astype(np.int32))
        word, row = np.concatenate(ids), np.concatenate(rows)
        count = np.bincount(row, minlength=n)
        order = np.argsort(-count, kind="stable")
        begin = (np.cumsum(count) - count)[order]
        length = count[order]
        state, total = np.full(n, 1 + self.size, np.int64), np.zeros(n)
        active = np.searchsorted(-length, -np.arange(length[0] if n else 0), "left")
        for t, m in enumerate(active):
            w = word[begin[:m] + t].astype(np.int64)
            s, add = state[:m], np.zeros(m)
            todo = np.flatnonzero(s)
            while len(todo):
                at = self.arcs.find(s[todo] * (self.size + 1) + w[todo])
                hit = (at >= 0) & (w[todo] >= 0)
                won, lost = todo[hit], todo[~hit]
                add[won] += self.weight[at[hit]]
                s[won] = -self.target[at[hit]]
                add[lost] += self.fail_weight[s[lost]]
                s[lost] = self.fail[s[lost]]
                todo = lost[s[lost] > 0]
            root = np.flatnonzero(s == 0)
            known = w[root] >= 0
            add[root] += np.where(known, self.first[w[root]], self.unknown)
            s[root] = np.where(known, w[root] + 1, 0)
            np.abs(s, out=s)
            total[:m] += add
        out = np.zeros(n)
        out[order] = total
        return out, count


def fit_automaton(docs: DataFrame, *, min_share: float = MIN_SHARE, discount: float = DISCOUNT) -> BackoffAutomaton:
    """Count over all of ``docs`` and build the automaton."""
    if not (0 < min_share < 1 and 0 < discount < 1):
        raise ValueError("min_share and discount must lie between 0 and 1")
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    single = _counted(texts, lambda column: (h for h, _ in _tokens(column)), "words")
    total, kinds = single.agg(F.sum("n"), F.count("*")).first()
    least, total = min_share * (total or 0), float(total or 0)
    keys, c1 = _arrays(single, least)
    size = len(keys)
    vocabulary, base = HashIndex(keys), size + 1

    def pairs_of(column):
        for w, row in _word_ids(column, vocabulary, size):
            a, b = w[:-1], w[1:]
            yield (a * base + b)[(row[1:] == row[:-1]) & (a >= 0) & (b >= 0)]

    k2, c2 = _arrays(_counted(texts, pairs_of, "pairs", least))
    pair_index = HashIndex(k2)

    def triples_of(column):
        for w, row in _word_ids(column, vocabulary, size):
            a, b, c = w[:-2], w[1:-1], w[2:]
            ok = np.flatnonzero((row[2:] == row[:-2]) & (a >= 0) & (b >= 0) & (c >= 0))
            p, q = pair_index.find(a[ok] * base + b[ok]), pair_index.find(b[ok] * base + c[ok])
            both = (p >= 0) & (q >= 0)
            yield p[both].astype(np.int64) * base + c[ok][both]

    k3, c3 = _arrays(_counted(texts, triples_of, "triples", least))
    begun = texts.where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    context1 = np.r_[c1, float(begun.count())]
    first = np.log(c1 / (total + 1)) if size else np.zeros(0)
    unknown = math.log((total - c1.sum() + 1) / (total + 1) / (kinds - size + 1))
    p1 = np.exp(first)
    a2, w2 = k2 // base, k2 % base
    p2 = (c2 - discount) / context1[a2]
    left = 1 - np.bincount(a2, p2, base)
    alpha1 = np.log(np.maximum(left, 1e-12) / np.maximum(1 - np.bincount(a2, p1[w2], base), 1e-12))
    a3, w3 = k3 // base, k3 % base
    p3 = (c3 - discount) / c2[a3]
    shorter = pair_index.find(w2[a3] * base + w3)  # kept, as triples are counted between kept pairs
    has = np.unique(a3)
    left = 1 - np.bincount(a3, p3, len(k2))[has]
    alpha2 = np.log(np.maximum(left, 1e-12) / np.maximum(1 - np.bincount(a3, p2[shorter], len(k2))[has], 1e-12))
    state2 = np.full(len(k2), -1, np.int64)
    state2[has] = 1 + base + np.arange(len(has))
    after = np.where(state2 >= 0, state2, 1 + w2)
    arcs = np.r_[(1 + a2) * base + w2, state2[a3] * base + w3]
    return BackoffAutomaton(
        vocabulary, size, np.r_[first, 0.0], unknown, HashIndex(arcs), np.log(np.r_[p2, p3]), np.r_[after, after[shorter]],
        np.r_[np.zeros(1 + base, np.int64), 1 + w2[has]], np.r_[0.0, alpha1, alpha2],
    )


_START, _PAIR, _TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _joined(left: np.ndarray, right: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * salt + mix64(right ^ salt))


def _sliced(batches) -> Iterator[pa.RecordBatch]:
    """(slice, begun, texts): slices of whole texts, as compressed Arrow streams; begun: texts that have words."""
    part, number = TaskContext.get().partitionId(), 0

    def packed(held):
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
            out.write_table(table)
        begun = sum(len(np.unique(row)) for b in held for _, row in _tokens(b.column("text")))
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([begun]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "begun", "texts"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield packed(held)
            held, size, number = [], 0, number + 1
    if held:
        yield packed(held)


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _ngrams(column):
    """(pairs, their texts, whether they begin the text, whether a word follows, triples, their texts, words of each text)."""
    found = list(_tokens(column))
    none = np.zeros(0, np.int64)
    word, row = np.concatenate([none, *(h for h, _ in found)]), np.concatenate([none.astype(np.int32), *(r.astype(np.int32) for _, r in found)])
    found.clear()
    count = np.bincount(row, minlength=len(column))
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    word, row = np.insert(word.view(np.uint64), at, _START), np.insert(row, at, row[at])
    start = np.zeros(len(row), bool)
    start[at + np.arange(len(at))] = True
    same = row[1:] == row[:-1]
    pair = _joined(word[:-1], word[1:], _PAIR)
    three = same[1:] & same[:-1]
    triple = _joined(pair[:-1], word[2:], _TRIPLE)[three]
    follows = np.r_[three, np.zeros(1, bool)][: len(pair)]
    return pair[same], row[1:][same], start[:-1][same], follows[same], triple, row[2:][three], count


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers, compressed: the bytes of each weight together, which leaves long runs of zeros."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def _of_planes(blob: bytes) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _shard_keys(bits: int, counted: bool = True):
    """(shard, slice, keys, n) of the distinct pairs and triples of each slice; shards are the first bits of the keys; n is 0 if they aren't counted."""

    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("texts").to_pylist()):
                pair, _, _, _, triple, _, _ = _ngrams(_unpacked(blob).column("text"))
                keys, n = np.unique(np.concatenate([pair, triple]), return_counts=True)
                n = n if counted else np.zeros_like(n)
                edge = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
                edge = np.r_[0, edge, len(keys)]
                used = np.flatnonzero(edge[1:] > edge[:-1])
                parts = [slice(edge[k], edge[k + 1]) for k in used]
                cols = [used, np.full(len(used), number), [_planes(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], [_planes(n[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "slice", "keys", "n"])

    return run


def _total_counts(rows: pa.Table) -> pa.Table:
    """(slice, shard, n): how often each key of a slice occurs in all slices, in the order in which it came."""
    keys = [np.cumsum(_of_planes(b), dtype=np.uint64) for b in rows.column("keys").to_pylist()]
    n = np.concatenate([_of_planes(b) for b in rows.column("n").to_pylist()])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, n).astype(np.int64)[at]
    edge = np.cumsum([0, *map(len, keys)])
    blobs = [_planes(total[a:b]) for a, b in zip(edge, edge[1:])]
    return pa.table([rows.column("slice"), rows.column("shard"), pa.array(blobs, pa.binary())], ["slice", "shard", "n"])


def _contexts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, whether the text begins with it) of each word, in the order of the pairs of :func:`_ngrams`."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_tokens(column)]
    word, row = (np.concatenate(c) for c in zip(*found))
    first = np.r_[True, row[1:] != row[:-1]][: len(row)]
    return np.where(first, _START.view(np.int64), np.r_[word[:1], word[:-1]]), word, first


#: What is noted of a failure arc: the pair that is left and its count (-1: the text begins), the word before, the word, the count of both.
_FAILED = ("pair", "n_pair", "before", "word", "n_both")


def _traversed(texts: pa.Table, counts: pa.Table, discount: float, begun: int) -> pa.Table:
    """(slice, place, doc_id, tokens, log_probability of arcs, failed) of the texts of a slice."""
    batch = _unpacked(texts.column("texts")[0].as_py())
    pair, row2, start, follows, triple, row3, count = _ngrams(batch.column("text"))
    _, at = np.unique(np.concatenate([pair, triple]), return_inverse=True)
    blobs = counts.sort_by("shard").column("n").to_pylist()
    n = np.concatenate([np.zeros(0), *map(_of_planes, blobs)])[at]
    c2, c3 = n[: len(pair)], n[len(pair) :]
    state, arc = np.full(len(pair), float(begun)), c2.copy()  # counts of the context before each word, and of it with the word
    state[~start], arc[~start] = c2[follows], c3  # the triples, in order, are those of the pairs that go on
    taken = arc > 0
    total = np.bincount(row2[taken], np.log((arc[taken] - discount) / state[taken]), len(batch)) if taken.any() else np.zeros(len(batch))
    left = np.flatnonzero(~taken)
    noted = np.zeros((len(left), len(_FAILED)), np.int64)
    if len(left):
        before, word, _ = _contexts(batch.column("text"))
        noted[:, 0] = pair[np.maximum(left - 1, 0)].view(np.int64)
        noted[:, 1] = np.where(start[left], -1, state[left])
        noted[:, 2], noted[:, 3], noted[:, 4] = before[left], word[left], c2[left]
    edge = np.searchsorted(row2[left], np.arange(len(batch) + 1)) * len(_FAILED)
    failed = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(noted.ravel()))
    number = pa.array(np.full(len(batch), texts.column("slice")[0].as_py()), pa.int64())
    cols = [number, pa.array(np.arange(len(batch)), pa.int64()), batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(total), failed]
    return pa.table(cols, ["slice", "place", "doc_id", "tokens", "log_probability", "failed"])


def _backed_off(failed: DataFrame, docs: DataFrame, discount: float) -> DataFrame:
    """(slice, place, backoff): what the failure arcs of each text cost, with the words that are read after them."""

    def grams(batches):
        for batch in batches:
            before, word, first = _contexts(batch.column("text"))
            pair = _joined(before.view(np.uint64), word.view(np.uint64), _PAIR).view(np.int64)
            left = np.where(first, 0, np.r_[pair[:1], pair[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(left), pa.array(before), pa.array(word)], ["first", "pair", "before", "word"])

    counted = written(docs.select("text").mapInArrow(grams, "first boolean, pair long, before long, word long").groupBy("first", "pair", "before", "word").agg(F.count("*").alias("n")), "triples")
    log = lambda kept, shorter: F.log(F.greatest(1 - kept, F.lit(1e-12)) / F.greatest(1 - shorter, F.lit(1e-12)))
    words_ = counted.groupBy("word").agg(F.sum("n").alias("n_word"))
    both = counted.groupBy("before", "word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    begun = counted.where("first").agg(F.sum("n")).first()[0] or 0
    context = words_.select(F.col("word").alias("before"), F.col("n_word").alias("n_before")).union(docs.sparkSession.createDataFrame([(int(_START.view(np.int64)), begun)], "before long, n_before long"))
    pairs = written(both.join(context, "before").join(words_, "word").select("before", "word", "n_before", ((F.col("n") - discount) / F.col("n_before")).alias("p2"), (F.col("n_word") / (total + 1)).alias("p1")), "pairs")
    alpha1 = pairs.groupBy("before").agg(log(F.sum("p2"), F.sum("p1")).alias("alpha1"))
    wanted = failed.where("n_pair > 0").select("pair", "n_pair").distinct()
    alpha2 = counted.where("not first").join(wanted, "pair").join(pairs, ["before", "word"])
    alpha2 = alpha2.groupBy("pair").agg(log(F.sum((F.col("n") - discount) / F.col("n_pair")), F.sum("p2")).alias("alpha2"))
    found = failed.join(alpha2, "pair", "left").join(alpha1, "before", "left").join(context, "before", "left").join(words_, "word", "left")
    single = F.log(F.coalesce("n_word", F.lit(1)) / (total + 1))
    after = F.when(F.col("n_both") > 0, F.log((F.col("n_both") - discount) / F.col("n_before"))).otherwise(F.coalesce("alpha1", F.lit(0.0)) + single)
    cost = after + F.when(F.col("n_pair") > 0, F.coalesce("alpha2", F.lit(0.0))).otherwise(0.0)
    out = written(found.groupBy("slice", "place").agg(F.sum(cost).alias("backoff")), "backoff")
    discard(counted, pairs)
    return out


#: Added to the numbers of slices of texts that are scored but not counted.
_OTHER = 1 << 62


def _scored_whole(docs: DataFrame, discount: float, others: DataFrame | None = None) -> DataFrame:
    if not 0 < discount < 1:
        raise ValueError("discount must lie between 0 and 1")
    bounded_batches(docs.sparkSession)
    cut = lambda df: df.select(whole_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, schema = cut(docs), "slice long, begun long, texts binary"
    slices = written(texts.mapInArrow(_sliced, schema), "slices")
    size, begun = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, slices.agg(F.sum("begun")).first()[0] or 0
    bits = (size // SHARD_BYTES).bit_length()
    form = "shard long, slice long, keys binary, n binary"
    keys, scored = slices.select("slice", "texts").mapInArrow(_shard_keys(bits), form), slices
    if others is not None:
        scored = written(cut(others).mapInArrow(_sliced, schema).withColumn("slice", F.col("slice") + F.lit(_OTHER)), "other-slices")
        keys = keys.union(scored.select("slice", "texts").mapInArrow(_shard_keys(bits, counted=False), form))
    counts = keys.groupBy("shard").applyInArrow(_total_counts, "slice long, shard long, n binary")
    if others is not None:
        counts = counts.where(F.col("slice") >= _OTHER)

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        return _traversed(left, right, discount, begun)

    found = scored.select("slice", "texts").groupBy("slice").cogroup(counts.groupBy("slice"))
    out = written(found.applyInArrow(traverse, "slice long, place long, doc_id long, tokens long, log_probability double, failed array<bigint>"), "scores")
    discard(slices, *([scored] if others is not None else []))
    columns = ["doc_id", "tokens", "log_probability"]
    if others is None:  # each word had its arc
        return out.select(columns)
    width = len(_FAILED)
    failed = out.where("size(failed) > 0").select("slice", "place", F.explode(F.expr(f"sequence(0, size(failed) - {width}, {width})")).alias("k"), "failed")
    failed = failed.select("slice", "place", *(F.expr(f"failed[k + {c}]").alias(name) for c, name in enumerate(_FAILED)))
    backoff = _backed_off(failed, texts, discount)
    return out.join(backoff, ["slice", "place"], "left").withColumn("log_probability", F.col("log_probability") + F.coalesce("backoff", F.lit(0.0))).select(columns)


def score_documents(docs: DataFrame, *, texts: DataFrame | None = None, min_share: float | None = None, discount: float = DISCOUNT, model: BackoffAutomaton | None = None) -> DataFrame:
    """(doc_id, tokens, log_probability, perplexity) under all n-grams of ``docs``, or a bounded automaton: ``model``, or that of ``min_share``.

    Scored are ``texts`` (doc_id, text), or ``docs`` themselves.
    """
    if model is None and min_share is None:
        return _with_perplexity(_scored_whole(docs, discount, texts))
    model = model or fit_automaton(docs, min_share=min_share, discount=discount)

    @F.arrow_udf("struct<tokens bigint, log_probability double>")
    def score(text: pa.Array) -> pa.Array:
        total, count = model.score(text)
        return pa.StructArray.from_arrays([pa.array(count.astype(np.int64)), pa.array(total)], ["tokens", "log_probability"])

    return _with_perplexity((docs if texts is None else texts).select(whole_id().alias("doc_id"), score(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*"))


def _with_perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.when(F.col("tokens") > 0, F.exp(-F.col("log_probability") / F.col("tokens"))))
