"""Near-duplicate texts by MinHash signatures over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sievelake.functions.shingles import BLANK_SLOT, hash_family, mixed64, packed_ngrams, permuted, token_hashes
from sievelake.operators.components import component_labels, connected_components
from sievelake.storage import discard, sized_broadcast, written

NUM_PERM, NGRAM_SIZE, THRESHOLD = 128, 3, 0.8
#: Slot values that a worker keeps of the n-grams it has met, and that it gathers at once; they bound its memory.
_KNOWN_VALUES, _GATHERED_VALUES = 1 << 23, 1 << 22
#: Characters of the texts whose n-grams are found at once; one text may be longer.
_CHARACTERS = 1 << 20
#: Signatures of a block; a task holds two blocks, of a kilobyte for each signature of 128 slots.
BLOCK = 16384
#: Bits of a slot that are compared before the slots; pairs of rows and columns whose bits are compared at once.
_LEVELS, _ROWS, _COLUMNS = 4, 32, 4096


@dataclass(frozen=True)
class MinHashSignature:
    values: tuple[int, ...]
    num_perm = property(lambda self: len(self.values), doc="How many slots there are.")


def _positive(**numbers: int) -> None:
    for name, value in numbers.items():
        if value < 1:
            raise ValueError(f"{name} is {value}; it must be 1 or more")


class MinHasher:
    """Signatures of single texts; :func:`signatures` makes the same ones for a table."""

    def __init__(self, num_perm: int = NUM_PERM, ngram_size: int = NGRAM_SIZE, seed: int = 42):
        _positive(num_perm=num_perm, ngram_size=ngram_size)
        self.num_perm, self.ngram_size = num_perm, ngram_size
        self.a, self.b = (np.array(x, np.uint64) for x in hash_family(num_perm, seed))
        self.grams = None

    def signature(self, text: str) -> MinHashSignature:
        return MinHashSignature(tuple(map(int, self.many([text])[0])))

    def similarity(self, first: MinHashSignature, second: MinHashSignature) -> float:
        """The share of slots that agree."""
        if first.num_perm != second.num_perm:
            raise ValueError("signatures of different lengths can't be compared")
        return sum(map(int.__eq__, first.values, second.values)) / first.num_perm

    def many(self, texts: list[str | None]) -> np.ndarray:
        """One row of slots for each text; a null counts as blank."""
        out = np.full((len(texts), self.num_perm), BLANK_SLOT, np.uint64)
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= _CHARACTERS or i + 1 == len(texts):
                self._fill(texts[begin : i + 1], out[begin : i + 1])
                begin, size = i + 1, 0
        return out

    def _fill(self, texts: list[str | None], out: np.ndarray) -> None:
        grams, at, row, _ = packed_ngrams(texts, self.ngram_size)  # distinct n-grams; which of them each text has, by text
        if not len(grams):
            return
        at = self._known(grams)[at]
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        step = max(1, _GATHERED_VALUES // self.num_perm)
        gathered = np.empty((min(step, int(np.diff(np.r_[edge, len(row)]).max())), self.num_perm), np.uint64)
        for begin, end in zip(edge.tolist(), np.r_[edge[1:], len(row)].tolist()):
            slots = out[row[begin]]
            for i in range(begin, end, step):  # a text of very many n-grams takes several
                values = self.values.take(at[i : min(i + step, end)], axis=0, out=gathered[: min(step, end - i)], mode="clip").min(0)
                slots[:] = values if i == begin else np.minimum(slots, values)

    def _known(self, grams: np.ndarray) -> np.ndarray:
        """Row of ``values`` of each n-gram; those of new ones are computed."""
        if self.grams is None or len(self.grams) * self.num_perm > _KNOWN_VALUES:
            self.grams, self.values = grams[:0], np.zeros((0, self.num_perm), np.uint64)
            self.rows = np.zeros(0, np.int64)
        found = np.searchsorted(self.grams, grams)
        old = found < len(self.grams)
        old[old] = self.grams[found[old]] == grams[old]
        new = grams[~old]
        if len(new):
            hashes = token_hashes(new, self.ngram_size)
            made = [permuted(hashes[i : i + 4096], self.a, self.b) for i in range(0, len(new), 4096)]
            rows = np.r_[self.rows, len(self.values) + np.arange(len(new))]
            both = np.concatenate([self.grams, new])
            order = np.argsort(both, kind="stable")
            self.grams, self.rows, self.values = both[order], rows[order], np.concatenate([self.values, *made])
            found = np.searchsorted(self.grams, grams)
        return self.rows[found]


def signatures(texts: DataFrame, key: str, text: str, *, num_perm: int = NUM_PERM, ngram_size: int = NGRAM_SIZE, seed: int = 42) -> DataFrame:
    """(key, signature array<bigint>) for every row; one narrow pass."""
    hasher = MinHasher(num_perm, ngram_size, seed)

    @F.arrow_udf("array<bigint>")
    def signed(column: pa.Array) -> pa.Array:
        parts = [hasher.many(column.slice(i, 256).to_pylist()) for i in range(0, len(column), 256)]
        flat = np.concatenate(parts).astype(np.int64).ravel() if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * num_perm, flat)

    return texts.select(F.col(key), signed(F.col(text).cast("string")).alias("signature"))


def signature_rows(texts: DataFrame, key: str, text: str, *, num_perm: int = NUM_PERM, ngram_size: int = NGRAM_SIZE, seed: int = 42) -> DataFrame:
    """(key, slot, value) of every slot of :func:`signatures`; Python makes the rows, as exploding arrays costs as much as filling them."""
    hasher = MinHasher(num_perm, ngram_size, seed)
    ready = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                value = hasher.many(batch.column("text").to_pylist()).astype(np.int64).ravel()
                keys = batch.column("key").take(pa.array(np.repeat(np.arange(batch.num_rows), num_perm)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(num_perm, dtype=np.int32), batch.num_rows)), pa.array(value)], ["key", "slot", "value"])

    schema = StructType([ready.schema["key"], StructField("slot", IntegerType()), StructField("value", LongType())])
    return ready.mapInArrow(run, schema).withColumnRenamed("key", key)


def needed_matches(num_perm: int, threshold: float) -> int:
    """The least number of equal slots whose share reaches the threshold; more than there are, if none does."""
    return next((m for m in range(num_perm + 1) if m / num_perm >= threshold), num_perm + 1)


def _checked(num_perm: int, ngram_size: int, threshold: float) -> None:
    if threshold < 0 or threshold > 1:
        raise ValueError("the threshold must lie between 0 and 1")
    _positive(num_perm=num_perm, ngram_size=ngram_size)


def _slots(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


class _Block:
    """Signatures in the order of their weight, with _LEVELS bits of a hash of each slot, 64 slots to a word."""

    def __init__(self, n: np.ndarray, weight: np.ndarray, slots: np.ndarray):
        order = np.argsort(weight, kind="stable")
        self.n, self.weight, self.slots = n[order], weight[order].astype(np.int64), slots[order]
        num_perm = slots.shape[1]
        mixed = mixed64(self.slots + np.arange(num_perm, dtype=np.uint64))
        self.words = []  # of a level, of 64 slots: a number of each signature
        for k in range(_LEVELS):
            bits = np.zeros((len(n), -(-num_perm // 64) * 8), np.uint8)
            packed = np.packbits((mixed >> np.uint64(63 - k)).astype(np.uint8) & 1, axis=1)
            bits[:, : packed.shape[1]] = packed
            self.words.append(np.ascontiguousarray(bits.view(np.uint64).T))


def _apart(a: _Block, b: _Block, p: np.ndarray, q: np.ndarray, levels: int) -> np.ndarray:
    """In how many slots the pairs differ by the bits of the first levels; never more than by the slots."""
    total = np.zeros(len(p), np.uint16)
    for w in range(len(a.words[0])):
        x = a.words[0][w].take(p) ^ b.words[0][w].take(q)
        for k in range(1, levels):
            x |= a.words[k][w].take(p) ^ b.words[k][w].take(q)
        total += np.bitwise_count(x)
    return total


def _near(a: _Block, b: _Block, differing: int, open_pairs=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, equal slots) of all pairs that differ in so many slots at most; within a block, each once.

    Weights of such pairs differ by no more, and neither do any bits of theirs; what passes both is
    compared slot by slot.  ``open_pairs`` may leave out pairs that needn't be known.
    """
    rows_, words = min(_ROWS, max(1, len(a.n))), range(len(a.words[0]))
    x, one = np.empty(rows_ * _COLUMNS, np.uint64), np.empty(rows_ * _COLUMNS, np.uint8)
    total, close = np.empty(rows_ * _COLUMNS, np.uint16 if len(words) > 3 else np.uint8), np.empty(rows_ * _COLUMNS, bool)
    for i in range(0, len(a.n), rows_):
        end = min(i + rows_, len(a.n))
        begin, stop = np.searchsorted(b.weight, a.weight[i] - differing, "left"), np.searchsorted(b.weight, a.weight[end - 1] + differing, "right")
        for j in range(max(begin, i) if a is b else begin, stop, _COLUMNS):
            wide = min(j + _COLUMNS, stop) - j
            size = (end - i) * wide
            for w in words:
                np.bitwise_xor(a.words[0][w, i:end, None], b.words[0][w, None, j : j + wide], out=x[:size].reshape(-1, wide))
                np.bitwise_count(x[:size], out=one[:size] if w else total[:size])
                if w:
                    np.add(total[:size], one[:size], out=total[:size])
            at = np.flatnonzero(np.less_equal(total[:size], differing, out=close[:size]))
            p = at // wide
            q = at - p * wide + j
            p += i
            if a is b:
                p, q = p[p < q], q[p < q]
            if open_pairs is not None:
                keep = open_pairs(p, q)
                p, q = p[keep], q[keep]
            for levels in range(2, _LEVELS + 1, 2):
                keep = _apart(a, b, p, q, levels) <= differing
                p, q = p[keep], q[keep]
            for k in range(0, len(p), 4096):
                r, s = p[k : k + 4096], q[k : k + 4096]
                equal = np.bitwise_count(np.packbits(a.slots[r] == b.slots[s], axis=1)).sum(1, dtype=np.int32)
                keep = equal >= a.slots.shape[1] - differing
                if keep.any():
                    yield r[keep], s[keep], equal[keep]


def _pair_rows(a: _Block, b: _Block, differing: int) -> Iterator[pa.RecordBatch]:
    """Batches (p, q, matches) of all similar signatures of two blocks."""
    held, size = [], 0
    for p, q, equal in _near(a, b, differing):
        held.append((a.n[p], b.n[q], equal))
        size += len(p)
        if size >= 65536:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["p", "q", "matches"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["p", "q", "matches"])


def _forest_rows(a: _Block, b: _Block, differing: int) -> Iterator[pa.RecordBatch]:
    """Batches (a, b) of links that connect what all similar signatures of two blocks connect: fewer than there are signatures."""
    names, shift = (a.n, 0) if a is b else (np.concatenate([a.n, b.n]), len(a.n))
    joined = np.arange(len(names))
    out = []
    for p, q, _ in _near(a, b, differing, lambda p, q: joined[p] != joined[q + shift]):
        nodes, labels = component_labels(joined[p], joined[q + shift])
        moved = nodes != labels
        out.append((names[nodes[moved]], names[labels[moved]]))
        to = np.arange(len(names))
        to[nodes] = labels
        joined = to[joined]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b"])


def _cut(counts: dict[int, int], rows: int) -> tuple[dict[int, tuple[int, int]], list[int], list[int]]:
    """(first block and number of blocks of each weight; least weights of the blocks; greatest ones) for blocks of about ``rows`` rows."""
    place, least, most, free = {}, [], [], 0
    for weight, count in sorted(counts.items()):
        if count <= free:
            place[weight] = (len(least) - 1, 1)
            most[-1], free = weight, free - count
            continue
        parts = -(-count // rows)
        place[weight] = (len(least), parts)
        least += [weight] * parts
        most += [weight] * parts
        free = rows - count if parts == 1 else 0
    return place, least, most


def _weighed(middle: np.ndarray, place: dict[int, tuple[int, int]] | None):
    """(weight) of batches of signatures, that is how many slots lie above the middle; with ``place``, (block, weight, n, signature)."""

    def run(batches):
        for batch in batches:
            weight = (_slots(batch.column("signature")) > middle).sum(1).astype(np.int32)
            if place is None:
                yield pa.RecordBatch.from_arrays([pa.array(weight)], ["weight"])
            elif len(weight):
                first, parts = np.array([place[w] for w in weight.tolist()]).T
                block = first + (mixed64(batch.column("n").to_numpy().astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(weight), batch.column("n"), batch.column("signature")], ["block", "weight", "n", "signature"])

    return run


def _compared_blocks(uri: str, least: list[int], most: list[int], differing: int, made):
    """``made`` of each pair of blocks (i, j) that may have similar signatures; they are read from the written table."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)

        def block(k):
            found = pq.read_table(f"{base}/block={k}", columns=["n", "weight", "signature"], filesystem=fs, partitioning=None).combine_chunks()
            return _Block(found.column("n").to_numpy(), found.column("weight").to_numpy(), _slots(found.column("signature").combine_chunks()))

        for batch in batches:
            for i, j in zip(*(batch.column(c).to_pylist() for c in ("i", "j"))):
                if least[j] - most[i] <= differing:
                    a = block(i)
                    yield from made(a, a if i == j else block(j), differing)

    return run


def _similar_signatures(distinct: DataFrame, num_perm: int, threshold: float, forest: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(p, q, matches) for similar ones of a written table (n, signature) of distinct signatures, each pair once; or links (a, b) that connect the same.  With it, the table of blocks.

    The result is that of comparing all pairs, which is what is done: shared slots are too common for buckets to part
    what isn't similar.  Signatures are weighed by their slots above a middle, so that similar ones have nearly
    equal weights, and stay in blocks of near weights in the shared folder.  A task reads two blocks and
    compares words of bits, 64 slots at once; its memory is that of two blocks, whatever the table.
    """
    spark, differing = distinct.sparkSession, num_perm - needed_matches(num_perm, threshold)
    kind, made = ("a long, b long", _forest_rows) if forest else ("p long, q long, matches int", _pair_rows)
    total = distinct.count()
    if differing < 0 or not total:
        return spark.createDataFrame([], kind), None
    middle = np.median([r.signature for r in distinct.select("signature").limit(1024).collect()], axis=0).astype(np.uint64)
    counts = distinct.select("signature").mapInArrow(_weighed(middle, None), "weight int").groupBy("weight").count().collect()
    cores = spark.sparkContext.defaultParallelism
    place, least, most = _cut({r["weight"]: r["count"] for r in counts}, max(1, min(BLOCK, max(1024, total // cores))))
    rows = distinct.select("n", "signature").mapInArrow(_weighed(middle, place), "block long, weight int, n long, signature array<bigint>")
    kept = written(rows.repartition("block"), "signature-blocks", by="block")
    blocks = len(least)
    tasks = spark.range(blocks * blocks).select(F.expr(f"id div {blocks}").alias("i"), F.expr(f"id % {blocks}").alias("j")).where("i <= j")
    tasks = tasks.repartition(max(1, min(blocks * (blocks + 1) // 2, max(16 * cores, blocks * blocks // 64))))
    return tasks.mapInArrow(_compared_blocks(kept.written_to, least, most, differing, made), kind), kept


def _numbered(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows with the number of their signature, the distinct signatures), both written.

    Copies share a signature, so only distinct ones are compared.  The number is a SHA-256 of it.
    """
    rows = written(signed.withColumn("s", F.sha2(F.array_join("signature", ","), 256)), "signatures")
    distinct = rows.groupBy("s").agg(F.first("signature").alias("signature")).withColumn("n", F.monotonically_increasing_id())
    return rows, written(distinct, "distinct-signatures")


def similar_pairs(texts: DataFrame, key: str, order: str, text: str, *, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, ngram_size: int = NGRAM_SIZE, seed: int = 42) -> DataFrame:
    """(a, b, matches, similarity) of all pairs at the threshold or above, a before b by ``order``.

    ``order`` must tell all rows apart, as the place in an ordered corpus does.
    """
    _checked(num_perm, ngram_size, threshold)
    signed = signatures(texts.select(F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("id"), F.col(text).alias("t")), "id", "t", num_perm=num_perm, ngram_size=ngram_size, seed=seed)
    rows, distinct = _numbered(signed)
    near = _similar_signatures(distinct, num_perm, threshold)[0]
    own = rows.groupBy("s").count().where("count > 1").join(distinct.select("s", "n"), "s").select(F.col("n").alias("p"), F.col("n").alias("q"), F.lit(num_perm).alias("matches"))
    if threshold != threshold:  # not a number: nothing reaches it
        own = own.where(F.lit(False))
    numbered = written(rows.join(distinct.select("s", "n"), "s").select("n", "id"), "numbered-rows")
    side = lambda c: sized_broadcast(numbered, 64).select(F.col("n").alias(c), F.col("id").alias(f"id_{c}"))
    both = near.union(own).join(side("p"), "p").join(side("q"), "q").where((F.col("p") != F.col("q")) | (F.col("id_p") < F.col("id_q")))
    first, second = F.least("id_p", "id_q"), F.greatest("id_p", "id_q")
    share = F.bround(F.col("matches") / F.lit(num_perm), 4)
    return both.select(first["k"].alias("a"), second["k"].alias("b"), F.col("matches").cast("bigint").alias("matches"), share.alias("similarity"))


def near_duplicate_groups(texts: DataFrame, key: str, text: str, *, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, ngram_size: int = NGRAM_SIZE, seed: int = 42) -> DataFrame:
    """(group_min, member, group_size): connected components of the similar pairs, of two members or more.

    Copies hang together through their signature, so a group of many needs no square of pairs.
    """
    _checked(num_perm, ngram_size, threshold)
    rows, distinct = _numbered(signatures(texts, key, text, num_perm=num_perm, ngram_size=ngram_size, seed=seed).withColumnRenamed(key, "member"))
    rows = rows.select("member", "s")
    if needed_matches(num_perm, threshold) == 0:
        labelled = rows.withColumn("component", F.lit(""))
    elif threshold != threshold:
        labelled = rows.withColumn("component", F.col("member").cast("string"))
    else:
        edges, blocks = _similar_signatures(distinct, num_perm, threshold, forest=True)
        label = written(connected_components(edges), "labels")
        if blocks is not None:
            discard(blocks)
        named = label.join(distinct.select("s", "n"), label.node == F.col("n")).select("s", F.col("component").cast("string").alias("component"))
        labelled = rows.join(named, "s", "left").select("member", F.coalesce("component", "s").alias("component"))
    groups = labelled.groupBy("component").agg(F.min("member").alias("group_min"), F.count("*").alias("group_size")).where("group_size > 1")
    return labelled.join(groups, "component").select("group_min", "member", "group_size")


@dataclass
class TextDedupResult:
    #: "a|b" to the rounded share of equal slots
    similarity_scores: dict[str, float] = field(default_factory=dict)
    #: the largest first
    near_duplicate_groups: list[list] = field(default_factory=list)


def find_near_duplicates(file_texts: Mapping[str, str], *, spark: SparkSession | None = None, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, ngram_size: int = NGRAM_SIZE) -> TextDedupResult:
    """Groups and scores for a corpus held in a dictionary; a table goes to the two functions above."""
    _checked(num_perm, ngram_size, threshold)
    if not file_texts:
        return TextDedupResult()
    spark = spark or SparkSession.builder.getOrCreate()
    texts = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(file_texts.items())], "o bigint, k string, t string")
    options = {"threshold": threshold, "num_perm": num_perm, "ngram_size": ngram_size}
    pairs = similar_pairs(texts, "k", "o", "t", **options).collect()
    members: dict[str, list[str]] = {}
    for row in near_duplicate_groups(texts, "k", "t", **options).collect():
        members.setdefault(row.group_min, []).append(row.member)
    place = {k: i for i, k in enumerate(file_texts)}
    pairs.sort(key=lambda r: (place[r.a], place[r.b]))
    groups = sorted(map(sorted, members.values()), key=lambda names: (-len(names), names))
    return TextDedupResult({f"{r.a}|{r.b}": r.similarity for r in pairs}, groups)
