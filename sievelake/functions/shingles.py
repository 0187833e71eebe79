"""Character n-grams, token hashes and the MinHash family, for columns and for single texts."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sievelake.storage import sized_broadcast, written

PRIME = (1 << 61) - 1
#: What every slot of a text without tokens holds.
BLANK_SLOT = (1 << 32) - 1
#: The white space that ``str.strip`` removes.
SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def ngrams(text: str, size=3) -> list[str]:
    """Overlapping n-grams of the lowered, stripped text; a shorter text is one token, a blank one none."""
    text = str.strip(text.lower())
    return [text[i : i + size] for i in range(max(1, len(text) - size + 1))] if text else []


def token_hash(token: str) -> int:
    """First four bytes of the token's MD5, little endian."""
    digest = hashlib.md5(token.encode("utf-8", "surrogatepass"), usedforsecurity=False)
    return int.from_bytes(digest.digest()[:4], "little")


_BITS, _PAD = 21, (1 << 21) - 1  # of a code point, and what is none


#: Codes up to which a table of all possible n-grams is looked up; beyond it, n-grams are sorted.
_TABLE = 1 << 22


def packed_ngrams(texts: list[str | None], size: int = 3, ready: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct n-grams; which of them each text has; the text of each; how often it has it): :func:`ngrams` of many texts at once.

    Texts of one order: those of a text lie together.  Up to three characters are packed into a number; longer n-grams
    are rows of code points.  ``ready`` texts are lowered and stripped.
    """
    texts = [t or "" for t in texts] if ready else [str.strip(t.lower()) if t else "" for t in texts]
    length = np.array([len(t) for t in texts], np.int64)
    gap = size - 1
    points = np.frombuffer(("\0" * gap).join(texts).encode("utf-32-le", "surrogatepass") + bytes(4 * gap * bool(texts)), np.uint32)
    start = np.cumsum(length + gap) - length - gap
    # letters are numbered from 1 in the order of their code points; 0 is what lies between texts
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(len(seen), np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    letter = number[points]
    for k in range(gap):
        letter[start + length + k] = 0
    base = len(letters) + 1
    grams = base**size
    if grams * max(1, len(texts)) >= 1 << 62:  # too many for a number: by ranks of the n-grams
        wide = np.ascontiguousarray(np.stack([np.r_[letter[k:], np.zeros(k, np.int64)] for k in range(size)], 1).astype(">u4"))
        names, code = np.unique(wide.view(f"S{4 * size}").ravel(), return_inverse=True) if len(wide) else (np.zeros(0, f"S{4 * size}"), np.zeros(0, np.int64))
        grams = max(1, len(names))
    else:
        names, code = None, letter.copy()
        for k in range(1, size):
            code *= base
            code[: len(code) - k] += letter[k:]
    text = np.repeat(np.arange(len(texts)), length + gap)
    first = np.zeros(len(points), bool)  # places where an n-gram begins
    if gap:
        full, edge = length >= size, np.zeros(len(points) + 1, np.int8)
        edge[start[length > 0]] += 1
        edge[(start + np.where(full, length - gap, 1))[length > 0]] -= 1
        first = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    else:
        first[:] = True
    key = (text * grams + code)[first]
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[at, len(key)])
    key = key[at]
    row = key // grams
    code = key - row * grams
    if grams <= _TABLE:
        has = np.zeros(grams, bool)
        has[code] = True
        distinct = np.flatnonzero(has)
        place = np.zeros(grams, np.int64)
        place[distinct] = np.arange(len(distinct))
        which = place[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    if names is None:
        parts = [distinct // base ** (size - 1 - k) % base for k in range(size)]
    else:
        parts = list(np.ascontiguousarray(names[distinct]).view(">u4").reshape(len(distinct), size).astype(np.int64).T)
    of = np.r_[_PAD, letters]
    columns = [of[p] for p in parts]
    if size <= 3:
        packed = columns[0]
        for c in columns[1:]:
            packed = packed << _BITS | c
    else:
        wide = np.ascontiguousarray(np.stack(columns, 1).astype(">u4"))
        packed = wide.view(f"S{4 * size}").ravel() if len(wide) else np.zeros(0, f"S{4 * size}")
    return packed, which, row, count


def gram_texts(grams: np.ndarray, size: int) -> list[str]:
    """The n-grams that :func:`packed_ngrams` made, as strings."""
    if size <= 3:
        points = [[p for p in (g >> _BITS * k & _PAD for k in range(size - 1, -1, -1)) if p != _PAD] for g in grams.tolist()]
    else:
        wide = np.ascontiguousarray(grams).view(">u4").reshape(len(grams), size).tolist()
        points = [[p for p in g if p != _PAD] for g in wide]
    return ["".join(map(chr, p)) for p in points]


def token_hashes(grams: np.ndarray, size: int) -> np.ndarray:
    """:func:`token_hash` of n-grams that :func:`packed_ngrams` made."""
    return np.array([token_hash(g) for g in gram_texts(grams, size)], np.uint64)


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its bits (Steele, Lea and Flood, 2014)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_family(num_perm: int, seed: int = 42) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Multipliers and offsets of the functions (a * h + b) mod PRIME; all multipliers are drawn first."""
    draw = random.Random(seed)
    a = tuple(draw.randint(1, PRIME - 1) for _ in range(num_perm))
    return a, tuple(draw.randint(0, PRIME - 1) for _ in range(num_perm))


def permuted(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * h + b) mod PRIME for all pairs, in 64 bits: as 2**61 is 1 modulo PRIME, a's high part is rotated."""
    h = hashes.astype(np.uint64)[:, None]
    low = (np.uint64(1) << np.uint64(30)) - np.uint64(1)
    high = (a >> np.uint64(31)) * h
    return ((high >> np.uint64(30)) + ((high & low) << np.uint64(31)) + (a & np.uint64(0x7FFFFFFF)) * h % np.uint64(PRIME) + b) % np.uint64(PRIME)


def stripped(text: Column) -> Column:
    """The lowered text without white space at its ends."""
    return F.btrim(F.lower(text), F.lit(SPACE))


#: A text is cut into pieces first, as finding the i-th character of a string takes i steps.
PIECE = 256


def ngram_rows(texts: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(key, gram) for every n-gram, repeated ones included."""
    ready = texts.select(F.col(key), stripped(F.col(text)).alias("__t")).where("__t <> ''")
    grams = F.greatest(F.length("__t") - (size - 1), F.lit(1))
    ready = ready.select(key, "__t", grams.alias("__n"))
    pieces = ready.select(key, "__t", "__n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((__n - 1) div {PIECE} as int)"))).alias("__p"))
    pieces = pieces.select(key, F.substring("__t", F.col("__p") * PIECE + 1, F.lit(PIECE + size - 1)).alias("__t"), F.least(F.lit(PIECE), F.col("__n") - F.col("__p") * PIECE).alias("__n"))
    places = pieces.select(key, "__t", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
    return places.select(key, F.substring("__t", F.col("__i"), F.lit(size)).alias("gram"))


def token_hash_column(gram: Column) -> Column:
    digest = F.md5(gram)
    swapped = F.concat(*(F.substring(digest, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(swapped, 16, 10).cast("bigint")


#: Characters of the texts whose n-grams a task finds at once (one text may be longer), and distinct n-grams that it keeps.
_CHARACTERS, _KEPT = 1 << 20, 1 << 18


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) for slices of about _CHARACTERS characters."""
    length = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(length, (length[begin - 1] if begin else 0) + _CHARACTERS, "right")))
        yield begin, texts.slice(begin, end - begin).to_pylist()
        begin = end


def _ready(texts: DataFrame, key: str | None, text: str) -> DataFrame:
    return texts.select(*([F.col(key).alias("key")] if key else []), stripped(F.col(text).cast("string")).alias("text")).where("text <> ''")


def ngram_counts(texts: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(key, gram, cnt): how often each n-gram occurs in the texts of a key.

    N-grams are counted text by text where the text is read.  Only counts of keys of several rows, which are
    found by a pass over the keys, are shuffled and summed.
    """
    ready = _ready(texts, key, text)

    def run(batches):
        for batch in batches:
            keys, column = batch.column("key"), batch.column("text")
            for begin, part in _slices(column):
                grams, at, row, count = packed_ngrams(part, size, ready=True)
                names = pa.array(gram_texts(grams, size), pa.string())
                for i in range(0, len(at), 1 << 17):
                    some = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(begin + row[some])), names.take(pa.array(at[some])), pa.array(count[some])], ["key", "gram", "cnt"])

    schema = StructType([ready.schema["key"], StructField("gram", StringType()), StructField("cnt", LongType(), False)])
    several = written(texts.select(F.col(key).alias("several")).groupBy("several").count().where("count > 1").select("several"), "keys-of-several-rows")
    named = ready.mapInArrow(run, schema)
    if several.count():
        same, side = F.col("key").eqNullSafe(F.col("several")), sized_broadcast(several, 64)
        once = ready.join(side, same, "left_anti").mapInArrow(run, schema)
        summed = ready.join(side, same, "left_semi").mapInArrow(run, schema).groupBy("key", "gram").agg(F.sum("cnt").alias("cnt"))
        named = once.union(summed.select("key", "gram", "cnt"))
    return named.withColumnRenamed("key", key)


def distinct_ngrams(texts: DataFrame, text: str, size: int = 3) -> DataFrame:
    """(gram): every n-gram of the texts once.  A task hands on each that it still knows once; it forgets all when they are too many."""

    def run(batches):
        known: set[int | bytes] = set()
        for batch in batches:
            for _, part in _slices(batch.column("text")):
                grams = packed_ngrams(part, size, ready=True)[0]
                new = np.array([g not in known for g in grams.tolist()], bool)
                if new.any():
                    if len(known) > _KEPT:
                        known.clear()
                    known.update(grams[new].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(gram_texts(grams[new], size), pa.string())], ["gram"])

    return _ready(texts, None, text).mapInArrow(run, StructType([StructField("gram", StringType())])).distinct()
