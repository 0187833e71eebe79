"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A Gaussian kernel over document statistics is approximated by random cosine features (Rahimi and
Recht, 2007).  Each partition of the labelled statistics sums its own share of the normal equations,
so only a (D + 1) x (D + 2) matrix leaves a task of ROWS_IN_TASK labelled rows; tasks add these up
before the driver gets a fixed number of them.  The ridge scores of a
held-out fifth of the labels are calibrated by pool-adjacent-violators.

Scale: documents are never shuffled.  The labelled sample is bounded (``max_labels``), and is broadcast
if its counted rows are small; scoring is one narrow pass over the texts.

Defined results
* null, empty or blank text: no evidence; score and probability are null and the document is rejected;
* null doc_id: scored like any other (it can't be labelled); repeated rows are each scored alike, to
  the last bit; a very long text is one row of statistics like any other;
* label rows with a null in doc_id or quality, or a quality other than 0 and 1, are ignored; repeated
  label rows count once; contradicting rows both count;
* no usable label, or labels of one kind only: nothing to learn, so score and probability are null
  and every document that isn't blank is kept;
* other columns, whatever their names, are passed through by :func:`filter_quality` and unused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh, sized_broadcast, whole_id, written
from .kernels import buffers, row_bounds, shingles, slices, span_hashes, words

FEATURES = 256
RIDGE = 1e-3
MAX_LABELS = 100_000
THRESHOLD = 0.5
BINS = 1024
ROWS_AT_ONCE = 512
#: Labelled rows whose sums leave a task as one vector, and how many vectors the driver adds up at most.
ROWS_IN_TASK = 50_000
VECTORS = 16

_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*|@^~<>{}[]\\=+_/"]] = True
_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _ALNUM[_a:_b] = True
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "digit", "punctuation", "odd_symbols", "shouting",
    "multibyte", "lines_per_word", "stops_per_word", "distinct_words", "distinct_pairs", "top_word", "repeats_previous",
    "wordless_tokens", "longest_word", "capitalised", "plain_words",
]


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the number of distinct hashes, the count of the most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(hashes):
        key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        runs, rows = np.diff(np.r_[at, len(key)]), (key[at] >> np.uint64(40)).astype(np.int64)
        distinct += np.bincount(rows, minlength=n)
        np.maximum.at(top, rows, runs)
    return distinct, top


def _slice_statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n, size = len(off) - 1, np.diff(off).astype(np.float64)
    start, end, row = words(data, off, _NOT_SPACE)
    hashes = span_hashes(data, start, end)
    length = (end - start).astype(np.float64)
    count = np.bincount(row, minlength=n).astype(np.float64)
    some, many = np.maximum(count, 1), np.maximum(size, 1)
    mean = np.bincount(row, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, n) / some - mean**2, 0))
    distinct, top = _distinct(hashes, row, n)
    pair, pair_row, _ = shingles(hashes, row, 2)
    pairs, _ = _distinct(pair, pair_row, n)
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    alnum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ALNUM[data], out=alnum[1:])
    letters = alnum[end] - alnum[start]
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    upper = (data >= 65) & (data <= 90)
    cols = [
        np.log1p(size), np.log1p(count), np.minimum(mean, 40), np.minimum(spread, 40), _per_row(upper, off) / many,
        _per_row((data >= 48) & (data <= 57), off) / many, _per_row(~_ALNUM[data] & _NOT_SPACE[data], off) / many,
        _per_row(_ODD[data], off) / many, _per_row((data == 33) | (data == 63), off) / many, _per_row(data >= 128, off) / many,
        np.minimum(_per_row(data == 10, off) / some, 1), _per_row(data == 46, off) / some, distinct / some,
        pairs / np.maximum(count - 1, 1), top / some, np.bincount(row, again, n) / some, np.bincount(row, letters == 0, n) / some,
        np.log1p(longest), np.bincount(row, upper[start], n) / some, np.bincount(row, letters == length, n) / some,
    ]
    return np.stack(cols, 1)


def statistics(column) -> np.ndarray:
    """One row of STATISTICS for each text of an Arrow column; a null counts as an empty text."""
    data, off = buffers(column)
    parts = [_slice_statistics(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression: knots (x, value) of the nondecreasing fit; x must be sorted."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a, a, b, c])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            lo, hi = blocks[-2], blocks.pop()
            blocks[-1] = [lo[0], hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / (lo[3] + hi[3]), lo[3] + hi[3]]
    return np.array([v for b in blocks for v in b[:2]]), np.repeat([b[2] for b in blocks], 2)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        out = np.ones((len(z), len(self.phases) + 1))
        turn = np.tile(self.phases, (len(z), 1))
        for j, row in enumerate(self.weights):  # a matrix product rounds a row by the place that it has in its batch
            turn += z[:, j, None] * row
        out[:, :-1] = np.cos(turn) * np.sqrt(2 / len(self.phases))
        return out

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Equal rows have equal scores, in whatever batches they are."""
        parts = [(self.features(stats[i : i + ROWS_AT_ONCE]) * self.coefficients).sum(1) for i in range(0, len(stats), ROWS_AT_ONCE)]
        return np.concatenate(parts or [np.zeros(0)])

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, *self.knots)


def _stats_udf():
    @F.arrow_udf("array<double>")
    def stats(text: pa.Array) -> pa.Array:
        s = statistics(text)
        return pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1], s.ravel())

    return stats


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _summed(df: DataFrame, per_partition, width: int, rows: int) -> np.ndarray:
    """Sum of per_partition(stats, label) over partitions of the ``rows`` rows; the driver gets VECTORS vectors at most."""

    def local(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += per_partition(_matrix(batch.column("stats")), batch.column("label").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    def added(batches):
        total = np.zeros(width)
        for batch in batches:
            total += _matrix(batch.column("v")).sum(0) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    tasks = max(1, -(-rows // ROWS_IN_TASK))
    parts = df.select("stats", "label").repartition(tasks).mapInArrow(local, "v array<double>")
    if tasks > VECTORS:
        parts = parts.repartition(VECTORS).mapInArrow(added, "v array<double>")
    return np.sum([np.array(r.v) for r in parts.collect()], axis=0)


def fit_quality(docs: DataFrame, labels: DataFrame, *, features: int = FEATURES, ridge: float = RIDGE, max_labels: int = MAX_LABELS, seed: int = 11) -> QualityModel | None:
    """Fit on the labelled documents; ``max_labels`` bounds the labelled sample (lowest hashes of doc_id)."""
    bounded_batches(docs.sparkSession)
    usable = labels.select(whole_id().alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sample = written(usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_labels), "labels")
    joined = docs.select(whole_id().alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").join(sized_broadcast(sample, 40), "id")
    seen = written(joined.select("label", (F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)) == 0).alias("held"), _stats_udf()("text").alias("stats")), "quality-labelled")
    d = len(STATISTICS)
    discard(sample)
    fit, held = seen.where("not held"), seen.where("held")
    n, rest = fit.count(), held.count()
    sums = _summed(fit, lambda s, y: np.concatenate([s.sum(0), (s**2).sum(0), [y.sum()]]), 2 * d + 1, n)
    if not n or not 0 < sums[-1] < n:
        discard(seen)
        return None
    mean = sums[:d] / n
    scale = np.maximum(np.sqrt(np.maximum(sums[d : 2 * d] / n - mean**2, 0)), 1e-6)
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (np.zeros(1), np.zeros(1)))
    k = features + 1

    def normal(s, y):
        total = np.zeros((k, k + 1))
        for i in range(0, len(s), ROWS_AT_ONCE):
            z = model.features(s[i : i + ROWS_AT_ONCE])
            total[:, :k] += z.T @ z
            total[:, k] += z.T @ y[i : i + ROWS_AT_ONCE]
        return total.ravel()

    eq = _summed(fit, normal, k * (k + 1), n).reshape(k, k + 1)
    penalty = np.full(k, ridge * n / features)
    penalty[-1] = 0
    model.coefficients = np.linalg.solve(eq[:, :k] + np.diag(penalty + 1e-9), eq[:, k])

    def binned(s, y):
        at = np.clip(((model.scores(s) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    counts = _summed(held, binned, 2 * BINS, rest) if rest else _summed(fit, binned, 2 * BINS, n)  # too few labels to hold any out
    discard(seen)
    used = np.flatnonzero(counts[:BINS])
    model.knots = pool_adjacent((used + 0.5) / BINS * 3 - 1, counts[BINS:][used] / counts[:BINS][used], counts[:BINS][used])
    return model


def _scored(text, model: QualityModel | None):
    @F.arrow_udf("struct<score double, probability double>")
    def score(column: pa.Array) -> pa.Array:
        s = model.scores(statistics(column))
        return pa.StructArray.from_arrays([pa.array(s), pa.array(model.probabilities(s))], ["score", "probability"])

    if model is None:
        return F.lit(None).cast("struct<score double, probability double>")
    return score(text)


def _blank(text):
    return F.coalesce(F.length(F.btrim(text, F.lit(" \t\n\r\f\v"))), F.lit(0)) == 0


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """(doc_id, score, probability, keep) for every row of ``docs``."""
    model = fit_quality(docs, labels, **fit)
    text = F.col("text").cast("string")
    found = docs.select(whole_id().alias("doc_id"), _blank(text).alias("blank"), _scored(F.coalesce(text, F.lit("")), model).alias("s"))
    value = lambda c: F.when(~F.col("blank"), F.col(f"s.{c}"))
    return found.select("doc_id", value("score").alias("score"), value("probability").alias("probability"), (~F.col("blank") & F.coalesce(F.col("s.probability") >= threshold, F.lit(True))).alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = fit_quality(docs, labels, **fit)
    (name,) = fresh(docs, "quality")
    text = F.col("text").cast("string")
    scored = docs.where(~_blank(text)).withColumn(name, _scored(F.coalesce(text, F.lit("")), model))
    return scored.where(F.coalesce(F.col(name)["probability"] >= threshold, F.lit(True))).select(*docs.columns)
