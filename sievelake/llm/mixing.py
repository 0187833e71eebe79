"""Mixing sources to target weights with soft domain membership.

A naive Bayes classifier over hashed words, fitted on the documents of the labelled table, gives each
document a posterior over the domains (the values of ``domain``, such as its language).  A document
counts for all its domains: n words with posterior p add n * p[d] to the total of domain d.  Rates r,
at least ``min_rate`` (0: nonnegative), are fitted by projected gradient descent on

    sum over d of (sum over i of r[i] n[i] p[i, d]  -  target[d]) ** 2 / (sum over i of n[i] p[i, d])

from r = 1.  In the metric of n the Lipschitz constant is at most 1, so the step is 1.  A document's
rate is a function of its posterior and of the residuals of the rounds so far, so each round is one
aggregation that replays these few numbers; no table of rates is kept.

Scale: texts are read for the fit (a bounded labelled sample, ``max_labels``), once for the totals
and once to apply the rates, and are never shuffled.  A round reads about 50 bytes a document.

Defined results
* null, empty and wordless texts have no words: their posterior is the prior, their rate 1;
* labelled rows with a null doc_id, and documents with a null or unlisted domain, don't train; with
  nothing to train on, posteriors are uniform;
* null doc_id and repeated rows are rated like any other, repeated rows alike;
* a domain of target weight 0 is allowed; one without any words is left as far from its target as it is;
* an empty table gives no rows; :func:`mix_documents` passes all columns through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, whole_id, written
from .kernels import buffers, slices, span_hashes, words

#: Shares of all words that each language should have.
TARGETS = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14}
BITS = 14
EVIDENCE = 25.0
MAX_LABELS = 100_000
ROUNDS = 60
TOLERANCE = 1e-4


def _buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = words(data, off)
    return (span_hashes(data, start, end) >> np.uint64(64 - BITS)).astype(np.int64), row


@dataclass
class DomainModel:
    domains: list[str]
    log_prior: np.ndarray
    log_word: np.ndarray  # (2**BITS, domains)
    evidence: float

    def posteriors(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each text, number of its words)."""
        data, off = buffers(column)
        post, count = [np.zeros((0, len(self.domains)))], [np.zeros(0)]
        for a, b in slices(off):
            bucket, row = _buckets(data[off[a] : off[b]], off[a : b + 1] - off[a])
            n = np.bincount(row, minlength=b - a).astype(float)
            total = np.stack([np.bincount(row, self.log_word[:, d][bucket], b - a) for d in range(len(self.domains))], 1)
            score = self.log_prior + total * (np.minimum(n, self.evidence) / np.maximum(n, 1))[:, None]
            e = np.exp(score - score.max(1, keepdims=True))
            post.append(e / e.sum(1, keepdims=True))
            count.append(n)
        return np.concatenate(post), np.concatenate(count)


@dataclass
class Rates:
    """A document's rate from its posterior: projected steps along the residuals of all rounds."""

    residuals: list[np.ndarray] = field(default_factory=list)
    min_rate: float = 0.0

    def __call__(self, post: np.ndarray, count: np.ndarray) -> np.ndarray:
        r = np.ones(len(post))
        for e in self.residuals:
            r = np.maximum(self.min_rate, r - post @ e)
        return np.where(count > 0, r, 1.0)


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], *, domain: str = "lang", max_labels: int = MAX_LABELS, evidence: float = EVIDENCE) -> DomainModel:
    ids = labels.select(whole_id().alias("id")).where("id is not null").distinct()
    sample = ids.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    index = {d: i for i, d in enumerate(domains)}
    rows = docs.select(whole_id().alias("id"), F.col("text").cast("string").alias("text"), F.col(domain).cast("string").alias("domain"))
    rows = rows.where(F.col("text").isNotNull() & F.col("domain").isin(domains)).join(F.broadcast(sample), "id").select("text", "domain")

    def counts(batches):
        total = np.zeros((len(domains), 1 << BITS), np.int64)
        for batch in batches:
            data, off = buffers(batch.column("text"))
            cls = np.array([index[d] for d in batch.column("domain").to_pylist()], np.int64)
            for a, b in slices(off):
                bucket, row = _buckets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                total += np.bincount((cls[a + row] << BITS) | bucket, minlength=total.size).reshape(total.shape)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "n"])

    found = np.full((len(domains), 1 << BITS), 0.5)
    for row in rows.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most domains * 2**BITS rows
        found.flat[row.cell] += row.n
    return DomainModel(domains, np.full(len(domains), -np.log(len(domains))), np.log(found / found.sum(1, keepdims=True)).T.copy(), evidence)


def _posterior(model: DomainModel, text):
    @F.arrow_udf("struct<posterior array<double>, words bigint>")
    def posterior(column: pa.Array) -> pa.Array:
        p, n = model.posteriors(column)
        lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())
        return pa.StructArray.from_arrays([lists, pa.array(n.astype(np.int64))], ["posterior", "words"])

    return posterior(text)


def _totals(table: DataFrame, rates: Rates, d: int) -> np.ndarray:
    def part(batches):
        total = np.zeros(2 * d)
        for batch in batches:
            n = batch.column("words").to_numpy(zero_copy_only=False).astype(float)
            p = batch.column("posterior").flatten().to_numpy().reshape(len(n), d)
            total[:d] += (n * rates(p, n)) @ p
            total[d:] += n @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"v{i}" for i in range(2 * d)])

    schema = ", ".join(f"v{i} double" for i in range(2 * d))
    row = table.select("posterior", "words").mapInArrow(part, schema).agg(*(F.sum(f"v{i}") for i in range(2 * d))).first()
    return np.array([x or 0.0 for x in row])


def fit_rates(table: DataFrame, weights: np.ndarray, *, total_words: float | None = None, min_rate: float = 0.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[Rates, np.ndarray, np.ndarray]:
    """(rates, totals reached, targets) for a table of (posterior, words).

    ``total_words`` None: the smallest total for which no domain has to shrink.
    """
    d, rates = len(weights), Rates([], min_rate)
    both = _totals(table, rates, d)
    now, base = both[:d], both[d:]
    if total_words is None:
        total_words = max((base[weights > 0] / weights[weights > 0]).tolist() or [0.0])
    target = weights * total_words
    for _ in range(rounds):
        if np.abs(now - target).max(initial=0) <= tolerance * max(total_words, 1e-9):
            break
        rates.residuals.append(np.where(base > 0, (now - target) / np.maximum(base, 1e-9), 0.0))
        last, now = now, _totals(table, rates, d)[:d]
        if np.abs(now - last).max(initial=0) <= 1e-2 * tolerance * max(total_words, 1e-9):
            break  # at the least-squares optimum, short of targets that can't be met
    return rates, now, target


def _checked(targets: dict[str, float]) -> tuple[list[str], np.ndarray]:
    domains, weights = sorted(targets), np.array([targets[d] for d in sorted(targets)], float)
    if not len(weights) or (weights < 0).any() or not weights.sum():
        raise ValueError("targets must be nonnegative and not all zero")
    return domains, weights / weights.sum()


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, domain: str = "lang", total_words: float | None = None, min_rate: float = 0.0, **fit) -> DataFrame:
    """(doc_id, words, posterior, rate, copies): copies is the rate rounded up or down by a hash of the row."""
    domains, weights = _checked(targets)
    model = fit_domains(docs, labels, domains, domain=domain, **fit)
    text = F.col("text").cast("string")
    scored = docs.select(whole_id().alias("doc_id"), F.xxhash64("doc_id", text).alias("h"), _posterior(model, text).alias("s")).select("doc_id", "h", "s.*")
    table = written(scored, "posteriors")
    rates, *_ = fit_rates(table, weights, total_words=total_words, min_rate=min_rate)

    @F.arrow_udf("double")
    def rate(posterior: pa.Array, count: pa.Array) -> pa.Array:
        n = count.to_numpy(zero_copy_only=False)
        return pa.array(rates(posterior.flatten().to_numpy().reshape(len(n), -1), n))

    return table.withColumn("rate", rate("posterior", "words")).select("doc_id", "words", "posterior", "rate", _copies(F.col("rate"), F.col("h")).alias("copies"))


def _copies(rate, h):
    return F.floor(rate + (F.pmod(F.xxhash64(F.lit("copies"), h), F.lit(1 << 30)) + 0.5) / float(1 << 30)).cast("int")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, domain: str = "lang", total_words: float | None = None, min_rate: float = 0.0, **fit) -> DataFrame:
    """``docs`` with each row repeated by its copies (none: left out), with all its columns."""
    domains, weights = _checked(targets)
    model = fit_domains(docs, labels, domains, domain=domain, **fit)
    text = F.col("text").cast("string")
    table = written(docs.select(_posterior(model, text).alias("s")).select("s.*"), "posteriors")
    rates, *_ = fit_rates(table, weights, total_words=total_words, min_rate=min_rate)
    discard(table)

    @F.arrow_udf("double")
    def rate(column: pa.Array) -> pa.Array:
        return pa.array(rates(*model.posteriors(column)))

    r, c = fresh(docs, "rate", "copy")
    rated = docs.withColumn(r, rate(text))
    copies = _copies(F.col(r), F.xxhash64("doc_id", text))
    return rated.withColumn(c, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
