import random

import numpy as np
import pytest

from sievelake.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = {"en": "the of and ing tion", "de": "der und sch keit", "fr": "le eaux ment é", "es": "los ción ñó ez"}


def corpus(seed=4, n=200):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(["en", "en", "en", "de", "fr", "es"])
        mixed = rng.choice(list(VOCAB)) if rng.random() < 0.2 else lang
        pick = lambda l: "".join(rng.choice(VOCAB[l].split()) for _ in range(2))
        text = " ".join(pick(lang if rng.random() < 0.6 else mixed) for _ in range(rng.choice([3, 40, 200])))
        rows.append((d, text, lang, "s", len(text)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(d, 1, 0) for d in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in mixing.mixing_rates(docs, labels).collect()}
    names = sorted(mixing.TARGETS)
    held = [d for d in range(1, 200, 2)]
    assert np.mean([names[int(np.argmax(out[d].posterior))] == rows[d][2] for d in held]) > 0.9
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in out.values())


@pytest.mark.parametrize("min_rate", [0.0, 1.0])
def test_totals_meet_targets(spark, min_rate):
    docs, labels = spark.createDataFrame(corpus(), SCHEMA), spark.createDataFrame([(d, 1, 0) for d in range(200)], "doc_id long, quality int, toxic int")
    out = mixing.mixing_rates(docs, labels, min_rate=min_rate).collect()
    names = sorted(mixing.TARGETS)
    total = sum(r.rate * r.words * np.array(r.posterior) for r in out)
    assert np.abs(total / total.sum() - [mixing.TARGETS[d] for d in names]).max() < 0.02
    assert all(r.rate >= min_rate and abs(r.copies - r.rate) <= 1 for r in out)
    mixed = mixing.mix_documents(docs, labels, min_rate=min_rate)
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {r.doc_id: r.copies for r in out if r.copies}


def test_equals_direct_projected_gradient(spark):
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([0.3] * 3, 50), rng.integers(0, 90, 50)
    table = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(p, n)], "posterior array<double>, words long")
    w = np.array([0.1, 0.2, 0.7])
    rates, now, target = mixing.fit_rates(table, w, total_words=2000.0, rounds=400, tolerance=1e-6)
    r, base = np.ones(50), n @ p
    for _ in range(2000):
        r = np.maximum(0, r - p @ (((n * r) @ p - w * 2000) / base))
    assert np.allclose((n * r) @ p, now, rtol=1e-3, atol=2)
    assert np.abs(now - target).max() < 2


def test_defined_cases(spark):
    rows = [(None, "the of and", "en", "s", 1), (1, None, None, None, None), (2, "", "de", "s", 0), (3, "der und", "de", "s", 1), (3, "der und", "de", "s", 1), (4, "le " * 50000, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as __RATE", "2 as posterior")
    none = spark.createDataFrame([(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mixing_rates(docs, none).collect()
    assert len(out) == 6 and [r.rate for r in out if not r.words] == [1.0, 1.0]
    assert mixing.mix_documents(docs, none, min_rate=1.0).columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixing_rates(empty, none).collect() == [] and mixing.mix_documents(empty, none).collect() == []
    with pytest.raises(ValueError):
        mixing.mixing_rates(docs, none, {"en": -1.0})
