import random

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        words = ["".join(rng.choice(["the", "on", "er", "ing", "é"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([20, 80, 300]))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.choice(["junk", "shout", "loop"])
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words] if kind == "junk" else [w.upper() + "!!" for w in words] if kind == "shout" else [w for w in words[:9] for _ in range(9)]
        rows.append((d, " ".join(words) + ".", "en", "s", 1))
        labels.append((d, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = corpus()
    train, held = [x for x in labels if x[0] % 2], {d: q for d, q, _ in labels if d % 2 == 0}
    out = quality.score_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(train, LABELS)).collect()
    got = [r for r in out if r.doc_id in held]
    assert np.mean([r.keep == bool(held[r.doc_id]) for r in got]) > 0.93
    by_score = sorted((r.score, r.probability) for r in out)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(by_score, by_score[1:])) and 0 <= by_score[0][1] <= by_score[-1][1] <= 1
    kept = quality.filter_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(train, LABELS)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in out if r.keep)


def test_normal_equations_equal_ridge_on_all_rows(spark):
    rows, labels = corpus(120)
    docs, table = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS)
    model = quality.fit_quality(docs, table, features=32)
    fold = {r[0]: r[1] for r in spark.sql("select id, pmod(xxhash64('fold', id), 5) = 0 from range(0, 120)").collect()}
    fit = [d for d in range(120) if not fold[d]]
    stats = quality.statistics(pa.array([rows[d][1] for d in fit]))
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.maximum(stats.std(0), 1e-6), atol=1e-6)
    z, y = model.features(stats), np.array([labels[d][1] for d in fit], float)
    penalty = np.full(33, quality.RIDGE * len(fit) / 32)
    penalty[-1] = 0
    assert np.allclose(model.coefficients, np.linalg.solve(z.T @ z + np.diag(penalty + 1e-9), z.T @ y), atol=1e-6)


def test_pool_adjacent_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        y, w = rng.random(7), rng.integers(1, 5, 7).astype(float)
        knots, values = quality.pool_adjacent(np.arange(7.0), y, w)
        fit = np.interp(np.arange(7), knots, values)
        # the min-max formula of isotonic regression
        mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])  # noqa: B023, E731
        assert np.allclose(fit, [max(min(mean(a, b) for b in range(i, 7)) for a in range(i + 1)) for i in range(7)])


def test_statistics_of_slices_equal_those_of_single_texts(monkeypatch):
    texts = ["a b a b", "", None, "Ünïcode WORDS 12!", "x " * 500, "line\nline\n"]
    whole = quality.statistics(pa.array(texts))
    single = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, single) and np.isfinite(whole).all()


def test_defined_cases(spark):
    rows, labels = corpus(80)
    rows += [(None, rows[0][1], "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n\t", "en", "s", 3), (903, "word " * 100000, "en", "s", 1), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as `__QUALITY`", "2 as keep", "3 as stats")
    table = spark.createDataFrame([*labels, *labels[:5], (None, 1, 0), (3, None, 0), (4, 7, 0)], LABELS)
    out = quality.score_quality(docs, table).collect()
    assert len(out) == len(rows)
    blank = [r for r in out if r.doc_id in (900, 901, 902)]
    assert len(blank) == 3 and all(r.score is None and r.probability is None and not r.keep for r in blank)
    same = [r.score for r in out if r.doc_id in (None, 0)]
    assert len(same) == 3 and len(set(same)) == 1
    kept = quality.filter_quality(docs, table)
    assert kept.columns == docs.columns and not {900, 901, 902} & {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(77, 0, 0)]])
def test_nothing_to_learn_keeps_all_that_is_not_blank(spark, labels):
    rows, _ = corpus(10)
    out = quality.score_quality(spark.createDataFrame([*rows, (50, "", "en", "s", 0)], SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.score is None and r.keep == (r.doc_id != 50) for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score_quality(empty, spark.createDataFrame(labels, LABELS)).collect() == []


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    model = quality.QualityModel(np.zeros(20), np.ones(20), rng.normal(0, 1, (20, 256)), rng.uniform(0, 6, 256), rng.normal(0, 1, 257), (np.zeros(1), np.zeros(1)))
    stats = rng.normal(0, 1, (1500, 20))
    whole = model.scores(stats)
    for lo, hi in ((0, 1), (3, 10), (511, 514), (700, 1500)):
        assert (model.scores(stats[lo:hi]) == whole[lo:hi]).all()
