import random

import pytest

from sievelake.llm.repeats import repeated_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k):
    docs = {}
    for d, t, *_ in rows:
        docs.setdefault((d, t), (t or "").split())
    seen = {}
    for key, w in docs.items():
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), set()).add(key)
    out = []
    for (d, t), w in docs.items():
        covered = [False] * (len(w) + 1)
        for i in range(len(w) - k + 1):
            if len(seen[tuple(w[i : i + k])]) > 1:
                covered[i : i + k] = [True] * k
        start = None
        for i, c in enumerate(covered):
            if c and start is None:
                start = i
            elif not c and start is not None:
                out.append((d, start, i - start))
                start = None
    return sorted(out, key=str)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    w = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    passages = [w(rng.choice([9, 11, 12, 13, 30, 80])) for _ in range(8)]
    rows = []
    for d in range(n):
        text = w(rng.choice([0, 5, 40, 100]))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            text += p + w(rng.choice([0, 3, 20]))
        if rng.random() < 0.1:
            text += ["run"] * rng.choice([20, 70])
        rows.append((d, " ".join(text), "en", "s", 1))
        if rng.random() < 0.15:
            rows.append((d + 1000, rng.choice(rows)[1], "en", "s", 1))
    return rows


@pytest.mark.parametrize("seed,vocabulary", [(1, 5000), (2, 3), (3, 40)])
def test_against_brute_force(spark, seed, vocabulary):
    rows = corpus(seed, 60, vocabulary)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = repeated_passages(docs, min_words=12, gram=5, shard_words=2000, block_items=300, held_items=500)
    assert sorted(((r.doc_id, r.start, r.words) for r in got.collect()), key=str) == brute(rows, 12)


@pytest.mark.parametrize("shard_words", [1, 400])
def test_crowded_anchors(spark, shard_words):
    rows = corpus(4, 50, 20)
    got = repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4), min_words=12, gram=5, shard_words=shard_words)
    assert sorted(((r.doc_id, r.start, r.words) for r in got.collect()), key=str) == brute(rows, 12)


def test_defined_cases(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(51))
    rows = [(None, "x " + passage, "en", "s", 1), (1, passage + "\n y", "en", "s", 1), (1, passage + "\n y", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n ", "en", "s", 0), (5, "again " * 60000, "en", "s", 1), (6, f"{rng.random()} " * 30 + passage.replace("p", "q") * 2, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as d", "2 as ctx")
    assert sorted(((r.doc_id, r.start, r.words) for r in repeated_passages(docs).collect()), key=str) == [(1, 0, 51), (None, 1, 51)]
    assert repeated_passages(docs.where("doc_id = 1")).collect() == []
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
