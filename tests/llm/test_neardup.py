import random

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import kernels, neardup
from sievelake.llm.kernels import buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, width=3):
    import re

    w = [x.lower() for x in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 12])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 30, 80, 300])))
        rows.append((d, text, "en", "s", len(text)))
    return rows


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(0)
    t, pool = 160, rng.integers(0, 2**63, 4000).astype(np.uint64)
    for size in (1, 3, 50, 1500):
        for share in (0.0, 0.5, 0.9):
            both = pool[: int(size * share)]
            rest = pool[int(size * share) :]
            a, b = np.r_[both, rest[: size - len(both)]], np.r_[both, rest[size : 2 * size - len(both)]]
            s = neardup.sketch(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2, t)
            assert (s != neardup._EMPTY).all()
            assert abs((s[0] == s[1]).mean() - len(both) / (2 * size - len(both))) < 0.15


def test_shingles_are_sets_of_word_runs():
    texts = ["a b c a b c", "One two", "one TWO", "", None, "é x", "...", "a b c d"]
    data, off = buffers(pa.array(texts))
    h, row = neardup.document_shingles(data, off, 3)
    assert np.bincount(row, minlength=8).tolist() == [len(shingle_set(t)) for t in texts]
    assert h[row == 1].tolist() == h[row == 2].tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = corpus(seed)
    sets = [shingle_set(r[1]) for r in rows]
    true = {(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= neardup.THRESHOLD}
    group = {r.doc_id: r.group_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    caught = {(i, j) for i, j in true if i in group and group[i] == group.get(j)}
    assert len(caught) >= 0.9 * len(true)
    # every grouped document is joined to its group by a chain of true pairs
    reach = {i: i for i in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for i, j in true:
            low = min(reach[i], reach[j])
            if reach[i] != low or reach[j] != low:
                reach[i] = reach[j] = low
                changed = True
    assert all(reach[d] == reach[g] for d, g in group.items())


def test_defined_cases(spark):
    words = " ".join("q%d" % i for i in range(200))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (None, words + " x", "en", "s", 1), (2, words.upper(), "de", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "?!", "en", "s", 2), (6, "?!", "en", "s", 2), (7, "alone", "en", "s", 5), (8, "z " * 40000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as `__ID`", "2 as th")
    assert sorted((str(r.doc_id), r.group_id, r.kept) for r in neardup.near_duplicates(docs).collect()) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", 1, False)]
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(empty).collect() == [] and neardup.drop_near_duplicates(empty).collect() == []


def test_leaders_across_batches():
    key = np.array([1, 2, 2, 2, 3, 4, 4, 5])
    node = np.array([9, 1, 2, 3, 5, 6, 7, 8])
    for cut in range(len(key)):
        for cut2 in range(cut, len(key)):
            batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(node[a:b])], ["key", "node"]) for a, b in ((0, cut), (cut, cut2), (cut2, len(key)))]
            got = [tuple(r.values()) for b in kernels.sorted_leaders(batches) for r in b.to_pylist()]
            assert got == [(2, 1, 1), (2, 2, 1), (2, 3, 1), (4, 6, 6), (4, 7, 6)]
