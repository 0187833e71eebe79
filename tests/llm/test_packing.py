import random
from collections import defaultdict

import pytest

from sievelake.llm.packing import pack, plan_packing


def check_plan(counts, capacity):
    plan = plan_packing(counts, capacity)
    import numpy as np

    filled = defaultdict(list)
    for length, n in counts.items():
        if n:
            seq, off = plan.place(np.full(n, length), np.arange(n))
            for s, o in zip(seq, off):
                filled[int(s)].append((int(o), length))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][0] + spans[-1][1] <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sorted(filled) == list(range(plan.sequences))
    return plan.sequences, filled


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_item_and_is_near_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    bins, _ = check_plan(counts, capacity)
    assert bins >= -(-sum(x * n for x, n in counts.items()) // capacity)
    assert bins <= best_fit_decreasing(counts, capacity) * 1.1 + 1


def test_exact_complements_are_consumed():
    _, filled = check_plan({60: 2, 40: 1, 30: 1, 10: 1}, 100)  # 60+40 and 60+30+10
    assert sorted(sorted(n for _, n in v) for v in filled.values()) == [[10, 30, 60], [40, 60]]
    _, filled = check_plan({70: 1, 5: 1, 10: 1, 15: 1}, 100)  # a triple
    assert len(filled) == 1


def test_rows(spark):
    rng = random.Random(3)
    rows = [(i if i % 7 else None, " ".join(["w"] * rng.choice([0, 1, 5, 33, 64, 65, 200])), "en", "s", 1) for i in range(120)]
    rows += [(1, "a b c", "en", "s", 1)] * 3 + [(5, None, None, None, None), (6, " \n\t ", "en", "s", 1), (7, "x " * 5000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, sequence string, offset long")
    out = pack(docs, capacity=64).collect()
    assert out[0].asDict().keys() == {"doc_id", "start", "length", "sequence", "offset"}
    words = defaultdict(int)
    for d, t, *_ in rows:
        words[d] += len((t or "").split())
    got, bins = defaultdict(int), defaultdict(list)
    for r in out:
        got[r.doc_id] += r.length
        bins[r.sequence].append((r.offset, r.length))
    assert dict(got) == {d: n for d, n in words.items() if n}
    for spans in bins.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 64
    spans = sorted((r.start, r.length) for r in out if r.doc_id == 7 and r.length)
    assert sum(n for _, n in spans) == 5000 + sum(len((t or "").split()) for d, t, *_ in rows[:-1] if d == 7)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
