import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.functions import shingles
from sievelake.operators import minhash
from sievelake.operators.minhash import MinHasher, find_near_duplicates

ODD = ["", "ab", "   ", "abc", "hello", "ABC ", " x ", "İstanbul ΣΑΣ", "日本語のテキスト", "\x1cq\x85", "a" * 700, "é" * 300 + "z"]


def slot_by_slot(text, k, n, seed=42):
    a, b = shingles.hash_family(k, seed)
    hashes = {shingles.token_hash(g) for g in shingles.ngrams(text, n)}
    return [min((x * h + y) % shingles.PRIME for h in hashes) if hashes else shingles.BLANK_SLOT for x, y in zip(a, b)]


def test_ngrams():
    assert shingles.ngrams("hello") == ["hel", "ell", "llo"]
    assert [shingles.ngrams(t) for t in ("ab", "", "   ", "abc")] == [["ab"], [], [], ["abc"]]
    assert len(shingles.ngrams("abcdefgh", 5)) == 4 and shingles.ngrams("aaaa", 2) == ["aa"] * 3
    assert set(shingles.SPACE) == {chr(c) for c in range(0x110000) if not chr(c).strip()}


def test_columns_equal_single_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "k int, t string")
    for n in (1, 3, 5):
        got = {}
        for r in shingles.ngram_rows(df, "k", "t", n).withColumn("h", shingles.token_hash_column(F.col("gram"))).collect():
            assert r.h == shingles.token_hash(r.gram)
            got.setdefault(r.k, []).append(r.gram)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(shingles.ngrams(t, n)) for k, t in enumerate(ODD) if t.strip()}
        signed = {r.k: r.signature for r in minhash.signatures(df, "k", "t", num_perm=20, ngram_size=n, seed=7).collect()}
        assert signed == {k: slot_by_slot(t, 20, n, 7) for k, t in enumerate(ODD)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20), st.integers(0, 10**6))
def test_permutation_arithmetic(hashes, seed):
    a, b = shingles.hash_family(5, seed)
    a, b = (*a, shingles.PRIME - 1, 1), (*b, shingles.PRIME - 1, 0)
    got = shingles.permuted(np.array(hashes, np.uint64), np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [[(x * h + y) % shingles.PRIME for x, y in zip(a, b)] for h in hashes]


def test_hasher():
    for k in (8, 16, 512):
        assert MinHasher(num_perm=k).signature("some text").num_perm == k
    assert MinHasher(seed=1).signature("abcd") != MinHasher(seed=2).signature("abcd")
    one = MinHasher(num_perm=64)
    assert one.similarity(one.signature("Same Text "), one.signature("same text")) == 1.0
    with pytest.raises(ValueError):
        one.similarity(one.signature("a"), MinHasher(num_perm=8).signature("a"))
    for bad in ({"num_perm": 0}, {"ngram_size": 0}):
        with pytest.raises(ValueError):
            MinHasher(**bad)


def brute(texts, threshold, k, n=3):
    keys = list(texts)
    signed = {x: slot_by_slot(t, k, n) for x, t in texts.items()}
    scores, parent = {}, {x: x for x in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            s = sum(map(int.__eq__, signed[x], signed[y])) / k
            if s >= threshold:
                scores[f"{x}|{y}"] = round(s, 4)
                parent[root(x)] = root(y)
    groups = {}
    for x in keys:
        groups.setdefault(root(x), []).append(x)
    return sorted((sorted(g) for g in groups.values() if len(g) > 1), key=lambda g: (-len(g), g[0])), scores


@pytest.mark.parametrize("threshold,k", [(0.8, 128), (0.5, 16), (1.0, 32), (0.0, 8), (0.3, 7), (float("nan"), 8)])
def test_groups_and_scores_equal_all_pairs(spark, threshold, k):
    rng = random.Random(3)
    texts = {}
    for i in range(24):
        base = rng.choice(list(texts.values()) or ["the quick brown fox jumps over"])
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 6])):
            t.insert(rng.randrange(len(t) + 1), rng.choice("abc é"))
        texts[f"d{rng.randrange(1000)}-{i}"] = rng.choice(["".join(t), "".join(t), f"{rng.random()}", "  "])
    got = find_near_duplicates(texts, threshold=threshold, num_perm=k, spark=spark)
    assert (got.near_duplicate_groups, got.similarity_scores) == brute(texts, threshold, k)


def test_small_corpora_and_bad_arguments(spark):
    assert find_near_duplicates({}).near_duplicate_groups == []
    assert find_near_duplicates({"a": "x"}, spark=spark).similarity_scores == {}
    same = find_near_duplicates({f"f{i}": "identical words here" for i in range(10)}, threshold=0.9, spark=spark)
    assert [len(g) for g in same.near_duplicate_groups] == [10] and len(same.similarity_scores) == 45
    for bad in ({"threshold": 1.5}, {"threshold": -0.1}, {"num_perm": 0}, {"ngram_size": 0}):
        with pytest.raises(ValueError):
            find_near_duplicates({"a": "b"}, **bad)


def test_registered_queries_have_the_slots_and_threshold_of_the_reference(spark, tmp_path):
    from sievelake.plans import catalog

    texts = ["one text about a thing " * 3, "one text about a thing " * 3 + "!", "quite another story", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    signed = catalog.QUERIES["minhash_signature"](spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert len(signed) == 4 and {r["count"] for r in signed} == {128}
    got = sorted(catalog.QUERIES["near_dup_groups"](spark, str(tmp_path)).collect())
    assert got == sorted(catalog.near_dup_groups(spark, str(tmp_path), 128, 0.8).collect())


def test_pairs_of_large_buckets_equal_brute_force(spark, monkeypatch):
    """Buckets that are cut into blocks, and runs of them that are longer than a batch."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(3)
    base = "the quick brown fox jumps over the lazy dog and runs away"
    texts = [base[: rng.randint(40, 57)] + rng.choice(["", " a", " bc"]) + str(i % 40) for i in range(90)] + ["zz" * i for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    hasher = MinHasher(64)
    signed = hasher.many(texts)
    for t in (0.5, 0.9):
        got = {(r.a, r.b): r.matches for r in minhash.similar_pairs(df, "k", "k", "t", threshold=t, num_perm=64).collect()}
        equal = {(i, j): int((signed[i] == signed[j]).sum()) for i in range(99) for j in range(i + 1, 99)}
        assert got == {p: m for p, m in equal.items() if m / 64 >= t}


def alike(count):
    """Distinct texts, all of them similar to each other."""
    base = "the quick brown fox jumps over the lazy dog and runs away from seven other animals " * 2
    return [base + w for w in ("a", "bc", "def", "gh", "i", "jkl", "mno", "pq", "rst", "uv", "wxy", "z", "ab", "cd", "efg", "hi", "jk", "lm", "no", "pqr")[:count]]


def test_groups_need_fewer_links_than_texts(spark, monkeypatch):
    """Links of similar texts grow with the square of the texts; what connects them doesn't."""
    df = spark.createDataFrame(list(enumerate(alike(20))), "k int, t string")
    seen = []
    joined = minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda edges: seen.append(edges.count()) or joined(edges))
    got = minhash.near_duplicate_groups(df, "k", "t").collect()
    assert len(got) == 20 and {(r.group_min, r.group_size) for r in got} == {(0, 20)}
    assert seen[0] < 20


def test_pairs_are_not_shuffled(spark):
    """Neither candidates nor similar pairs are dealt out by their ends, while the ids are few enough for a broadcast."""
    df = spark.createDataFrame(list(enumerate(alike(12))), "k int, t string")
    pairs = minhash.similar_pairs(df, "k", "k", "t")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.partition("Union")[2].partition("MapInArrow")[0] and "band" not in plan and "HashAggregate(keys=[a" not in plan
    assert pairs.count() == 66


def test_blocks_compare_all_pairs():
    """Of signatures of any number of slots, whatever their weights; bits that differ never leave out similar ones."""
    rng = np.random.default_rng(5)
    for num_perm, differing in ((7, 4), (64, 20), (128, 25), (300, 0), (300, 90), (8, 8)):
        slots = rng.integers(0, 2, (90, num_perm)).astype(np.uint64) * rng.integers(0, 2**60, num_perm).astype(np.uint64)
        slots[40:] = slots[rng.integers(0, 40, 50)]
        slots[40:] += (rng.random((50, num_perm)) < 0.1).astype(np.uint64)
        weight = (slots > np.median(slots, axis=0)).sum(1)
        whole = minhash._Block(np.arange(90), weight, slots)
        parts = [minhash._Block(np.arange(90)[k::2], weight[k::2], slots[k::2]) for k in (0, 1)]
        equal = (slots[:, None] == slots[None]).sum(2)
        want = {(i, j): int(equal[i, j]) for i in range(90) for j in range(i + 1, 90) if equal[i, j] >= num_perm - differing}

        def named(a, b):
            return {tuple(sorted((int(a.n[i]), int(b.n[j])))): int(m) for p, q, e in minhash._near(a, b, differing) for i, j, m in zip(p, q, e)}

        assert named(whole, whole) == want
        assert named(parts[0], parts[0]) | named(parts[1], parts[1]) | named(*parts) == want


def test_blocks_by_weight_hold_all_rows():
    for rows, counts in ((10, {0: 3, 2: 4, 3: 25, 4: 1, 9: 30}), (1, {5: 3}), (100, {1: 1, 2: 1})):
        place, least, most = minhash._cut(counts, rows)
        assert place.keys() == counts.keys() and sorted(b for b in {x for f, n in place.values() for x in range(f, f + n)}) == list(range(len(least)))
        assert all(least[b] <= w <= most[b] for w, (f, n) in place.items() for b in range(f, f + n))
        assert all(-(-counts[w] // n) <= rows for w, (f, n) in place.items())


def test_signature_rows_are_made_without_exploding(spark):
    df = spark.createDataFrame([*enumerate(ODD), (None, "abc"), (3, None)], "k int, t string")
    got = minhash.signature_rows(df, "k", "t", num_perm=20)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(k, i, v) for k, t in [*enumerate(ODD), (None, "abc"), (3, "")] for i, v in enumerate(slot_by_slot(t, 20, 3))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["k", "slot", "value"]


def test_many_texts_at_once_have_the_ngrams_and_counts_of_single_texts(monkeypatch):
    """With tables of all possible n-grams, by sorting, and by ranks where a number can't hold one."""
    rng = random.Random(2)
    letters = [chr(c) for c in (0, 32, 97, 98, 99, 0x130, 0x3A3, 0x1F600, 0x10FFFF, 0xD800)]
    for table in (1 << 22, 1):
        monkeypatch.setattr(shingles, "_TABLE", table)
        for n in (1, 2, 3, 4, 5, 30) * 10:
            texts = [None, *("".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 4, 9, 40]))) for _ in range(rng.randrange(8)))][rng.randrange(2) :]
            grams, at, row, count = shingles.packed_ngrams(texts, n)
            names, got = shingles.gram_texts(grams, n), {}
            for a, r, c in zip(at, row, count):
                got.setdefault(int(r), {})[names[a]] = int(c)
            assert len(set(names)) == len(names) and got == {i: dict(Counter(g)) for i, t in enumerate(texts) if t and (g := shingles.ngrams(t, n))}


def test_ngrams_of_single_rows_are_not_shuffled(spark, monkeypatch):
    """Repeated and null keys are summed over their rows; the other keys' n-grams stay where they are."""
    monkeypatch.setattr(shingles, "_CHARACTERS", 50)
    rows = [*enumerate(ODD), (None, "abcabc"), (None, "xabc"), (3, "bcabc"), (3, None), (40, None), (41, "aaaa")]
    df = spark.createDataFrame(rows, "k int, t string")
    want = Counter((k, g) for k, t in rows for g in shingles.ngrams(t or ""))
    got = shingles.ngram_counts(df, "k", "t")
    assert got.columns == ["k", "gram", "cnt"] and Counter({(r.k, r.gram): r.cnt for r in got.collect()}) == want and got.count() == len(want)
    single = shingles.ngram_counts(df.where("k <> 3"), "k", "t")
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and single.count() == len([k for k in want if k[0] not in (None, 3)])


@pytest.mark.parametrize("kept", [2, 1 << 18])
def test_tasks_hand_on_distinct_ngrams(spark, monkeypatch, kept):
    """A task's n-grams meet no others before they are distinct, also where it forgets some."""
    monkeypatch.setattr(shingles, "_CHARACTERS", 50)
    monkeypatch.setattr(shingles, "_KEPT", kept)
    df = spark.createDataFrame([(t,) for t in [*ODD, *ODD, None]], "t string")
    for n in (1, 3, 5):
        found = shingles.distinct_ngrams(df, "t", n)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.gram for r in found.collect()) == sorted({g for t in ODD for g in shingles.ngrams(t, n)})


def test_registered_ngrams_and_hashes_are_found_text_by_text(spark):
    from sievelake.plans import catalog

    for name in ("ngrams", "token_hash"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
