import numpy as np
import pytest

from sievelake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    out = []
    good = [(i, r, np.array(v, np.float64)) for r, (i, v, _) in enumerate(rows) if v and all(e is not None and np.isfinite(e) for e in v)]
    for i, r, v in good:
        near = sorted((float(((v - w) ** 2).sum()), j if j is not None else topk.NO_ID) for j, s, w in good if s != r and len(w) == len(v))
        out += [(i, n + 1, j if j != topk.NO_ID else None, round(d**0.5, 6)) for n, (d, j) in enumerate(near[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,shard_rows", [(1, 10_000), (2, 40), (3, 17)])
def test_against_brute_force(spark, seed, shard_rows):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 3, (5, 6))
    rows = [(i, np.float32(centers[i % 5] + rng.normal(0, 1, 6)).tolist(), 0) for i in range(200)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (0, rows[0][1], 0), (None, rows[3][1], 0)]
    got = topk.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), k=4, shard_rows=shard_rows, leaf_rows=8, query_rows=60).collect()
    assert sorted(((r.vec_id, r.rank, r.neighbor_id, round(r.distance, 6)) for r in got), key=str) == brute([(i, np.float32(v).tolist(), 0) for i, v, _ in rows], 4)


def test_defined_cases(spark):
    rows = [(1, [0.0, 0.0], 0), (2, None, 0), (3, [], 0), (4, [1.0, None], 0), (5, [float("nan"), 0.0], 0), (6, [3.0, 4.0], None), (7, [1.0], 0), (8, [float("inf"), 1.0], 0), (9, [2.0], 0)]
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as shard")
    got = {(r.vec_id, r.rank, r.neighbor_id, r.distance) for r in topk.nearest(vectors).collect()}
    assert got == {(1, 1, 6, 5.0), (6, 1, 1, 5.0), (7, 1, 9, 1.0), (9, 1, 7, 1.0)}
    assert topk.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_same_points_make_one_leaf():
    tree = topk.Tree(np.ones((1000, 3)), 10)
    assert len(tree.edge) == 2


def test_asked_rows_are_searched_among_all(spark):
    rng = np.random.default_rng(9)
    rows = [(i, np.float32(rng.normal(0, 1, 5)).tolist(), 0) for i in range(300)] + [(500, None, 0), (None, [0.0] * 5, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = topk.nearest(df, asked="vec_id % 50 = 0", k=3, shard_rows=20, leaf_rows=4, query_rows=2).collect()
    want = [x for x in brute(rows, 3) if x[0] is not None and x[0] % 50 == 0]
    assert sorted(((r.vec_id, r.rank, r.neighbor_id, round(r.distance, 6)) for r in got), key=str) == want


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(topk, "MAX_SHARDS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(0, 1, 3)).tolist(), 0) for i in range(150)]
    got = topk.nearest(spark.createDataFrame(rows, SCHEMA), k=4, shard_rows=10, leaf_rows=3).collect()
    assert sorted(((r.vec_id, r.rank, r.neighbor_id, round(r.distance, 6)) for r in got), key=str) == brute(rows, 4)


def test_many_equal_vectors(spark):
    """A third of all rows is one vector; each finds its first ten others at distance 0."""
    same = spark.range(30_000).selectExpr("id as vec_id", "array(1f, 0f, if(id % 2 = 0, 0f, -0f)) as embedding", "0 as label")
    rest = spark.range(30_000, 32_000).selectExpr("id as vec_id", "array(float(id), 2f, 3f) as embedding", "0 as label")
    got = topk.nearest(same.union(rest))
    counted = got.where("vec_id < 30000").groupBy("distance").count().collect()
    assert [(r.distance, r["count"]) for r in counted] == [(0.0, 300_000)]
    assert [r.neighbor_id for r in got.where("vec_id = 3").orderBy("rank").collect()] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_ids_that_are_no_numbers_count_as_missing(spark):
    df = spark.createDataFrame([("a", [0.0]), ("7", [1.0])], "vec_id string, embedding array<double>")
    assert {(r.vec_id, r.neighbor_id) for r in topk.nearest(df).collect()} == {(None, 7), (7, None)}
