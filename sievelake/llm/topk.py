"""Exact nearest neighbours of the asked rows among all rows, with a KD-tree per shard.

Equal vectors are collapsed first: a distinct vector keeps the k + 1 rows of it that come first, which
are all that any result can need.  Shards are cells of median splits taken from a bounded sample
(which decides where vectors lie, not what is found); a large cell is cut into blocks by hash.  Each
block has a tree that splits at the median of its widest dimension down to leaves with tight boxes.

A query visits the cells in the order of their box-to-query bounds, in rounds of growing numbers of
cells: the nearest cell first, then four more, sixteen more and so on.  Its k-th distance goes from
round to round, and a cell whose bound exceeds it isn't visited.  Within a block, leaves are visited
best first until the bound exceeds the k-th distance.  Queries that visit the same leaf are handled by
one matrix product; pairs that it can't exclude get their distance from the differences.

Scale: a task holds one block of points and CHUNK queries at a time; the queries of a block stream past
its tree, and a block that very many ask for is copied, once for each ``query_rows`` of them.  The
driver holds splits, boxes and sizes of at most MAX_SHARDS cells.  Rounds grow with the logarithm of
that number.  Results are merged by query, k + 1 rows of each at most.

Defined results
* neighbours are the other rows, at Euclidean distance, ordered by (distance, id, row); ids that are
  null, or no numbers, come last; a repeated row is a neighbour at distance 0, a row is never its own;
* ``asked`` says whose neighbours are wanted (all rows, if it is None; a null says no); every row is
  a possible neighbour;
* a null vector, or one with a null, NaN or infinite element, has no rows and is no neighbour, nor is
  an empty one; vectors are compared with those of their own dimension only;
* with fewer than k others, all of them are returned; any number of equal rows is one vector to
  search; an empty table gives no rows; other columns are not read, but by ``asked``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, discard, id_or_last, null_id, sized_broadcast, written  # noqa: F401

K = 10
SHARD_ROWS = 16_384
MAX_SHARDS = 1024
LEAF_ROWS = 256
QUERY_ROWS = 262_144
CHUNK = 1024
#: Numbers that the sample for the splits has at most, and sampled vectors for each cell.
SAMPLE_NUMBERS = 1 << 22
SAMPLED = 64


class Tree:
    """Leaves of median splits: rows ``order[edge[i]:edge[i + 1]]`` lie in the box lo[i]..hi[i]."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        parts, todo = [], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            spread = np.ptp(points[at], axis=0)
            axis = int(np.argmax(spread))
            if len(at) <= leaf_rows or spread[axis] == 0:
                parts.append(at)
            else:
                half = len(at) // 2
                at = at[np.argpartition(points[at, axis], half)]
                todo += [at[:half], at[half:]]
        self.order = np.concatenate(parts)
        self.edge = np.r_[0, np.cumsum([len(p) for p in parts])]
        self.points = points[self.order]
        self.square = (self.points**2).sum(1)
        self.lo = np.stack([points[p].min(0) for p in parts])
        self.hi = np.stack([points[p].max(0) for p in parts])


def bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box, never too large by rounding."""
    out = np.empty((len(x), len(lo)))
    for i in range(len(lo)):
        gap = np.maximum(np.maximum(lo[i] - x, x - hi[i]), 0)
        out[:, i] = np.einsum("ij,ij->i", gap, gap)
    return out * (1 - 1e-12)


def search(tree: Tree, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, squared distance, point) of the first k points of each query by (distance, id, row), none farther than its kth."""
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    ids, rows = ids[tree.order], rows[tree.order]
    for c in range(0, len(x), CHUNK):
        q, limit = x[c : c + CHUNK], kth[c : c + CHUNK].copy()
        q_square = (q**2).sum(1)
        bound = bounds(q, tree.lo, tree.hi)
        visit = np.argsort(bound, axis=1)
        top = found[0]
        active = np.arange(len(q))
        for step in range(len(tree.lo)):
            leaf = visit[active, step]
            near = bound[active, leaf] <= limit[active]
            active, leaf = active[near], leaf[near]
            if not len(active):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(leaf[by_leaf]) != 0])
            pairs = []
            for a, b in zip(at, np.r_[at[1:], len(active)]):
                who, i = active[by_leaf[a:b]], leaf[by_leaf[a]]
                lo, hi = tree.edge[i], tree.edge[i + 1]
                scale = q_square[who][:, None] + tree.square[lo:hi]
                rough = scale - 2 * (q[who] @ tree.points[lo:hi].T)
                slack = 1e-9 * scale
                most = limit[who]
                if hi - lo > k:  # what k points of this leaf surely undercut can't be among the first k
                    most = np.minimum(most, np.partition(rough + slack, k - 1, axis=1)[:, k - 1])
                w, p = np.nonzero(rough <= most[:, None] + slack)
                pairs.append((who[w], p + lo))
            who, p = (np.concatenate(z) for z in zip(*pairs))
            gap = q[who] - tree.points[p]
            dist = np.einsum("ij,ij->i", gap, gap)
            ok = dist <= limit[who]
            who, dist, p = (np.r_[t, z[ok]] for t, z in zip(top, (who, dist, p)))
            sort = np.lexsort((rows[p], ids[p], dist, who))
            who, dist, p = who[sort], dist[sort], p[sort]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == k - 1
            limit[who[last]] = dist[last]
            top = tuple(z[rank < k] for z in (who, dist, p))
        found.append((top[0] + c, top[1], tree.order[top[2]]))
    return tuple(np.concatenate(z) for z in zip(*found))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _splits(sample: np.ndarray, shards: int) -> list[tuple[int, float]]:
    """A heap of (axis, value) splits with at least ``shards`` cells, or none."""
    cells, splits = [sample], []
    while len(cells) < shards:
        later = []
        for cell in cells:
            axis = int(np.argmax(np.ptp(cell, axis=0))) if len(cell) else 0
            value = float(np.median(cell[:, axis])) if len(cell) else 0.0
            splits.append((axis, value))
            later += [cell[cell[:, axis] < value], cell[cell[:, axis] >= value]]
        cells = later
    return splits


def _cell(x: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while len(at) and len(splits) and at.min() < len(splits):
        axis = np.array([s[0] for s in splits])[at]
        value = np.array([s[1] for s in splits])[at]
        at = 2 * at + 1 + (x[np.arange(len(x)), axis] >= value)
    return at - len(splits)


_FOUND = "query long, squared double, point long, id long, row long"
_BLOCK_BITS = 32


def _sharded(points: DataFrame, dim: int, n: int, shard_rows: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points with the cell and the block that each lies in; written), and of the cells: number, blocks, lo, hi."""
    shards = min(MAX_SHARDS, -(-n // shard_rows))
    mine = points.where(F.col("dim") == dim)
    splits: list[tuple[int, float]] = []
    if shards > 1:
        wanted = min(SAMPLED * shards, max(shards, SAMPLE_NUMBERS // dim))
        rows = (mine.sample(wanted / n, seed=7) if wanted < n else mine).select("v").collect()
        splits = _splits(np.array([r.v for r in rows], float).reshape(len(rows), dim), shards)

    @F.arrow_udf("bigint")
    def cell(v: pa.Array) -> pa.Array:
        return pa.array(_cell(_matrix(v), splits) if len(v) else np.zeros(0, np.int64))

    def boxes(batches):
        least: dict[int, np.ndarray] = {}
        most: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            x, at = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, dim)), batch.column("cell").to_numpy(zero_copy_only=False)
            for c in np.unique(at).tolist():
                own = x[at == c]
                lo, hi = own.min(0), own.max(0)
                least[c] = np.minimum(least[c], lo) if c in least else lo
                most[c] = np.maximum(most[c], hi) if c in most else hi
                count[c] = count.get(c, 0) + len(own)
        lists = lambda found: pa.array([found[c].tolist() for c in count], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64()), lists(least), lists(most)], ["cell", "n", "lo", "hi"])

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"cell": table.column("cell")[:1], "n": pa.array([int(table.column("n").to_numpy().sum())]), "lo": pa.array([_matrix(table.column("lo")).min(0).tolist()]), "hi": pa.array([_matrix(table.column("hi")).max(0).tolist()])})

    kind = "cell long, n long, lo array<double>, hi array<double>"
    placed = written(mine.withColumn("cell", cell("v")).repartition("cell", F.pmod("point", F.lit(256))), "vector-cells")
    found = sorted(placed.select("cell", "v").mapInArrow(boxes, kind).groupBy("cell").applyInArrow(merged, kind).collect())  # at most 2 * MAX_SHARDS cells
    return placed, np.array([r.cell for r in found]), np.array([-(-r.n // (2 * shard_rows)) for r in found]), np.array([r.lo for r in found]), np.array([r.hi for r in found])


def _searched(k: int, leaf_rows: int):
    """For rows sorted by (cell, part, kind), points before queries: what the queries find in the cell."""

    def run(batches):
        key, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "kind"))
            edge = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(edge, np.r_[edge[1:], len(cell)]):
                if key != (cell[a], part[a]):
                    key, held, tree = (cell[a], part[a]), [], None
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(rows)
                    continue
                if tree is None:
                    points = pa.Table.from_batches(held)
                    held = [points.column(c).to_numpy() for c in ("point", "id", "row")]
                    tree = Tree(_matrix(points.column("v")), leaf_rows)
                who, squared, p = search(tree, held[1], held[2], _matrix(rows.column("v")), rows.column("kth").to_numpy(zero_copy_only=False), k)
                cols = [rows.column("point").to_numpy(zero_copy_only=False)[who], squared, *(h[p] for h in held)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "squared", "point", "id", "row"])

    return run


def _firsts(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("squared", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _nearest_points(points: DataFrame, dim: int, n: int, k: int, shard_rows: int, leaf_rows: int, query_rows: int) -> DataFrame:
    """(query, squared, point, id, row): the first k distinct vectors for each asked one of them; a written table."""
    placed, cells, blocks, lo, hi = _sharded(points, dim, n, shard_rows)
    names = np.concatenate([(int(c) << _BLOCK_BITS) + np.arange(m) for c, m in zip(cells, blocks)]).astype(np.int64)
    of_cell, first_block = np.repeat(np.arange(len(cells)), blocks), np.cumsum(blocks) - blocks
    block = F.pmod(F.xxhash64("point"), F.element_at(F.array(*(F.lit(int(m)) for m in blocks)), F.array_position(F.array(*(F.lit(int(c)) for c in cells)), F.col("cell")).cast("int")))
    placed_in = placed.withColumn("cell", F.shiftleft("cell", _BLOCK_BITS) + block) if (blocks > 1).any() else placed.withColumn("cell", F.shiftleft("cell", _BLOCK_BITS))

    def visited(begin: int, end: int):
        @F.arrow_udf("array<bigint>")
        def visit(v: pa.Array, kth: pa.Array) -> pa.Array:
            if not len(v):
                return pa.array([], pa.list_(pa.int64()))
            bound = bounds(_matrix(v), lo, hi)
            order = np.argsort(bound, axis=1, kind="stable")[:, begin:end]
            near = np.take_along_axis(bound, order, 1) <= kth.to_numpy(zero_copy_only=False)[:, None]
            who, chosen = np.nonzero(near)[0], order[near]
            size = blocks[chosen]
            at = np.repeat(first_block[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
            total = np.bincount(who, size, len(v)).astype(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(total)].astype(np.int32)), pa.array(names[at]))

        return visit

    queries = placed.where("asked").select("point", "v")
    top, begin, width = None, 0, 1
    while begin < len(cells):
        if top is None:
            now = queries.withColumn("kth", F.lit(float("inf")))
        else:
            kth = top.groupBy(F.col("query").alias("point")).agg(F.when(F.count("*") >= k, F.max("squared")).alias("kth"))
            now = queries.join(kth, "point", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
        now = written(now.withColumn("cell", F.explode(visited(begin, begin + width)("v", "kth"))), "vector-queries")
        load = written(now.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts")), "vector-load")
        parts = sized_broadcast(load, 24)
        side = lambda df, part, kind, *cols: df.join(parts, "cell").select("cell", part.alias("part"), F.lit(kind).alias("kind"), "point", "v", *cols)
        given = side(placed_in, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), 0, "id", "row", F.lit(None).cast("double").alias("kth"))
        asking = side(now, F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"), 1, F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("row"), "kth")
        sorted_ = given.union(asking).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        found = sorted_.mapInArrow(_searched(k, leaf_rows), _FOUND)
        before, top = top, written(_firsts(found if top is None else top.union(found), k), "vector-neighbours")
        discard(now, load, *([] if before is None else [before]))
        begin, width = begin + width, 4 * width
    discard(placed)
    return top


def nearest(vectors: DataFrame, *, asked: str | Column | None = None, k: int = K, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance) for the k nearest others of every asked row; rank from 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = F.lit(True) if asked is None else F.expr(asked) if isinstance(asked, str) else asked
    v = F.transform(F.col("embedding").cast("array<double>"), lambda e: e + F.lit(0.0))  # -0.0 becomes 0.0
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(id_or_last("vec_id").alias("id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where(F.col("v").isNotNull() & (F.size("v") > 0) & good)
    rows = written(rows.select("id", F.xxhash64("v").alias("h"), "v", "asked", F.monotonically_increasing_id().alias("row")), "vectors")
    order = Window.partitionBy("h", "v").orderBy("id", "row")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)  # cut before the shuffle, too
    distinct = first.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("best"))
    wanted = rows.where("asked").select("h", "v").distinct().withColumn("asked", F.lit(True))
    points = distinct.join(wanted, ["h", "v"], "left").select("h", "v", "best", F.coalesce("asked", F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("point"))
    points = written(points.withColumn("dim", F.size("v")), "distinct-vectors")
    searched = points.select("point", "v", "dim", "asked", F.col("best")[0]["id"].alias("id"), F.col("best")[0]["row"].alias("row"))
    tops = [_nearest_points(searched, r.dim, r["count"], k + 1, shard_rows, leaf_rows, query_rows) for r in sorted(points.groupBy("dim").count().collect(), key=lambda r: r.dim)]
    if not tops:
        discard(rows, points)
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    top = tops[0]
    for more in tops[1:]:
        top = top.union(more)
    lists = top.select("query", "squared", "point").join(points.select("point", "best"), "point").groupBy("query").agg(F.collect_list(F.struct("squared", "best")).alias("near"))  # k + 1 vectors of k + 1 rows
    flat = F.flatten(F.transform("near", lambda p: F.transform(p["best"], lambda b: F.struct(p["squared"].alias("squared"), b["id"].alias("id"), b["row"].alias("row")))))
    lists = lists.select("query", F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    who = rows.where("asked").select("h", "v", "id", "row").join(points.select("h", "v", F.col("point").alias("query")), ["h", "v"]).select("id", "row", "query")
    others = F.slice(F.filter("near", lambda n: n["row"] != F.col("row")), 1, k)
    out = who.join(lists, "query").select("id", F.posexplode(others).alias("place", "n"))
    out = out.select(null_id(F.col("id")).alias("vec_id"), (F.col("place") + 1).alias("rank"), null_id(F.col("n.id")).alias("neighbor_id"), F.sqrt("n.squared").alias("distance"))
    return out
