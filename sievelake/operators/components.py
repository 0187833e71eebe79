"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.storage import discard, written

#: Up to so many edges, one task joins them (about 200 bytes an edge); beyond it, stars are contracted by shuffles.
ONE_TASK_EDGES = 300_000
MAX_ROUNDS = 100


def component_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) by hooking and pointer jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if np.array_equal(px, py):
            return nodes, nodes[parent]
        lo, hi = np.minimum(px, py), np.maximum(px, py)
        np.minimum.at(parent, hi, lo)
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def _one_task(edges: DataFrame, kind: str) -> DataFrame:
    arrow = {"bigint": pa.int64(), "string": pa.string()}[kind]

    def join(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            whole = pa.Table.from_batches(found)
            nodes, labels = component_labels(*(whole.column(c).to_numpy() for c in ("a", "b")))
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000], arrow), pa.array(labels[i : i + 100_000], arrow)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(join, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, *, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, both bigint or both string).

    The component is named by its smallest node.  Large edge tables are contracted by alternating
    large-star and small-star steps (Kiveris et al., 2014), each written to the shared folder, until
    nothing changes; the number of rounds grows with the logarithm of the size, not with the diameter.
    Rows with a null end are ignored; an edge from a node to itself makes it a component.
    """
    kind = dict(edges.dtypes)["a"]
    edges = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    if edges.count() <= one_task_edges:
        return _one_task(edges, kind)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    stars, last = None, None
    now = edges.where("a != b")
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).distinct()
        before, stars = stars, written(small, "stars")
        if before is not None:
            discard(before)
        now = stars
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
        last = seen
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
