"""Connected components of an edge table, by alternating large and small stars.

Each round is a few aggregations and joins on node ids, so no neighbourhood is ever
collected; the edge table of each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: So many edges (16 bytes each) are joined by one task; more go by stars.
FEW_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the edges a-b connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new[new], new[label])
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _forests(batches):
    """Per partition, the forest of each few batches: fewer edges, the same components."""
    held, size = [], 0

    def out():
        u, v = forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 2_000_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def components(edges: DataFrame, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long, never null); root is the least node."""
    edges = edges.select("a", "b").where("a <> b")
    edges = written(edges.mapInArrow(_forests, "a long, b long"), "edges")
    if edges.count() <= few_edges:
        roots = written(edges.repartition(1).mapInArrow(_forests, "a long, b long"), "roots")
        return roots.toDF("node", "root").union(roots.select("b", "b").distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").where("u <> m").union(low).distinct()
        edges = written(small.toDF("a", "b"), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.toDF("node", "root").union(edges.select("b", "b").distinct())
        before = now
