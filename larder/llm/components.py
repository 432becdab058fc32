"""Connected components of a graph too large for one machine: distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.shared import materialize, scratch

#: A task folds its edges into a forest whenever it holds this many.
FOLD_EDGES = 1 << 20


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that are not their own root; a root is its component's smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        nxt = label.copy()
        for at in (label[left], label[right], left, right):
            np.minimum.at(nxt, at, low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, label):
            break
        label = nxt
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition's edges: at most one edge per node, however many came in."""
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
        if count >= FOLD_EDGES:
            forest = union(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [forest], 0
    if held:
        node, root = union(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def fold(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_fold, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns) that is not its component's root.

    Each round folds edges inside tasks, deals them out by node, folds again and
    lets every node skip to the parent of its parent; it ends when each node has
    one parent and no parent has another. Hubs do not gather: an edge is dealt by
    its larger end, after the local fold, and the skip joins a table with one row
    per node, written first so that Spark can split a hot parent. No state leaves
    the cluster but two counts per round.
    """
    a, b = edges.columns
    start = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root"))
    with scratch(edges.sparkSession) as result:
        with scratch(edges.sparkSession) as keep:
            now = keep(materialize(fold(start), "edges"))
        while True:
            with scratch(edges.sparkSession) as keep:  # a round leaves one table
                forest = materialize(fold(now.repartition("node")), "forest")
                up = materialize(forest.groupBy("node").agg(F.min("root").alias("root")), "parents")
                f, u = forest.alias("f"), up.alias("u")
                skipped = f.join(u, F.col("f.root") == F.col("u.node"), "left").select(
                    F.col("f.node"), F.coalesce("u.root", "f.root").alias("root"), F.col("u.root").isNotNull().alias("moved")
                )
                after = materialize(skipped, "edges")
                rows, moved = after.agg(F.count(F.lit(1)), F.count(F.when(F.col("moved"), 1))).first()
                if moved == 0 and rows == up.count():
                    return result(keep(up))
                now = keep(after).select("node", "root")
