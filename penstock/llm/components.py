"""Connected components of an edge table by alternating large-star and small-star steps, in Spark alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, materialise

#: Edges that a task contracts at once.
EDGES_AT_ONCE = 500_000
#: Nodes (two numbers each) that are broadcast at most; more are joined by sorting.
BROADCAST_NODES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component within these edges) of all nodes that are not the least themselves."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: a.size], place[a.size :]
    label = np.arange(nodes.size)
    while x.size:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(up := label[label], label):
            label = up
    own = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[own], nodes[label[own]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) with the components of the given ones: stars, one for each component of some 500,000 edges."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def stars() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return pa.record_batch([pa.array(x) for x in forest(t["a"].to_numpy(), t["b"].to_numpy())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES_AT_ONCE:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b); root is the least node of the component.

    Each task first contracts its own edges to stars. Then a large star hangs every larger neighbour of a node on the node's
    least neighbour, and a small star every smaller one, until every component is one star. An edge is one row (a > b), and
    only nodes that are neither ends nor roots yet are looked up, so a component's root is never a key that its edges meet in.
    Tables of edges are written to the shared folder between steps.
    """
    now = materialise(edges.where("a <> b").mapInArrow(contract, "a long, b long").distinct(), "edges")
    while True:
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("low")).union(now.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("low")))
        seen = ends.groupBy("node").agg(F.min("low").alias("least"), F.count("low").alias("smaller"), F.count_if(F.col("low").isNull()).alias("larger"))
        open_ = materialise(seen.where("smaller > 0 and (larger > 0 or smaller > 1)"), "open")
        left, between = open_.agg(F.count("*"), F.count_if(F.col("larger") > 0)).first()
        if not left:
            drop_table(open_)
            break
        inner = open_.where("larger > 0").select("node", "least")
        inner = F.broadcast(inner) if between <= BROADCAST_NODES else inner.hint("merge")
        large = now.join(inner, F.col("b") == F.col("node"), "left").select("a", F.coalesce("least", "b").alias("b"))
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select("m", F.explode(F.array("a", "b")).alias("n")).where("n <> m")
        after = materialise(small.select(F.col("n").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        drop_table(open_)
        drop_table(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
