"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import Tables

#: Up to so many edges (16 bytes each) are joined in the driver; more by rounds of the distributed algorithm.
DRIVER_EDGES = 1_000_000


def components(edges: DataFrame, tables: Tables, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that it is connected with.

    edges: a written table of longs. Both ways give the same rows.
    """
    n = edges.count()
    return tables.write(_in_driver(edges) if n <= driver_edges else _by_rounds(edges, tables))


def _in_driver(edges: DataFrame) -> DataFrame:
    table = edges.select("a", "b").toArrow()
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    root = np.arange(nodes.size)
    while True:  # hook every root to the least root beside it, then shorten the paths
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        while not np.array_equal(low, low[low]):
            low = low[low]
        new = low[root]
        if np.array_equal(new, root):
            break
        root = new
    out = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[root], pa.int64())})
    return edges.sparkSession.createDataFrame(out, "node long, root long")


def _by_rounds(edges: DataFrame, tables: Tables) -> DataFrame:
    """Alternates large-star and small-star until no edge changes; each round is a written table."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = tables.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        around = both(now)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = tables.write(around.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        now = tables.write(small)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == last:
            break
        last = sign
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
