"""Connected components of a table of links, by large-star and small-star rounds.

Up to ``FEW`` links, which are counted, are joined on the driver. More stay in tables, as do
labels; each round's links are written to the shared folder. Minima are combined
before the shuffle; joins by a node of very many links are split where Spark finds them skewed. The rounds
end when every node but the roots has one link, to a root, which is counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep

FEW = 200_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, in order, and the least node of each one's component."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return node, node[root]
        np.minimum.at(root, high, low)
        while ((up := root[root]) != root).any():
            root = up


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has several links up, or links both up and down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component. Nulls and self-links are left out."""
    links = links.where("a <> b").select("a", "b")
    if links.count() <= FEW:
        got = links.toArrow()
        node, root = roots(*(got.column(c).to_numpy() for c in ("a", "b")))
        kind = dict(links.dtypes)["a"]
        return links.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), f"node {kind}, root {kind}")
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while _unfinished(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node links to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        down = small.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = keep(down.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        drop(edges)
        edges = after
    # Every component is a star around its least node now.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
