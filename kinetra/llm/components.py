"""Connected components of an edge table, by alternating large-star and small-star steps on Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize


class Forest:
    """Union-find over integer ids; find() halves paths, the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = g = up.get(p, p)
            x = g
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a batch that are no part of a cycle inside it: connects the same nodes with fewer rows."""
    for batch in batches:
        u, v = (np.asarray(batch.column(i)) for i in range(2))
        forest = Forest()
        keep = np.fromiter((forest.join(a, b) for a, b in zip(u.tolist(), v.tolist(), strict=True)), bool, len(u))
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected edges (u long, v long); root is the smallest node that it reaches.

    Each round joins every node with the smallest of its neighbours; the edges turn into stars in O(log^2 n) rounds. Rounds
    are written to the shared folder. The smallest neighbours are combined before the shuffle and written before they are
    joined, so that the join deals both sides out by itself and adaptive execution can split a hub's rows. Empty edges give
    an empty result; null ends, self-loops and repeated edges are dropped.
    """
    now = materialize(edges.select("u", "v").where("u <> v").transform(map_arrow, _thin, "u long, v long").distinct())
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        # Large star: neighbours above a node go to the smallest of the node and its neighbours.
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: a node and its lower neighbours go to the smallest of them; edges here run from high to low.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").where("u <> v").distinct())
        discard(now, low, large, least)
        now = after
        # Stars: each node has one lower neighbour, which has none.
        many, deep = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1), now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi").limit(1)
        if not many.union(deep.select("u", F.lit(1).cast("long"))).take(1):
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct()))
    discard(now)
    return roots
