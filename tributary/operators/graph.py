"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import save


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (src, dst) to rows (node, component): the smallest node reachable, for every node of an edge that is not
    the smallest of its component. Each round is written to the shared folder."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = save(now, "edges")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
    before = mark(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        now = save(_small_star(_large_star(now)), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
    linked = both.where("dst > src").join(least, "src")
    return linked.select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are linked to the smallest of them. Every edge points down."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    linked = edges.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return linked.unionByName(least.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
