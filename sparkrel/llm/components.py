"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id that has a link in *links* (a, b): root is the smallest id reachable.

    Loops and repeated links do no harm; null ends are dropped.  Each round is written to the shared folder, so
    lineage stays short.  Joins have plain exchanges on both sides, so an id with very many links is split.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        # Large star: neighbours above an id are linked to its smallest neighbour.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stored(_star(both, F.col("b") > F.col("a")), "links")
        # Small star: neighbours below an id, and the id, are linked to the smallest.
        small = stored(_star(large, F.lit(True)), "links")
        discard(edges, large)
        edges = small
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def _star(edges: DataFrame, kept) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(F.col("id"), F.least("id", "m").alias("m"))
    # The alias of an expression hides the grouping from the planner: both sides get exchanges of their own,
    # which is what lets it split a hot id.
    least = least.select((F.col("id") + F.lit(0)).alias("id"), "m")
    joined = edges.join(least, edges["a"] == least["id"])
    moved = joined.where(kept).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("id").alias("a"), F.col("m").alias("b"))
    return moved.union(own).where("a <> b").distinct()
