"""Connected components by alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: The rounds needed grow with the logarithm of the longest path; this only guards against a bug.
MAX_ROUNDS = 60


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Each key with the least of itself and its neighbours; one partially aggregated row a key."""
    return edges.groupBy(F.col(key).alias("__u")).agg(F.least(F.min(other), F.first(key)).alias("__m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b")
    return both.where("b > a").join(least.hint("merge"), F.col("a") == F.col("__u")).select(F.col("b").alias("a"), F.col("__m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = _least(down, "a", "b")
    moved = down.join(least.hint("merge"), F.col("a") == F.col("__u")).where("b > __m").select(F.col("b").alias("a"), F.col("__m").alias("b"))
    return moved.unionByName(least.select(F.col("__u").alias("a"), F.col("__m").alias("b")))


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node of its component.

    Every round is written to the shared folder. Nothing but a count and a checksum reaches the driver: joins merge
    sorted rows, as broadcast tables would be built there.
    Self-links, repeated edges and an empty table are allowed; nodes without an edge are not returned.
    """
    where, now = work.write(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        nearer = _large_star(now.where("a <> b")).distinct()
        after, then = work.write(_small_star(nearer).distinct(), "stars")
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen is not None:
            work.drop(where)
        where, now = after, then
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        work.release()
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
