"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import written

# Stars halve the paths of a graph, so a graph of 2**40 vertices needs about 40 rounds.
ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns id and component (the smallest reachable id) for every id in `edges` (columns a, b).

    Alternates large and small stars: every vertex links its larger neighbours, then its smaller
    ones, to the smallest of them, until nothing changes. Every round is a few joins and
    aggregates over the edges and is written to the shared folder, which cuts the lineage. Edges
    with a missing end are ignored. An edge table without rows gives no rows.
    """
    edges = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = _state(edges)
    for _ in range(ROUNDS):
        if state[0] == 0:
            break
        edges = _written(_small_star(_large_star(edges)))
        previous, state = state, _state(edges)
        if state == previous:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.union(edges.select("b", "b").distinct())


def _written(edges: DataFrame) -> DataFrame:
    return written(edges, "components")


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and checksum of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    inner = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", "m")).distinct()
