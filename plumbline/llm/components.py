"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combine and two joins that leave the pairs of a hot vertex where they
are, so no vertex's neighbours are gathered in one task.  The aggregations and what a round leaves are tables in the
shared folder, so that each is computed once and its size is known to the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

MAX_ROUNDS = 60


#: Pairs that a task of a round takes on average; small tables are not spread over many tasks.
TASK_PAIRS = 200_000


def _few(df: DataFrame, total: int) -> DataFrame:
    """df in as many tasks as `total` pairs need, if these are fewer than it has."""
    return df.coalesce(8 + total // TASK_PAIRS)


def _hang(pairs: DataFrame, total: int) -> DataFrame:
    """pairs(u, v), at most `total` of them: join every pair to the smallest of u and its neighbours (column m)."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    least = materialize(_few(least, total), "least")
    return lookup(pairs, least, "u", "m", "n", total)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hang(both, 2 * count).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _hang(down, 2 * count)
    moved = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(hung.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, component): every vertex of an edge with the smallest vertex it reaches.

    Self loops and repeated edges change nothing; an empty table gives an empty table."""
    now = materialize(edges.where("u != v").select("u", "v").distinct(), "edges")
    count = now.count()
    for _ in range(MAX_ROUNDS):
        now = materialize(_few(_small_star(_large_star(now, count), count), count), "edges")
        # Edges go from a vertex to a smaller one.  If every vertex has one edge down, and none to a vertex that has
        # one itself, these are stars, which another round would leave as they are.
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
        met = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        count, open_ = met.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
