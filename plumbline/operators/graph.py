"""Graph operators over nodes(id, …) and edges(src, dst, label); edges are a bag.

Loops run over a frontier of the vertices found last, anti-joined with those seen, and are bounded in depth.  Every
frontier is a table in the shared folder, so that a level's plan does not hold those before it, and a loop ends with
the first empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize


def neighbours(edges: DataFrame, label: str | None = None, reverse: bool = False) -> DataFrame:
    """(id, neighbour) along or against the edges of a label; repeated edges repeat."""
    e = edges.where(F.col("label") == label) if label else edges
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return e.select(F.col(a).alias("id"), F.col(b).alias("neighbour"))


def fan_in(edges: DataFrame, label: str | None = None) -> DataFrame:
    e = edges.where(F.col("label") == label) if label else edges
    return e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth): vertices within `depth` steps of any seed, with the distance to the nearest; seeds at 0.
    `allowed`(id) blocks all other vertices, for traversal too."""
    step = edges.select("src", "dst")
    if not directed:
        step = step.union(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = step.distinct()
    if allowed is not None:
        step = step.join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    step = materialize(step, "steps")
    seen = front = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    for d in range(1, depth + 1):
        reached = front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id")).distinct()
        front = materialize(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def closure(edges: DataFrame, start: DataFrame, label: str, depth: int) -> DataFrame:
    """Vertices reachable along a label from start(id), without the start itself."""
    return bfs(edges.where(F.col("label") == label), start, depth, directed=True).where("depth > 0").select("id")


def shortest_path(edges: DataFrame, start, end, depth: int, label: str | None = None) -> DataFrame:
    """One row with the least path of fewest edges from start to end as an array, none if there is none within
    `depth`.  All labels count unless one is named; end is a vertex or a table(id) with one."""
    e = materialize((edges.where(F.col("label") == label) if label else edges).select("src", "dst").distinct(), "steps")
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    ends = end.select("id") if isinstance(end, DataFrame) else spark.createDataFrame([(end,)], f"id {kind}")
    seen = front = spark.createDataFrame([(start, [start])], f"id {kind}, path array<{kind}>")
    for _ in range(depth):
        reached = front.join(e, front["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = materialize(reached.join(seen.select("id"), "id", "left_anti"), "frontier")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if not front.join(ends, "id", "left_semi").isEmpty():
            break
    return seen.join(F.broadcast(ends), "id", "left_semi").select("path")


def induced(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """Edges of the labels with both ends in nodes."""
    ids = nodes.select("id").distinct()
    e = edges.where(F.col("label").isin(labels))
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "label")


def used_imports(imports: DataFrame, uses: DataFrame) -> DataFrame:
    """imports(src, dst) with is_used: whether uses(src, dst) has the pair."""
    hit = uses.select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    return imports.join(hit, ["src", "dst"], "left").withColumn("is_used", F.coalesce("_hit", F.lit(False))).drop("_hit")


def resolve(calls: DataFrame, candidates: list[DataFrame], key: list[str]) -> DataFrame:
    """Prioritised resolution: calls(key…) get `target` from the first of the candidate tables (key…, target) that
    has one; unresolved stay null."""
    out, names = calls, []
    for i, c in enumerate(candidates):
        names.append(f"_c{i}")
        on = [k for k in key if k in c.columns]
        out = out.join(c.groupBy(*on).agg(F.min("target").alias(names[-1])), on, "left")
    return out.withColumn("target", F.coalesce(*names)).drop(*names)


def reply_tree(comments: DataFrame, depth: int = 10) -> DataFrame:
    """(id, root, depth) of comments(id, parent): replies below their thread's first comment, depth-bounded."""
    out = level = materialize(comments.where("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth")), "frontier")
    replies = comments.where("parent is not null").select(F.col("id").alias("child"), "parent")
    for d in range(1, depth + 1):
        level = materialize(replies.join(level, F.col("parent") == level["id"]).select(F.col("child").alias("id"), "root", F.lit(d).alias("depth")), "frontier")
        if level.isEmpty():
            break
        out = out.union(level)
    return out
