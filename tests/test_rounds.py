"""Work that a query does once, or where it belongs: held by its plan."""

from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import text
from plumbline.llm import components
from plumbline.operators import bench, paired
from plumbline.streaming import reviews

SMALL = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stars_are_seen_at_once(spark, monkeypatch):
    """Edges that are stars after a round end the loop: no second round only shows that nothing changes."""
    names = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: (names.append(name), f(df, name))[1])
    edges = [(0, i) for i in range(1, 9)] + [(20, 21)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(9)}, 20: 20, 21: 20}
    assert names.count("edges") == 2


def test_dealt_rows_are_not_shuffled_again(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 1, 4), (1, 2, 3), (2, 1, 9)], "task long, arm int, ord int")
    first = paired.dedupe(rows, ["task", "arm"], ["ord"], deal=["task"])
    assert sorted(map(tuple, first.collect())) == [(1, 1, 4), (1, 2, 3), (2, 1, 9)]
    plan = first.groupBy("task").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_split_by_reach_computes_scores_once(spark):
    scores = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "A", 3), (3, "A", 4), (3, "B", 5), (3, "C", 6), (None, "A", 7)], "task_id long, condition string, n int")
    out = bench.split_by_reach(scores, spark.createDataFrame([(3,)], "task_id long"), ["A", "B"])
    assert sorted((r.n, r.reached) for r in out.collect()) == [(1, False), (2, False), (4, True), (5, True), (6, True)]
    assert optimized(out).count("LogicalRDD") == 2


def test_line_accuracy_sorts_counts(spark):
    rows = [("A", True, d) for d in (7, 0, 0, 3)] + [("B", True, None), ("B", False, None)]
    out = bench.line_accuracy(spark.createDataFrame(rows, "condition string, quoting boolean, distance int"))
    assert {r.condition: (r.located, r.median) for r in out.collect()} == {"A": (4, 3), "B": (0, None), "all": (4, 3)}
    assert "row_number" not in optimized(out)


def test_a_batch_of_reviews_needs_no_state_store(spark):
    at = datetime(2024, 1, 1)
    rows = [("2", "start", "r", 1, "u", "open", None, None), ("1", "opened", "r", 1, "t", "open", None, at), ("1", "opened", "r", 1, "t", "open", None, at), (None, "opened", "r", 1, "x", "open", None, at), ("3", "opened", None, 1, "x", "open", None, at)]
    out = reviews.review_changes(spark.createDataFrame(rows, reviews.EVENT))
    assert "TransformWithState" not in optimized(out)
    assert [(r.seq, r.event_id, r.review, r.change, r.title) for r in out.orderBy("seq").collect()] == [(1, "2", 1, "started", None), (2, "1", None, "updated", "t")]


def test_a_diff_is_read_once_not_for_each_line(spark):
    plan = optimized(entry.queries()["hunk_lines"](spark, SMALL))
    assert "(.+?)" not in plan[: plan.index("Generate")]


def test_changed_ranges(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +4 @@ f()\n+a\n@@ -1,2 +9,3 @@\n+b\n@@ -1,2 +20,0 @@\ndiff --git a/y b/y\n+++ /dev/null\n@@ -1 +0,0 @@\ndiff --git a/z.c b/z.c\n@@ -3 +7 @@\n"
    got = spark.createDataFrame([(diff,)], "d string").select(F.explode(text.changed_ranges(F.col("d"))).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("x.py", 4, 4), ("x.py", 9, 11), ("x.py", 20, 20), ("z.c", 7, 7)]


def test_few_large_splits_become_many_tasks(spark):
    plan = optimized(entry.queries()["chance_rematch"](spark, SMALL))
    assert "RepartitionByExpression [o_orderkey" in plan
