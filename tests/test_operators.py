import numpy as np
import pytest
from plumbline.functions import text
from plumbline.operators import graph, match, retrieve, roc
from plumbline.sources import read_jsonl, read_labels, remaining
from pyspark.sql import functions as F

DEFECT = "path string, defect_id string, d_line int, d_ord int"
DIFF = "diff --git a/foo.py b/foo.py\n--- a/foo.py\n+++ b/foo.py\n@@ -1,3 +1,4 @@\n import os\n-x = 1\n+x = 2\n+y = 3\n z = 0\ndiff --git a/bar.py b/bar.py\n--- /dev/null\n+++ b/bar.py\n@@ -0,0 +1,2 @@\n+a = 1\n+b = 2"
FINDING = "path string, finding_id string, f_line int, f_ord int"


@pytest.mark.parametrize(
    "defects, findings, tolerance, want",
    [
        ([10], [13], 5, {"d0": ("f0", 3)}),
        ([10], [40], 5, {"d0": (None, None)}),
        ([10], [14, 11], 5, {"d0": ("f1", 1)}),
        ([10, 11], [10], 5, {"d0": ("f0", 0), "d1": (None, None)}),
        ([10], [None], 5, {"d0": (None, None)}),
        ([10], [13], 1, {"d0": (None, None)}),
    ],
)
def test_greedy_match(spark, defects, findings, tolerance, want):
    d = spark.createDataFrame([("a.py", f"d{i}", x, i) for i, x in enumerate(defects)], DEFECT)
    f = spark.createDataFrame([("a.py", f"f{i}", x, i) for i, x in enumerate(findings)], FINDING)
    assert {r.defect_id: (r.finding_id, r.distance) for r in match.greedy_match(d, f, ["path"], tolerance).collect()} == want


def test_paths(spark):
    df = spark.createDataFrame([("a/src/app.py",), ("b/src/app.py",), ("./src/app.py",), ("src\\app.py",), ("../.x",), ("",)], "p string")
    got = [r.n for r in df.select(text.normalise_path(F.col("p")).alias("n")).collect()]
    assert got == ["src/app.py"] * 4 + ["x", ""]
    assert not spark.range(1).select(text.paths_match(F.lit(""), F.lit("")).alias("m")).first().m


def test_bfs_chain_and_blocked_vertices(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")], "src string, dst string, label string")
    seed = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in graph.bfs(e, seed, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.id for r in graph.bfs(e, seed, 3, allowed=spark.createDataFrame([("b",), ("d",)], "id string")).collect()} == {"a", "b"}
    assert graph.shortest_path(e, "a", "d", 5).first().path == ["a", "b", "c", "d"]
    assert graph.shortest_path(e, "d", "a", 5).count() == 0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("x", s, True) for s in (1, 2, 2)] + [("x", s, False) for s in (1, 2)], "arm string, score int, d boolean")
    r = roc.auc(roc.score_histogram(df, ["arm"], "score", F.col("d")), ["arm"], "score").first()
    pairs = [(a, b) for a in (1, 2, 2) for b in (1, 2)]
    assert r.auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))


def test_lexical_order(spark):
    pool = spark.createDataFrame([("review_summary",), ("review_detail",), ("unrelated",)], "name string")
    got = retrieve.lexical(pool, ["review"], "name", "name", 5).collect()
    assert [r.name for r in got] == ["review_detail", "review_summary"]


def test_greedy_fill_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 40), ("q", 2, 80), ("q", 3, 50)], "q string, i int, tokens int")
    r = retrieve.greedy_fill(df, ["q"], ["i"], "i", "tokens", 100).first()
    assert (r.offered, r.kept, r.used, r.remaining) == (3, 2, 90, 10)


def test_diff_functions(spark):
    r = spark.createDataFrame([(DIFF,)], "diff string").select(text.hunk_headers(F.col("diff")).alias("h"), text.diff_files(F.col("diff")).alias("f"), text.distractor_lines(F.col("diff"), F.lit(0)).alias("o")).first()
    assert r.h == [1, 1] and r.f == ["foo.py", "r.py"] and r.o == []


@pytest.mark.parametrize(
    "comment, outside, strict",
    [("", False, False), ("breaks handlers.py badly", True, True), ("see https://x.org", True, True), ("it is called by the job", True, True), ("fails with AssertionError here", True, False), ("rename x", False, False)],
)
def test_scope(spark, comment, outside, strict):
    r = spark.createDataFrame([(comment, DIFF)], "c string, d string").select(text.scope(F.col("c"), F.col("d")).alias("s")).first().s
    assert (r.outside, r.strict) == (outside, strict)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task_id": "x", "hit": true}\n\n{"task_id": "y"}\n')
    rows = read_jsonl(spark, str(tmp_path / "a.jsonl"), "task_id string, hit boolean").where("task_id is not null").orderBy("ordinal").collect()
    assert [(r.task_id, r.hit) for r in rows] == [("x", True), ("y", None)]
    (tmp_path / "l.csv").write_text("id,label\n1,yes\n2,NO\n3,maybe\n")
    assert sorted((r.id, r.label) for r in read_labels(spark, str(tmp_path / "l.csv")).collect()) == [("1", True), ("2", False)]
    a, b = (spark.createDataFrame([(i,) for i in x], "k int") for x in ((1, 2, 3), (2,)))
    assert sorted(r.k for r in remaining(a, b, ["k"]).collect()) == [1, 3]


def test_webhook_stream_drops_replays(spark, tmp_path):
    from plumbline import streaming

    line = '{"event_id": "%s", "event_type": "pull_request", "action": "%s", "repository": "org/repo", "number": 17, "received": "2024-01-0%dT00:00:00Z"}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(line % ("e1", "opened", 1) + line % ("e1", "opened", 1) + line % ("e2", "closed", 2))
    stream = streaming.without_replays(streaming.events(spark, str(tmp_path / "in")))
    sink = streaming.upsert_sink(str(tmp_path / "out"), ["repository", "number"])
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = streaming.current(spark, str(tmp_path / "out"), ["repository", "number"]).collect()
    assert [(r.number, r.action) for r in rows] == [(17, "closed")]


def test_dense_takes_blocks_of_queries_and_breaks_ties_by_id(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(300, 6))
    vectors[40:80] = vectors[7]  # many equal scores
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [1.0] * 6), (999, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieve.dense(rows.where("vec_id % 10 = 0"), rows, 4).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {}
    for q in range(0, 300, 10):
        order = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if i != q)[:4]
        want |= {(q, k + 1): i for k, (_, i) in enumerate(order)}
    assert got == want
    assert retrieve.dense(rows.limit(0), rows, 4).count() == 0


def test_auc_permutation_and_difference_on_a_clear_case(spark):
    rows = spark.createDataFrame([(i, i % 5, i % 2 == 0, (10 + i % 3) if i % 2 == 0 else i % 3, 1 + i % 3) for i in range(60)], "task long, cluster long, positive boolean, x int, y int")
    p = roc.auc_permutation(rows, "task", "positive", 50).first()
    assert p["observed"] == pytest.approx(0.5, abs=1e-9) and p["p"] == 0.0
    long = rows.select("cluster", "positive", F.explode(F.array(F.struct(F.lit(1).alias("arm"), F.col("x").alias("score")), F.struct(F.lit(2).alias("arm"), F.col("y").alias("score")))).alias("r")).select("cluster", "positive", "r.*")
    d = roc.auc_difference(spark, long, "cluster", "arm", 1, 2, "score", F.col("positive"), 40).first()
    assert d["point"] == pytest.approx(0.5, abs=1e-9) and d["low"] <= d["point"] <= d["high"] and d["reading"] == "gain"


def test_transitions_leave_out_missing_flags(spark):
    rows = spark.createDataFrame([("d", 1.0, 0.0), ("d", 1.0, None), ("t", 0.0, 1.0), ("t", 0.0, 0.0)], "side string, x double, y double")
    assert {r[0]: tuple(r)[1:] for r in roc.transitions(rows, ["side"]).collect()} == {"d": (0, 1, 0, 0), "t": (0, 0, 1, 1)}
