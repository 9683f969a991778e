"""Text rules, benchmarks, resampling, the store and sources."""

import hashlib
import hmac
import json
import zipfile
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from plumbline import streaming
from plumbline.functions import hashing, stats, text
from plumbline.operators import audit, bench, evidence, graph, match, resample, retrieve, roc, store
from plumbline.plans.sqlmath import probit_sql
from plumbline.sources import cached, flat_paths, read_sources, read_zip_results
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame(pd.DataFrame([values])).select(column.alias("v")).first().v


@pytest.mark.parametrize("value, want", [("80%", 80), (" 57 ", 57), ("+57", None), ("70.5", 70), ("71.5", 72), ("101", None), ("-3", None), ("x", None), ("100", 100), ("100.4", None)])
def test_confidence(spark, value, want):
    assert one(spark, text.parse_confidence(F.col("x")), x=value) == want


def test_ratings_of_replies(spark):
    def rated(reply, headers=(1, 20), line=20):
        return spark.createDataFrame([(reply, list(headers), line)], "r string, h array<int>, l int").select(text.parse_hunk_ratings("r", "h", "l").alias("v")).first().v

    full = rated(json.dumps({"hunk_ratings": [{"line": 1, "defect_probability": "70%"}, {"line": "+20", "defect_probability": 30.0}, {"line": 9, "defect_probability": 1}, {"line": 20}, 5]}))
    assert (full.hunk_score, full.hunk_ratings, full.unmatched_rating_lines, full.invalid_rating_entries, full.hunks_rated, full.rating_missing) == (30, {"1": 70, "20": 30}, [9], 2, 2, False)
    twice = rated('x {"hunk_ratings": [{"line": 20, "defect_probability": 1}, {"line": 20, "defect_probability": 2}]}')
    assert (twice.hunk_score, twice.ratings_ambiguous, twice.rating_missing) == (None, [20], True)
    none = rated("no json")
    assert none.json_failed and not none.rating_missing and none.hunk_score is None and not none.ratings_present


def test_unicode_names_count_as_words(spark):
    r = one(spark, text.names_in(F.col("x")), x="in größe_maß, `été_x()`, 'ab' and https://x.org/some_name; class lambda_ `lambda`")
    assert r.idents == ["größe_maß"] and r.paths == []
    assert one(spark, text.names_caller(F.col("m"), F.array(F.lit("f.x"))), m="the F.X breaks") and not one(spark, text.names_caller(F.col("m"), F.array(F.lit("fx"))), m="the fxy breaks")


def test_entity_source_keeps_within_the_text(spark):
    body = "a\nb\nc\n"
    assert one(spark, text.entity_source(F.col("t"), F.lit(0), F.lit(9)), t=body) == "a\nb\nc"
    assert one(spark, text.entity_source(F.col("t"), F.lit(5), F.lit(9)), t=body) is None
    assert one(spark, text.entity_source(F.col("t"), F.lit(1), F.lit(3), 2), t=body) == "a\nb\n    # ... 1 more lines"
    assert one(spark, text.window(F.col("t"), F.lit(1), 1), t=body)[:] == (1, 2, "a\nb")


def test_greedy_matching_agrees_with_a_plain_loop(spark):
    rnd = np.random.default_rng(2)
    d = [(f"p{rnd.integers(6)}", f"d{i}", int(rnd.integers(60)), i) for i in range(150)]
    f = [(f"p{rnd.integers(6)}", f"f{i}", int(rnd.integers(60)), i) for i in range(120)]
    used, want = set(), {}
    for path, name, line, _ in d:
        near = sorted((abs(fl - line), o, fid) for fp, fid, fl, o in f if fp == path and abs(fl - line) <= 5 and fid not in used)
        want[name] = (near[0][2], near[0][0]) if near else (None, None)
        used |= {near[0][2]} if near else set()
    got = match.greedy_match(spark.createDataFrame(d, "path string, defect_id string, d_line int, d_ord int"), spark.createDataFrame(f, "path string, finding_id string, f_line int, f_ord int"), ["path"], 5)
    assert {r.defect_id: (r.finding_id, r.distance) for r in got.collect()} == want


def test_zroc_slope_takes_inner_points_only(spark):
    rows = [("a", s, True) for s in (0, 30, 50, 70, 70, 90)] + [("a", s, False) for s in (0, 0, 10, 30, 50, 90)] + [("b", 5, True), ("b", 5, False)]
    got = {r.arm: (r.slope, r.points) for r in roc.zroc_slope(roc.score_histogram(spark.createDataFrame(rows, "arm string, score int, d boolean"), ["arm"], "score", F.col("d")), ["arm"], "score").collect()}
    z, pts = NormalDist().inv_cdf, set()
    for t in range(1, 101):
        h, f = (np.mean([s >= t for a, s, d in rows if a == "a" and d == c]) for c in (True, False))
        if 0 < h < 1 and 0 < f < 1:
            pts.add((z(f), z(h)))
    x, y = np.array(sorted(pts)).T
    assert got["a"] == (pytest.approx(np.polyfit(x, y, 1)[0]), len(pts)) and got["b"] == (None, 0)


def test_auc_permutation_agrees_with_plain_counting(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, bool(i % 2), int(rnd.integers(5)) + 2 * (i % 2), int(rnd.integers(5))) for i in range(60)]

    def auc(scores):
        pairs = [(a > b) + 0.5 * (a == b) for (_, p, *_), a in zip(rows, scores) if p for (_, q, *_), b in zip(rows, scores) if not q]
        return np.mean(pairs)

    seen = auc([r[2] for r in rows]) - auc([r[3] for r in rows])
    swaps = hashing.coins(0, [str(r[0]) for r in rows], 200)
    null = [auc([r[3] if s else r[2] for r, s in zip(rows, c)]) - auc([r[2] if s else r[3] for r, s in zip(rows, c)]) for c in swaps.T]
    got = roc.auc_permutation(spark.createDataFrame(rows, "task long, positive boolean, x int, y int").repartition(3), "task", "positive", 200).first()
    assert got.observed == pytest.approx(seen) and got.p == pytest.approx(np.mean(np.abs(null) >= abs(seen) - 1e-9))


def test_auc_difference_by_matrix_and_by_join(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = spark.createDataFrame([(int(i % 7), "ab"[i % 2], bool(rnd.integers(2)), int(rnd.integers(6))) for i in range(300)], "cluster int, arm string, positive boolean, score int")
    results = []
    for limit in (10**6, 0):
        monkeypatch.setattr(roc, "HISTOGRAM_ROWS", limit)
        results.append(roc.auc_difference(spark, rows, "cluster", "arm", "a", "b", "score", F.col("positive"), 60).first().asDict())
    assert results[0] == pytest.approx(results[1])


def test_chance_draws(spark):
    rows = spark.createDataFrame([(1, 10, 1, 100), (2, 50, 50, 50)], "id long, line int, lo int, hi int")
    got = {r.id: r.rate for r in resample.chance_hits(rows, "id", "line", "lo", "hi", 5, 4000).collect()}
    assert got[2] == 1.0 and got[1] == pytest.approx(0.11, abs=0.02)
    numbers = hashing.numbers(0, ["k"], 6)[0]
    assert [int(x) for x in numbers[:4]] == [int(hashlib.md5(b"0|0|k").hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]


def test_mcnemar_and_probit(spark):
    import duckdb

    r = spark.createDataFrame([(10, 2), (0, 0)], "b long, c long").select(stats.mcnemar_corrected(F.col("b"), F.col("c")).alias("p"), stats.mcnemar_exact(F.col("b"), F.col("c")).alias("e")).collect()
    assert r[0].p == pytest.approx(2 * (1 - NormalDist().cdf(7 / 12**0.5))) and r[0].e == pytest.approx(0.03857421875) and (r[1].p, r[1].e) == (1.0, 1.0)
    for p in (0.001, 0.07, 0.3, 0.5, 0.93, 0.9999):
        assert duckdb.connect().sql(f"select {probit_sql(f'{p}::double')} as z").fetchall()[0][0] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-12)


def test_frontiers_end_and_hubs_count_once(spark):
    hub = [("h", f"x{i}") for i in range(300)] + [(f"x{i}", f"y{i % 3}") for i in range(300)]
    e = spark.createDataFrame([(*p, "calls") for p in hub], "src string, dst string, label string")
    got = {r.id: r.depth for r in graph.bfs(e, spark.createDataFrame([("h",)], "id string"), 50, directed=True).collect()}
    assert len(got) == 304 and got["y2"] == 2
    comments = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 99)], "id long, parent long")
    assert {r.id: (r.root, r.depth) for r in graph.reply_tree(comments).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0)}


def test_positions_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    assert {r.k: r.shard for r in retrieve.round_robin(rows, [F.col("k")], 4).collect()} == {k: k % 4 for k in range(101)}


def test_evidence_of_a_chain(spark):
    body = "\n".join(f"line{i}" for i in range(1, 60)) + "\ndef far():\n    pass\n"
    sources = spark.createDataFrame([("r", "a.py", body), ("r", "b.py", body), ("r", "c.py", body)], "repo string, path string, text string")
    schema = "task_id string, repo string, kind string, argument string, evidence string, is_defect boolean, defect_path string, defect_line int, caller_path string, caller_line int, via_path string, via_line int"
    tasks = spark.createDataFrame([("t1", "r", "none_sentinel", "", "", True, "a.py", 10, "b.py", 20, "c.py", 30), ("t2", "r", "default_flip", "deep", "", False, "a.py", 10, "b.py", 20, None, None), ("t3", "r", "default_flip", "", "", True, "gone.py", 1, "b.py", 2, None, None)], schema)
    got = {r.task_id: r for r in evidence.evidence_for(tasks, sources).collect()}
    assert set(got) == {"t1", "t2"} and len(got["t1"].snippets) == 4 and [r.kind for r in got["t1"].relations] == ["checks-return-of", "returns-result-of"]
    assert [r.kind for r in got["t2"].relations] == ["calls-with-argument"] and got["t2"].snippets[2].label == "a.far"
    hidden = evidence.evidence_for(tasks, sources, hide=True).collect()
    assert [r.task_id for r in hidden] == ["t1"] and hidden[0].snippets[1]["last"] < 20


def test_benchmark_edges(spark):
    rows = spark.createDataFrame([("t", "A", "./src/x.py", 5), ("t", "A", "y.py", 5), ("t", "A", "src/x.py", None), ("t", "B", "x.py", 9)], "task_id string, condition string, path string, line int")
    tasks = spark.createDataFrame([("t", "a/src/x.py", 5, [9], "k")], "task_id string, defect_path string, defect_line int, distractor_lines array<int>, kind string")
    got = {r.condition: (r.hit, r.flagged, r.findings, r.precise) for r in bench.review_scores(tasks, rows).collect()}
    assert got == {"A": (True, 0, 3, True), "B": (False, 1, 1, False)}
    assert bench.score_summary(bench.review_scores(tasks, rows.limit(0)), ["condition"]).count() == 0
    goals = bench.targets(spark.createDataFrame([("t", "a.py", 3), ("t", "", 3), ("t", "a.py", None)], "task_id string, path string, line int"))
    assert [tuple(r) for r in goals.collect()] == [("t", "a.py", 3)]


def test_store(spark):
    comments = spark.createDataFrame([("t", 1, "u", "hi", "request", None, 1)], "thread string, id long, user string, comment string, type string, parent long, at long")
    messages = spark.createDataFrame([("t", 2, "u", "more", 1, 2), ("t", 3, "u", "", None, 3), ("t", 4, "u", "lost", 77, 4)], "thread string, id long, user string, comment string, parent long, at long")
    answers = spark.createDataFrame([(2, 5, "yes", 5), (4, 6, "no", 6)], "request long, id long, comment string, at long")
    out = store.reply(comments, messages, answers)
    assert sorted(r.id for r in out.collect()) == [1, 2, 5]
    assert [(h.type, h.comment) for h in store.conversation(out).first().history] == [("request", "hi"), ("request", "more"), ("response", "yes")]
    usage = spark.createDataFrame([], "review long, user long, llm_model string, input_tokens int, output_tokens int, cost double")
    kept, used = store.submit_ratings(spark.createDataFrame([(1, 1, 2, "a")], "review long, user long, rating int, feedback string"), usage, spark.createDataFrame([(1, 1, 5, "b", 1), (1, 1, 6, "c", 2), (2, 1, 4, None, 3)], "review long, user long, rating int, feedback string, at long"), F.lit("m"))
    assert [tuple(r) for r in kept.collect()] == [(1, 1, 5, "b")] and used.count() == 1


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "m.py").write_text("x = 1\n")
    (tmp_path / "src" / "n.md").write_text("no")
    files = read_sources(spark, str(tmp_path / "src"))
    assert [(r.text, r.suffix, r.folders[-1]) for r in flat_paths(files).collect()] == [("x = 1\n", ".py", "a")]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("d/result.json", json.dumps({"results": [{"instance_id": "i", "comment": "c", "verified": True}]}))
        z.writestr("d/other.json", "{}")
    assert [(r.name, r.instance_id, r.verified) for r in read_zip_results(spark, str(tmp_path / "r.zip")).collect()] == [("d/result.json", "i", True)]
    build = lambda: spark.range(3)
    assert cached(spark, str(tmp_path / "cache"), {"repo": "r", "commit": "c"}, build).count() == cached(spark, str(tmp_path / "cache"), {"repo": "r", "commit": "c"}, lambda: 1 / 0).count() == 3
    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("body", good), ("body", "sha256=0"), ("body", None)], "payload string, header string")
    assert [r.v for r in rows.select(streaming.signature_ok("k")("payload", "header").alias("v")).collect()] == [True, False, False]


def test_audits(spark):
    tasks = spark.createDataFrame(
        [("a", "pkg/d.py", 2, "@@ -1,1 +1,1 @@\n-x = 'a'\n+x = \"a\"\n@@ -2,1 +2,1 @@\n-y = 1\n+y = 2\n", "x = 'a'\ny = 1\n", "use.py", "from pkg.d import f\n", "f"), ("b", "pkg/d.py", 1, "@@ -2,1 +2,1 @@\n-y = 1\n+y = 3\n", "x = 1\ny = 1\n", "use.py", "import other\n", "f"), ("c", "d.py", 1, "", "def (", "u.py", "", "f"), ("d", "d.py", 1, "", None, "u.py", "", "f")],
        "task_id string, defect_path string, defect_line int, diff string, defect_text string, caller_path string, caller_text string, name string",
    )
    got = {r.task_id: tuple(r)[1:] for r in audit.audit_tasks(tasks).collect()}
    assert got == {"a": (None, True, 0, True), "b": (None, False, 1, False), "c": ("unparseable", None, None, None), "d": ("sources missing", None, None, None)}
    total = audit.audit_summary(audit.audit_tasks(tasks), []).first()
    assert (total.tasks, total.unresolved, total.tree_changing, total.defect_last, total.unread) == (4, 1, 1, 1, 2)
