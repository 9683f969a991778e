import pytest
from plumbline.functions import stats
from plumbline.operators import paired, resample
from pyspark.sql import functions as F


def test_first_row_wins_and_incomplete_tasks_go(spark):
    rows = [("t", a, True, 0) for a in ("1", "2", "3")] + [("t", "1", False, 1), ("t", "1", False, 2), ("t", "2", False, 1), ("u", "1", True, 0), ("u", "2", True, 0)]
    df = spark.createDataFrame(rows, "task string, arm string, precise boolean, ord int")
    first = paired.dedupe(df, ["task", "arm"], ["ord"])
    assert df.count() - first.count() == 3
    whole = paired.complete_tasks(first, "task", "arm").collect()
    assert sorted((r.arm, r.precise) for r in whole) == [("1", True), ("2", True), ("3", True)]
    last = paired.dedupe(df, ["task", "arm"], ["ord"], last=True)
    assert not last.where("task = 't' and arm = '1'").first().precise


def test_paired_summary_counts_nulls_and_discordants(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0), (4, 1.0, 0.0), (5, None, 1.0)], "task int, x double, y double")
    r = paired.paired_summary(df).first()
    assert (r.n, r.skipped, r.b, r.c) == (4, 1, 2, 1)
    assert r.difference == pytest.approx(0.25)


def test_mcnemar_exact_values(spark):
    cases = {(5, 0): 0.0625, (0, 5): 0.0625, (0, 0): 1.0, (4, 4): 1.0, (1, 6): 0.125, (20, 0): 2 * 0.5**20, (900, 1000): None}
    df = spark.createDataFrame([(b, c) for b, c in cases], "b int, c int")
    got = {(r.b, r.c): r.p for r in df.withColumn("p", stats.mcnemar_exact(F.col("b"), F.col("c"))).collect()}
    for key, want in cases.items():
        assert want is None and 0.02 < got[key] < 0.03 or got[key] == pytest.approx(want)


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    assert [r.holm for r in paired.holm(df, "p", ["i"]).orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06])
    df = spark.createDataFrame([(0, 0.9), (1, 0.8)], "i int, p double")
    assert [r.holm for r in paired.holm(df, "p", ["i"]).collect()] == [1.0, 1.0]


def test_cluster_bootstrap_contains_the_point(spark):
    pattern = [(1, 0), (1, 1), (0, 1), (1, 0), (0, 0), (1, 0)]
    df = spark.createDataFrame([(c, float(x), float(y)) for c in range(3) for x, y in pattern], "cluster int, x double, y double")
    r = resample.cluster_bootstrap(spark, df, "cluster", 200).first()
    assert r.point == pytest.approx(1 / 3) and r.low <= r.point <= r.high


def test_kappa_is_null_when_chance_agrees(spark):
    df = spark.createDataFrame([(True, True), (True, True)], "a boolean, b boolean")
    assert paired.kappa(df, F.col("a"), F.col("b")).first().kappa is None


def test_normal_functions(spark):
    r = spark.range(1).select(stats.probit(F.lit(0.975)).alias("z"), stats.normal_cdf(F.lit(0.0)).alias("p"), stats.probit(F.lit(1.0)).alias("none")).first()
    assert r.z == pytest.approx(1.959964, abs=1e-6) and r.p == 0.5 and r.none is None
