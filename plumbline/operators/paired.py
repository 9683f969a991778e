"""Paired experiments: one row per task and arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import mcnemar_exact, ratio
from ..tables import spread


def dedupe(df: DataFrame, keys: list[str], order: list[str], last: bool = False, deal: list[str] = ()) -> DataFrame:
    """One row per key: the first in `order`, or the last.  A struct maximum or minimum, so repeats are combined
    before the shuffle instead of being sorted after it.

    With `deal`, some of the keys of which each has few rows, rows are dealt by these at once: whole splits are not
    sorted before the shuffle, and what joins or groups by these keys later needs no shuffle of its own.  The number
    of tasks is given, as their sorts stay in memory side by side and joined partitions would make them large."""
    if deal:
        df = spread(df, *deal)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in rest if c not in order])
    best = F.max(row) if last else F.min(row)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def complete_tasks(df: DataFrame, task: str, arm: str, arms: int | None = None) -> DataFrame:
    """Relational division: the rows of tasks that have every arm (every one seen, if `arms` is not given)."""
    total = F.lit(arms) if arms is not None else df.select(F.countDistinct(arm)).scalar()
    whole = df.groupBy(task).agg(F.countDistinct(arm).alias("_n")).where(F.col("_n") == total).select(task)
    return df.join(whole, task, "left_semi")


def pair_arms(df: DataFrame, task: str, arm: str, a, b, metric: str, keep: list[str] = ()) -> DataFrame:
    """(task, keep…, x, y): the metric in both arms as a double, by one aggregation instead of a self-join.  Tasks
    without a value in either arm keep a null, to be counted as skipped."""
    value = lambda which: F.max(F.when(F.col(arm) == which, F.col(metric).cast("double")))
    return df.where(F.col(arm).isin(a, b)).groupBy(task, *keep).agg(value(a).alias("x"), value(b).alias("y"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs, skipped, means, difference a - b, discordant counts and McNemar's exact p."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    counts = pairs.agg(
        F.count_if(both).alias("n"),
        F.count_if(~both).alias("skipped"),
        F.avg(F.when(both, F.col("x"))).alias("mean_a"),
        F.avg(F.when(both, F.col("y"))).alias("mean_b"),
        F.avg(F.col("x") - F.col("y")).alias("difference"),
        F.count_if(F.col("x") > F.col("y")).alias("b"),
        F.count_if(F.col("x") < F.col("y")).alias("c"),
    )
    return counts.withColumn("p", mcnemar_exact(F.col("b"), F.col("c")))


def family(df: DataFrame, task: str, arm: str, base, others: list, metric: str) -> DataFrame:
    """(arm, n, b, c, p): McNemar's test of `base` against each other arm, by one aggregation over all of them."""
    value = lambda which: F.max(F.when(F.col(arm) == which, F.col(metric).cast("int")))
    wide = df.where(F.col(arm).isin(base, *others)).groupBy(task).agg(value(base).alias("_x"), *[value(o).alias(f"_y{k}") for k, o in enumerate(others)])
    x = F.col("_x")
    counts = [F.count_if(c).alias(f"{n}{k}") for k in range(len(others)) for y in [F.col(f"_y{k}")] for n, c in (("n", x.isNotNull() & y.isNotNull()), ("b", x > y), ("c", x < y))]
    listed = F.array(*[F.struct(F.lit(o).alias("arm"), *[F.col(f"{n}{k}").alias(n) for n in "nbc"]) for k, o in enumerate(others)])
    return wide.agg(*counts).select(F.explode(listed).alias("r")).select("r.*").withColumn("p", mcnemar_exact(F.col("b"), F.col("c")))


def holm(df: DataFrame, p: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """Holm's step-down adjustment in column `holm`: running maximum of (m - rank + 1) * p, at most 1.  Families are
    small tables of tests; pass `by` for several."""
    family = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ranked = family.orderBy(p, *order)
    m, rank = F.count("*").over(family), F.row_number().over(ranked)
    raw = df.withColumn("_raw", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    return raw.withColumn("holm", F.max("_raw").over(ranked.rowsBetween(W.unboundedPreceding, 0))).drop("_raw")


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement and Cohen's kappa of two boolean ratings; null kappa if chance agreement is 1."""
    a, b = a.cast("double"), b.cast("double")
    s = df.where(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("agreement"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", "agreement", F.when(chance != 1, (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def arm_table(df: DataFrame, arm: str, metric: Column, extras: dict[str, Column]) -> DataFrame:
    """Per arm: rows, rows with a metric, missing, its mean, and the mean of each extra with null as 0."""
    return df.groupBy(arm).agg(
        F.count("*").alias("n"),
        F.count(metric).alias("n_metric"),
        (F.count("*") - F.count(metric)).alias("missing"),
        F.avg(metric.cast("double")).alias("mean_metric"),
        *[F.avg(F.coalesce(c.cast("double"), F.lit(0.0))).alias(f"mean_{name}") for name, c in extras.items()],
    )


def balanced_means(df: DataFrame, arm: str, metric: Column, positive: Column) -> DataFrame:
    """Per arm: the metric's mean over positives, over negatives, and the mean of both; null if a side is empty."""
    side = lambda keep: F.avg(F.when(keep, metric.cast("double")))
    out = df.groupBy(arm).agg(side(positive).alias("defects"), side(~positive).alias("twins"))
    return out.withColumn("balanced", (F.col("defects") + F.col("twins")) / 2)


def common_keys(df: DataFrame, arm: str, keys: list[str], arms: list) -> DataFrame:
    """(arm, n, rate) over the keys that every one of the arms has; repeated rows of a key count once, as hit if any
    of them is.  df(arm, keys…, hit)."""
    once = df.where(F.col(arm).isin(*arms)).groupBy(arm, *keys).agg(F.bool_or("hit").alias("hit"))
    whole = once.groupBy(*keys).agg(F.countDistinct(arm).alias("_n")).where(F.col("_n") == len(arms)).drop("_n")
    return once.join(whole, keys, "left_semi").groupBy(arm).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("rate"))


def condition_summary(outcomes: DataFrame, by: str, task: str, hit: Column, reported: Column, tokens: Column, cost: Column) -> DataFrame:
    """Per condition: tasks, defects, hits, recall, false positives, precision, F1, tokens and cost per hit."""
    s = outcomes.groupBy(by).agg(
        F.countDistinct(task).alias("tasks"), F.count("*").alias("defects"), F.count_if(hit).alias("hits"), F.sum(reported).alias("reported"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost")
    )
    s = s.withColumn("false_positives", F.greatest(F.lit(0), F.col("reported") - F.col("hits"))).withColumn("recall", ratio(F.col("hits"), F.col("defects"), 0.0))
    s = s.withColumn("precision", ratio(F.col("hits"), F.col("hits") + F.col("false_positives"), 0.0))
    s = s.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0), F.lit(0.0)))
    return s.withColumn("cost_per_hit", ratio(F.col("cost"), F.col("hits"))).withColumn("tokens_per_hit", ratio(F.col("tokens"), F.col("hits")))
