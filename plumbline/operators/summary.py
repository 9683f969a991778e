"""Summaries that a report prints: parity, confusion, splits by length and by day, overlaps, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parity(rows: DataFrame, by: str, value: str, tolerance: float = 0.1) -> DataFrame:
    """(spread, parity): how far the groups' means lie apart, as a share of the largest, and whether that is tolerable."""
    means = rows.groupBy(by).agg(F.avg(value).alias("_mean"))
    spread = (F.max("_mean") - F.min("_mean")) / F.max("_mean")
    return means.agg(spread.alias("spread"), (spread <= tolerance).alias("parity"))


def confusion(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, n): the counts of each pair of labels."""
    return rows.groupBy(first, second).agg(F.count("*").alias("n"))


def long_short(rows: DataFrame, by: str, length: str, outcome: Column) -> DataFrame:
    """(by, class, n, rate): the outcome's rate among all rows of a group, those longer than its median, and the others."""
    medians = rows.groupBy(by).agg(F.percentile(length, 0.5).alias("_median"))
    side = F.when(F.col(length) > F.col("_median"), "long").otherwise("short")
    labelled = rows.withColumn("_outcome", outcome).join(medians, by).withColumn("class", F.explode(F.array(F.lit("all"), side)))
    return labelled.groupBy(by, "class").agg(F.count("*").alias("n"), F.avg(F.col("_outcome").cast("double")).alias("rate"))


def overlap_counts(got: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """(tp, fn): of the keys that both sides have, those that share a value and those that share none."""
    listed = lambda df, name: df.groupBy(key).agg(F.collect_set(value).alias(name))
    hit = listed(got, "_got").join(listed(truth, "_true"), key).select(F.arrays_overlap("_got", "_true").alias("hit"))
    return hit.agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))


def last_activity(comments: DataFrame, thread: str, order: str, asks: Column) -> DataFrame:
    """(thread, last, comments, asked): each thread's last comment by `order`, its comments, and those that ask."""
    return comments.groupBy(thread).agg(F.max(order).alias("last"), F.count("*").alias("comments"), F.count_if(asks).alias("asked"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(*[df.select(F.count("*")).scalar().alias(name) for name, df in tables.items()])


def day_split(rows: DataFrame, time: str, kind: str, value: str) -> DataFrame:
    """(day, kind, n, highest, median) of each day's rows of each kind."""
    return rows.groupBy(F.date_format(time, "yyyy-MM-dd").alias("day"), kind).agg(F.count("*").alias("n"), F.max(value).alias("highest"), F.percentile(value, 0.5).alias("median"))


def patterns(rows: DataFrame, who: str, kind: str) -> DataFrame:
    """(pattern, n): how many have each set of kinds, sorted and comma-joined."""
    own = rows.groupBy(who).agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("pattern"))
    return own.groupBy("pattern").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """(name, n): rows by the name that names(key, name) has for them; rows without one are left out."""
    return rows.join(names.select(key, name), key).groupBy(name).agg(F.count("*").alias("n"))
