"""Roll-ups, access filters, merges and histories of the review store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_rollup(usage: DataFrame, model: str, sums: dict[str, Column], digits: int = 6) -> DataFrame:
    """Totals per model and a grand total (model null, is_total true)."""
    return usage.rollup(model).agg(*[F.round(F.sum(c), digits).alias(n) for n, c in sums.items()], F.count("*").alias("calls"), (F.grouping(model) == 1).alias("is_total"))


def cost_of(usage_cost: Column, cost: Column) -> Column:
    """The usage's cost if there is one, else the row's, null as 0."""
    return F.coalesce(usage_cost, cost, F.lit(0.0))


def price(model: Column, prices: list[tuple[str, float]], default: float) -> Column:
    """Price of the first entry, in declared order, whose name is part of the model's."""
    out = None
    for name, value in prices:
        out = F.when(F.contains(model, F.lit(name)), value) if out is None else out.when(F.contains(model, F.lit(name)), value)
    return out.otherwise(default) if out is not None else F.lit(default)


def visible(rows: DataFrame, grants: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key any of the grant tables has: one semi-join on their union, so nothing fans out."""
    union = grants[0].select(key)
    for g in grants[1:]:
        union = union.union(g.select(key))
    return rows.join(union.distinct(), key, "left_semi")


def merge_left_wins(ours: DataFrame, theirs: DataFrame, key: str, names: tuple[str, str] = ("db", "remote")) -> DataFrame:
    """Our rows and those of theirs whose key we lack, with their source."""
    return ours.withColumn("source", F.lit(names[0])).unionByName(theirs.join(ours.select(key), key, "left_anti").withColumn("source", F.lit(names[1])))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Latest row per key; columns of the new row that are null keep the old value."""
    cols = [c for c in old.columns if c not in key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = lambda c: F.max_by(c, F.struct("_new", order)).alias(c) if c == order else F.max(F.when(F.col(c).isNotNull(), F.struct("_new", order, c)))[c].alias(c)
    return both.groupBy(*key).agg(*[last(c) for c in cols])


def latest(rows: DataFrame, by: list[str], order: list[str], k: int = 1) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "children") -> DataFrame:
    """Parents with the number of their children, 0 included; children are counted before the join."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])


def membership(events: DataFrame, key: list[str], action: str, order: list[str]) -> DataFrame:
    """Keys whose last event is not a removal."""
    last = events.groupBy(*key).agg(F.max_by(action, F.struct(*order)).alias("last"))
    return last.where("last != 'removed'").select(*key)


def first_violation(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(rule, violations) of every constraint in declared order, by one aggregation."""
    counts = rows.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, bad) in enumerate(rules)])
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (name, _) in enumerate(rules)])
    return counts.select(F.explode(listed).alias("x")).select("x.*")


def lru_keep(files: DataFrame, mtime: str, size: str, id_: str, keep_bytes: int, partitions: str | None = None) -> DataFrame:
    """The newest files whose running size stays within keep_bytes, per partition of a cache."""
    w = (W.partitionBy(partitions) if partitions else W.partitionBy(F.lit(0))).orderBy(F.desc(mtime), id_).rowsBetween(W.unboundedPreceding, 0)
    return files.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= keep_bytes)


def search(rows: DataFrame, columns: list[str], needle: str, filters: dict | None = None) -> DataFrame:
    """Rows with the needle, ignoring case, in any of the columns, and with the given exact values."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(needle.lower()))
    for c, v in (filters or {}).items():
        hit = hit & (F.col(c) == v)
    return rows.where(hit)
