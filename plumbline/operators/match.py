"""Interval and nearest joins on a path and a line.

A theta join on lines becomes an equi-join: lines fall into buckets at least as wide as the tolerance or interval
step, one side is repeated for the buckets it can reach, and the exact predicate follows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], line: str, other: str, tolerance: int) -> DataFrame:
    """Pairs with equal keys and |line - other| <= tolerance; null lines match nothing."""
    width = 2 * tolerance + 1
    l = left.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.floor((F.col(line) + d) / width) for d in (-tolerance, tolerance)]))))
    r = right.withColumn("_cell", F.floor(F.col(other) / width))
    return l.join(r, [*keys, "_cell"]).where(F.abs(F.col(line) - F.col(other)) <= tolerance).drop("_cell")


def overlapping(points: DataFrame, spans: DataFrame, keys: list[str], first: str, last: str, lo: str, hi: str, width: int = 256) -> DataFrame:
    """Pairs of intervals [first, last] and [lo, hi] with equal keys that overlap.  Both sides are laid out over
    buckets; a pair is taken in the first bucket that it shares, so that it is found once."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    p = points.where(F.col(first) <= F.col(last)).withColumn("_cell", cells(first, last))
    s = spans.where(F.col(lo) <= F.col(hi)).withColumn("_cell", cells(lo, hi))
    joined = p.join(s, [*keys, "_cell"]).where((F.col(lo) <= F.col(last)) & (F.col(hi) >= F.col(first)))
    return joined.where(F.col("_cell") == F.floor(F.greatest(F.col(first), F.col(lo)) / width)).drop("_cell")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: list[str], line: str, lo: str, hi: str, order: list[str]) -> DataFrame:
    """For each point the smallest interval that contains it; ties by `order`."""
    p = points.withColumn("_at", F.col(line))
    found = overlapping(p, spans, keys, line, "_at", lo, hi)
    w = W.partitionBy(*point).orderBy(F.col(hi) - F.col(lo), *order)
    return found.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_at")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], id_: str, line: str, other: str, tolerance: int, order: list[str]) -> DataFrame:
    """For each left row its nearest right row within the tolerance, many to one."""
    found = within_tolerance(left, right, keys, line, other, tolerance)
    row = F.struct(F.abs(F.col(line) - F.col(other)).alias("distance"), *order)
    return found.groupBy(id_).agg(F.min(row).alias("_m")).select(id_, F.col("_m.distance").alias("distance"), *[F.col(f"_m.{c}").alias(c) for c in order])


def greedy_match(defects: DataFrame, findings: DataFrame, keys: list[str], tolerance: int = 5) -> DataFrame:
    """One-to-one: each defect in order takes the unconsumed finding nearest to it, the first of equals.

    defects(keys…, defect_id, d_line, d_ord), findings(keys…, finding_id, f_line, f_ord); keys hold the path.
    Returns (defect_id, hit, finding_id, distance) of every defect.  Consumption depends on order, so candidate pairs
    are read in order, path by path, with what is consumed so far; only candidate pairs get there.  Defects farther
    apart than the tolerance cannot share a finding, so that runs of a path are dealt by themselves."""
    pairs = within_tolerance(defects, findings, keys, "d_line", "f_line", tolerance)
    order = W.partitionBy(*keys).orderBy("d_line", "defect_id")
    gap = F.col("d_line") - F.lag("d_line").over(order) > 2 * tolerance
    runs = defects.where("d_line is not null").withColumn("_run", F.sum(F.when(gap, 1).otherwise(0)).over(order)).select(*keys, "defect_id", "_run")
    pairs = pairs.join(runs, [*keys, "defect_id"])
    defect_type, finding_type = pairs.schema["defect_id"].dataType.simpleString(), pairs.schema["finding_id"].dataType.simpleString()
    distance = F.abs(F.col("d_line") - F.col("f_line")).cast("long").alias("distance")
    pairs = pairs.select(F.xxhash64(*keys, "_run").alias("_group"), "defect_id", "finding_id", "d_ord", "f_ord", distance)

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, settled, used = None, None, set()
        for batch in batches:
            kept = []
            for k, (group, defect, finding) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_group", "defect_id", "finding_id")))):
                if group != at:
                    at, settled, used = group, None, set()
                if (group, defect) != settled and finding not in used:
                    used.add(finding)
                    settled = (group, defect)
                    kept.append(k)
            yield batch.select(["defect_id", "finding_id", "distance"]).take(pa.array(kept, pa.int64()))

    dealt = pairs.repartition("_group").sortWithinPartitions("_group", "d_ord", "defect_id", "distance", "f_ord")
    matched = dealt.mapInArrow(take, f"defect_id {defect_type}, finding_id {finding_type}, distance long")
    return defects.select("defect_id").join(matched, "defect_id", "left").select("defect_id", F.col("finding_id").isNotNull().alias("hit"), "finding_id", "distance")


def false_positives(findings: DataFrame, matched: DataFrame) -> DataFrame:
    return findings.join(matched.where("hit").select("finding_id"), "finding_id", "left_anti")
