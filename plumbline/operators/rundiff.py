"""Two runs over the same items: AUC, detection measures, and their differences between arms and between runs.

Every cell (run, arm) enters a draw as columns of one vector of cluster sums: a histogram of ratings for the AUC, four
counts for the binary measures.  All statistics of a draw come from that vector, so all cells share the draws."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialize
from .resample import drawn_sums, numbered

MEASURES = ("h", "f", "d_prime", "criterion")


def _auc(hist: np.ndarray) -> np.ndarray:
    """hist (…, 2, scores), positives and negatives by rising score -> AUC; nan if a class is empty."""
    hd, ht = hist[..., 0, :], hist[..., 1, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (hd * (np.cumsum(ht, -1) - 0.5 * ht)).sum(-1) / (hd.sum(-1) * ht.sum(-1))


def _detection(counts: np.ndarray) -> np.ndarray:
    """counts (…, 4): positives, negatives, and the flagged of both -> (…, 4) clamped H and F, d' and c."""
    z = np.vectorize(NormalDist().inv_cdf, otypes=[float])
    n, flagged = counts[..., :2], counts[..., 2:]
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = np.minimum(np.maximum(flagged / n, 1 / (2 * n)), 1 - 1 / (2 * n))
    whole = (n > 0).all(-1)
    q = np.full(rate.shape, np.nan)
    if whole.any():
        q[whole] = z(rate[whole])
    rate = np.where(whole[..., None], rate, np.nan)
    return np.stack([rate[..., 0], rate[..., 1], q[..., 0] - q[..., 1], -(q[..., 0] + q[..., 1]) / 2], -1)


def statistics(arms: list) -> list[tuple[str, str | None, int, int | None]]:
    """(statistic, run or None for A - B, arm, base arm or None), in the order of _values()."""
    runs, arm, pairs = ("A", "B"), range(len(arms)), range(len(arms) - 1)
    top = len(arms) - 1
    out = [("auc", r, a, None) for r in runs for a in arm]
    out += [("d_auc", r, top, a) for r in runs for a in pairs] + [("d_auc", None, top, a) for a in pairs] + [("d_auc_common", None, top, a) for a in pairs]
    for m in MEASURES:
        out += [(m, r, a, None) for r in runs for a in arm] + [(m, None, a, None) for a in arm]
        out += [(m, r, top, a) for r in runs for a in pairs] + [(m, None, top, a) for a in pairs]
    return out


def _values(sums: np.ndarray, arms: int, scores: int) -> np.ndarray:
    """sums (draws, columns) -> (draws, statistics)."""
    cells, n = 2 * arms, len(sums)
    hist = sums[:, : 4 * cells * scores].reshape(n, 2, 2, arms, 2, scores)  # all or common, run, arm, class, score
    curve, common = _auc(hist[:, 0]), _auc(hist[:, 1])
    found = _detection(sums[:, 4 * cells * scores :].reshape(n, 2, arms, 4))
    change = lambda x: x[:, :, -1:] - x[:, :, :-1]  # noqa: E731  the last arm less each other, per run
    between = lambda x: x[:, 0] - x[:, 1]
    flat = lambda x: x.reshape(n, -1)
    out = [flat(curve), flat(change(curve)), between(change(curve)), between(change(common))]
    for m in range(len(MEASURES)):
        x = found[..., m]
        out += [flat(x), between(x), flat(change(x)), between(change(x))]
    return np.concatenate(out, axis=1)


def compare_runs(rows: DataFrame, arms: list, positive: Column, scores: int = 101, trials: int = 6000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """rows(run, arm, task, cluster, score, hit) of the runs 'A' and 'B' -> (statistic, run, arm, base, nd, nt, value,
    low, high), one row a statistic.

    `auc` is of the ratings 0 to scores - 1, `d_auc` the last arm's less each other arm's, with run null for the
    difference between the runs, `d_auc_common` the same over the tasks that all cells scored; h, f, d_prime and
    criterion are of the binary hit, per arm, between runs, between arms, and both.  Clusters without a scored row in
    every cell are left out; rows without a hit have no say in the binary measures.  Intervals are of the sorted
    draws by position; draws that lack a class do not count."""
    spark = rows.sparkSession
    place = F.coalesce(*[F.when(F.col("arm") == a, F.lit(k)) for k, a in enumerate(arms)])
    cell = rows.where(F.col("run").isin("A", "B") & F.col("arm").isin(*arms))
    rating = F.col("score").cast("int")
    cell = cell.select("task", "cluster", F.when(rating.between(0, scores - 1), rating).alias("score"), "hit", F.when(positive, 0).otherwise(1).alias("side"), (F.when(F.col("run") == "A", 0).otherwise(len(arms)) + place).alias("cell"))
    # A task's cells are the bits of a number, so that the rows are read once and meet no other copy of themselves.
    bits = F.bit_or(F.when(F.col("score").isNotNull(), F.expr("shiftleft(1L, cell)"))).over(W.partitionBy("task"))
    cell = cell.withColumn("common", F.coalesce(F.col("task").isNotNull() & (bits == (1 << 2 * len(arms)) - 1), F.lit(False)))
    counts = materialize(cell.groupBy("cluster", "cell", "side", "score", "hit", "common").agg(F.count("*").alias("n")), "run-counts")
    scored = counts.where("score is not null")
    in_all = scored.groupBy("cluster").agg(F.countDistinct("cell").alias("_n")).where(F.col("_n") == 2 * len(arms)).select("cluster")
    clusters = numbered(in_all, "cluster")
    n = F.col("n").cast("double").alias("value")
    ratings = scored.select("cluster", ((F.col("cell") * 2 + F.col("side")) * scores + F.col("score")).alias("column"), n, "common")
    common = ratings.where("common").withColumn("column", F.col("column") + 4 * len(arms) * scores)
    last = 8 * len(arms) * scores
    flags = counts.where("hit is not null").select("cluster", F.explode(F.array(*[F.struct((F.lit(last) + F.col("cell") * 4 + F.col("side") + 2 * k).alias("column"), (on.cast("double") * n).alias("value")) for k, on in enumerate((F.lit(1), F.col("hit")))])).alias("x")).select("cluster", "x.column", "x.value")
    counted = ratings.unionByName(common).drop("common").unionByName(flags)
    entries = counted.groupBy("cluster", "column").agg(F.sum("value").alias("value")).join(clusters, "cluster")
    entries = materialize(entries.select("slot", "k", F.col("column").cast("int").alias("column"), "value"), "run-cells")
    width, named = last + 8 * len(arms), statistics(arms)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = np.stack(batch.column("sums").to_numpy(zero_copy_only=False))
                values = _values(sums, len(arms), scores)
                columns = [np.repeat(batch.column("draw").to_numpy(), len(named)), np.tile(np.arange(len(named)), len(values)), values.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["draw", "id", "value"])

    own = entries.groupBy("column").agg(F.sum("value").alias("value")).collect()  # at most one row a column
    point = np.zeros((1, width))
    for r in own:
        point[0, r["column"]] = r["value"]
    values = _values(point, len(arms), scores)[0]
    drawn = drawn_sums(entries, width, trials, seed).mapInArrow(measure, "draw long, id long, value double").where("not isnan(value)")
    listed = drawn.groupBy("id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    tail = (1 - level) / 2
    at = lambda q, shift: F.get("v", F.least(F.greatest(F.floor(q * F.size("v") + 1e-9).cast("int") + shift, F.lit(0)), F.size("v") - 1))
    ends = listed.select("id", at(tail, 0).alias("low"), at(1 - tail, -1).alias("high"))
    hist, flagged = point[0, : last // 2].reshape(2 * len(arms), 2, scores).sum(-1), point[0, last:].reshape(2 * len(arms), 4)
    table = []
    for k, ((name, run, arm, base), value) in enumerate(zip(named, values)):
        of = None
        if run and base is None:
            c = arm + len(arms) * (run == "B")
            of = (hist if name == "auc" else flagged)[c]
        table.append((k, name, run, arms[arm], None if base is None else arms[base], *(map(int, of[:2]) if of is not None else (None, None)), None if np.isnan(value) else float(value)))
    kind = dict(rows.dtypes)["arm"]
    stated = spark.createDataFrame(table, f"id long, statistic string, run string, arm {kind}, base {kind}, nd long, nt long, value double")
    return stated.join(ends, "id", "left").drop("id")
