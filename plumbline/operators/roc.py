"""ROC and signal detection from score histograms: rows are counted once per (group, score), so that every curve
works on at most as many rows as there are scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import coins
from ..functions.stats import clamp_rate, probit
from ..tables import materialize
from .paired import complete_tasks
from .resample import drawn_sums, draws, interval, numbered


def score_histogram(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """(by…, score, hd, ht): positives and negatives at each score."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("hd"), F.count_if(~positive).alias("ht"))


def auc(hist: DataFrame, by: list[str], score: str, weight: str | None = None) -> DataFrame:
    """Tie-aware AUC per group: sum of hd * (negatives below + half of those equal) over nd * nt; null if a class is
    empty.  weight multiplies the counts, as for a bootstrap draw."""
    w = F.col(weight) if weight else F.lit(1)
    h = hist.groupBy(*by, score).agg(F.sum(w * F.col("hd")).alias("hd"), F.sum(w * F.col("ht")).alias("ht"))
    below = F.coalesce(F.sum("ht").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = h.withColumn("wins", F.col("hd") * (below + 0.5 * F.col("ht")))
    s = wins.groupBy(*by).agg(F.sum("hd").alias("nd"), F.sum("ht").alias("nt"), F.sum("wins").alias("wins"), F.sum(F.col("hd") * F.col("ht")).alias("ties"))
    pairs = F.col("nd").cast("double") * F.col("nt")
    return s.select(*by, "nd", "nt", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"), F.when(pairs > 0, F.col("ties") / pairs).alias("tie_share"))


def roc_points(hist: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by…, score, h, f): clamped hit and false-alarm rates of flagging scores at or above each threshold."""
    down = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    nd, nt = F.sum("hd").over(whole), F.sum("ht").over(whole)
    return hist.select(*by, score, clamp_rate(F.sum("hd").over(down), nd).alias("h"), clamp_rate(F.sum("ht").over(down), nt).alias("f"))


def zroc_slope(hist: DataFrame, by: list[str], score: str) -> DataFrame:
    """Least-squares slope of z(H) on z(F) over the distinct points of flagging scores of t and more, t from 1, with
    both rates, as they are, strictly between 0 and 1; null with fewer than three distinct F."""
    down = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    rate = lambda c: F.sum(c).over(down) / F.sum(c).over(whole)
    points = hist.select(*by, score, rate("hd").alias("h"), rate("ht").alias("f")).where(F.col(score) >= 1)
    points = points.select(*by, "h", "f").where("h > 0 and h < 1 and f > 0 and f < 1").distinct()
    slope = points.groupBy(*by).agg(F.when(F.countDistinct("f") >= 3, F.regr_slope(probit("h"), probit("f"))).alias("slope"), F.count("*").alias("points"))
    return hist.select(*by).distinct().join(slope, by, "left").fillna(0, ["points"])


def detection_rates(df: DataFrame, by: list[str], flagged: Column, positive: Column) -> DataFrame:
    """Clamped hit and false-alarm rates per group; null if the class is empty."""
    s = df.groupBy(*by).agg(
        F.count_if(positive).alias("nd"), F.count_if(~positive).alias("nt"), F.count_if(positive & flagged).alias("hd"), F.count_if(~positive & flagged).alias("ht")
    )
    rate = lambda x, n: F.when(F.col(n) > 0, clamp_rate(F.col(x), F.col(n)))
    return s.select(*by, "nd", "nt", rate("hd", "nd").alias("h"), rate("ht", "nt").alias("f"))


def d_prime(df: DataFrame, by: list[str], flagged: Column, positive: Column) -> DataFrame:
    """d' = z(H) - z(F) and c = -(z(H) + z(F)) / 2 per group."""
    z = detection_rates(df, by, flagged, positive).withColumn("zh", probit("h")).withColumn("zf", probit("f"))
    return z.select(*by, "nd", "nt", "h", "f", (F.col("zh") - F.col("zf")).alias("d_prime"), (-(F.col("zh") + F.col("zf")) / 2).alias("criterion"))


def _side_difference(curves: DataFrame, by: list[str], side: str, a, b) -> DataFrame:
    """(by…, e): AUC of side a less that of side b, where both have one."""
    of = lambda which: F.max(F.when(F.col(side) == which, F.col("auc")))
    return curves.groupBy(*by).agg((of(a) - of(b)).alias("e")).where("e is not null")


#: Distinct scores up to which a draw's histograms are one vector; beyond, the rows of histograms are joined with the
#: draws.
HISTOGRAM_ROWS = 100_000


def _drawn_differences(spark: SparkSession, hist: DataFrame, cluster: str, arm: str, a, b, score: str, trials: int, seed: int) -> DataFrame:
    """(draw, e): the AUC difference of each draw of clusters, from the drawn clusters' histograms, which are vectors
    of the draw."""
    clusters = numbered(hist.select(cluster).distinct(), cluster)
    levels = materialize(hist.select(score).distinct(), "levels")
    n = levels.count()
    if n > HISTOGRAM_ROWS:
        weights = draws(spark, clusters, trials, seed).join(clusters, "slot").select("draw", cluster, "m")
        return _side_difference(auc(hist.join(weights, cluster), ["draw", arm], score, "m"), ["draw"], arm, a, b)
    levels = levels.withColumn("_level", F.row_number().over(W.orderBy(score)) - 1)
    side = (F.col(arm) == b).cast("int") * (2 * n) + F.col("_level")
    both = F.explode(F.array(*[F.struct((side + k * n).alias("column"), F.col(c).cast("double").alias("value")) for k, c in enumerate(("hd", "ht"))])).alias("x")
    entries = hist.join(levels, score).join(clusters, cluster).select("slot", "k", both).select("slot", "k", F.col("x.column").cast("int").alias("column"), "x.value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hd, ht = np.stack(batch.column("sums").to_numpy(zero_copy_only=False)).reshape(-1, 2, 2, n).transpose(2, 0, 1, 3)
                with np.errstate(invalid="ignore", divide="ignore"):
                    curve = (hd * (np.cumsum(ht, -1) - 0.5 * ht)).sum(-1) / (hd.sum(-1) * ht.sum(-1))
                e = curve[:, 0] - curve[:, 1]
                yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array(e)], ["draw", "e"]).filter(pa.array(np.isfinite(e)))

    return drawn_sums(entries, 4 * n, trials, seed).mapInArrow(run, "draw long, e double")


def auc_difference(spark: SparkSession, rows: DataFrame, cluster: str, arm: str, a, b, score: str, positive: Column, trials: int = 6000, margin: float = 0.05, seed: int = 0) -> DataFrame:
    """One row: the AUC difference of arms a and b, its 95% and 90% intervals over resampled clusters, its reading, the
    two-sided bootstrap p and wider intervals (98.75% and 99.29%) for several comparisons.

    Only clusters that both arms scored count.  A cluster enters a draw through its score histogram, so that a draw
    costs (clusters x scores) whatever the number of items; both arms share the draws."""
    hist = score_histogram(rows.where(F.col(arm).isin(a, b)), [cluster, arm], score, positive)
    shared = hist.groupBy(cluster).agg(F.countDistinct(arm).alias("_arms")).where("_arms = 2")
    hist = hist.join(shared.select(cluster), cluster, "left_semi")
    spread = materialize(_drawn_differences(spark, hist, cluster, arm, a, b, score, trials, seed), "draws")
    point = _side_difference(auc(hist, [arm], score).withColumn("_all", F.lit(0)), ["_all"], arm, a, b).select(F.col("e").alias("point"))
    out = point.join(interval(spread, "e"))
    for level, name in ((0.90, "90"), (1 - 0.05 / 4, "9875"), (1 - 0.05 / 7, "9929")):
        out = out.join(interval(spread, "e", level).select(F.col("low").alias(f"low{name}"), F.col("high").alias(f"high{name}")))
    share = lambda c: F.avg(c.cast("double"))
    out = out.join(spread.agg((2 * F.least(share(F.col("e") <= 0), share(F.col("e") >= 0))).alias("p")))
    return out.withColumn("reading", reading(F.col("low"), F.col("low90"), F.col("high90"), margin))


def auc_permutation(pairs: DataFrame, key: str, positive: str, trials: int = 4000, seed: int = 0) -> DataFrame:
    """pairs(key, positive, x, y), scores of one item in two arms: the AUC difference and the share of label swaps
    whose difference is at least as large.

    A task counts its items once for all draws: the matrix of swaps times the change that a swap makes to the
    histogram.  What is shuffled are vectors of draws, one for each score and task."""
    both = pairs.where("x is not null and y is not null").select(F.col(key).cast("string").alias("key"), F.col(positive).alias("positive"), F.col("x").cast("double"), F.col("y").cast("double"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[float, np.ndarray] = {}  # score -> (first or second side) x (positive or not) x (as it is, draws…)
        for batch in batches:
            at = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("positive", "x", "y")]
            for k in range(0, batch.num_rows, 2000):
                positive, x, y = (c[k : k + 2000] for c in at)
                swap = coins(seed, batch.column("key")[k : k + 2000].to_pylist(), trials).astype(np.float32)
                for score in np.unique(np.concatenate([x, y])):
                    own = held.setdefault(float(score), np.zeros((2, 2, trials + 1)))
                    for c, which in enumerate((positive.astype(bool), ~positive.astype(bool))):
                        first, second = ((v == score) & which for v in (x, y))
                        moved = (second.astype(np.float32) - first) @ swap
                        own[0, c] += np.append(first.sum(), first.sum() + moved)
                        own[1, c] += np.append(second.sum(), second.sum() - moved)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.float64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["score", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table["counts"])
        return pa.table({"score": table["score"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((s, v) for b in batches for s, v in zip(b.column("score").to_pylist(), b.column("counts").to_pylist()))
        if not rows:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.float64())] * 2, ["observed", "p"])
            return
        counts = np.stack([np.frombuffer(v).reshape(2, 2, -1) for _, v in rows])
        hd, ht = counts[:, :, 0], counts[:, :, 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            curves = (hd * (np.cumsum(ht, 0) - 0.5 * ht)).sum(0) / (hd.sum(0) * ht.sum(0))
        e = curves[0] - curves[1]
        seen, null = float(e[0]), e[1:][np.isfinite(e[1:])]
        p = float((np.abs(null) >= abs(seen) - 1e-9).mean()) if np.isfinite(seen) and len(null) else None
        yield pa.RecordBatch.from_arrays([pa.array([seen if np.isfinite(seen) else None], pa.float64()), pa.array([p], pa.float64())], ["observed", "p"])

    summed = both.mapInArrow(count, "score double, counts binary").groupBy("score").applyInArrow(add, "score double, counts binary")
    return summed.coalesce(1).mapInArrow(compare, "observed double, p double")


def detection_intervals(spark: SparkSession, rows: DataFrame, cluster: str, arm: str, base, flagged: Column, positive: Column, trials: int = 6000, seed: int = 0, level: float = 0.95, mean_of: list | None = None) -> DataFrame:
    """Per arm: H, F, d' and c, their intervals over resampled clusters, and those of the differences to `base` with
    the same draws.  Intervals are sorted draws by position.  Clusters that lack an arm are left out; a draw without
    defects or without twins does not count.  mean_of: an extra row, arm null, with the mean of d' over these arms
    less that of the base."""
    whole = complete_tasks(rows, cluster, arm)
    sums = whole.groupBy(cluster, arm).agg(F.count_if(positive).alias("nd"), F.count_if(~positive).alias("nt"), F.count_if(positive & flagged).alias("hd"), F.count_if(~positive & flagged).alias("ht"))
    sums = materialize(sums, "detection-sums")
    clusters, four = numbered(sums.select(cluster).distinct(), cluster), ("nd", "nt", "hd", "ht")
    arms = materialize(sums.select(arm).distinct().withColumn("_at", F.row_number().over(W.orderBy(arm)) - 1), "arms")
    n_arms = arms.count()
    listed = F.posexplode(F.array(*[F.col(c).cast("double") for c in four])).alias("_c", "value")
    entries = sums.join(arms, arm).join(clusters, cluster).select("slot", "k", "_at", listed).select("slot", "k", (F.col("_at") * 4 + F.col("_c")).alias("column"), "value")
    drawn = drawn_sums(entries, 4 * n_arms, trials, seed)
    drawn = drawn.select("draw", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(max(n_arms - 1, 0))), lambda a: F.slice("sums", 4 * a + 1, 4))).alias("_at", "_s"))
    drawn = drawn.join(arms, "_at").select("draw", arm, *[F.get("_s", F.lit(i)).cast("long").alias(c) for i, c in enumerate(four)])
    own = sums.groupBy(arm).agg(*[F.sum(c).alias(c) for c in four]).select(F.lit(-1).cast("long").alias("draw"), arm, *four)
    drawn = drawn.union(own).where("nd > 0 and nt > 0")
    rates = drawn.select("draw", arm, "nd", "nt", clamp_rate(F.col("hd"), F.col("nd")).alias("h"), clamp_rate(F.col("ht"), F.col("nt")).alias("f"))
    z = rates.withColumn("zh", probit("h")).withColumn("zf", probit("f"))
    z = materialize(z.select("draw", arm, "nd", "nt", "h", "f", (F.col("zh") - F.col("zf")).alias("d"), (-(F.col("zh") + F.col("zf")) / 2).alias("c")), "draws")
    zero = z.where(F.col(arm) == base).select("draw", F.col("d").alias("_d"), F.col("c").alias("_c"))
    z = z.join(zero, "draw", "left").withColumn("dd", F.col("d") - F.col("_d")).withColumn("dc", F.col("c") - F.col("_c"))
    if mean_of:
        mean = z.where(F.col(arm).isin(*mean_of)).groupBy("draw").agg(F.avg("d").alias("m"), F.count("*").alias("n")).where(F.col("n") == len(mean_of)).join(zero, "draw")
        blank = {c: F.lit(None).cast(t) for c, t in z.dtypes}
        z = z.unionByName(mean.select("draw", *[(F.col("m") - F.col("_d")).alias(c) if c == "dd" else blank[c].alias(c) for c in z.columns if c != "draw"]))
    cells = {c: F.sort_array(F.collect_list(F.when(F.col("draw") >= 0, F.col(c)))) for c in ("d", "c", "dd", "dc")}
    point = [F.max(F.when(F.col("draw") < 0, F.col(c))).alias(c) for c in ("nd", "nt", "h", "f", "d", "c", "dd", "dc")]
    out = z.groupBy(arm).agg(*point, *[v.alias(f"_{c}") for c, v in cells.items()])

    def at(c: str, q: float, shift: int) -> Column:
        n = F.size(f"_{c}")
        return F.get(f"_{c}", F.least(F.greatest(F.floor(q * n + 1e-9).cast("int") + shift, F.lit(0)), n - 1))

    tail = (1 - level) / 2
    limits = [x for c in cells for x in (at(c, tail, 0).alias(f"{c}_low"), at(c, 1 - tail, -1).alias(f"{c}_high"))]
    return out.select(arm, "nd", "nt", "h", "f", "d", "c", "dd", "dc", *limits)


def transitions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by…, x, y), flags as 0 or 1 in two arms: the 2 x 2 counts of each class."""
    n = lambda a, b, name: F.count_if((F.col("x") == a) & (F.col("y") == b)).alias(name)
    return pairs.where("x is not null and y is not null").groupBy(*by).agg(n(1, 1, "kept"), n(1, 0, "lost"), n(0, 1, "gained"), n(0, 0, "never"))


def reading(low95: Column, low90: Column, high90: Column, margin: float) -> Column:
    """Decision from two intervals: equivalence if the 90% one lies within the margin, gain if the 95% one is above
    0, both, or inconclusive."""
    same, gain = (low90 > -margin) & (high90 < margin), low95 > 0
    return F.when(same & gain, "gain and equivalence").when(gain, "gain").when(same, "equivalence").otherwise("inconclusive")


def verdict(low: Column, high: Column) -> Column:
    """What an interval says of 0; null if an end is missing."""
    return F.when(low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high), None).when(low > 0, "higher").when(high < 0, "lower").otherwise("not distinguishable")


def excludes_zero(low: Column, high: Column) -> Column:
    """Whether an interval excludes 0; null if an end is missing."""
    return F.when(~(low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high)), (low > 0) | (high < 0))


def twelve_bins(score: Column) -> Column:
    """Bins 0, 1-9, 10-19 … 90-99, 100 as 0 to 11."""
    return F.when(score <= 0, 0).when(score >= 100, 11).otherwise(F.floor(score / 10) + 1).cast("int")
