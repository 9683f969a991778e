"""Resampling over clusters.

A bootstrap draw is a vector of cluster weights, made within a task, and a cluster enters through its sums, so that the
cost is draws x clusters however many rows there are, and no table holds a row for each of them.  Label swaps and chance findings concern single rows: their draws are vectors
within a task.  Draws are pure hashes, shared by every statistic that uses them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import coins, drawn_slots, hash32, numbers, uniform


def numbered(clusters: DataFrame, key: str) -> DataFrame:
    """Clusters with an ordinal from 0 by key, and their number k."""
    w = W.orderBy(key)
    return clusters.withColumn("slot", F.row_number().over(w) - 1).withColumn("k", F.count("*").over(W.partitionBy(F.lit(0))))


def draws(spark: SparkSession, clusters: DataFrame, trials: int, seed: int = 0) -> DataFrame:
    """(draw, slot, m): how often each cluster is drawn when k of k are drawn with replacement."""
    k = clusters.agg(F.max("k").alias("k"))
    picks = spark.range(trials).withColumnRenamed("id", "draw").join(F.broadcast(k)).where("k is not null")
    picks = picks.select("draw", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("pick"))
    slot = F.pmod(hash32(F.lit(seed), F.col("draw"), F.col("pick")), F.col("k"))
    return picks.select("draw", slot.alias("slot")).groupBy("draw", "slot").agg(F.count("*").alias("m"))


#: Entries that one task weighs at a time, and numbers that it holds of its draws.
ENTRIES = 1 << 22
HELD = 1 << 22
DRAW_BLOCK = 250


def drawn_sums(entries: DataFrame, width: int, trials: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """entries(by, slot, k, column, value) -> (by, draw, sums): for each draw of k of k slots with replacement, the sums
    of the columns 0 to width - 1 over the drawn slots, as an array of doubles.

    A group of entries is packed once and meets each block of draws in a task, which makes the weights of one draw as
    a vector, multiplies and adds up; no row is made for a pair of draw and slot.  Groups of many slots are packed in
    several blocks, whose sums add up."""
    spark, key = entries.sparkSession, by or "_all"
    kind = dict(entries.dtypes).get(key, "int")
    block = max(1, min(DRAW_BLOCK, HELD // max(width, 1)))
    span = max(1, ENTRIES // max(width, 1))
    packed = entries if by else entries.withColumn(key, F.lit(0))
    packed = packed.where("value != 0").groupBy(key, "k", (F.col("slot") / span).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("column", "slot", "value"))).alias("entries"))
    # A group whose values are all 0 has its draws too.
    packed = packed.unionByName(entries.select(F.col(by) if by else F.lit(0).alias(key), "k").distinct().withColumns({"part": F.lit(-1).cast("long"), "entries": F.array().cast("array<struct<column:int,slot:bigint,value:double>>")}))
    packed = packed.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(max(trials - 1, 0)), F.lit(block)))).repartition("first", key, "part")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, first = batch.column("k")[i].as_py(), batch.column("first")[i].as_py()
                own = batch.column("entries")[i].values
                column, slot, value = (own.field(n).to_numpy() for n in ("column", "slot", "value"))
                start = np.flatnonzero(np.diff(column, prepend=-1))
                numbers = np.arange(first, min(first + block, trials))
                out = np.zeros((len(numbers), width))
                if len(start):
                    for d, n in enumerate(numbers.tolist()):
                        weight = np.bincount(drawn_slots(seed, n, k), minlength=k)
                        out[d, column[start]] = np.add.reduceat(weight[slot] * value, start)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, 1), pa.array([first], pa.int64()), pa.array([out.tobytes()], pa.binary())], [key, "first", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
        first, n = table["first"][0].as_py(), len(total) // width
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(total))
        return pa.table({key: table[key].take(pa.array(np.zeros(n, int))), "draw": pa.array(np.arange(first, first + n)), "sums": lists})

    weighed = packed.select(key, "k", "entries", F.col("first").cast("long").alias("first")).mapInArrow(weigh, f"`{key}` {kind}, first long, sums binary")
    drawn = weighed.groupBy(key, "first").applyInArrow(add, f"`{key}` {kind}, draw long, sums array<double>")
    return drawn if by else drawn.drop(key)


def bootstrap_sums(spark: SparkSession, rows: DataFrame, cluster: str, sums: dict[str, Column], trials: int, seed: int = 0) -> DataFrame:
    """Per draw, the weighted sums of the given columns over the drawn clusters."""
    per = numbered(rows.groupBy(cluster).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]), cluster)
    entries = per.select("slot", "k", F.posexplode(F.array(*sums)).alias("column", "value")).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return drawn_sums(entries, len(sums), trials, seed).select("draw", *[F.get("sums", F.lit(i)).alias(n) for i, n in enumerate(sums)])


def clustered_rates(outcomes: DataFrame, by: str, task: str, hit: Column, trials: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by, tasks, defects, hits, recall, recall_low, recall_high): each condition's share of hits, with the interval
    from draws of its own tasks, all rows of a task together, by position in the sorted draws (one below, one up)."""
    per = outcomes.groupBy(by, task).agg(F.count("*").alias("n"), F.count_if(hit).alias("h"))
    own = W.partitionBy(by)
    per = per.withColumn("slot", (F.row_number().over(own.orderBy(task)) - 1).cast("long")).withColumn("k", F.count("*").over(own))
    entries = per.select(by, "slot", "k", F.posexplode(F.array(F.col("h").cast("double"), F.col("n").cast("double"))).alias("column", "value"))
    spread = drawn_sums(entries, 2, trials, seed, by).select(by, (F.get("sums", F.lit(0)) / F.get("sums", F.lit(1))).alias("e"))
    listed = spread.groupBy(by).agg(F.sort_array(F.collect_list("e")).alias("v"))
    tail = (1 - level) / 2
    at = lambda q, shift: F.get("v", F.least(F.greatest(F.floor(q * F.size("v") + 1e-9).cast("int") + shift, F.lit(0)), F.size("v") - 1))
    ends = listed.select(F.col(by).alias("_by"), at(tail, -1).alias("recall_low"), at(1 - tail, 0).alias("recall_high"))
    total = per.groupBy(by).agg(F.count("*").alias("tasks"), F.sum("n").alias("defects"), F.sum("h").alias("hits"))
    total = total.withColumn("recall", F.col("hits") / F.col("defects"))
    return total.join(ends, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def cluster_bootstrap(spark: SparkSession, pairs: DataFrame, cluster: str, trials: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """pairs(x, y, cluster): one row with the mean difference and its percentile interval, quantiles interpolated."""
    d = pairs.where("x is not null and y is not null").withColumn("d", F.col("x") - F.col("y"))
    estimates = bootstrap_sums(spark, d, cluster, {"s": F.col("d"), "n": F.lit(1)}, trials, seed).select((F.col("s") / F.col("n")).alias("e"))
    return d.agg(F.avg("d").alias("point"), F.count("*").alias("n")).join(interval(estimates, "e", level))


def interval(estimates: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """(low, high): quantiles at (1 -/+ level) / 2, linearly interpolated at q (n - 1)."""
    q = F.percentile(column, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return estimates.agg(q.alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def index_interval(estimates: DataFrame, column: str, level: float = 0.95, shift: tuple[int, int] = (0, -1)) -> DataFrame:
    """Quantiles by position in the sorted draws: element int(q n) + shift, kept within the ends.  The conventions in
    use differ in the shift: (0, -1) for repository intervals, (-1, 0) for task intervals."""
    values = estimates.agg(F.sort_array(F.collect_list(column)).alias("v"), F.count(column).alias("n"))
    at = lambda q, s: F.get("v", F.least(F.greatest(F.floor(q * F.col("n") + 1e-9) + s, F.lit(0)), F.col("n") - 1).cast("int"))
    return values.select(at((1 - level) / 2, shift[0]).alias("low"), at((1 + level) / 2, shift[1]).alias("high"))


def balanced_bootstrap(spark: SparkSession, rows: DataFrame, cluster: str, arm: str, a, b, metric: str, positive: str, trials: int = 2000, seed: int = 0) -> DataFrame:
    """Difference of balanced means (mean of the class means) of two arms; arms and classes share the draws, and
    draws that lack a class are left out."""
    x = F.col(metric).cast("double")
    sums = {}
    for name, which in (("a", a), ("b", b)):
        for side, keep in (("d", F.col(positive)), ("t", ~F.col(positive))):
            here = (F.col(arm) == which) & keep & x.isNotNull()
            sums[f"{name}{side}s"], sums[f"{name}{side}n"] = F.when(here, x).otherwise(0.0), F.when(here, 1).otherwise(0)

    def estimate(df: DataFrame) -> DataFrame:
        mean = lambda n: F.when(F.col(f"{n}n") > 0, F.col(f"{n}s") / F.col(f"{n}n"))
        return df.select(((mean("ad") + mean("at")) / 2 - (mean("bd") + mean("bt")) / 2).alias("e")).where("e is not null")

    used = rows.where(F.col(arm).isin(a, b))
    point = estimate(used.agg(*[F.sum(c).alias(n) for n, c in sums.items()])).withColumnRenamed("e", "point")
    spread = estimate(bootstrap_sums(spark, used, cluster, sums, trials, seed))
    return point.join(interval(spread, "e"))


def permutation(spark: SparkSession, pairs: DataFrame, key: str, trials: int = 4000, seed: int = 0) -> DataFrame:
    """Paired label swaps: the share of draws whose |mean difference| reaches the observed one.  A task sums its pairs
    once for all draws, as the matrix of swaps times the differences, and hands on one number a draw."""
    d = pairs.where("x is not null and y is not null").select(F.col(key).cast("string").alias("key"), (F.col("x") - F.col("y")).alias("d"))

    def swap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trials)
        for batch in batches:
            moving = batch.column("d").to_numpy()
            for k in range(0, len(moving), 4000):
                # +1 for a coin of 0, -1 for a coin of 1
                total += moving[k : k + 4000].sum() - 2 * (moving[k : k + 4000] @ coins(seed, batch.column("key")[k : k + 4000].to_pylist(), trials))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trials)), pa.array(total)], ["draw", "s"])

    null = d.where("d != 0").mapInArrow(swap, "draw long, s double").groupBy("draw").agg(F.sum("s").alias("s"))
    null = spark.range(trials).withColumnRenamed("id", "draw").join(null, "draw", "left").select(F.coalesce("s", F.lit(0.0)).alias("s"))
    seen = d.agg(F.sum("d").alias("seen"), F.count("*").alias("n"))
    return null.join(F.broadcast(seen)).agg(F.first(F.col("seen") / F.col("n")).alias("observed"), F.avg((F.abs("s") >= F.abs("seen") - 1e-9).cast("double")).alias("p"))


def _trials(cells: DataFrame, trials: int, seed: int) -> DataFrame:
    """cells(…, n) -> a row for each simulated item, with two uniform numbers, which cells of one size share."""
    u = lambda arm: uniform(F.lit(seed), F.lit(arm), F.col("_trial") * F.col("n") + F.col("_item"))
    rows = cells.where("n > 0").withColumn("_trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).repartition("_trial")
    return rows.withColumn("_item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1))).withColumns({"_a": u("a"), "_b": u("b")})


def _critical(per: DataFrame, critical: float) -> Column:
    """Whether the corrected McNemar statistic of p and m is critical, as 0 or 1."""
    total = F.col("p") + F.col("m")
    statistic = F.when(total > 0, F.pow(F.greatest(F.abs(F.col("p") - F.col("m")) - 1, F.lit(0)).cast("double"), 2) / total).otherwise(0.0)
    return (statistic > critical).cast("double")


def simulate_power(cells: DataFrame, by: list[str], trials: int, critical: float = 3.841458820694124, seed: int = 0) -> DataFrame:
    """cells(by…, n, base, lift) -> (by…, power, trials): the power of paired designs of n items, as the share of
    simulated experiments whose corrected McNemar statistic is critical."""
    a, b = F.col("_a") < F.col("base") + F.col("lift"), F.col("_b") < F.col("base")
    per = _trials(cells, trials, seed).groupBy(*by, "_trial").agg(F.count_if(a & ~b).alias("p"), F.count_if(~a & b).alias("m"))
    return per.groupBy(*by).agg(F.avg(_critical(per, critical)).alias("power"), F.count("*").alias("trials"))


def minimum_lift(cells: DataFrame, by: list[str], target: float, trials: int, lifts: list[float], critical: float = 3.841458820694124, seed: int = 0) -> DataFrame:
    """cells(by…, n, base) -> (by…, lift, power) of the smallest of `lifts` whose simulated power reaches the target; a
    cell of which none does gives no row.  All lifts share the draws of simulate_power, so every item is drawn once
    and counted against each lift."""
    a = lambda lift: F.col("_a") < F.col("base") + lift
    b = F.col("_b") < F.col("base")
    counts = [c for k, lift in enumerate(lifts) for c in (F.count_if(a(lift) & ~b).alias(f"p{k}"), F.count_if(~a(lift) & b).alias(f"m{k}"))]
    listed = F.array(*[F.struct(F.lit(lift).alias("lift"), F.col(f"p{k}").alias("p"), F.col(f"m{k}").alias("m")) for k, lift in enumerate(lifts)])
    per = _trials(cells, trials, seed).groupBy(*by, "_trial").agg(*counts).select(*by, F.explode(listed).alias("r")).select(*by, "r.*")
    power = per.groupBy(*by, "lift").agg(F.avg(_critical(per, critical)).alias("power")).where(F.col("power") >= target)
    return power.groupBy(*by).agg(F.min(F.struct("lift", "power")).alias("r")).select(*by, "r.*")


def chance_hits(targets: DataFrame, id_: str, line: str, lo: str, hi: str, tolerance: int, trials: int = 500, seed: int = 0) -> DataFrame:
    """(id, rate): the share of draws in which a uniform line of [lo, hi] falls within the tolerance of the target.
    The draws of a target are made where it is; nothing is shuffled."""
    kind = dict(targets.dtypes)[id_]
    rows = targets.select(F.col(id_).alias("id"), F.col(id_).cast("string").alias("key"), *[F.col(c).cast("long").alias(n) for n, c in (("line", line), ("lo", lo), ("hi", hi))])

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                at, low, high = (part.column(c).to_numpy()[:, None] for c in ("line", "lo", "hi"))
                guess = low + numbers(seed, part.column("key").to_pylist(), trials) % (high - low + 1)
                rate = (np.abs(guess - at) <= tolerance).mean(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rate)], ["id", "rate"])

    return rows.mapInArrow(draw, f"id {kind}, rate double").withColumnRenamed("id", id_)


def chance_baseline(tasks: DataFrame, tolerance: int = 5, trials: int = 500, seed: int = 0) -> DataFrame:
    """tasks(task, condition, lines array<struct<path, line>>, defects array<struct<defect_id, path, line>>, findings)
    -> (task, condition, defect_id, rate): how often a defect is hit when as many findings as the review had fall on
    lines of the diff at random and are matched one to one, in order and to the nearest.  Tasks without lines give
    no row."""
    schema = "task string, condition string, defect_id string, rate double"

    def match(defects, codes: dict[str, int], path: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Share of draws (rows of path and line) that hit each defect: all draws of a task at once, defect by defect."""
        free, out, every = np.ones(path.shape, bool), [], np.arange(len(path))
        for d in defects:
            if d["line"] is None or d["path"] not in codes:
                out.append(0.0)
                continue
            far = np.where(free & (path == codes[d["path"]]), np.abs(at - d["line"]), 1 << 50)
            best = far.argmin(axis=1)
            hit = far[every, best] <= tolerance
            free[every[hit], best[hit]] = False
            out.append(float(hit.mean()))
        return np.array(out)

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            # The lines of a batch stay arrays; a row's are a part of them.
            lines = batch.column("lines")
            flat, size = lines.flatten(), lines.value_lengths().fill_null(0).to_numpy()
            start = np.cumsum(size) - size
            paths = flat.field("path").dictionary_encode()
            codes = {p: k for k, p in enumerate(paths.dictionary.to_pylist()) if p}
            path = paths.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = flat.field("line").cast(pa.int64()).fill_null(-(1 << 40)).to_numpy(zero_copy_only=False)
            rest = (batch.column(c).to_pylist() for c in ("task", "condition", "defects", "findings"))
            for task, condition, defects, k, first, n in zip(*rest, start.tolist(), size.tolist()):
                defects, k = defects or [], int(k or 0)
                if n and defects:
                    if k:
                        picks = numbers(seed, [f"{task}|{condition}"], trials * k)[0].reshape(trials, k) % n + first
                        hits = match(defects, codes, path[picks], at[picks]).tolist()
                    else:
                        hits = [0.0] * len(defects)
                    rows += [(task, condition, d["defect_id"], h) for d, h in zip(defects, hits)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.float64()])], ["task", "condition", "defect_id", "rate"])

    return tasks.select("task", "condition", "lines", "defects", "findings").mapInArrow(draw, schema)


def difference_of_differences(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two runs' pairs (key, cluster, x, y) to (key, cluster, x, y) of the items that both runs scored in both arms,
    where x and y are now the runs' own differences: their mean difference is the difference of differences."""
    whole = lambda df: df.where("x is not null and y is not null")
    other = whole(second).select(key, (F.col("x") - F.col("y")).alias("_d"))
    return whole(first).join(other, key).select(key, "cluster", (F.col("x") - F.col("y")).alias("x"), F.col("_d").alias("y"))
