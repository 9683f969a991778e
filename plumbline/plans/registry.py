"""Registered queries: every operator on stand-in tables, each with SQL for DuckDB.

Tasks, arms and scores come from lineitem and orders: task = order, arm = line number, hit = returned, cluster =
customer modulo 37, class = order status F.  Randomness is a hash of its key on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import audit, graph, match, paired, resample, retrieve, roc, rollup, summary
from ..session import tune
from ..streaming import dedupe_events, review_state
from .sqlmath import probit_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{d}/{name}.parquet")


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
FIRST = f"first as (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(ORDER)}) = 1)"
RUNS = f"""with {FIRST}, runs as (select l_orderkey as task, l_linenumber as arm, l_returnflag = 'R' as hit, o_custkey % 37 as cluster, o_orderstatus = 'F' as is_defect,
 cast(l_quantity as int) as score, l_extendedprice as cost, l_discount as discount from first join orders on l_orderkey = o_orderkey)"""
PAIRS = RUNS + """, pairs as (select task, cluster, is_defect, max(case when arm = 1 then hit::int end)::double as x, max(case when arm = 2 then hit::int end)::double as y
 from runs where arm in (1, 2) group by task, cluster, is_defect)"""


def first_lines(spark, d):
    return paired.dedupe(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ORDER, deal=["l_orderkey"])


def runs(spark, d):
    return first_lines(spark, d).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("arm"), (F.col("l_returnflag") == "R").alias("hit"), (F.col("o_custkey") % 37).alias("cluster"),
        (F.col("o_orderstatus") == "F").alias("is_defect"), F.col("l_quantity").cast("int").alias("score"), F.col("l_extendedprice").alias("cost"), F.col("l_discount").alias("discount"),
    )


def pairs(spark, d):
    return paired.pair_arms(runs(spark, d), "task", "arm", 1, 2, "hit", ["cluster", "is_defect"])


# ---------------------------------------------------------------- loading and pairing


@query(f"with {FIRST}, whole as (select l_orderkey from first where l_linenumber <= 3 group by 1 having count(distinct l_linenumber) = 3) select l_orderkey, l_linenumber, l_partkey, l_suppkey from first where l_linenumber <= 3 and l_orderkey in (from whole)")
def dedupe_balance(spark, d):
    df = first_lines(spark, d).where("l_linenumber <= 3")
    return paired.complete_tasks(df, "l_orderkey", "l_linenumber", 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"with last as (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in ORDER)}) = 1) select l_orderkey, l_linenumber, l_partkey, l_returnflag from last")
def dedupe_last(spark, d):
    return paired.dedupe(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ORDER, last=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("select count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicates, count(distinct l_orderkey) - (select count(*) from (select l_orderkey from lineitem where l_linenumber <= 3 group by 1 having count(distinct l_linenumber) = 3)) as incomplete from lineitem")
def load_counters(spark, d):
    li = t(spark, d, "lineitem")
    whole = li.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n")).where("n = 3").agg(F.count("*").alias("whole"))
    s = li.agg((F.count("*") - F.countDistinct("l_orderkey", "l_linenumber")).alias("duplicates"), F.countDistinct("l_orderkey").alias("tasks"))
    return s.join(whole).select("duplicates", (F.col("tasks") - F.col("whole")).alias("incomplete"))


@query(PAIRS + " select count(*) filter (where x is not null and y is not null) as n, count(*) filter (where x is null or y is null) as skipped, round(avg(x) filter (where y is not null), 6) as mean_a, round(avg(y) filter (where x is not null), 6) as mean_b, round(avg(x - y), 6) as difference, count(*) filter (where x > y) as b, count(*) filter (where x < y) as c from pairs")
def paired_diff(spark, d):
    return paired.paired_summary(pairs(spark, d)).select("n", "skipped", r6("mean_a").alias("mean_a"), r6("mean_b").alias("mean_b"), r6("difference").alias("difference"), "b", "c")


FAMILY = RUNS + """, wide as (select task, max(case when arm = 1 then hit::int end) as h1, max(case when arm = 2 then hit::int end) as h2, max(case when arm = 3 then hit::int end) as h3, max(case when arm = 4 then hit::int end) as h4 from runs group by task),
 tests as (select 2 as arm, count(*) filter (where h1 > h2) as b, count(*) filter (where h1 < h2) as c from wide union all select 3, count(*) filter (where h1 > h3), count(*) filter (where h1 < h3) from wide union all select 4, count(*) filter (where h1 > h4), count(*) filter (where h1 < h4) from wide)"""
EXACT = "least(1.0, 2 * (select sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0))) from (select unnest(range(0, least(b, c) + 1)) as i)))"


def family(spark, d):
    return paired.family(runs(spark, d), "task", "arm", 1, [2, 3, 4], "hit")


@query(FAMILY + f" select arm, b, c, round({EXACT}, 6) as p from tests")
def mcnemar(spark, d):
    return family(spark, d).select("arm", "b", "c", r6("p").alias("p"))


@query(FAMILY + f", ps as (select arm, {EXACT} as p from tests), ranked as (select *, row_number() over (order by p, arm) as k, count(*) over () as m from ps) select arm, round(max(least(1.0, (m - k + 1) * p)) over (order by p, arm), 6) as holm from ranked")
def holm(spark, d):
    return paired.holm(family(spark, d), "p", ["arm"]).select("arm", r6("holm").alias("holm"))


@query(RUNS + " select arm, count(*) as n, count(hit) as n_metric, count(*) - count(hit) as missing, round(avg(hit::int), 6) as mean_metric, round(avg(coalesce(cost, 0)), 6) as mean_cost, round(avg(coalesce(score, 0)), 6) as mean_score from runs group by arm")
def arm_table(spark, d):
    out = paired.arm_table(runs(spark, d), "arm", F.col("hit").cast("int"), {"cost": F.col("cost"), "score": F.col("score")})
    return out.select("arm", "n", "n_metric", "missing", *[r6(c).alias(c) for c in ("mean_metric", "mean_cost", "mean_score")])


@query(RUNS + ", s as (select arm, avg(hit::int) filter (where is_defect) as dm, avg(hit::int) filter (where not is_defect) as tm from runs group by arm) select arm, round(dm, 6) as defects, round(tm, 6) as twins, round((dm + tm) / 2, 6) as balanced from s")
def balanced_means(spark, d):
    out = paired.balanced_means(runs(spark, d), "arm", F.col("hit").cast("int"), F.col("is_defect"))
    return out.select("arm", r6("defects").alias("defects"), r6("twins").alias("twins"), r6("balanced").alias("balanced"))


@query(RUNS + """, s as (select arm, count(distinct task) as tasks, count(*) as defects, count(*) filter (where hit) as hits, sum(score % 3) as reported, sum(score) as tokens, sum(cost) as cost from runs group by arm),
 f as (select *, greatest(0, reported - hits) as false_positives, case when defects = 0 then 0.0 else hits / defects end as recall from s), g as (select *, case when hits + false_positives = 0 then 0.0 else hits / (hits + false_positives) end as precision_ from f)
 select arm, tasks, defects, hits, cast(false_positives as bigint) as false_positives, round(recall, 6) as recall, round(precision_, 6) as precision, round(case when precision_ + recall = 0 then 0.0 else 2 * precision_ * recall / (precision_ + recall) end, 6) as f1, round(cost / hits, 4) as cost_per_hit, round(tokens / hits, 6) as tokens_per_hit from g""")
def condition_summary(spark, d):
    out = paired.condition_summary(runs(spark, d), "arm", "task", F.col("hit"), F.col("score") % 3, F.col("score"), F.col("cost"))
    return out.select("arm", "tasks", "defects", "hits", F.col("false_positives").cast("bigint").alias("false_positives"), r6("recall").alias("recall"), r6("precision").alias("precision"), r6("f1").alias("f1"), F.round("cost_per_hit", 4).alias("cost_per_hit"), r6("tokens_per_hit").alias("tokens_per_hit"))


@query(RUNS + ", m as (select arm, avg(score) as context from runs group by arm) select round((max(context) - min(context)) / max(context), 6) as spread, (max(context) - min(context)) / max(context) <= 0.1 as parity from m")
def context_parity(spark, d):
    return summary.parity(runs(spark, d), "arm", "score").select(r6("spread").alias("spread"), "parity")


@query("select count(*) as n, round(avg((quality = toxic)::int), 6) as agreement, round((avg((quality = toxic)::int) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 6) as kappa from labels where quality is not null and toxic is not null")
def kappa(spark, d):
    return paired.kappa(t(spark, d, "labels"), F.col("quality"), F.col("toxic")).select("n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


@query("select quality, toxic, count(*) as n from labels group by all")
def confusion(spark, d):
    return summary.confusion(t(spark, d, "labels"), "quality", "toxic")


@query("with s as (select count(*) as n, count(*) filter (where quality = 1) as k from labels), p as (select n, k, k / n as p, 1.959963984540054 as z from s) select n, k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high from p")
def wilson_interval(spark, d):
    s = t(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return s.select("n", "k", r6(low).alias("low"), r6(high).alias("high"))


# ---------------------------------------------------------------- resampling

TRIALS = 6000


def _u32(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::bigint"


def _boot(sums: str) -> str:
    return f"""per as (select cluster, {sums} group by cluster), num as (select *, row_number() over (order by cluster) - 1 as slot, count(*) over () as k from per),
 picks as (select draw, {_u32("'0|' || draw || '|' || pick")} % (select max(k) from num) as slot from (select unnest(range(0, {TRIALS})) as draw) cross join (select unnest(range(1, (select max(k) from num) + 1)) as pick))"""


@query(PAIRS + ", " + _boot("sum(x - y) as s, count(*) as n from pairs where x is not null and y is not null") + ", est as (select draw, sum(s) / sum(n) as e from picks join num using (slot) group by draw) select (select round(avg(x - y), 6) from pairs) as point, (select count(*) from pairs where x is not null and y is not null) as n, round(quantile_cont(e::double, 0.025), 6) as low, round(quantile_cont(e::double, 0.975), 6) as high from est")
def cluster_bootstrap(spark, d):
    out = resample.cluster_bootstrap(spark, pairs(spark, d), "cluster", TRIALS)
    return out.select(r6("point").alias("point"), "n", r6("low").alias("low"), r6("high").alias("high"))


@query(PAIRS + ", " + _boot("sum(x - y) as s, count(*) as n from pairs where x is not null and y is not null") + f", est as (select draw, sum(s) / sum(n) as e from picks join num using (slot) group by draw), l as (select list_sort(list(e)) as v from est) select round(v[{int(.025 * TRIALS) + 1}], 6) as low, round(v[{int(.975 * TRIALS)}], 6) as high from l")
def index_bootstrap(spark, d):
    both = pairs(spark, d).where("x is not null and y is not null")
    e = resample.bootstrap_sums(spark, both, "cluster", {"s": F.col("x") - F.col("y"), "n": F.lit(1)}, TRIALS).select((F.col("s") / F.col("n")).alias("e"))
    return resample.index_interval(e, "e").select(r6("low").alias("low"), r6("high").alias("high"))


_SIDES = ", ".join(f"sum(case when arm = {a} and {c} then hit::int else 0 end) as {n}{s}s, count(*) filter (where arm = {a} and {c}) as {n}{s}n" for n, a in (("a", 1), ("b", 2)) for s, c in (("d", "is_defect"), ("t", "not is_defect")))
_BAL = "((ads / adn + ats / atn) / 2 - (bds / bdn + bts / btn) / 2)"


@query(RUNS + ", " + _boot(f"{_SIDES} from runs where arm in (1, 2)") + f", est as (select draw, {', '.join(f'sum({n}{s}{k}) as {n}{s}{k}' for n in 'ab' for s in 'dt' for k in 'sn')} from picks join num using (slot) group by draw), e as (select {_BAL} as e from est) select (select round({_BAL}, 6) from (select {_SIDES} from runs)) as point, round(quantile_cont(e::double, 0.025), 6) as low, round(quantile_cont(e::double, 0.975), 6) as high from e where e is not null")
def balanced_bootstrap(spark, d):
    out = resample.balanced_bootstrap(spark, runs(spark, d), "cluster", "arm", 1, 2, "hit", "is_defect", TRIALS)
    return out.select(r6("point").alias("point"), r6("low").alias("low"), r6("high").alias("high"))


PERMUTATIONS = 4000


def _coins(source: str, key: str, rest: str) -> str:
    """The coins of PERMUTATIONS draws for each row of source, 128 of a digest: rest…, draw, coin."""
    digests = f"select {rest}, blk, md5('0|' || blk || '|' || {key}) as h from {source} cross join (select unnest(range(0, {-(-PERMUTATIONS // 128)})) as blk)"
    bits = f"select {rest}, blk * 128 + i as draw, (('0x' || substr(h, i // 4 + 1, 1))::int >> (3 - i % 4)::int) & 1 as coin from ({digests}) cross join (select unnest(range(0, 128)) as i)"
    return f"(select * from ({bits}) where draw < {PERMUTATIONS})"


@query(PAIRS + f""", dd as (select task, x - y as d from pairs where x is not null and y is not null), moving as (select * from dd where d <> 0), sw as (select draw, sum(case when coin = 0 then d else -d end) as s from {_coins("moving", "task", "d")} group by draw), o as (select sum(d) as seen, count(*) as n from dd)
 select (select round(seen / n, 6) from o) as observed, round(avg((abs(coalesce(s, 0)) >= abs((select seen from o)) - 1e-9)::int), 6) as p from (select unnest(range(0, {PERMUTATIONS})) as draw) left join sw using (draw)""")
def permutation_test(spark, d):
    out = resample.permutation(spark, pairs(spark, d), "task", PERMUTATIONS)
    return out.select(r6("observed").alias("observed"), r6("p").alias("p"))


#: Power cells: an arm with as many items as there are clusters in it, and its rate of hits.
POWER_CELLS = RUNS + f""", cells as (select arm, count(distinct cluster) as n, round(avg(hit::int), 2) as base from runs group by arm),
 items as (select arm, n, base, trial, trial * n + item as id from (select *, unnest(range(0, n)) as item from (select *, unnest(range(0, 100)) as trial from cells))), c as (select *, {_u32("'0|a|' || id")} / 4294967296.0 as a, {_u32("'0|b|' || id")} / 4294967296.0 as b from items)"""
_CRITICAL = "avg((case when p + m > 0 then power(greatest(abs(p - m) - 1, 0), 2) / (p + m) else 0 end > 3.841458820694124)::int)"


def power_cells(spark, d):
    return runs(spark, d).groupBy("arm").agg(F.countDistinct("cluster").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 2).alias("base"))


@query(POWER_CELLS + f", s as (select arm, trial, count(*) filter (where a < base + 0.25 and b >= base) as p, count(*) filter (where b < base and a >= base + 0.25) as m from c group by arm, trial) select arm, round({_CRITICAL}, 6) as power, count(*) as trials from s group by arm")
def power(spark, d):
    cells = power_cells(spark, d).withColumn("lift", F.lit(0.25))
    return resample.simulate_power(cells, ["arm"], 100).select("arm", r6("power").alias("power"), "trials")


# ---------------------------------------------------------------- ROC and signal detection

HIST = RUNS + ", hist as (select arm, score, count(*) filter (where is_defect) as hd, count(*) filter (where not is_defect) as ht from runs where score is not null group by arm, score)"


def hist(spark, d):
    return roc.score_histogram(runs(spark, d), ["arm"], "score", F.col("is_defect"))


@query(HIST + " select * from hist")
def score_hist(spark, d):
    return hist(spark, d)


@query(HIST + " select a.arm, cast(any_value(n.nd) as bigint) as nd, cast(any_value(n.nt) as bigint) as nt, round(sum(a.hd * b.ht * case when b.score < a.score then 1.0 when b.score = a.score then 0.5 else 0 end) / any_value(n.nd * n.nt), 6) as auc, round(sum(case when a.score = b.score then a.hd * b.ht else 0 end) / any_value(n.nd * n.nt), 6) as tie_share from hist a join hist b on a.arm = b.arm join (select arm, sum(hd)::double as nd, sum(ht)::double as nt from hist group by arm) n on n.arm = a.arm group by a.arm")
def auc(spark, d):
    return roc.auc(hist(spark, d), ["arm"], "score").select("arm", "nd", "nt", r6("auc").alias("auc"), r6("tie_share").alias("tie_share"))


@query(HIST + ", c as (select arm, score, sum(hd) over w as ch, sum(ht) over w as cf, sum(hd) over (partition by arm) as nd, sum(ht) over (partition by arm) as nt from hist window w as (partition by arm order by score desc)) select arm, score, round(least(greatest(ch / nd, 1 / (2 * nd)), 1 - 1 / (2 * nd)), 6) as h, round(least(greatest(cf / nt, 1 / (2 * nt)), 1 - 1 / (2 * nt)), 6) as f from c")
def roc_points(spark, d):
    return roc.roc_points(hist(spark, d), ["arm"], "score").select("arm", "score", r6("h").alias("h"), r6("f").alias("f"))


@query(RUNS + ", s as (select arm, count(*) filter (where is_defect) as nd, count(*) filter (where not is_defect) as nt, count(*) filter (where is_defect and hit) as hd, count(*) filter (where not is_defect and hit) as ht from runs group by arm) select arm, nd, nt, round(least(greatest(hd / nd, 1 / (2 * nd)), 1 - 1 / (2 * nd)), 6) as h, round(least(greatest(ht / nt, 1 / (2 * nt)), 1 - 1 / (2 * nt)), 6) as f from s")
def detection_rates(spark, d):
    return roc.detection_rates(runs(spark, d), ["arm"], F.col("hit"), F.col("is_defect")).select("arm", "nd", "nt", r6("h").alias("h"), r6("f").alias("f"))


RATES = RUNS + ", s as (select arm, count(*) filter (where is_defect) as nd, count(*) filter (where not is_defect) as nt, count(*) filter (where is_defect and hit) as hd, count(*) filter (where not is_defect and hit) as ht from runs group by arm), r as (select arm, nd, nt, least(greatest(hd / nd, 1 / (2 * nd)), 1 - 1 / (2 * nd)) as h, least(greatest(ht / nt, 1 / (2 * nt)), 1 - 1 / (2 * nt)) as f from s)"


@query(RATES + f" select arm, nd, nt, round({probit_sql('h')} - {probit_sql('f')}, 6) as d_prime, round(-({probit_sql('h')} + {probit_sql('f')}) / 2, 6) as criterion from r")
def d_prime(spark, d):
    return roc.d_prime(runs(spark, d), ["arm"], F.col("hit"), F.col("is_defect")).select("arm", "nd", "nt", r6("d_prime").alias("d_prime"), r6("criterion").alias("criterion"))


@query(HIST + f""", c as (select arm, score, sum(hd) over w as ch, sum(ht) over w as cf, sum(hd) over (partition by arm) as nd, sum(ht) over (partition by arm) as nt from hist window w as (partition by arm order by score desc)),
 pts as (select distinct arm, ch / nd as h, cf / nt as f from c where score >= 1 and ch > 0 and ch < nd and cf > 0 and cf < nt), z as (select arm, {probit_sql('h')} as y, {probit_sql('f')} as x from pts)
 select arm, round(case when count(distinct x) >= 3 then regr_slope(y, x) end, 6) as slope, count(*) as points from z group by arm""")
def zroc_slope(spark, d):
    return roc.zroc_slope(hist(spark, d), ["arm"], "score").select("arm", r6("slope").alias("slope"), "points")


@query(RUNS + ", b as (select arm, case when score * 2 <= 0 then 0 when score * 2 >= 100 then 11 else score * 2 // 10 + 1 end as bin from runs) select arm, cast(bin as int) as bin, count(*) as n from b group by all")
def twelve_bins(spark, d):
    return runs(spark, d).withColumn("bin", roc.twelve_bins(F.col("score") * 2)).groupBy("arm", "bin").agg(F.count("*").alias("n"))


@query(RUNS + ", c as (select arm, score, count(*) as n from runs group by all) select arm, score, n, row_number() over (partition by arm order by n desc, score) as rank from c qualify rank <= 5")
def top_values(spark, d):
    c = runs(spark, d).groupBy("arm", "score").agg(F.count("*").alias("n"))
    return retrieve.top_k(c, ["arm"], [F.desc("n"), F.col("score")], 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(RUNS + ", m as (select arm, quantile_cont(score::double, 0.5) as med from runs group by arm) select r.arm, case when score > med then 'long' else 'short' end as class, count(*) as n, round(avg(hit::int), 6) as rate from runs r join m on r.arm = m.arm group by all union all select arm, 'all', count(*), round(avg(hit::int), 6) from runs group by arm")
def long_short(spark, d):
    return summary.long_short(runs(spark, d), "arm", "score", F.col("hit").cast("int")).select("arm", "class", "n", r6("rate").alias("rate"))


ROC_TRIALS = 6000
_AUC = "sum(hd * (below + 0.5 * ht)) / (sum(hd) * sum(ht)) as auc"
_BELOW = "coalesce(sum(ht) over (partition by {0} order by score rows between unbounded preceding and 1 preceding), 0) as below"


@query(RUNS + f""", hc as (select cluster, arm, score, count(*) filter (where is_defect) as hd, count(*) filter (where not is_defect) as ht from runs where arm in (1, 2) and score is not null group by all),
 shared as (select cluster from hc group by 1 having count(distinct arm) = 2), {_boot("count(*) as n from hc where cluster in (from shared)").replace(str(TRIALS), str(ROC_TRIALS))},
 drawn as (select draw, arm, score, hd, ht from picks join num using (slot) join hc using (cluster) union all select -1, arm, score, hd, ht from hc where cluster in (from shared)),
 w as (select draw, arm, score, sum(hd) as hd, sum(ht) as ht from drawn group by all), c as (select *, {_BELOW.format('draw, arm')} from w), a as (select draw, arm, {_AUC} from c group by draw, arm),
 e as (select draw, max(auc) filter (where arm = 1) - max(auc) filter (where arm = 2) as e from a group by draw),
 q as (select quantile_cont(e, 0.025) as low, quantile_cont(e, 0.975) as high, quantile_cont(e, 0.05) as low90, quantile_cont(e, 0.95) as high90, quantile_cont(e, 0.00625) as low9875, quantile_cont(e, 0.99375) as high9875, quantile_cont(e, 0.05 / 14) as low9929, quantile_cont(e, 1 - 0.05 / 14) as high9929 from e where draw >= 0)
 select round((select e from e where draw = -1), 6) as point, round(low, 6) as low, round(high, 6) as high, case when low90 > -0.05 and high90 < 0.05 and low > 0 then 'gain and equivalence' when low > 0 then 'gain' when low90 > -0.05 and high90 < 0.05 then 'equivalence' else 'inconclusive' end as reading, (select round(2 * least(avg((e <= 0)::int), avg((e >= 0)::int)), 6) from e where draw >= 0) as p, round(low9875, 6) as low9875, round(high9875, 6) as high9875, round(low9929, 6) as low9929, round(high9929, 6) as high9929 from q""")
def auc_difference(spark, d):
    out = roc.auc_difference(spark, runs(spark, d), "cluster", "arm", 1, 2, "score", F.col("is_defect"), ROC_TRIALS)
    return out.select(r6("point").alias("point"), r6("low").alias("low"), r6("high").alias("high"), "reading", *[r6(c).alias(c) for c in ("p", "low9875", "high9875", "low9929", "high9929")])


@query(RUNS + f""", dd as (select task, is_defect, max(score) filter (where arm = 1) as x, max(score) filter (where arm = 2) as y from runs where arm in (1, 2) group by all having x is not null and y is not null),
 g as (select draw, is_defect, x, y, coin, count(*) as n from {_coins("dd", "task", "is_defect, x, y")} group by all union all select -1, is_defect, x, y, 0, count(*) from dd group by all),
 f as (select draw, 0 as side, is_defect, case when coin = 1 then y else x end as score, n from g union all select draw, 1, is_defect, case when coin = 1 then x else y end, n from g),
 w as (select draw, side, score, coalesce(sum(n) filter (where is_defect), 0) as hd, coalesce(sum(n) filter (where not is_defect), 0) as ht from f group by all), c as (select *, {_BELOW.format('draw, side')} from w),
 a as (select draw, side, {_AUC} from c group by draw, side), e as (select draw, max(auc) filter (where side = 0) - max(auc) filter (where side = 1) as e from a group by draw)
 select round((select e from e where draw = -1), 6) as observed, round(avg((abs(e) >= abs((select e from e where draw = -1)) - 1e-9)::int), 6) as p from e where draw >= 0""")
def auc_permutation(spark, d):
    scores = paired.pair_arms(runs(spark, d), "task", "arm", 1, 2, "score", ["is_defect"])
    return roc.auc_permutation(scores, "task", "is_defect", PERMUTATIONS).select(r6("observed").alias("observed"), r6("p").alias("p"))


@query(PAIRS + " select is_defect, count(*) filter (where x = 1 and y = 1) as kept, count(*) filter (where x = 1 and y = 0) as lost, count(*) filter (where x = 0 and y = 1) as gained, count(*) filter (where x = 0 and y = 0) as never from pairs where x is not null and y is not null group by is_defect")
def transitions(spark, d):
    return roc.transitions(pairs(spark, d), ["is_defect"])


@query(RUNS + ", cells as (select task, cluster, max(case when arm = 1 then hit::int end)::double as x1, max(case when arm = 2 then hit::int end)::double as y1, max(case when arm = 1 then (score > 25)::int end)::double as x2, max(case when arm = 2 then (score > 25)::int end)::double as y2 from runs where arm in (1, 2) group by task, cluster), dd as (select task, cluster, (x1 - y1) - (x2 - y2) as d from cells where x1 + y1 + x2 + y2 is not null), " + _boot("sum(d) as s, count(*) as n from dd") + ", est as (select draw, sum(s) / sum(n) as e from picks join num using (slot) group by draw) select (select round(avg(d), 6) from dd) as point, (select count(*) from dd) as n, round(quantile_cont(e, 0.025), 6) as low, round(quantile_cont(e, 0.975), 6) as high from est")
def difference_of_differences(spark, d):
    rows = runs(spark, d).withColumn("long", F.col("score") > 25)
    first, second = (paired.pair_arms(rows, "task", "arm", 1, 2, metric, ["cluster"]) for metric in ("hit", "long"))
    out = resample.cluster_bootstrap(spark, resample.difference_of_differences(first, second, "task"), "cluster", TRIALS)
    return out.select(r6("point").alias("point"), "n", r6("low").alias("low"), r6("high").alias("high"))


@query(POWER_CELLS + f""", l as (select unnest(range(1, 51)) / 100.0 as lift), s as (select arm, lift, trial, count(*) filter (where a < base + lift and b >= base) as p, count(*) filter (where b < base and a >= base + lift) as m from c cross join l group by arm, lift, trial),
 w as (select arm, lift, {_CRITICAL} as power from s group by arm, lift) select arm, round(lift::double, 6) as lift, round(power, 6) as power from w where power >= 0.5 qualify row_number() over (partition by arm order by lift) = 1""")
def minimum_lift(spark, d):
    out = resample.minimum_lift(power_cells(spark, d), ["arm"], 0.5, 100, [k / 100 for k in range(1, 51)])
    return out.select("arm", r6("lift").alias("lift"), r6("power").alias("power"))


CHANCE_DRAWS = 500


@query(f"""with d as (select o_orderkey, date_diff('day', date '1992-01-01', o_orderdate::date) as line, o_orderkey % 40 as up, o_orderkey % 25 as down from orders), h as (select *, md5('0|' || blk || '|' || o_orderkey) as h from d cross join (select unnest(range(0, {CHANCE_DRAWS // 4})) as blk))
 select o_orderkey, round(avg((abs(('0x' || substr(h, i * 8 + 1, 8))::bigint % (up + down + 1) - up) <= 5)::int), 6) as rate from h cross join (select unnest(range(0, 4)) as i) group by o_orderkey""")
def chance_baseline(spark, d):
    line = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    targets = t(spark, d, "orders").select("o_orderkey", line.alias("line"), (line - F.col("o_orderkey") % 40).alias("lo"), (line + F.col("o_orderkey") % 25).alias("hi"))
    return resample.chance_hits(targets, "o_orderkey", "line", "lo", "hi", 5, CHANCE_DRAWS).select("o_orderkey", r6("rate").alias("rate"))


# ---------------------------------------------------------------- matching

SPOTS = f"""with {FIRST}, defects as (select o_orderkey as defect_id, o_custkey as path, date_diff('day', date '1992-01-01', o_orderdate::date) as d_line from orders),
 findings as (select l_orderkey * 10 + l_linenumber as finding_id, l_partkey as path, date_diff('day', date '1992-01-01', l_shipdate::date) as f_line from first)"""


def spots(spark, d):
    """Orders as defects, all lines as findings: path = customer or part, line = days since 1992."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1992-01-01").cast("date"))
    defects = t(spark, d, "orders").select(F.col("o_orderkey").alias("defect_id"), F.col("o_custkey").alias("path"), day("o_orderdate").alias("d_line"))
    finding_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    return defects, first_lines(spark, d).select(finding_id.alias("finding_id"), F.col("l_partkey").alias("path"), day("l_shipdate").alias("f_line"))


@query(SPOTS + " select defect_id, count(*) as near, cast(min(abs(d_line - f_line)) as int) as distance from defects join findings using (path) where abs(d_line - f_line) <= 5 group by defect_id")
def range_join(spark, d):
    a, b = spots(spark, d)
    return match.within_tolerance(a, b, ["path"], "d_line", "f_line", 5).groupBy("defect_id").agg(F.count("*").alias("near"), F.min(F.abs(F.col("d_line") - F.col("f_line"))).alias("distance"))


@query(SPOTS + " select defect_id, cast(abs(d_line - f_line) as int) as distance, finding_id from defects join findings using (path) where abs(d_line - f_line) <= 5 qualify row_number() over (partition by defect_id order by abs(d_line - f_line), finding_id) = 1")
def nearest_match(spark, d):
    a, b = spots(spark, d)
    return match.nearest(a, b, ["path"], "defect_id", "d_line", "f_line", 5, ["finding_id"])


@query(SPOTS.replace("with ", "with recursive ", 1) + """, near as (select defect_id, path, list({'id': finding_id, 'distance': abs(d_line - f_line)::bigint} order by abs(d_line - f_line), finding_id) as c from defects join findings using (path) where abs(d_line - f_line) <= 5 group by all),
 d as (select *, row_number() over (partition by path order by defect_id) as k from near),
 walk(path, k, used, defect_id, pick) as (select distinct path, 0::bigint, []::bigint[], null::bigint, null::struct(id bigint, distance bigint) from d
  union all select path, k, case when pick is null then used else list_append(used, pick.id) end, defect_id, pick from (select d.path, d.k, w.used, d.defect_id, list_filter(d.c, lambda x: not list_contains(w.used, x.id))[1] as pick from walk w join d on d.path = w.path and d.k = w.k + 1))
 select o.defect_id, pick is not null as hit, pick.id as finding_id, pick.distance as distance from defects o left join (select defect_id, pick from walk where pick is not null) w on w.defect_id = o.defect_id""")
def greedy_match(spark, d):
    a, b = spots(spark, d)
    return match.greedy_match(a.withColumn("d_ord", F.col("defect_id")), b.withColumn("f_ord", F.col("finding_id")), ["path"], 5)


@query(SPOTS + " select count(*) as false_positives from findings f where not exists (select 1 from defects d where d.path = f.path and abs(d_line - f_line) <= 5)")
def unmatched_findings(spark, d):
    a, b = spots(spark, d)
    hits = match.within_tolerance(b, a, ["path"], "f_line", "d_line", 5).select("finding_id", F.lit(True).alias("hit"))
    return match.false_positives(b, hits).agg(F.count("*").alias("false_positives"))


@query(SPOTS + " select defect_id, count(*) as hunks from defects d join findings f on d.path = f.path and d_line <= f_line + 3 and d_line + 10 >= f_line - 3 group by defect_id")
def overlap_join(spark, d):
    a, b = spots(spark, d)
    a = a.withColumn("first", F.col("d_line")).withColumn("last", F.col("d_line") + 10)
    b = b.withColumn("lo", F.col("f_line") - 3).withColumn("hi", F.col("f_line") + 3)
    return match.overlapping(a, b, ["path"], "first", "last", "lo", "hi").groupBy("defect_id").agg(F.count("*").alias("hunks"))


@query(SPOTS + " select f.finding_id, d.defect_id, f_line::int as f_line from findings f join defects d on d.path = f.path and f_line between d_line and d_line + d.defect_id % 30 qualify row_number() over (partition by f.finding_id order by d.defect_id % 30, d.defect_id) = 1")
def innermost_interval(spark, d):
    a, b = spots(spark, d)
    a = a.withColumn("lo", F.col("d_line")).withColumn("hi", (F.col("d_line") + F.col("defect_id") % 30).cast("int"))
    return match.innermost(b, a, ["path"], ["finding_id"], "f_line", "lo", "hi", ["defect_id"]).select("finding_id", "defect_id", "f_line")


@query("with f as (select l_orderkey as task, array_agg(distinct l_suppkey) as names from lineitem group by 1) select count(*) filter (where len(list_intersect(f.names, g.names)) > 0) as tp, count(*) filter (where len(list_intersect(f.names, g.names)) = 0) as fn from f join (select l_orderkey as task, array_agg(distinct l_suppkey) as names from lineitem where l_returnflag = 'R' group by 1) g using (task)")
def set_compare(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), "l_suppkey", "l_returnflag")
    return summary.overlap_counts(li, li.where("l_returnflag = 'R'"), "task", "l_suppkey")


# ---------------------------------------------------------------- graphs

EDGES = """edges as (select 's' || s_suppkey as src, 'n' || s_nationkey as dst, 'in' as label from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey, 'of' from nation
 union all select 'c' || c_custkey, 'n' || c_nationkey, 'in' from customer union all select 'p' || l_partkey, 's' || l_suppkey, 'by' from lineitem)"""


def edges(spark, d):
    def e(name, a, akey, b, bkey, label):
        return t(spark, d, name).select(F.concat(F.lit(a), F.col(akey)).alias("src"), F.concat(F.lit(b), F.col(bkey)).alias("dst"), F.lit(label).alias("label"))

    li = t(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.lit("by").alias("label"))
    return e("supplier", "s", "s_suppkey", "n", "s_nationkey", "in").union(e("nation", "n", "n_nationkey", "r", "n_regionkey", "of")).union(e("customer", "c", "c_custkey", "n", "c_nationkey", "in")).union(li)


@query(f"with {EDGES} select dst as id, count(*) as edges, count(distinct src) as sources from edges group by dst")
def fan_in(spark, d):
    return graph.fan_in(edges(spark, d))


@query(f"with {EDGES} select src as id, dst as neighbour from edges where label = 'by'")
def neighbours(spark, d):
    return graph.neighbours(edges(spark, d), "by")


@query(f"with recursive {EDGES}, both_ as (select distinct src, dst from edges union select distinct dst, src from edges), walk(id, depth) as (select 'r0', 0 union select dst, depth + 1 from walk join both_ on src = id where depth < 3) select id, min(depth) as depth from walk group by id")
def bfs(spark, d):
    return graph.bfs(edges(spark, d), spark.createDataFrame([("r0",)], "id string"), 3)


@query(f"with recursive {EDGES}, walk(id, depth) as (select 's1', 0 union select dst, depth + 1 from walk join edges on src = id where depth < 4) select distinct id from walk where depth > 0")
def closure(spark, d):
    e = edges(spark, d).withColumn("label", F.lit("any"))
    return graph.closure(e, spark.createDataFrame([("s1",)], "id string"), "any", 4)


@query(f"with recursive {EDGES}, walk(id, path, depth) as (select 'c1', ['c1'], 0 union all select dst, list_append(path, dst), depth + 1 from walk join (select distinct src, dst from edges) on src = id where depth < 3) select list_aggregate(path, 'string_agg', '>') as path from walk where id = (select 'r' || n_regionkey from nation join customer on c_nationkey = n_nationkey where c_custkey = 1) order by depth, path limit 1")
def shortest_path(spark, d):
    end = t(spark, d, "nation").join(t(spark, d, "customer").where("c_custkey = 1"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("r"), "n_regionkey").alias("id"))
    return graph.shortest_path(edges(spark, d), "c1", end, 3).select(F.array_join("path", ">").alias("path"))


@query(f"with {EDGES} select src, dst, label from edges where label in ('in', 'of') and src in (select 's' || s_suppkey from supplier union select 'n' || n_nationkey from nation) and dst in (select 'n' || n_nationkey from nation where n_regionkey < 3)")
def induced_subgraph(spark, d):
    nation = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), "n_regionkey")
    nodes = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id")).union(nation.where("n_regionkey < 3").select("id"))
    return graph.induced(nodes, edges(spark, d), ["in", "of"])


@query("select o_orderkey as src, o_custkey as dst, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as is_used from orders")
def unused_imports(spark, d):
    imports = t(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    used = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src")).distinct().join(imports, "src")
    return graph.used_imports(imports, used)


@query("with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce((select 'part ' || max(p_brand) from part where p_partkey = l_partkey and p_size > 25), (select 'supplier ' || max(s_nationkey) from supplier where s_suppkey = l_suppkey and s_nationkey < 12)) as target from c")
def prioritised_resolution(spark, d):
    calls = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = t(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("part "), "p_brand").alias("target"))
    second = t(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("supplier "), F.col("s_nationkey")).alias("target"))
    return graph.resolve(calls, [first, second], ["l_partkey", "l_suppkey"])


@query("with recursive walk(conv_id, turn, depth) as (select conv_id, min(turn), 0 from conversations group by 1 union all select c.conv_id, c.turn, depth + 1 from walk w join conversations c on c.conv_id = w.conv_id and c.turn = w.turn + 1 where depth < 10) select conv_id, turn, depth from walk")
def reply_tree(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    ids = c.join(first, "conv_id").select(F.struct("conv_id", "turn").alias("id"), F.when(F.col("turn") > F.col("first"), F.struct("conv_id", (F.col("turn") - 1).alias("turn"))).alias("parent"))
    return graph.reply_tree(ids, 10).select("id.conv_id", "id.turn", "depth")


# ---------------------------------------------------------------- retrieval

TOKENS = "ceil(length(text) / 4)::bigint"


@query("select doc_id, s as score from (select doc_id, source, cast(contains(lower(source), 'src') as int) + cast(contains(lower(source), '1') as int) as s from documents) where s > 0 order by s desc, length(source), doc_id limit 25")
def lexical_topk(spark, d):
    return retrieve.lexical(t(spark, d, "documents").select("doc_id", "source"), ["src", "1"], "source", "doc_id", 25).select("doc_id", "score")


@query("with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from e), s as (select q.vec_id as query_id, p.vec_id, list_sum(list_transform(list_zip(p.v, q.v), lambda z: z[1] * z[2])) as score from n q join n p on q.vec_id <> p.vec_id where q.vec_id % 100 = 0) select query_id, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s qualify rank <= 5")
def dense_topk(spark, d):
    e = t(spark, d, "embeddings")
    return retrieve.dense(e.where("vec_id % 100 = 0"), e, 5).select("query_id", "vec_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"select lang, doc_id from documents qualify row_number() over (partition by lang order by {_u32(chr(39) + '0|' + chr(39) + ' || doc_id')}, doc_id) <= 7")
def seeded_sample(spark, d):
    return retrieve.seeded_sample(t(spark, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 7)


@query(f"with wanted as (select lang, count(*) as n from documents where source = 'src1' group by 1) select lang, doc_id from documents join wanted using (lang) where source <> 'src1' qualify row_number() over (partition by lang order by {_u32(chr(39) + '0|' + chr(39) + ' || doc_id')}, doc_id) <= n")
def random_type_matched(spark, d):
    docs = t(spark, d, "documents").select("lang", "doc_id", "source")
    wanted = docs.where("source = 'src1'").groupBy("lang").agg(F.count("*").alias("n"))
    return retrieve.type_matched(wanted, docs.where("source != 'src1'").drop("source"), "lang", ["doc_id"])


@query(f"with r as (select source, doc_id, {TOKENS} as tokens from documents), s as (select *, sum(tokens) over (partition by source order by doc_id) as used from r) select source, doc_id, tokens, cast(used as bigint) as used from s where used <= 20000")
def budget_prefix(spark, d):
    rows = t(spark, d, "documents").select("source", "doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))
    return retrieve.budget_prefix(rows, ["source"], ["doc_id"], "tokens", 20000)


@query(f"with recursive r as (select lang, doc_id, {TOKENS} as t, row_number() over (partition by lang order by doc_id) as k from documents), fill(lang, k, used, kept) as (select distinct lang, 0::bigint, 0::bigint, 0::bigint from r union all select f.lang, r.k, case when used + t <= 5000 then used + t else used end, case when used + t <= 5000 then kept + 1 else kept end from fill f join r on r.lang = f.lang and r.k = f.k + 1) select lang, k as offered, kept, used, 5000 - used as remaining from fill f where k = (select max(k) from r where r.lang = f.lang)")
def budget_fill(spark, d):
    rows = t(spark, d, "documents").select("lang", "doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))
    out = retrieve.greedy_fill(rows, ["lang"], ["doc_id"], "doc_id", "tokens", 5000)
    return out.withColumn("remaining", F.col("remaining").cast("bigint"))


@query("with r as (select source, doc_id, sum(n_chars) over w as s, row_number() over w as k from documents window w as (partition by source order by doc_id)) select source, k, cast(s as bigint) as total from r qualify row_number() over (partition by source order by abs(s - 30000), k) = 1")
def closest_prefix(spark, d):
    return retrieve.closest_prefix(t(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 30000)


@query("select source, doc_id, row_number() over (partition by source order by case lang when 'en' then 0 when 'fr' then 1 else 2 end, (n_chars > 2000)::int, n_chars, doc_id) as rank from documents qualify rank <= 6")
def ranked_neighbours(spark, d):
    tier = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    out = retrieve.tiered(t(spark, d, "documents").select("source", "doc_id", "lang", "n_chars"), ["source"], tier, F.col("n_chars") > 2000, "n_chars", "doc_id", 6)
    return out.select("source", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("select item_id, cast((row_number() over (order by md5(item_id::varchar), item_id) - 1) % 6 as int) as shard from benchmark")
def round_robin(spark, d):
    return retrieve.round_robin(t(spark, d, "benchmark").select("item_id"), [F.md5(F.col("item_id").cast("string")), F.col("item_id")], 6)


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents) select doc_id, cast(line as int) as line, content from l where contains(content, 'icense') order by doc_id, line limit 50")
def grep_lines(spark, d):
    return retrieve.grep(t(spark, d, "documents").select("doc_id", "text"), "text", "icense", 50, "doc_id")


# ---------------------------------------------------------------- roll-ups and the review store


@query("select event_type, round(sum(value), 4) as cost, cast(sum(user_id) as bigint) as tokens, count(*) as calls, grouping(event_type) = 1 as is_total from events group by rollup (event_type)")
def usage_rollup(spark, d):
    out = rollup.usage_rollup(t(spark, d, "events"), "event_type", {"cost": F.col("value"), "tokens": F.col("user_id")}, 4)
    return out.select("event_type", "cost", "tokens", "calls", "is_total")


@query("select event_type, count(*) as n, round(sum(case when contains(event_type, 'c') then 2.5 when contains(event_type, 'e') then 1.25 else 0.5 end)::double, 6) as price from events group by 1")
def price_lookup(spark, d):
    p = rollup.price(F.col("event_type"), [("c", 2.5), ("e", 1.25)], 0.5)
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum(p)).alias("price"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3 union select c_custkey from customer where c_mktsegment = 'BUILDING')")
def acl_filter(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return rollup.visible(t(spark, d, "orders").select("o_orderkey", "o_custkey"), [c.where("c_nationkey = 3"), c.where("c_mktsegment = 'BUILDING'")], "o_custkey")


@query("select o_orderkey, o_orderstatus, 'db' as source from orders where o_orderstatus = 'F' union all select o_orderkey, 'X', 'remote' from orders where o_orderstatus <> 'F'")
def merge_left_wins(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rollup.merge_left_wins(o.where("o_orderstatus = 'F'"), o.withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("with o as (select o_custkey as k, max(o_orderkey) filter (where o_orderstatus = 'F') as a, max(o_orderkey) filter (where o_orderstatus <> 'F') as b from orders group by 1) select k, coalesce(b, a) as ver, case when b is not null and b % 5 <> 0 then b % 5 when a is not null then a % 5 end as note from o")
def upsert_non_null(spark, d):
    o = t(spark, d, "orders")
    old = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("ver")).withColumn("note", F.col("ver") % 5)
    new = o.where("o_orderstatus != 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("ver")).withColumn("note", F.when(F.col("ver") % 5 != 0, F.col("ver") % 5))
    return rollup.upsert(old, new, ["k"], "ver")


@query("select conv_id, max(turn) as last_turn, count(*) as comments, count(*) filter (where role = 'user') as asked from conversations group by 1")
def thread_last_activity(spark, d):
    return summary.last_activity(t(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").withColumnRenamed("last", "last_turn")


@query("select c_custkey, coalesce(n, 0) as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def thread_counts(spark, d):
    kids = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return rollup.child_counts(t(spark, d, "customer").select("c_custkey"), kids, "c_custkey", "orders")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders qualify rank <= 5")
def history(spark, d):
    out = rollup.latest(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5)
    return out.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def paginate(spark, d):
    return rollup.page(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20).select("o_orderkey")


@query("with l as (select user_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select user_id from l where event_type <> 'purchase'")
def membership(spark, d):
    e = t(spark, d, "events").withColumn("action", F.when(F.col("event_type") == "purchase", "removed").otherwise("added"))
    return rollup.membership(e, ["user_id"], "action", ["ts", "event_id"])


@query("select 0 as ord, 'no price' as rule, count(*) filter (where l_extendedprice <= 0) as violations from lineitem union all select 1, 'large discount', count(*) filter (where l_discount > 0.09) from lineitem union all select 2, 'shipped late', count(*) filter (where l_shipdate > timestamp '1998-06-01') from lineitem")
def guard_rules(spark, d):
    rules = [("no price", F.col("l_extendedprice") <= 0), ("large discount", F.col("l_discount") > 0.09), ("shipped late", F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp"))]
    return rollup.first_violation(t(spark, d, "lineitem"), rules)


@query("with r as (select source, doc_id, sum(n_chars) over (partition by source order by doc_id desc rows unbounded preceding) as running from documents) select source, doc_id, cast(running as bigint) as running from r where running <= 40000")
def lru_keep(spark, d):
    return rollup.lru_keep(t(spark, d, "documents").select("source", "doc_id", "n_chars"), "doc_id", "n_chars", "doc_id", 40000, "source").select("source", "doc_id", "running")


@query("select p_partkey from part where (contains(lower(p_name), '1') or contains(lower(p_type), '1')) and p_size = 10")
def admin_search(spark, d):
    return rollup.search(t(spark, d, "part"), ["p_name", "p_type"], "1", {"p_size": 10}).select("p_partkey")


@query("select (select count(*) from customer) as users, (select count(*) from orders) as repositories, (select count(*) from lineitem) as reviews, (select count(*) from events) as events")
def table_counts(spark, d):
    names = {"users": "customer", "repositories": "orders", "reviews": "lineitem", "events": "events"}
    return summary.table_counts({name: t(spark, d, table) for name, table in names.items()})


@query("select event_id, user_id, event_type from (select * from events union all select * from events) qualify row_number() over (partition by event_id order by ts, user_id) = 1")
def webhook_dedupe(spark, d):
    e = t(spark, d, "events")
    return dedupe_events(e.union(e), "event_id", ["ts", "user_id"]).select("event_id", "user_id", "event_type")


@query("select user_id, arg_max(event_type, (ts, event_id)) as last_event, count(*) filter (where event_type in ('opened', 'reopened', 'synchronize')) as triggers, count(*) as events from events group by 1")
def review_states(spark, d):
    return review_state(t(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(max(value), 6) as highest, round(quantile_cont(value::double, 0.5), 6) as median from events group by all")
def day_split(spark, d):
    out = summary.day_split(t(spark, d, "events"), "ts", "event_type", "value")
    return out.select("day", "event_type", "n", r6("highest").alias("highest"), r6("median").alias("median"))


@query("select pattern, count(*) as users from (select user_id, string_agg(distinct event_type, ',' order by event_type) as pattern from events group by 1) group by 1")
def day_patterns(spark, d):
    return summary.patterns(t(spark, d, "events"), "user_id", "event_type").withColumnRenamed("n", "users")


@query("""with m as (select n_nationkey as model, (n_nationkey + 1) / 100.0 as in_1k, (n_nationkey + 1) / 25.0 as out_1k from nation), c as (select model, in_1k, out_1k, seed, condition, depth, case when condition <> 'E' then 1500 end as budget from m, (select unnest([0, 1, 2]) as seed), (select 'B' as condition, unnest([1, 2, 3]) as depth union all select unnest(['A', 'C', 'E']), null)),
 u as (select floor(avg(l_quantity) * 100)::bigint as tin, floor(avg(l_tax) * 5000)::bigint as tout, count(distinct l_orderkey) as tasks from lineitem) select model, condition, depth, budget, count(*) as cells, sum(tasks)::bigint as runs, sum(tin * tasks)::bigint as input_tokens, round(sum(tasks * (tin * in_1k + tout * out_1k) / 1000)::double, 4) as cost from c, u group by model, condition, depth, budget""")
def run_matrix(spark, d):
    """Nations as models with prices; usage and tasks are those of the order lines."""
    n = F.col("n_nationkey")
    models = t(spark, d, "nation").select(n.alias("model"), ((n + 1) / 100).alias("input_1k"), ((n + 1) / 25).alias("output_1k"))
    usage = t(spark, d, "lineitem").agg(F.floor(F.avg("l_quantity") * 100).alias("input_tokens"), F.floor(F.avg("l_tax") * 5000).alias("output_tokens"), F.countDistinct("l_orderkey").alias("tasks"))
    cells = audit.matrix_cells(models, [0, 1, 2], ["A", "B", "C", "E"], [1, 2, 3], 1500)
    out = audit.matrix_cost(cells, usage, ["model", "condition", "depth", "budget"])
    return out.select("model", "condition", "depth", "budget", "cells", "runs", "input_tokens", F.round("cost", 4).alias("cost"))


@query("select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 0 group by 1")
def language_histogram(spark, d):
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return summary.histogram(t(spark, d, "customer").where("c_acctbal > 0"), nations, "c_nationkey", "r_name")


# ---------------------------------------------------------------- text


@query(r"select page_id, len(list_distinct(regexp_extract_all(html, 'href=.([^\x22\x27]+)', 1))) as links, regexp_matches(url, '(^|/)en/') as english, length(html) as chars from pages")
def url_count(spark, d):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r"href=.([^\x22\x27]+)"), 1))
    return t(spark, d, "pages").select("page_id", F.size(links).cast("bigint").alias("links"), F.col("url").rlike("(^|/)en/").alias("english"), F.length("html").cast("bigint").alias("chars"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as key, ceil(length(text) / 4)::bigint as tokens from documents")
def comment_key(spark, d):
    return t(spark, d, "documents").select("doc_id", text.comment_key(F.col("text")).alias("key"), text.estimate_tokens(F.col("text")).alias("tokens"))


LINES = "lines as (select doc_id, source, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null)"


def diffs(spark, d):
    """Every document as a diff that replaces one line, the source, by the document's lines."""
    lines = F.split("text", "\n")
    path = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1,"), F.size(lines), F.lit(" @@\n-"), F.coalesce("source", F.lit("")))
    return t(spark, d, "documents").where("text is not null").select("doc_id", F.concat(head, F.lit("\n+"), F.array_join(lines, "\n+")).alias("diff"))


@query(f"with {LINES} select 'd' || doc_id || '.txt' as path, 'add' as kind, null::int as old_line, line::int as new_line, content from lines union all select 'd' || doc_id || '.txt', 'delete', 1, null, coalesce(source, '') from documents where text is not null")
def diff_lines(spark, d):
    return diffs(spark, d).select(F.explode(text.diff_lines("diff")).alias("r")).select("r.*")


@query(f"with {LINES} select 'd' || doc_id || '.txt' as path, 1 as first, max(line)::int as last from lines group by doc_id")
def changed_ranges(spark, d):
    return diffs(spark, d).select(F.explode(text.changed_ranges(F.col("diff"))).alias("r")).select("r.*")


@query("with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as k from conversations where text is not null) select conv_id || ':A:' || k as finding_id, 'c' || conv_id || '.py' as path, turn::int as line, text as message from r")
def parse_findings(spark, d):
    """Every conversation as one fenced JSON reply with a finding a turn."""
    c = t(spark, d, "conversations").where("text is not null")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    finding = lambda x: F.struct(F.concat(F.lit("c"), F.col("conv_id"), F.lit(".py")).alias("file"), x["turn"].alias("line"), x["text"].alias("description"))
    rows = c.groupBy("conv_id").agg(turns.alias("turns")).select(F.col("conv_id").cast("string").alias("task"), F.struct(F.transform("turns", finding).alias("findings")).alias("r"))
    rows = rows.select("task", F.concat(F.lit("```json\n"), F.to_json("r"), F.lit("\n```")).alias("reply"))
    return rows.select(F.explode(text.parse_findings("reply", "task", F.lit("A"))["findings"]).alias("f")).select("f.*")


@query("select l_orderkey, l_linenumber, cast(l_linenumber * l_quantity as int) || '.5%' as value, case when cast(l_linenumber * l_quantity as int) + 0.5 <= 100 and round_even(cast(l_linenumber * l_quantity as int) + 0.5, 0) <= 100 then round_even(cast(l_linenumber * l_quantity as int) + 0.5, 0)::int end as confidence from lineitem")
def parse_confidence(spark, d):
    value = F.concat((F.col("l_linenumber") * F.col("l_quantity")).cast("int"), F.lit(".5%"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value")).select("*", text.parse_confidence(F.col("value")).alias("confidence"))
