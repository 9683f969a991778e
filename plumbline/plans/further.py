"""More registered queries: run comparison, clustered intervals, reviews as state, selections, sources with braces, loading."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import bench, resample, rundiff, selection, store
from ..sources import hits, load_run
from ..streaming import reviews
from ..tables import shared_dir
from .registry import FIRST, RUNS, _boot, first_lines, query, r6, runs, t
from .sqlmath import probit_sql

# ---------------------------------------------------------------- runs and conditions


@query(RUNS + f""", per as (select arm, cluster, count(*) as n, count(*) filter (where hit) as h from runs group by all), num as (select *, row_number() over (partition by arm order by cluster) - 1 as slot, count(*) over (partition by arm) as k from per),
 picks as (select arm, draw, ('0x' || substr(md5('0|' || draw || '|' || pick), 1, 8))::bigint % k as slot from (select arm, k, unnest(range(1, k + 1)) as pick from (select distinct arm, k from num)) cross join (select unnest(range(0, 2000)) as draw)),
 e as (select arm, draw, sum(h) / sum(n) as e from picks join num using (arm, slot) group by all), l as (select arm, list_sort(list(e)) as v from e group by arm)
 select arm, count(*) as tasks, sum(n)::bigint as defects, sum(h)::bigint as hits, round(sum(h) / sum(n), 6) as recall, round(any_value(v)[{int(.025 * 2000)}], 6) as recall_low, round(any_value(v)[{int(.975 * 2000) + 1}], 6) as recall_high from per join l using (arm) group by arm""")
def condition_intervals(spark, d):
    """Every condition's recall with the interval of its own clusters."""
    out = resample.clustered_rates(runs(spark, d), "arm", "cluster", F.col("hit"))
    return out.select("arm", "tasks", "defects", "hits", *[r6(c).alias(c) for c in ("recall", "recall_low", "recall_high")])


def _run_difference_sql() -> str:
    cell = lambda name, x, where="": ", ".join(f"max({x}) filter (where run = '{r}' and a = {a}{where}) as {name}{r.lower()}{a}" for r in "AB" for a in (1, 2))
    rate = lambda h, n: f"least(greatest({h} / {n}::double, 1 / (2.0::double * {n})), 1 - 1 / (2.0::double * {n}))"
    rows, change = [], lambda x, r: f"{x}{r}2 - {x}{r}1"
    for x, name in (("u", "auc"), ("h", "h"), ("f", "f"), ("d", "d_prime"), ("c", "criterion")):
        rows += [(name, f"'{r}'", a, "null", f"{x}{r.lower()}{a}") for r in "AB" for a in (1, 2)]
        difference = "d_auc" if x == "u" else name
        rows += [(difference, f"'{r}'", 2, "1", change(x, r.lower())) for r in "AB"] + [(difference, "null", 2, "1", f"({change(x, 'a')}) - ({change(x, 'b')})")]
        if x == "u":
            rows.append(("d_auc_common", "null", 2, "1", f"({change('v', 'a')}) - ({change('v', 'b')})"))
        else:
            rows += [(name, "null", a, "null", f"{x}a{a} - {x}b{a}") for a in (1, 2)]
    listed = " union all ".join(f"select draw, '{n}' as statistic, {r} as run, {a} as arm, {b} as base, {v} as value from wide" for n, r, a, b, v in rows)
    return RUNS + f""", cells as (select case when arm <= 2 then 'A' else 'B' end as run, (arm - 1) % 2 + 1 as a, task, cluster, score // 10 as score, hit, is_defect from runs where arm <= 4),
 shared as (select cluster from cells group by 1 having count(distinct (run, a)) = 4), common as (select task from cells group by 1 having count(distinct (run, a)) = 4),
 {_boot("count(*) as n0 from cells where cluster in (from shared)")},
 hc as (select 0 as com, cluster, run, a, score, count(*) filter (where is_defect) as hd, count(*) filter (where not is_defect) as ht from cells group by all union all
  select 1, cluster, run, a, score, count(*) filter (where is_defect), count(*) filter (where not is_defect) from cells where task in (from common) group by all),
 bc as (select cluster, run, a, count(*) filter (where is_defect) as nd, count(*) filter (where not is_defect) as nt, count(*) filter (where is_defect and hit) as xd, count(*) filter (where not is_defect and hit) as xt from cells group by all),
 times as (select draw, cluster, count(*) as m from picks join num using (slot) group by all union all select -1, cluster, 1 from shared),
 w as (select draw, com, run, a, score, sum(m * hd) as hd, sum(m * ht) as ht from times join hc using (cluster) group by all),
 q as (select *, coalesce(sum(ht) over (partition by draw, com, run, a order by score rows between unbounded preceding and 1 preceding), 0) as below from w),
 u as (select draw, com, run, a, sum(hd)::bigint as nd, sum(ht)::bigint as nt, sum(hd * (below + 0.5 * ht)) / (sum(hd) * sum(ht)) as auc from q group by all),
 s as (select draw, run, a, sum(m * nd) as nd, sum(m * nt) as nt, sum(m * xd) as xd, sum(m * xt) as xt from times join bc using (cluster) group by all),
 b as (select draw, run, a, nd::bigint as nd, nt::bigint as nt, {rate('xd', 'nd')} as h, {rate('xt', 'nt')} as f from s), z as (select *, {probit_sql('h')} as zh, {probit_sql('f')} as zf from b),
 wide as (select * from (select draw, {cell('u', 'auc', ' and com = 0')}, {cell('v', 'auc', ' and com = 1')} from u group by draw) join (select draw, {cell('h', 'h')}, {cell('f', 'f')}, {cell('d', 'zh - zf')}, {cell('c', '-(zh + zf) / 2')} from z group by draw) using (draw)),
 long as ({listed}), n as (select 'auc' as statistic, run, a as arm, null::int as base, nd, nt from u where draw = -1 and com = 0 union all select t.statistic, run, a, null, nd, nt from b cross join (select unnest(['h', 'f', 'd_prime', 'criterion']) as statistic) t where draw = -1),
 e as (select statistic, run, arm, base, max(value) filter (where draw = -1) as value, list_sort(list(value) filter (where draw >= 0)) as v from long group by all)
 select e.statistic, e.run, e.arm, e.base, nd, nt, round(value, 6) as value, round(v[151], 6) as low, round(v[5850], 6) as high from e left join n on n.statistic = e.statistic and n.run = e.run and n.arm = e.arm and e.base is null"""


@query(_run_difference_sql())
def auc_run_difference(spark, d):
    """Arms 1 and 2 as one run, 3 and 4 as another over the same tasks; ratings of six steps."""
    rows = runs(spark, d).where("arm <= 4").withColumn("run", F.when(F.col("arm") <= 2, "A").otherwise("B")).withColumn("arm", ((F.col("arm") - 1) % 2 + 1).cast("int")).withColumn("score", F.floor(F.col("score") / 10))
    out = rundiff.compare_runs(rows, [1, 2], F.col("is_defect"), scores=6)
    return out.select("statistic", "run", "arm", "base", "nd", "nt", *[r6(c).alias(c) for c in ("value", "low", "high")])


# ---------------------------------------------------------------- reviews as state

_ACTION = "case event_type when 'signup' then case event_id % 3 when 0 then 'opened' when 1 then 'reopened' else 'synchronize' end when 'view' then 'closed' when 'click' then 'start' when 'purchase' then 'complete' else 'fail' end"


@query(f"""with recursive e as (select user_id as number, event_id, ts, {_ACTION} as action, 't' || event_id % 7 as title, row_number() over (partition by user_id order by ts, event_id::varchar) as i from events where event_type is not null),
 s as (select number, 0::bigint as i, null::varchar as title, 0::bigint as reviews, null::bigint as pending, []::bigint[] as started, null::bigint as event_id, null::varchar as action, null::varchar as change, null::bigint as review from (select distinct user_id as number from events)
  union all select e.number, e.i, case when e.action in ('start', 'complete', 'fail') then s.title else e.title end,
   case when e.action = 'start' and pending is null or e.action in ('opened', 'reopened', 'synchronize') and pending is null and len(started) = 0 then reviews + 1 else reviews end,
   case when e.action = 'start' then null when e.action in ('opened', 'reopened', 'synchronize') and pending is null and len(started) = 0 then reviews + 1 else pending end,
   case when e.action = 'start' then list_append(started, coalesce(pending, reviews + 1)) when e.action in ('complete', 'fail') and len(started) > 0 then started[:len(started) - 1] else started end, e.event_id, e.action,
   case when e.action in ('opened', 'reopened', 'synchronize') then case when pending is not null then 'enqueued' when len(started) = 0 then 'created' end when e.action = 'start' then 'started' when len(started) > 0 then case e.action when 'complete' then 'completed' when 'fail' then 'failed' end end,
   case when e.action in ('opened', 'reopened', 'synchronize') then case when pending is not null then pending when len(started) = 0 then reviews + 1 end when e.action = 'start' then coalesce(pending, reviews + 1) when e.action in ('complete', 'fail') then started[len(started)] end
  from s join e on e.number = s.number and e.i = s.i + 1),
 c as (select number, i, 1 as k, title, event_id, 'updated' as change, null::bigint as review from s where action not in ('start', 'complete', 'fail') union all select number, i, 2, title, event_id, change, review from s where change is not null)
 select number, row_number() over (partition by number order by i, k) as seq, event_id::varchar as event_id, review, change, case change when 'created' then 'pending' when 'enqueued' then 'pending' when 'started' then 'in_progress' when 'completed' then 'completed' when 'failed' then 'failed' end as review_status, title, case when change = 'failed' then 'e' || event_id % 5 end as error from c""")
def review_life(spark, d):
    """Every event of a user as one of a pull request, each of them sent twice."""
    action = F.expr(_ACTION)
    events = t(spark, d, "events").where("event_type is not null").select(F.col("event_id").cast("string").alias("event_id"), action.alias("action"), F.lit("r").alias("repository"), F.col("user_id").alias("number"), F.expr("concat('t', event_id % 7)").alias("title"), F.lit("open").alias("status"), F.expr("concat('e', event_id % 5)").alias("error"), F.col("ts").cast("timestamp").alias("received"))
    out = reviews.review_changes(events.union(events))
    return out.select("number", "seq", "event_id", "review", "change", "review_status", "title", "error")


# ---------------------------------------------------------------- selections

_CALLS = "case when role = 'user' or turn % 5 = 4 then [] else list_transform(range(1, length(text) % 3 + 2), lambda i: {'name': case i % 2 when 1 then 'search_code' else 'read_file' end, 'hit': (length(text) + i) % 4 = 0}) end"


@query(f"""with t as (select conv_id as task, turn + 1 as turn, case when turn > 0 and length(text) % 11 = 0 then 'timeout' end as error, length(text) as n, {_CALLS} as calls from conversations where conv_id is not null),
 e as (select *, min(case when error is not null or len(calls) = 0 then turn end) over (partition by task) as stop from (select * from t where turn <= 8)), k as (select * from e where stop is null or turn <= stop), u as (select *, error is null as ok from k)
 select task, max(turn) as turns, sum(case when ok then len(calls) else 0 end)::bigint as tool_calls, sum(case when ok then len(list_filter(calls, lambda c: c.name = 'search_code')) else 0 end)::bigint as searches, sum(case when ok then len(list_filter(calls, lambda c: c.name = 'read_file')) else 0 end)::bigint as reads,
 coalesce(bool_or(ok and len(list_filter(calls, lambda c: c.name = 'search_code')) > 0), false) as searched_at_all, bool_or(ok and len(list_filter(calls, lambda c: c.hit)) > 0) as found_the_caller, min(case when ok and len(list_filter(calls, lambda c: c.hit)) > 0 then turn end) as first_found, sum(case when ok then n end)::bigint as input_tokens,
 case when max(stop) is null then 'did not finish within 8 turns' else max(case when turn = stop then error end) end as error from u group by task""")
def agent_transcripts(spark, d):
    """Conversations as agents' turns: a turn of the user, and each fifth, calls no tool."""
    talk, n = t(spark, d, "conversations").where("conv_id is not null"), F.length("text")
    call = lambda i: F.struct(F.when(i % 2 == 1, "search_code").otherwise("read_file").alias("name"), F.lit("q").alias("query"), F.when((i % 2 == 0) & ((n + i) % 4 == 0), "src/caller.py").otherwise("other.py").alias("path"), F.when((i % 2 == 1) & ((n + i) % 4 == 0), "src/caller.py:3: f()").otherwise("no matches").alias("output"))
    calls = F.when(~((F.col("role") == "user") | (F.col("turn") % 5 == 4)), F.transform(F.sequence(F.lit(1), n % 3 + 1), call))
    turns = talk.select(F.col("conv_id").alias("task"), F.lit("AGENT").alias("condition"), (F.col("turn") + 1).alias("turn"), F.when((F.col("turn") > 0) & (n % 11 == 0), "timeout").alias("error"), "text", n.alias("input_tokens"), F.lit(0).alias("output_tokens"), calls.alias("calls"))
    out = selection.transcripts(turns, talk.select(F.col("conv_id").alias("task"), F.lit("src/caller.py").alias("caller_path")).distinct())
    return out.drop("condition", "text", "output_tokens")


_TARGETS = "select p_brand as repo, p_type as file, 'f' || p_size as name from part group by all"


@query(f"""with g as ({_TARGETS}), c as (select p_brand as repo, p_type as file, 'f' || p_size as name, list_sort(list(distinct 'c' || p_partkey % 4)) as callers from part where p_partkey % 3 = 0 group by all),
 u as (select repo, name, count(*) = 1 as unique_name from g group by all), o as (select *, row_number() over (partition by repo order by ('0x' || substr(md5('0|' || repo || '|' || file || '|' || name), 1, 8))::bigint, file, name) as place from g left join c using (repo, file, name) join u using (repo, name)),
 h as (select *, row_number() over (partition by repo order by place) as k from o where callers is not null), s as (select * from h where k <= 5)
 select repo, (select count(*) from g where g.repo = r.repo) as definitions, (select count(*) from s where s.repo = r.repo) as sampled_with_callers, (select count(*) from s where s.repo = r.repo and unique_name) as unique_name_targets,
 (select count(*) from o where o.repo = r.repo and callers is null and (place < (select max(place) from s where s.repo = r.repo) or (select count(*) from s where s.repo = r.repo) < 5)) as sampled_without_callers from (select distinct repo from g) r""")
def validation_summary(spark, d):
    return _validation(spark, d)[1]


@query(f"""with g as ({_TARGETS}), c as (select p_brand as repo, p_type as file, 'f' || p_size as name, list_sort(list(distinct 'c' || p_partkey % 4)) as callers from part where p_partkey % 3 = 0 group by all)
 select repo, file, name, array_to_string(callers, ',') as callers from g join c using (repo, file, name) qualify row_number() over (partition by repo order by ('0x' || substr(md5('0|' || repo || '|' || file || '|' || name), 1, 8))::bigint, file, name) <= 5""")
def validation_targets(spark, d):
    return _validation(spark, d)[0].select("repo", "file", "name", F.array_join("callers", ",").alias("callers"))


def _validation(spark, d):
    part = t(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("file"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("name"), "p_partkey")
    callers = part.where("p_partkey % 3 = 0").withColumn("caller", F.concat(F.lit("c"), (F.col("p_partkey") % 4).cast("string")))
    return selection.validation_sample(part.select("repo", "file", "name").distinct(), callers.select("repo", "file", "name", "caller"), 5)


_SYMBOLS = """s as (select o_custkey % 50 as task, o_orderkey as identity, 'm' || o_custkey % 4 || '.py' as path, o_orderkey % 40 as first, o_orderkey % 40 + o_orderkey % 9 as last,
  'm' || o_custkey % 4 || '.py' || case o_orderkey % 5 when 0 then '' when 1 then '::C' || o_orderkey % 7 when 2 then '::C' || o_orderkey % 7 || '.f' || o_orderkey % 3 when 3 then '::C' || o_orderkey % 7 || '.D.g' else '::h' || o_orderkey end as qualified_name,
  case when o_orderkey % 5 = 1 then 'class' when o_orderkey % 11 = 0 then 'other' when o_orderkey % 5 = 0 then 'file' else 'function' end as kind from orders)"""


@query(f"""with {_SYMBOLS}, ch as (select distinct o_custkey % 50 as task, 'm' || o_custkey % 6 || '.py' as path, o_custkey % 30 + 5 as lo, o_custkey % 30 + 9 as hi from orders where o_orderkey % 7 = 0),
 f as (select distinct s.* from s join ch using (task, path) where s.qualified_name <> path and kind in ('class', 'function') and first <= hi and last >= lo),
 kept as (select * from f where not exists (select 1 from f g where g.task = f.task and starts_with(g.qualified_name, f.qualified_name || '.'))),
 hub as (select task, path, min(identity) as identity from s where qualified_name = path and (task, path) in (select (task, path) from ch) and (task, path) not in (select (task, path) from f) group by all),
 a as (select task, identity, qualified_name, path, kind, 0 as hub, first, last - first as n from kept union all select task, identity, path, path, 'file', 1, 0, 0 from hub)
 select task, row_number() over (partition by task order by hub, first, n, qualified_name, identity)::int as rank, identity, qualified_name, path, kind from a""")
def symbol_seeds(spark, d):
    """Orders as symbols of an index that gives no kinds: they are read from the sources."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    path = F.concat(F.lit("m"), s(c % 4), F.lit(".py"))
    below = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("::C"), s(k % 7))).when(k % 5 == 2, F.concat(F.lit("::C"), s(k % 7), F.lit(".f"), s(k % 3))).when(k % 5 == 3, F.concat(F.lit("::C"), s(k % 7), F.lit(".D.g"))).otherwise(F.concat(F.lit("::h"), s(k)))
    text = F.when(k % 5 == 1, "\n@final\nclass C:\n    pass\n").when(k % 11 == 0, "x = 1\n").when(k % 5 == 0, None).otherwise("@cached\n  async def f(x):\n    return x\n")
    orders = t(spark, d, "orders")
    symbols = orders.select((c % 50).alias("task"), k.alias("identity"), F.concat(path, below).alias("qualified_name"), path.alias("path"), F.lit(None).cast("string").alias("kind"), text.alias("text"), (k % 40).alias("first"), (k % 40 + k % 9).alias("last"))
    changed = orders.where("o_orderkey % 7 = 0").select((c % 50).alias("task"), F.concat(F.lit("m"), s(c % 6), F.lit(".py")).alias("path"), (c % 30 + 5).alias("first"), (c % 30 + 9).alias("last")).distinct()
    return selection.symbol_seeds(symbols, changed)


@query("select o_orderkey as k, count(*) as lines, sum(l_quantity) as quantity from orders join lineitem on l_orderkey = o_orderkey group by 1 having sum(l_quantity) > 150 order by 1 limit 25")
def first_large_orders(spark, d):
    """The first 25 orders, by key, whose lines sum up to more than 150: lines are read for few orders only."""
    lines = t(spark, d, "lineitem")

    def large(block):
        return block.join(lines, F.col("k") == F.col("l_orderkey")).groupBy("k").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")).where("quantity > 150")

    return selection.first_qualifying(t(spark, d, "orders").select(F.col("o_orderkey").alias("k")).distinct(), "k", large, 25)


_FILES = "select c_nationkey as repo, case when c_custkey % 3 = 0 then '' else 'src/' || case when c_custkey % 3 = 1 then '' else 'm' || c_custkey % 4 || '/' end end || 'f' || c_custkey || '.py' as path, c_custkey as bytes from customer"


def tree_files(spark, d):
    k = F.col("c_custkey")
    deep = F.when(k % 3 == 0, "").when(k % 3 == 1, "src/").otherwise(F.concat(F.lit("src/m"), (k % 4).cast("string"), F.lit("/")))
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("repo"), F.concat(deep, F.lit("f"), k.cast("string"), F.lit(".py")).alias("path"), k.alias("bytes"))


@query(f"""with f as ({_FILES}), p as (select repo, bytes, string_split(path, '/') as ps from f), s as (select repo, bytes, ps, unnest(range(0, len(ps))) as depth from p)
 select repo, array_to_string(ps[1:depth], '/') as folder, depth::int as depth, count(*) as files, sum(bytes)::bigint as bytes, array_to_string(list_sort(list(distinct ps[depth + 1])), ',') as children from s group by all""")
def folder_sizes(spark, d):
    out = selection.folders(tree_files(spark, d))
    return out.select("repo", "folder", "depth", "files", "bytes", F.array_join("children", ",").alias("children"))


@query(f"""with f as ({_FILES}), p as (select repo, bytes, string_split(path, '/') as ps from f),
 two as (select repo, ps[1] as a, ps[2] as name, '{{' || string_agg('"' || ps[3] || '":' || bytes, ',' order by ps[3]) || '}}' as info from p where len(ps) = 3 group by all),
 one as (select repo, a as name, '{{' || string_agg('"' || name || '":' || info, ',' order by name) || '}}' as info from (select * from two union all select repo, ps[1], ps[2], bytes::varchar from p where len(ps) = 2) group by all)
 select repo, '{{' || string_agg('"' || name || '":' || info, ',' order by name) || '}}' as structure from (select * from one union all select repo, ps[1], bytes::varchar from p where len(ps) = 1) group by repo""")
def nested_structure(spark, d):
    return selection.structure(tree_files(spark, d).withColumn("info", F.col("bytes").cast("string")))


# ---------------------------------------------------------------- sources in languages with braces

_KEY = "c_custkey"
BRACED = {
    "js": "import lib from './lib{0}'\nclass Shape{0} extends Base{0} {{\n  area(r) {{ this.total = scale{0}(r); return this.unit.of(r); }}\n}}\nconst make{0} = (a) => {{\n  return new Shape{0}(lift{0}(a));\n}};\n",
    "java": "import lib.Tool{0};\n/* class No {{}} */\npublic class Box{0}<T> extends Base{0}<T> {{\n  @Override\n  int size(List<T> all, int n) throws E {{\n    int k = n + all.size();\n    return Tool{0}.clip(k, \"}}\");\n  }}\n}}\n",
    "c": "#include \"tool{0}.h\"\nint run{0}(struct node *n, int k) {{\n  n->count += k;\n  return step{0}(n, '}}');\n}}\n",
}
#: kind, name, owner, receiver, first and last line of what each file has; @ stands for its key.
_EXPECTED = {
    "js": [
        ("def", "Shape@", None, None, 2, 4), ("inherits", "Base@", "Shape@", None, 2, 4), ("def", "area", "Shape@", None, 3, 3), ("read", "r", "area", None, 3, 3), ("write", "this.total", "area", None, 3, 3), ("call", "scale@", "area", None, 3, 3), ("read", "scale@", "area", None, 3, 3), ("read", "r", "area", None, 3, 3), ("read", "this.unit", "area", None, 3, 3), ("call", "of", "area", "this.unit", 3, 3), ("read", "r", "area", None, 3, 3),
        ("def", "make@", None, None, 5, 7), ("read", "a", "make@", None, 5, 5), ("read", "Shape@", "make@", None, 6, 6), ("call", "lift@", "make@", None, 6, 6), ("read", "lift@", "make@", None, 6, 6), ("read", "a", "make@", None, 6, 6), ("import", "import lib from './lib@'", None, None, 1, 1),
    ],
    "java": [
        ("def", "Box@", None, None, 3, 9), ("inherits", "Base@", "Box@", None, 3, 9), ("def", "size", "Box@", None, 4, 8), ("read", "all", "size", None, 5, 5), ("read", "n", "size", None, 5, 5), ("write", "k", "size", None, 6, 6), ("read", "n", "size", None, 6, 6), ("read", "all", "size", None, 6, 6), ("call", "size", "size", "all", 6, 6),
        ("read", "Tool@", "size", None, 7, 7), ("call", "clip", "size", "Tool@", 7, 7), ("read", "k", "size", None, 7, 7), ("import", "import lib.Tool@;", None, None, 1, 1),
    ],
    "c": [
        ("def", "run@", None, None, 2, 5), ("read", "n", "run@", None, 2, 2), ("read", "k", "run@", None, 2, 2), ("read", "n", "run@", None, 3, 3), ("write", "n->count", "run@", None, 3, 3), ("read", "k", "run@", None, 3, 3), ("call", "step@", "run@", None, 4, 4), ("read", "step@", "run@", None, 4, 4), ("read", "n", "run@", None, 4, 4), ("import", "#include \"tool@.h\"", None, None, 1, 1),
    ],
}
_quoted = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
_ROWS = ", ".join(f"({_quoted(lang)}, {_quoted(kind)}, {_quoted(name)}, {_quoted(owner)}, {_quoted(receiver)}, {first}, {last})" for lang, rows in _EXPECTED.items() for kind, name, owner, receiver, first, last in rows)


@query(f"""select c_custkey || '.' || lang as file, kind, replace(name, '@', c_custkey::varchar) as name, replace(owner, '@', c_custkey::varchar) as owner, replace(receiver, '@', c_custkey::varchar) as receiver, first, last, count(*) as n
 from customer cross join (values {_ROWS}) as x(lang, kind, name, owner, receiver, first, last) group by all""")
def brace_tags(spark, d):
    """A file in each language for every customer."""
    key = F.col(_KEY).cast("string")
    fill = lambda text: F.concat(*[x for k, part in enumerate(text.replace("{{", "{").replace("}}", "}").split("{0}")) for x in ([key] if k else []) + [F.lit(part)]])
    files = F.array(*[F.struct(F.concat(key, F.lit("." + lang)).alias("path"), fill(body).alias("text")) for lang, body in BRACED.items()])
    sources = t(spark, d, "customer").select(F.lit("r").alias("repo"), F.explode(files).alias("f")).select("repo", "f.*")
    return code.parse_tags(sources).groupBy("file", "kind", "name", "owner", "receiver", "first", "last").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- loading and small rules


def _run_folder(spark, d):
    """Order lines as the outcomes and reviews of a run, written and read again."""
    root = f"{shared_dir(spark)}/plumbline/run-{uuid.uuid4().hex}"
    first = first_lines(spark, d)
    k = F.col("l_orderkey").cast("string")
    first.select(F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("defect_id"), F.concat(F.lit("org-"), k).alias("task_id"), F.lit("B").alias("condition"), (F.col("l_returnflag") == "R").alias("hit"), F.when(F.col("l_returnflag") == "R", (F.col("l_partkey") % 3).cast("int")).alias("line_distance")).write.json(f"{root}/outcomes.jsonl")
    first.where("l_linenumber = 1").select(F.concat(F.lit("org-"), k).alias("task_id"), F.lit("B").alias("condition"), F.col("l_quantity").cast("int").alias("context_chars")).write.json(f"{root}/raw.jsonl")
    return load_run(spark, root)


@query(f"with {FIRST} select 'org-' || l_orderkey as task_id, 'd' || l_linenumber as defect_id, l_returnflag = 'R' as hit, l_returnflag = 'R' and l_partkey % 3 = 0 as exact, 'org' as repo from first")
def outcome_hits(spark, d):
    outcomes, _ = _run_folder(spark, d)
    exact = hits(outcomes, exact=True).withColumnRenamed("hit", "exact")
    return hits(outcomes).join(exact, ["task_id", "defect_id"]).withColumn("repo", text.repo_prefix(F.col("task_id")))


@query(f"with {FIRST} select 'org-' || l_orderkey as task_id, l_quantity::int as context_chars, (select count(*) from first f where f.l_orderkey = first.l_orderkey) as outcomes from first where l_linenumber = 1")
def run_folder(spark, d):
    outcomes, raw = _run_folder(spark, d)
    n = outcomes.groupBy("task_id").agg(F.count("*").alias("outcomes"))
    return raw.join(n, "task_id").select("task_id", "context_chars", "outcomes")


@query("select o_orderkey as k, o_custkey % 90 || ',' || o_orderkey % 1000 as starts from orders")
def hunk_starts(spark, d):
    c, k = (F.col(x) for x in ("o_custkey", "o_orderkey"))
    s = lambda x: x.cast("string")
    diff = F.concat(F.lit("diff --git a/x b/x\n@@ -1,2 +"), s(c % 90), F.lit(",3 @@ def f\n+@@ -9 +9 @@\n context\n@@ -7 +"), s(k % 1000), F.lit(" @@\n-a"))
    return t(spark, d, "orders").select(k.alias("k"), F.array_join(F.transform(text.hunk_headers(diff), s), ",").alias("starts"))


@query("select o_orderkey as query, case o_custkey % 3 when 0 then 'a.py' else 'b.py' end as path, (o_custkey % 50)::int as line from orders where o_custkey % 3 < 2 and o_custkey % 50 > 0")
def fault_targets(spark, d):
    c = F.col("o_custkey")
    defects = t(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(c % 3 == 0, "a.py").when(c % 3 == 1, "b.py").otherwise("").alias("path"), F.when(c % 50 != 0, (c % 50).cast("int")).alias("line"))
    return bench.targets(defects)


@query("""with m as (select user_id, event_id, case event_id % 4 when 0 then 'Previous feedback: f' || event_id % 9 when 1 then 'Previous feedback: f' || event_id % 9 || '|Previous response: r' || event_id % 5 end as line from events where user_id is not null)
 select user_id, string_agg(line, '|' order by event_id) as episodes from m where line is not null group by user_id""")
def episodic_memory(spark, d):
    k = F.col("event_id")
    feedback, answer = F.concat(F.lit('"feedback_received": "f'), (k % 9).cast("string"), F.lit('"')), F.concat(F.lit('"ai_response_snippet": "r'), (k % 5).cast("string"), F.lit('"'))
    value = F.when(k % 4 == 0, F.concat(F.lit("{"), feedback, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit("{"), answer, F.lit(", "), feedback, F.lit("}"))).when(k % 4 == 2, "{broken").otherwise('["feedback_received"]')
    memory = t(spark, d, "events").where("user_id is not null").select("user_id", "event_id", value.alias("value"))
    return store.episodes(memory, ["user_id"], "value", ["event_id"]).select("user_id", F.array_join("episodes", "|").alias("episodes"))
