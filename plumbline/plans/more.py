"""Registered queries of code graphs, retrieval, benchmarks, evidence, audits and the store, on stand-in tables.

Source files are made of regions, nations and suppliers: a repository a region, a function and a class a region, a
function a nation that imports and calls the region's, a class a supplier that extends the region's and calls the
nation's.  Reviews, logs and comments are made of orders and their lines."""

from __future__ import annotations

import keyword
import re
import uuid

from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import audit, bench, codegraph, context, evidence, generate, paired, resample, retrieve, roc, rollup, store
from ..sources import cached, read_labels, remaining, structure_runs, write_jsonl
from ..tables import materialize, shared_dir, spread
from .registry import FIRST, RUNS, TRIALS, _boot, first_lines, query, r6, runs, t
from .sqlmath import probit_sql

# ---------------------------------------------------------------- code graphs

TOP = "def top{0}(x, deep=True):\n    if x is None:\n        raise ValueError('x')\n    return x\n\n\nclass Base{0}:\n    def run(self):\n        return top{0}(1)\n"
LOAD = "from ..lib.region{1} import top{1} as base\n\n\ndef load{0}(x):\n    return base(x)\n"
SUP = "from n.nation{1} import load{1}\nfrom lib.region{2} import Base{2}\n\n\nclass Sup{0}(Base{2}):\n    def go(self):\n        self.run()\n        return load{1}({0})\n"

_R, _N, _S = "'lib/region' || r_regionkey || '.py'", "'n/nation' || n_nationkey || '.py'", "'s/sup' || s_suppkey || '.py'"
_REGION, _NATION, _SUP = "from region", "from nation", "from supplier join nation on s_nationkey = n_nationkey"
CODE_EDGES = f"""with e as (
 select 'r' || r_regionkey as repo, {_R} as src, {_R} || '::function::top' || r_regionkey as dst, 'contains' as label {_REGION}
 union all select 'r' || r_regionkey, {_R}, {_R} || '::class::Base' || r_regionkey, 'contains' {_REGION}
 union all select 'r' || r_regionkey, {_R}, {_R} || '::function::run', 'contains' {_REGION}
 union all select 'r' || r_regionkey, {_R} || '::class::Base' || r_regionkey, {_R} || '::function::run', 'contains' {_REGION}
 union all select 'r' || r_regionkey, {_R} || '::function::run', {_R} || '::function::top' || r_regionkey, 'calls' {_REGION}
 union all select 'r' || r_regionkey, {_R} || '::function::top' || r_regionkey, {_R} || '::var::' || unnest(['x', 'deep', 'ValueError']), 'reads' {_REGION}
 union all select 'r' || r_regionkey, {_R} || '::function::run', {_R} || '::var::' || unnest(['self', 'top' || r_regionkey]), 'reads' {_REGION}
 union all select 'r' || n_regionkey, {_N}, {_N} || '::function::load' || n_nationkey, 'contains' {_NATION}
 union all select 'r' || n_regionkey, {_N}, 'lib/region' || n_regionkey || '.py', 'imports' {_NATION}
 union all select 'r' || n_regionkey, {_N} || '::function::load' || n_nationkey, 'lib/region' || n_regionkey || '.py::function::top' || n_regionkey, 'calls' {_NATION}
 union all select 'r' || n_regionkey, {_N} || '::function::load' || n_nationkey, {_N} || '::var::' || unnest(['x', 'base']), 'reads' {_NATION}
 union all select 'r' || n_regionkey, {_S}, {_S} || unnest(['::class::Sup' || s_suppkey, '::function::go']), 'contains' {_SUP}
 union all select 'r' || n_regionkey, {_S} || '::class::Sup' || s_suppkey, {_S} || '::function::go', 'contains' {_SUP}
 union all select 'r' || n_regionkey, {_S}, unnest([{_N}, 'lib/region' || n_regionkey || '.py']), 'imports' {_SUP}
 union all select 'r' || n_regionkey, {_S} || '::class::Sup' || s_suppkey, 'lib/region' || n_regionkey || '.py::class::Base' || n_regionkey, 'inherits_from' {_SUP}
 union all select 'r' || n_regionkey, {_S} || '::function::go', unnest([{_N} || '::function::load' || n_nationkey, 'lib/region' || n_regionkey || '.py::function::run']), 'calls' {_SUP}
 union all select 'r' || n_regionkey, {_S} || '::function::go', {_S} || '::var::' || unnest(['self', 'self.run', 'load' || n_nationkey]), 'reads' {_SUP})"""
#: kind, name, first and last line of the nodes of each kind of file.
_OF = {
    "region": [("file", "''", 1, 9), ("function", "'top' || r_regionkey", 1, 4), ("class", "'Base' || r_regionkey", 7, 9), ("function", "'run'", 8, 9), ("variable", "'x'", 1, 1), ("variable", "'deep'", 1, 1), ("variable", "'ValueError'", 3, 3), ("variable", "'self'", 8, 8), ("variable", "'top' || r_regionkey", 9, 9)],
    "nation": [("file", "''", 1, 5), ("function", "'load' || n_nationkey", 4, 5), ("variable", "'x'", 4, 4), ("variable", "'base'", 5, 5)],
    "supplier": [("file", "''", 1, 8), ("class", "'Sup' || s_suppkey", 5, 8), ("function", "'go'", 6, 8), ("variable", "'self'", 6, 6), ("variable", "'self.run'", 7, 7), ("variable", "'load' || n_nationkey", 8, 8)],
}
_PLACES = {"region": ("r_regionkey", _R, _REGION), "nation": ("n_regionkey", _N, _NATION), "supplier": ("n_regionkey", _S, _SUP)}
CODE_NODES = "n as (" + " union all ".join(
    f"select 'r' || {repo} as repo, {path} as relative_path, {path}{'' if kind == 'file' else f" || '::{'var' if kind == 'variable' else kind}::' || {name}"} as id, '{kind}' as type, {f"split_part({path}, '/', 2)" if kind == 'file' else name} as name, {first} as first, {last} as last {where}"
    for table, rows in _OF.items() for repo, path, where in [_PLACES[table]] for kind, name, first, last in rows
) + ")"


def sources(spark, d):
    fmt = lambda s, *cols: F.concat(*[x for part in _parts(s) for x in [F.col(cols[part]).cast("string") if isinstance(part, int) else F.lit(part)]])
    region, nation = t(spark, d, "region"), t(spark, d, "nation")
    one = region.select(F.concat(F.lit("r"), "r_regionkey").alias("repo"), F.format_string("lib/region%s.py", F.col("r_regionkey").cast("string")).alias("path"), fmt(TOP, "r_regionkey").alias("text"))
    two = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.format_string("n/nation%s.py", F.col("n_nationkey").cast("string")).alias("path"), fmt(LOAD, "n_nationkey", "n_regionkey").alias("text"))
    sup = t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    three = sup.select(F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.format_string("s/sup%s.py", F.col("s_suppkey").cast("string")).alias("path"), fmt(SUP, "s_suppkey", "n_nationkey", "n_regionkey").alias("text"))
    return one.union(two).union(three)


def _parts(template: str) -> list:
    return [int(x[1:-1]) if re.fullmatch(r"\{\d\}", x) else x for x in re.split(r"(\{\d\})", template) if x]


def graph_of(spark, d):
    src = materialize(sources(spark, d), "sources")
    nodes, edges = codegraph.build(src, code.parse_tags(src))
    return src, materialize(nodes, "nodes"), materialize(edges, "graph-edges")


@query(f"select 'r' || r_regionkey as repo, {_R} as file, unnest([{{'kind': 'def', 'name': 'top' || r_regionkey, 'first': 1, 'last': 4, 'owner': null}}, {{'kind': 'def', 'name': 'Base' || r_regionkey, 'first': 7, 'last': 9, 'owner': null}}, {{'kind': 'def', 'name': 'run', 'first': 8, 'last': 9, 'owner': 'Base' || r_regionkey}}, {{'kind': 'call', 'name': 'ValueError', 'first': 3, 'last': 3, 'owner': 'top' || r_regionkey}}, {{'kind': 'call', 'name': 'top' || r_regionkey, 'first': 9, 'last': 9, 'owner': 'run'}}], recursive := true) {_REGION} union all select 'r' || n_regionkey, {_N}, unnest([{{'kind': 'def', 'name': 'load' || n_nationkey, 'first': 4, 'last': 5, 'owner': null}}, {{'kind': 'call', 'name': 'base', 'first': 5, 'last': 5, 'owner': 'load' || n_nationkey}}, {{'kind': 'import', 'name': 'base', 'first': 1, 'last': 1, 'owner': null}}], recursive := true) {_NATION} union all select 'r' || n_regionkey, {_S}, unnest([{{'kind': 'def', 'name': 'Sup' || s_suppkey, 'first': 5, 'last': 8, 'owner': null}}, {{'kind': 'inherits', 'name': 'Base' || n_regionkey, 'first': 5, 'last': 8, 'owner': 'Sup' || s_suppkey}}, {{'kind': 'def', 'name': 'go', 'first': 6, 'last': 8, 'owner': 'Sup' || s_suppkey}}, {{'kind': 'call', 'name': 'run', 'first': 7, 'last': 7, 'owner': 'go'}}, {{'kind': 'call', 'name': 'load' || n_nationkey, 'first': 8, 'last': 8, 'owner': 'go'}}, {{'kind': 'import', 'name': 'load' || n_nationkey, 'first': 1, 'last': 1, 'owner': null}}, {{'kind': 'import', 'name': 'Base' || n_regionkey, 'first': 2, 'last': 2, 'owner': null}}], recursive := true) {_SUP}")
def parse_tags(spark, d):
    tags = code.parse_tags(sources(spark, d))
    return tags.where("category != 'var_dependency'").select("repo", "file", "kind", "name", "first", "last", "owner")


@query(f"select 'r' || r_regionkey as repo, {_R} as path, 'Base' || r_regionkey || ':7-9:run' as classes, 'top' || r_regionkey || ':1-4,run:8-9' as functions {_REGION} union all select 'r' || n_regionkey, {_N}, '', 'load' || n_nationkey || ':4-5' {_NATION} union all select 'r' || n_regionkey, {_S}, 'Sup' || s_suppkey || ':5-8:go', 'go:6-8' {_SUP}")
def file_outline(spark, d):
    span = lambda x: F.concat(x["name"], F.lit(":"), x["first"].cast("string"), F.lit("-"), x["last"].cast("string"))
    classes = F.transform("classes", lambda c: F.concat(span(c), F.lit(":"), F.array_join(c["methods"], "+")))
    return code.outline(sources(spark, d)).select("repo", "path", F.array_join(classes, ",").alias("classes"), F.array_join(F.transform("functions", span), ",").alias("functions"))


@query(f"{CODE_EDGES} select * from e")
def code_graph(spark, d):
    return graph_of(spark, d)[2]


@query(f"with {CODE_NODES} select repo, id, type, name, relative_path, first, last from n")
def code_nodes(spark, d):
    return graph_of(spark, d)[1].select("repo", "id", "type", "name", "relative_path", "first", "last")


@query(f"select 'r' || n_regionkey as repo, {_N} as file, 'base' as local, 'lib/region' || n_regionkey || '.py' as target, 'top' || n_regionkey as symbol {_NATION} union all select 'r' || n_regionkey, {_S}, 'load' || n_nationkey, {_N}, 'load' || n_nationkey {_SUP} union all select 'r' || n_regionkey, {_S}, 'Base' || n_regionkey, 'lib/region' || n_regionkey || '.py', 'Base' || n_regionkey {_SUP}")
def import_table(spark, d):
    src = materialize(sources(spark, d), "sources")
    return codegraph.import_table(src.select("repo", "path"), code.parse_tags(src))[0]


@query("select 'r' || n_regionkey as repo, 's/sup' || s_suppkey || '.py::class::Sup' || s_suppkey as caller_class, 'lib/region' || n_regionkey || '.py' as file from supplier join nation on s_nationkey = n_nationkey")
def parent_files(spark, d):
    _, _, edges = graph_of(spark, d)
    return codegraph.ancestors_of(edges.where("label = 'inherits_from'").select("repo", "src", "dst", F.lit(0).alias("ord"))).select("repo", "caller_class", "file")


@query(f"""{CODE_EDGES}, {CODE_NODES} select n.repo, count(*) as function_nodes, (select count(*) from e where label = 'calls' and e.repo = n.repo) as calls_edges, (select count(*) from e where label = 'calls' and e.repo = n.repo and split_part(src, '::', 1) <> split_part(dst, '::', 1)) as cross_file_calls, 0::bigint as phantom_function_nodes from n where type = 'function' group by n.repo""")
def graph_stats(spark, d):
    _, nodes, edges = graph_of(spark, d)
    return codegraph.graph_stats(nodes, edges)


@query(f"""{CODE_EDGES}, {CODE_NODES}, o as (select e.repo, src as id, string_agg(distinct n.name, ',' order by n.name) filter (where label = 'calls') as calls, string_agg(distinct n.name, ',' order by n.name) filter (where label = 'reads') as reads, string_agg(distinct n.name, ',' order by n.name) filter (where label = 'imports') as related, string_agg(distinct n.name, ',' order by n.name) filter (where label = 'inherits_from') as bases from e join n on n.repo = e.repo and n.id = e.dst group by all),
 u as (select e.repo, dst as id, string_agg(distinct n.name, ',' order by n.name) as users from e join n on n.repo = e.repo and n.id = e.src where label = 'reads' group by all)
 select n.repo, n.id, n.type, n.relative_path as filepath, n.first as start_line, n.last as end_line, coalesce(calls, '') as calls, coalesce(reads, '') as reads, coalesce(related, '') as related_files, coalesce(bases, '') as inheritance, coalesce(users, '') as accessed_by from n left join o using (repo, id) left join u using (repo, id)""")
def code_export(spark, d):
    src, nodes, edges = graph_of(spark, d)
    joined = lambda c: F.coalesce(F.array_join(f"info.{c}", ","), F.lit("")).alias(c)
    return codegraph.export(nodes, edges, src).select("repo", "id", "type", "filepath", "start_line", "end_line", *map(joined, ("calls", "reads", "related_files", "inheritance", "accessed_by")))


@query("select 'r' || n_regionkey as repo, 's/sup' || s_suppkey || '.py::function::go' as id, 'def go(self):' as first_line, '        return load' || n_nationkey || '(' || s_suppkey || ')' as last_line from supplier join nation on s_nationkey = n_nationkey")
def entity_source(spark, d):
    src, nodes, _ = graph_of(spark, d)
    rows = codegraph.find(nodes, "function", "go").join(src.withColumnRenamed("path", "relative_path"), ["repo", "relative_path"])
    lines = F.split(text.entity_source(F.col("text"), F.col("first"), F.col("last")), "\n")
    return rows.select("repo", "id", F.trim(lines[0]).alias("first_line"), F.element_at(lines, -1).alias("last_line"))


@query("select 'r' || n_regionkey as repo, 'load' || n_nationkey as name, 's/sup' || s_suppkey || '.py' as file, 'go' as caller from supplier join nation on s_nationkey = n_nationkey")
def loose_callers(spark, d):
    return codegraph.loose_callers(code.parse_tags(sources(spark, d))).where("name like 'load%'")


@query(f"{CODE_EDGES}, {CODE_NODES}, g as (select distinct n.name, e.src from e join n on n.id = e.dst and n.repo = e.repo where label = 'calls' and n.name like 'load%'), w as (select 'load' || n_nationkey as name, 's/sup' || s_suppkey || '.py::function::go' as src {_SUP} where s_suppkey % 3 <> 0) select (select count(*) from g join w using (name, src)) as tp, (select count(*) from g anti join w using (name, src)) as fp, (select count(*) from w anti join g using (name, src)) as fn, round((select count(*) from g join w using (name, src)) / (select count(*) from w), 6) as recall, round((select count(*) from g join w using (name, src)) / (select count(*) from g), 6) as precision")
def caller_scores(spark, d):
    _, nodes, edges = graph_of(spark, d)
    got = edges.where("label = 'calls'").join(nodes.select("repo", F.col("id").alias("dst"), "name"), ["repo", "dst"]).where("name like 'load%'").select("name", "src")
    truth = t(spark, d, "supplier").where("s_suppkey % 3 != 0").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    truth = truth.select(F.concat(F.lit("load"), "n_nationkey").alias("name"), F.concat(F.lit("s/sup"), "s_suppkey", F.lit(".py::function::go")).alias("src"))
    return codegraph.caller_scores(got, truth, ["name", "src"]).select("tp", "fp", "fn", r6("recall").alias("recall"), r6("precision").alias("precision"))


# ---------------------------------------------------------------- retrieval

TYPES = ["class", "function"]


def asked(spark, d, node: str = "s/sup%1$s.py::function::go"):
    sup = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return sup.select(F.concat(F.lit("q"), "s_suppkey").alias("query"), F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.format_string(node, F.col("s_suppkey").cast("string")).alias("node"))


@query("select 'q' || s_suppkey as query, p as pos, 's/sup' || s_suppkey || '.py' || case p when 0 then '::function::go' when 1 then '::class::Sup' || s_suppkey else '' end as id from supplier join nation on s_nationkey = n_nationkey cross join (select unnest([0, 1, 3]) as p)")
def seed_nodes(spark, d):
    node = "s/sup%1$s.py::function::go\n s/sup%1$s.py::class \n\ns/none.py::class::X\ns/sup%1$s.py"
    return context.seeds(graph_of(spark, d)[1], asked(spark, d, node)).select("query", "pos", "id")


@query(f"with b as ({CODE_EDGES} select e.repo, src as a, dst as b, 1 as way from e union all select repo, dst, src, 0 from e), {CODE_NODES}, one as (select 'q' || s_suppkey as query, 's/sup' || s_suppkey || '.py::function::go' as seed, b.b as id, min(way) as way from supplier join b on b.a = 's/sup' || s_suppkey || '.py::function::go' join n on n.id = b.b and n.repo = b.repo where n.type in ('class', 'function') group by all), two as (select distinct query, b.b as id from one join b on b.a = one.id join n on n.id = b.b and n.repo = b.repo where n.type in ('class', 'function')) select query, id, 1 as depth from one union all select query, id, 2 from two where (query, id) not in (select query, id from one union all select query, seed from one)")
def graph_walk(spark, d):
    _, nodes, edges = graph_of(spark, d)
    found = context.seeds(nodes, asked(spark, d))
    return context.walk(nodes, edges, found, 2, TYPES).select("query", "id", "depth")


@query("select 'q' || s_suppkey as query, unnest([{'rank': 1, 'id': 'n/nation' || n_nationkey || '.py::function::load' || n_nationkey}, {'rank': 2, 'id': 'lib/region' || n_regionkey || '.py::function::run'}, {'rank': 3, 'id': 's/sup' || s_suppkey || '.py::class::Sup' || s_suppkey}], recursive := true) from supplier join nation on s_nationkey = n_nationkey")
def graph_context(spark, d):
    """Condition B at depth 1: other files first, callees before the own class."""
    _, nodes, edges = graph_of(spark, d)
    found = context.seeds(nodes, asked(spark, d))
    picked = context.select("B", nodes, edges, asked(spark, d), found, depth=1, types=TYPES, cross_file=True, callers_first=True)
    return picked.select("query", "rank", "id")


@query(f"with {CODE_NODES}, q as (select 'q' || s_suppkey as query, 'r' || n_regionkey as repo, 'sup' || s_suppkey as term, 's/sup' || s_suppkey || '.py::class::Sup' || s_suppkey as seed {_SUP}) select query, n.id, row_number() over (partition by query order by length(n.name), n.id)::int as rank from q join n using (repo) where contains(lower(n.name), term) and n.id <> seed qualify rank <= 12")
def lexical_context(spark, d):
    _, nodes, _ = graph_of(spark, d)
    queries = asked(spark, d, "s/sup%1$s.py::class::Sup%1$s")
    return context.lexical(nodes, queries, context.seeds(nodes, queries), 12).select("query", "id", "rank")


@query(f"with {CODE_NODES}, q as (select 'q' || s_suppkey as query, 'r' || n_regionkey as repo, 's/sup' || s_suppkey || '.py::function::go' as seed {_SUP}), p as (select query, id, type, ('0x' || substr(md5('0|' || query || '|' || id), 1, 8))::bigint as h from q join n using (repo) where type in ('class', 'function') and id <> seed), k as (select *, row_number() over (partition by query, type order by h, id) as k from p) select query, id, row_number() over (partition by query order by h, id)::int as rank from k where k <= case type when 'class' then 1 else 2 end")
def random_context(spark, d):
    """Condition C: as many of each type as condition B finds at depth 1."""
    _, nodes, edges = graph_of(spark, d)
    found = context.seeds(nodes, asked(spark, d))
    return context.select("C", nodes, edges, asked(spark, d), found, depth=1, types=TYPES).select("query", "id", "rank")


@query("select 'q' || s_suppkey as query, unnest([{'rank': 1, 'id': 's/sup' || s_suppkey || '.py'}, {'rank': 2, 'id': 's/sup' || s_suppkey || '.py::class::Sup' || s_suppkey}, {'rank': 3, 'id': 's/sup' || s_suppkey || '.py::var::self.run'}], recursive := true) from supplier join nation on s_nationkey = n_nationkey")
def fault_context(spark, d):
    """Condition F: what spans line 7 of the query's file."""
    _, nodes, _ = graph_of(spark, d)
    queries = asked(spark, d)
    goals = queries.select("query", F.substring_index("node", "::", 1).alias("path"), F.lit(7).alias("line"))
    return context.fault_location(nodes, queries, context.seeds(nodes, queries), goals, 12).select("query", "rank", "id")


@query()
def dense_context(spark, d):
    """Condition G; tested against a search of all nodes."""
    _, nodes, edges = graph_of(spark, d)
    found = context.seeds(nodes, asked(spark, d))
    return context.dense(nodes, asked(spark, d), found, 5).select("query", "id", r6("score").alias("score"), "rank")


@query("select 'q' || s_suppkey as query, 'B' as condition, 3 as offered, true as whole, true as found, 's/sup' || s_suppkey || '.py::go' as shown from supplier join nation on s_nationkey = n_nationkey")
def context_payload(spark, d):
    src, nodes, edges = graph_of(spark, d)
    out = context.retrieve("B", nodes, edges, src, asked(spark, d), budget=3000, depth=1, types=TYPES)
    split = text.split_payload("payload")
    shown = F.regexp_extract(text.render_context("payload"), r"diff: (.*)\n", 1)
    return out.select("query", split["condition"].alias("condition"), "offered", (F.col("kept") == F.col("offered")).alias("whole"), F.contains(split["shown"], F.lit('"found": true')).alias("found"), shown.alias("shown"))


@query(f"with {FIRST}, h as (select l_orderkey as task, l_linenumber as ord, case when l_linenumber % 2 = 0 then 'caller' else 'expand' end as grp, l_suppkey as identity, 'f' || l_partkey % 50 || '.py' as path, case when l_returnflag = 'R' then 'variable' else 'function' end as kind, l_quantity > 5 as has from first), s as (select distinct o_orderkey as task, o_custkey % 100 as identity, 'f' || o_custkey % 50 || '.py' as path from orders), k as (select h.*, (h.task, h.path) in (select task, path from s) as home from h where kind = 'function' and has and (h.task, h.identity) not in (select task, identity from s)), f as (select *, row_number() over (partition by task, identity order by (grp <> 'caller')::int, home::int, ord) as n from k) select task, identity, path, row_number() over (partition by task order by (grp <> 'caller')::int, home::int, ord)::int as rank from f where n = 1 qualify rank <= 3")
def deliver_hits(spark, d):
    li = first_lines(spark, d)
    path = F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py"))
    hits = li.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, "caller").otherwise("expand").alias("grp"), F.col("l_suppkey").alias("identity"), F.concat(path, F.lit("::x")).alias("qualified_name"), path.alias("path"), F.when(F.col("l_returnflag") == "R", "variable").otherwise("function").alias("kind"), F.when(F.col("l_quantity") > 5, "code").alias("text"))
    seed_rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 100).alias("identity"), F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py")).alias("path"))
    return context.deliver(hits, seed_rows, ["function", "class", "method"], 3).select("task", "identity", "path", "rank")


# ---------------------------------------------------------------- comments and replies

COMMENT = "case o_orderkey % 7 when 0 then 'breaks utils/part_' || o_custkey || '.py badly' when 1 then 'see https://x.org/a_b.py and \"load_' || o_custkey || '\"' when 2 then 'it is called by the job in lib/x.go' when 3 then 'fails with AssertionError in `load_rows' || o_custkey || '()` and `lambda`' when 4 then 'rename x' when 5 then '@bot: CustomerName and order_key differ, as in self.order.value' else 'matches the `order_key` of part_' || o_custkey % 7 || '.py' end"
DIFF = "'diff --git a/utils/part_' || o_custkey % 7 || '.py b/utils/part_' || o_custkey % 7 || '.py' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '+order_key = 1'"


def comments(spark, d):
    k, c, m = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string"), (F.col("o_custkey") % 7).cast("string")
    comment = F.when(k == 0, F.concat(F.lit("breaks utils/part_"), c, F.lit(".py badly"))).when(k == 1, F.concat(F.lit('see https://x.org/a_b.py and "load_'), c, F.lit('"'))).when(k == 2, "it is called by the job in lib/x.go")
    comment = comment.when(k == 3, F.concat(F.lit("fails with AssertionError in `load_rows"), c, F.lit("()` and `lambda`"))).when(k == 4, "rename x").when(k == 5, "@bot: CustomerName and order_key differ, as in self.order.value").otherwise(F.concat(F.lit("matches the `order_key` of part_"), m, F.lit(".py")))
    path = F.concat(F.lit("utils/part_"), m, F.lit(".py"))
    diff = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/x\n+++ b/x\n+order_key = 1"))
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", comment.alias("comment"), diff.alias("diff"))


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_KW = ", ".join(_sq(k) for k in keyword.kwlist)
_BARE = "regexp_replace({0}, '^[().,`''\"]+|[().,`''\"]+$', '', 'g')"
NAMES = f"""c as (select o_orderkey, o_custkey, {COMMENT} as comment, {DIFF} as diff from orders), nb as (select *, regexp_replace(comment, 'https?://\\S+', ' ', 'g') as body from c),
 nm as (select *, list_sort(list_distinct(regexp_extract_all(body, {_sq(text.NAME_PATH)}))) as paths, list_sort(list_distinct(list_filter(list_concat(list_transform(list_filter(list_transform(regexp_extract_all(body, {_sq(text.QUOTED)}), lambda q: q[2:-2]), lambda q: regexp_full_match(q, '[A-Za-z_][\\w.]*(\\(\\))?')), lambda q: regexp_replace(q, '[()]+$', '')), list_concat(regexp_extract_all(body, {_sq(text.SNAKE)}), regexp_extract_all(body, {_sq(text.CAMEL)}))), lambda n: length(n) >= 3 and n not in ({_KW})))) as idents from nb)"""


@query(f"with {NAMES} select o_orderkey, array_to_string(paths, ',') as paths, array_to_string(idents, ',') as idents from nm")
def names_in(spark, d):
    names = text.names_in(F.col("comment"))
    return comments(spark, d).select("o_orderkey", F.array_join(names["paths"], ",").alias("paths"), F.array_join(names["idents"], ",").alias("idents"))


_STOP = ", ".join(map(_sq, text.STOPWORDS))


@query(f"""with c as (select o_orderkey, {COMMENT} as comment, lower({DIFF}) as shown, {DIFF} as diff from orders), b as (select *, regexp_replace(comment, '@\\w+:', ' ', 'g') as body from c),
 h as (select *, list_distinct(flatten(list_transform(list_filter(list_transform(flatten(list_transform(list_filter(string_split(diff, chr(10)), lambda l: regexp_matches(l, '^(diff --git|\\+\\+\\+ |--- )')), lambda l: regexp_split_to_array(trim(l), '\\s+'))), lambda w: lower(regexp_replace(w, '^[ab/]+', ''))), lambda w: regexp_matches(w, {_sq(text.SCOPE_PATH)})), lambda n: [n, string_split(n, '/')[-1]]))) as touched from b),
 f as (select *, list_filter(regexp_extract_all(body, {_sq(text.SCOPE_PATH)}), lambda p: not list_contains(touched, lower(p)) and not list_contains(touched, string_split(lower(p), '/')[-1]) and not contains(shown, lower(p))) as files,
  list_filter(list_concat(list_filter(list_transform(regexp_extract_all(body, {_sq(text.BACKTICKED)}, 1), lambda x: trim(x)), lambda x: length(x) between 3 and 59 and not starts_with(x, 'http') and not starts_with(x, '/')), regexp_extract_all(body, {_sq(text.IDENTIFIER)}, 1)), lambda x: {_BARE.format('lower(x)')} <> '' and {_BARE.format('lower(x)')} not in ({_STOP})) as tokens, regexp_extract(body, '(?i)' || {_sq(text.ELSEWHERE)}, 0) as phrase from h),
 g as (select *, list_filter(list_transform(list_filter(tokens, lambda x, i: list_position(list_transform(tokens, lambda y: {_BARE.format('lower(y)')}), {_BARE.format('lower(x)')}) = i), lambda x: {_BARE.format('x')}), lambda x: length(string_split(x, '.')[1]) >= 4 and not contains(shown, lower(string_split(x, '.')[1])) and not contains(shown, lower(x))) as names from f),
 r as (select *, list_concat(list_transform(files, lambda p: 'names a file the diff does not contain: ' || p), list_concat(case when regexp_matches(body, 'https?://\\S+') then ['links to code outside the diff'] else [] end, case when phrase <> '' then ['refers to code elsewhere: ''' || phrase || ''''] else [] end)) as strict from g)
 select o_orderkey, len(strict) + len(names) > 0 as outside, len(strict) > 0 as strict, array_to_string(list_concat(strict, list_transform(names, lambda x: 'names an identifier absent from the diff: ' || x)), '; ') as reasons, array_to_string(list_concat(files, names), ',') as external from r""")
def evidence_scope(spark, d):
    s = text.scope(F.col("comment"), F.col("diff"))
    return comments(spark, d).withColumn("s", s).select("o_orderkey", F.col("s.outside").alias("outside"), F.col("s.strict").alias("strict"), F.array_join("s.reasons", "; ").alias("reasons"), F.array_join("s.external", ",").alias("external"))


@query("with p as (select c_custkey, case c_custkey % 8 when 0 then 'tests/a.py' when 1 then 'src/test_x.py' when 2 then 'src/test_x.js' when 3 then 'src/x_test.py' when 4 then 'src/x_test.js' when 5 then 'conftest.py' when 6 then 'src/myconftest.py' else 'src/app.py' end as path from customer) select c_custkey, c_custkey % 8 in (0, 1, 3, 5) as test, c_custkey % 8 in (0, 1, 2, 3, 5, 6) as test_any, path like '%.py' or path like '%.js' as supported, replace(replace(path, '.py', ''), '/', '.') as module, c_custkey % 8 = 7 as is_app from p")
def path_rules(spark, d):
    names = ["tests/a.py", "src/test_x.py", "src/test_x.js", "src/x_test.py", "src/x_test.js", "conftest.py", "src/myconftest.py", "src/app.py"]
    rows = t(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 8 + 1).cast("int")).alias("path"))
    path = F.col("path")
    return rows.select("c_custkey", text.is_test_path(path).alias("test"), text.is_test_path(path, True).alias("test_any"), text.in_supported_source(path).alias("supported"), text.module_of(path).alias("module"), text.module_matches(F.lit("app"), path).alias("is_app"))


@query("select o_orderkey, 'src/p' || o_custkey || '.py' as path, case when o_orderkey % 5 = 4 then null else o_orderkey % 100 end::int as line, o_custkey % 3 = 0 as same, o_custkey % 3 <> 0 as other, case when o_orderkey % 5 <> 4 then abs(o_orderkey % 100 - o_custkey % 100) end::int as distance, 'repo' || o_custkey % 10 as repo, 'abc' || o_custkey || 'd' as squeezed from orders")
def path_and_line(spark, d):
    c = F.col("o_custkey").cast("string")
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("a/src/p", "./src//p", "src\\p", "b/./src/p"))), (F.col("o_orderkey") % 4 + 1).cast("int")), c, F.lit(".py "))
    k = (F.col("o_orderkey") % 100).cast("string")
    line = text.parse_line(F.element_at(F.array(k, F.concat(F.lit("+"), k), F.concat(F.lit(" "), k, F.lit(" ")), F.concat(k, F.lit(".0")), F.concat(k, F.lit(".5"))), (F.col("o_orderkey") % 5 + 1).cast("int")))
    other = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("src/p"), c, F.lit(".py"))).otherwise(F.lit("x.py"))
    rows = t(spark, d, "orders").select("o_orderkey", text.normalise_path(raw).alias("path"), line.alias("line"), text.paths_match(raw, other).alias("same"), (F.col("o_custkey") % 100).cast("int").alias("at"), F.concat(F.lit("x::repo"), (F.col("o_custkey") % 10).cast("string"), F.lit("::y")).alias("task"), F.concat(F.lit("A-b C_"), c, F.lit(" D")).alias("name"))
    return rows.select("o_orderkey", "path", "line", "same", (~F.col("same")).alias("other"), text.line_distance(F.col("line"), F.col("at")).alias("distance"), text.repo_of(F.col("task")).alias("repo"), text.squeeze_name(F.col("name")).alias("squeezed"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then null when o_custkey % 7 = 6 then null else case o_custkey % 7 when 0 then o_orderkey % 2 = 1 when 1 then o_orderkey % 2 = 1 when 2 then o_orderkey % 2 = 1 when 3 then o_orderkey % 2 = 1 when 4 then o_orderkey % 2 = 1 else false end end as correct from orders")
def mechanism_rubric(spark, d):
    kinds = ["exception_type", "none_sentinel", "default_flip", "tuple_order", "empty_to_none", "default_flip", "other"]
    right = ["a caller catches KeyError", "the caller checks for None", "callers omit KeyError", "the tuple is unpacked", "len( of None fails", "nothing", "the caller"]
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("o_custkey") % 7 + 1).cast("int"))
    said = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("Hm."), pick(right))).otherwise(F.array(F.lit("prefer f-strings")))
    rows = t(spark, d, "orders").select("o_orderkey", pick(kinds).alias("kind"), said.alias("said"))
    return rows.select("o_orderkey", text.mechanism_correct(F.col("kind"), F.lit("KeyError"), F.col("said")).alias("correct"))


RATED = FIRST + """, e as (select l_orderkey as task, l_linenumber as k, case when l_linenumber = 7 then null else l_linenumber * 10 end as line, l_suppkey as raw, case l_suppkey % 4 when 0 then l_suppkey % 101 when 1 then l_suppkey % 101 when 2 then case when l_suppkey % 200 <= 100 then l_suppkey % 200 end else null end as value from first)"""


@query(f"""with {RATED}, ok as (select task, line, count(distinct value) as n, min(value) as v from e where line is not null and line <= 40 and value is not null group by all), a as (select task, count(*) filter (where line > 40) as unmatched, count(*) filter (where line is null or (line <= 40 and value is null)) as invalid from e group by task)
 select a.task, (select v from ok where ok.task = a.task and line = 20 and n = 1)::int as hunk_score, coalesce((select string_agg(line || ':' || v, ',' order by line) from ok where ok.task = a.task and n = 1), '') as ratings, unmatched::int as unmatched, invalid::int as invalid, coalesce((select count(*) from ok where ok.task = a.task and n = 1), 0)::int as rated, 4 as total, not exists (select 1 from ok where ok.task = a.task and line = 20 and n = 1) as missing from a""")
def hunk_ratings(spark, d):
    """Each order as a reply that rates its lines' hunks, some of them badly."""
    s = F.col("l_suppkey")
    value = F.when(s % 4 == 0, F.to_json(F.struct((s % 101).alias("v")))).when(s % 4 == 1, F.to_json(F.struct(F.concat((s % 101).cast("string"), F.lit(" %")).alias("v")))).when(s % 4 == 2, F.to_json(F.struct((s % 200).cast("double").alias("v")))).otherwise(F.lit('{"v":true}'))
    entry = F.concat(F.lit('{"line": '), F.when(F.col("l_linenumber") == 7, F.lit('"x"')).otherwise(F.concat(F.lit('"+'), (F.col("l_linenumber") * 10).cast("string"), F.lit('"'))), F.lit(', "defect_probability": '), F.regexp_extract(value, r'^\{"v":(.*)\}$', 1), F.lit("}"))
    rows = first_lines(spark, d).withColumn("entry", entry).groupBy(F.col("l_orderkey").alias("task")).agg(F.array_join(F.array_sort(F.collect_list("entry")), ", ").alias("entries"))
    reply = F.concat(F.lit('Here: {"findings": [], "hunk_ratings": ['), F.col("entries"), F.lit("]} done"))
    out = rows.select("task", text.parse_hunk_ratings(reply, F.array(*[F.lit(x) for x in (10, 20, 30, 40)]), F.lit(20)).alias("r"))
    listed = F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("r.hunk_ratings"), lambda x: F.struct(x["key"].cast("int").alias("k"), x["value"].alias("v")))), lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["v"].cast("string"))), ",")
    return out.select("task", F.col("r.hunk_score").alias("hunk_score"), listed.alias("ratings"), F.size("r.unmatched_rating_lines").alias("unmatched"), F.col("r.invalid_rating_entries").alias("invalid"), F.col("r.hunks_rated").alias("rated"), F.col("r.hunks_total").alias("total"), F.col("r.rating_missing").alias("missing"))


@query(f"with {FIRST}, i as (select l_orderkey as task, l_returnflag = 'R' as hit, case when l_linenumber % 5 <> 0 then (l_partkey % 101)::int end as confidence from first) select task, case when count(*) filter (where hit and confidence is null) > 0 then null else coalesce(max(confidence) filter (where hit), 0) end::int as score, count(*) filter (where hit and confidence is null) > 0 as missing from i group by task")
def item_scores(spark, d):
    scores = F.collect_list(F.struct((F.col("l_returnflag") == "R").alias("hit"), F.when(F.col("l_linenumber") % 5 != 0, (F.col("l_partkey") % 101).cast("int")).alias("confidence")))
    rows = first_lines(spark, d).groupBy(F.col("l_orderkey").alias("task")).agg(text.item_score(scores).alias("s"))
    return rows.select("task", "s.score", "s.missing")


def _hunks(spark, d):
    """Every order as a diff of two files with a hunk for each of its lines."""
    li = first_lines(spark, d).select("l_orderkey", F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 500 + 1).cast("int").alias("at"), (F.col("l_quantity") % 9).cast("int").alias("n"))
    body = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.lit("\n+x"), i.cast("string"))), "")).otherwise("\n-y")
    hunk = F.concat(F.lit("@@ -1 +"), F.col("at").cast("string"), F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit(","), F.col("n").cast("string"))), F.lit(" @@ f()"), body, F.lit("\n"))
    file = F.when(F.col("k") % 2 == 0, "src/even.py").otherwise("doc/odd.md")
    head = F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\n--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n"))
    files = li.withColumn("head", head).groupBy("l_orderkey", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", hunk.alias("h")))), lambda x: x["h"]), "").alias("hunks"))
    return files.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat("head", "hunks"))), "").alias("diff"))


HUNKS = f"{FIRST}, h as (select l_orderkey, l_linenumber as k, l_linenumber % 2 = 0 as even, (l_partkey % 500 + 1)::int as top, (l_quantity % 9)::int as n from first)"


@query(f"with {HUNKS}, x as (select l_orderkey, case when even then 'src/even.py' else 'doc/odd.md' end as path, unnest(range(top, greatest(top, top + n - 1) + 1)) as line from h) select l_orderkey, count(*) as lines, sum(line)::bigint as total, count(distinct path) as files, bool_or(path = 'src/even.py') as source from x group by l_orderkey")
def hunk_lines(spark, d):
    # What is asked of a diff is computed before its lines are rows.
    rows = _hunks(spark, d).select("l_orderkey", text.hunk_lines(F.col("diff")).alias("lines"), (F.size(text.paths_in_diff(F.col("diff"))) > 0).alias("source"))
    rows = rows.select("l_orderkey", F.explode("lines").alias("x"), "source")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("x.line").alias("total"), F.countDistinct("x.path").alias("files"), F.bool_or("source").alias("source"))


@query(f"with {HUNKS} select l_orderkey, top as first, greatest(top, top + n - 1) as last, n + (n = 0)::int + 2 as text_lines from h where even")
def hunks_of_file(spark, d):
    rows = _hunks(spark, d).select("l_orderkey", F.explode(text.hunks_of(F.col("diff"), F.lit("a/src/even.py"))).alias("x"))
    return rows.select("l_orderkey", "x.first", "x.last", F.size(F.split("x.text", "\n")).alias("text_lines"))


# ---------------------------------------------------------------- benchmarks

DEFECTS = f"{FIRST}, f as (select 'i' || l_orderkey as task_id, 'i' || l_orderkey || '#' || (row_number() over (partition by l_orderkey order by l_linenumber) - 1) as defect_id, case when l_linenumber % 4 = 0 then '' else 'src/p' || l_partkey || case when l_partkey % 5 = 0 then '.md' else '.py' end end as path, case when l_linenumber % 3 = 0 then case when l_suppkey % 2 = 0 then l_suppkey end else l_quantity end::int as line, case when l_returnflag = 'R' then case when l_linestatus = 'F' then 'functional' else 'style' end else '' end as comment_type, l_returnflag = 'R' and l_discount > 0.05 as test_verified, l_orderkey from first)"


def instances(spark, d):
    li = first_lines(spark, d)
    path = F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 5 == 0, ".md").otherwise(".py")))
    note = F.concat(F.lit("  line  "), F.col("l_linenumber").cast("string"), F.lit("\n of "), F.col("l_orderkey").cast("string"), F.lit(" "))
    comment = F.struct(F.col("l_linenumber").alias("k"), path.alias("path"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).cast("int").alias("line"), F.when((F.col("l_linenumber") % 3 != 0) | (F.col("l_suppkey") % 2 == 0), F.col("l_suppkey")).cast("int").alias("original_line"), note.alias("text"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(comment)).alias("comments"))
    rows = rows.select(F.concat(F.lit("i"), "l_orderkey").alias("instance_id"), F.concat(F.lit("r"), F.col("l_orderkey") % 40).alias("repo"), F.when(F.col("l_orderkey") % 10 == 0, "Ruby").otherwise(" Python").alias("language"), F.lit("b").alias("base_commit"), F.lit("h").alias("head_commit"), F.lit("+x").alias("diff"), "comments")
    said = li.where("l_returnflag = 'R'").select(F.concat(F.lit("i"), "l_orderkey").alias("instance_id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_orderkey").cast("string")).alias("comment"), F.when(F.col("l_linestatus") == "F", "functional").otherwise("style").alias("comment_type"), (F.col("l_discount") > 0.05).alias("test_verified"))
    return rows, said


@query(f"with {DEFECTS} select task_id, defect_id, path, line, comment_type, test_verified from f where l_orderkey % 10 <> 0 and path <> '' and line is not null")
def comment_defects(spark, d):
    rows, verdicts = instances(spark, d)
    return bench.comment_defects(rows, verdicts).select("task_id", "defect_id", "path", "line", "comment_type", "test_verified")


@query(f"with {DEFECTS} select task_id, defect_id, path, line from f where l_orderkey % 10 <> 0 and path like '%.py' and line is not null and comment_type = 'functional' and test_verified")
def confirmed_defects(spark, d):
    rows, verdicts = instances(spark, d)
    return bench.comment_defects(rows, verdicts, confirmed=True, supported=True).select("task_id", "defect_id", "path", "line")


@query(f"with {DEFECTS} select count(distinct task_id) as tasks, count(*) as defects, count(*) filter (where comment_type = 'functional' and test_verified) as confirmed, count(*) filter (where path like '%.py') as in_supported_source, count(distinct l_orderkey % 40) as repos, round(count(*) / count(distinct task_id), 2) as defects_per_task from f where l_orderkey % 10 <> 0 and path <> '' and line is not null")
def benchmark_summary(spark, d):
    return bench.summarise(bench.comment_defects(*instances(spark, d)))


@query("with d as (select o_orderkey as task_id, length(o_orderpriority) + o_custkey % 300 as size from orders) select task_id from d where size <= 250 order by task_id limit 400")
def first_tasks(spark, d):
    diff = F.concat("o_orderpriority", F.repeat(F.lit("x"), (F.col("o_custkey") % 300).cast("int")))
    return bench.first_tasks(t(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), diff.alias("diff")), 400, 250).select("task_id")


@query("select o_orderkey as task_id, o_custkey % 3 <> 0 as is_defect, case when o_orderkey % 2 = 0 then 2 else 1 end as hops, array_to_string(list_sort(list_distinct(list_filter([1 + o_custkey % 50, 3 + o_custkey % 40, 60], lambda x: x <> 60))), ',') as distractors from orders where o_custkey % 5 <> 0 and o_orderkey % 7 <> 0")
def generated_tasks(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    one = lambda line: F.concat(F.lit("@@ -"), line.cast("string"), F.lit(",1 +"), line.cast("string"), F.lit(",1 @@\n-a\n+b\n"))
    diff = F.when(k % 7 == 0, F.lit("--- a/x\n-only\n")).otherwise(F.concat(F.lit("--- a/x\n+++ b/x\n"), one(1 + c % 50), one(3 + c % 40), one(F.lit(60))))
    rows = t(spark, d, "orders").select(k.alias("task_id"), F.when(c % 5 == 0, "tests/a.py").otherwise("src/a.py").alias("caller_path"), F.lit("src/b.py").alias("defect_path"), F.lit(60).alias("defect_line"), diff.alias("diff"), F.when(c % 3 == 0, False).when(c % 3 == 1, True).alias("is_defect"), F.when(k % 2 == 0, "src/v.py").alias("via_path"))
    return bench.generated_tasks(rows).select("task_id", "is_defect", "hops", F.array_join(F.transform("distractor_lines", lambda x: x.cast("string")), ",").alias("distractors"))


REVIEWS = f"{FIRST}, t as (select o_orderkey as task_id, 'src/f' || o_custkey % 3 || '.py' as dpath, (o_custkey % 20)::int as dline, case when o_custkey % 2 = 0 then 'a' else 'b' end as kind from orders), g as (select l_orderkey as task_id, case when l_linenumber <= 3 then 'A' else 'B' end as condition, 'f' || l_partkey % 3 || '.py' as base, case when l_linenumber % 3 = 0 then null else l_quantity % 20 end as line from first), s as (select g.task_id, condition, kind, bool_or(coalesce(dpath like '%' || base and line = dline, false)) as hit, count(*) filter (where dpath like '%' || base and line <> dline and line in (3, 7, 11)) as flagged, count(*) as findings from g join t using (task_id) group by all)"


def review_rows(spark, d):
    tasks = t(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("a/src/f"), (F.col("o_custkey") % 3).cast("string"), F.lit(".py")).alias("defect_path"), (F.col("o_custkey") % 20).cast("int").alias("defect_line"), F.array(*[F.lit(x) for x in (3, 7, 11)]).alias("distractor_lines"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("kind"))
    found = first_lines(spark, d).select(F.col("l_orderkey").alias("task_id"), F.when(F.col("l_linenumber") <= 3, "A").otherwise("B").alias("condition"), F.concat(F.lit("./src/f"), (F.col("l_partkey") % 3).cast("string"), F.lit(".py")).alias("path"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") % 20).cast("int").alias("line"), F.col("l_linenumber").alias("pos"))
    return bench.review_scores(tasks, found)


@query(f"with {REVIEWS} select *, hit and flagged = 0 as precise from s")
def review_scores(spark, d):
    return review_rows(spark, d)


@query(f"with {REVIEWS} select condition, count(*) as tasks, round(avg(hit::int), 6) as recall, round(avg((hit and flagged = 0)::int), 6) as precise_rate, sum(flagged)::bigint as confirmed_false_positives, sum(findings)::bigint as findings_reported, round(case when sum(hit::int) + sum(flagged) > 0 then sum(hit::int) / (sum(hit::int) + sum(flagged)) else 0 end, 6) as confirmed_precision from s group by condition")
def review_summary(spark, d):
    out = bench.score_summary(review_rows(spark, d), ["condition"])
    return out.select("condition", "tasks", r6("recall").alias("recall"), r6("precise_rate").alias("precise_rate"), "confirmed_false_positives", "findings_reported", r6("confirmed_precision").alias("confirmed_precision"))


@query(f"with {REVIEWS}, w as (select task_id from s group by 1 having count(*) = 2) select task_id % 3 = 0 as reached, condition, count(*) as tasks, round(avg((hit and flagged = 0)::int), 6) as precise_rate from s where task_id in (from w) group by all")
def reach_split(spark, d):
    near = t(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("task_id"))
    out = bench.score_summary(bench.split_by_reach(review_rows(spark, d), near, ["A", "B"]), ["reached", "condition"])
    return out.select("reached", "condition", "tasks", r6("precise_rate").alias("precise_rate"))


@query(f"with {FIRST}, r as (select l_orderkey as task_id, l_linenumber as arm, case when l_linenumber % 4 <> 0 then l_returnflag = 'R' end as mechanism, 'the caller in f' || l_partkey % 5 || ' breaks' as message from first) select task_id, arm, case when mechanism is not null then mechanism and (contains(message, 'f' || o_custkey % 5 || ' ')) end as mechanism_strict from r join orders on o_orderkey = task_id")
def strict_mechanism(spark, d):
    rows = first_lines(spark, d).select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("arm"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_returnflag") == "R").alias("mechanism"), F.concat(F.lit("The caller in F"), (F.col("l_partkey") % 5).cast("string"), F.lit(" breaks")).alias("message"))
    stem = F.concat(F.lit("src/f"), (F.col("o_custkey") % 5).cast("string"), F.lit(".py"))
    name = F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string"))
    tokens = t(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.array_union(bench.caller_tokens(stem, F.lit("zz"), F.lit("own")), F.array(name)).alias("tokens"))
    return bench.strict_mechanism(rows, tokens).select("task_id", "arm", "mechanism_strict")


@query(f"""with {NAMES}, x as (select *, list_distinct(list_concat(paths, idents)) as names, case when o_custkey % 2 = 0 then 'B' else 'D' end as condition, 'code of load_' || o_custkey || ' and order_key in utils/part_' || o_custkey || '.py' as context from nm), y as (select *, list_filter(names, lambda n: not contains(diff, n)) as outside from x)
 select condition, count(*) as defects, count(*) filter (where len(names) > 0) as named, count(*) filter (where len(list_filter(names, lambda n: contains(context, n))) > 0) as found, count(*) filter (where len(outside) > 0) as outside_named, count(*) filter (where len(list_filter(outside, lambda n: contains(context, n))) > 0) as outside_found, count(distinct o_orderkey) filter (where len(names) > 0) as tasks_named, count(distinct o_orderkey) filter (where len(list_filter(names, lambda n: contains(context, n))) > 0) as tasks_found from y group by condition""")
def evidence_recall(spark, d):
    rows = comments(spark, d)
    defects = rows.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderkey").alias("defect_id"), F.col("comment").alias("text"), "diff")
    c = F.col("o_custkey").cast("string")
    contexts = rows.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_custkey") % 2 == 0, "B").otherwise("D").alias("condition"), F.concat(F.lit("code of load_"), c, F.lit(" and order_key in utils/part_"), c, F.lit(".py")).alias("context"))
    return bench.evidence_recall(defects, contexts)


ACCURACY = f"{FIRST}, g as (select l_orderkey as task_id, case when l_linenumber % 2 = 0 then 'A' else 'B' end as condition, l_orderkey || '-' || l_linenumber as finding_id, case when l_linenumber % 5 <> 0 then (l_quantity)::int end as line, case when l_linenumber % 3 = 0 then null else 'tok' || l_suppkey % 10 end as tok, l_partkey % 2 as file from first), n as (select l_orderkey as task_id, l_partkey % 2 as file, (l_linenumber * 3)::int as new_line, 'x = tok' || l_suppkey % 10 || '0' as content from first), d as (select g.*, (select min(abs(line - new_line)) from n where n.task_id = g.task_id and n.file = g.file and contains(content, tok)) as distance from g)"


def quoted_findings(spark, d):
    li = first_lines(spark, d)
    file = F.concat(F.lit("src/f"), (F.col("l_partkey") % 2).cast("string"), F.lit(".py"))
    tok = F.concat(F.lit("tok"), (F.col("l_suppkey") % 10).cast("string"))
    found = li.select(F.col("l_orderkey").alias("task_id"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("condition"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("finding_id"), F.concat(F.lit("b/"), file).alias("path"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).cast("int").alias("line"), F.when(F.col("l_linenumber") % 3 == 0, "no quote").otherwise(F.concat(F.lit("the `"), tok, F.lit("` is wrong"))).alias("message"))
    lines = li.select(F.col("l_orderkey").alias("task_id"), file.alias("path"), (F.col("l_linenumber") * 3).cast("int").alias("new_line"), F.concat(F.lit("x = "), tok, F.lit("0")).alias("content"))
    return bench.line_distances(found, lines)


@query(f"with {ACCURACY}, q as (select unnest([condition, 'all']) as condition, tok is not null and line is not null as quoting, case when tok is not null and line is not null then distance end as distance from d) select condition, count(*) as findings, count(*) filter (where quoting) as quoting, count(distance) as located, round(avg((distance = 0)::int), 6) as exact, round(avg((distance <= 5)::int), 6) as within_5, round(avg((distance > 5)::int), 6) as beyond_5, list_sort(list(distance) filter (where distance is not null))[count(distance) // 2 + 1] as median from q group by condition")
def line_accuracy(spark, d):
    out = bench.line_accuracy(quoted_findings(spark, d))
    return out.select("condition", "findings", "quoting", "located", *[r6(c).alias(c) for c in ("exact", "within_5", "beyond_5")], "median")


@query(RUNS + """, q as (select arm, is_defect, case when score % 5 <> 0 then score end as hs, score % 11 = 0 as jf, score % 5 = 0 as rm, score % 13 = 0 as amb, score % 17 = 0 as um, score % 7 as hr from runs), h as (select arm, hs, count(*) filter (where is_defect) as hd, count(*) filter (where not is_defect) as ht from q where hs is not null group by all)
 select arm, count(*) filter (where is_defect) as attempted_defects, count(*) filter (where not is_defect) as attempted_twins, count(hs) filter (where is_defect) as scored_defects, count(hs) filter (where not is_defect) as scored_twins, count(*) filter (where jf and is_defect) as no_json_defects, count(*) filter (where jf and not is_defect) as no_json_twins, count(*) filter (where rm and is_defect) as missing_defects, count(*) filter (where rm and not is_defect) as missing_twins, count(*) filter (where amb) as ambiguous, count(*) filter (where um) as unmatched, round(avg((hr = 6)::int) filter (where not jf), 6) as all_rated, count(distinct hs) as distinct_values, (select round(sum(hd * ht) / (sum(hd) * sum(ht)), 6) from h where h.arm = q.arm) as tie_share from q group by arm""")
def quality_table(spark, d):
    s = F.col("score")
    one = F.array(F.lit(1))
    rows = runs(spark, d).select("arm", "is_defect", F.when(s % 5 != 0, s).alias("hunk_score"), (s % 11 == 0).alias("json_failed"), (s % 5 == 0).alias("rating_missing"), F.when(s % 13 == 0, one).alias("ratings_ambiguous"), F.when(s % 17 == 0, one).alias("unmatched_rating_lines"), F.lit(0).alias("invalid_rating_entries"), (s % 7).alias("hunks_rated"), F.lit(6).alias("hunks_total"))
    out = bench.quality_table(rows)
    return out.select(*[r6(c).alias(c) if c in ("all_rated", "tie_share") else c for c in out.columns])


@query(RUNS + " select task, arm, case when score % 3 = 0 then score % 2 = 0 when hit and score % 3 = 1 then false end as mechanism_judge from runs")
def judged(spark, d):
    rows = runs(spark, d).select("task", "arm", "hit", F.when(F.col("score") % 3 != 1, "it breaks").alias("message"))
    verdicts = runs(spark, d).where("score % 3 = 0").select("task", "arm", F.when(F.col("score") % 2 == 0, " yes, it does").otherwise("NO").alias("answer"))
    return bench.judged(rows, verdicts, ["task", "arm"]).select("task", "arm", "mechanism_judge")


@query("select n_nationkey % 8 as cell, case when count(distinct n_regionkey) < 3 then 'incomplete' when bool_and(n_regionkey - 2 > 0) then 'better on every model' when bool_and(n_regionkey - 1 < 0) then 'worse on every model' else 'no detectable gain' end as outcome from nation group by 1")
def decision_rule(spark, d):
    cells = t(spark, d, "nation").select((F.col("n_nationkey") % 8).alias("cell"), F.col("n_regionkey").alias("model"), (F.col("n_regionkey") - 2).alias("low"), (F.col("n_regionkey") - 1).alias("high"))
    return bench.decision(cells, ["cell"], 3)


@query(RUNS + ", c as (select arm, task, bool_or(hit) as hit from runs where arm in (1, 2, 3) group by all), w as (select task from c group by 1 having count(*) = 3) select arm, count(*) as n, round(avg(hit::int), 6) as rate from c where task in (from w) group by arm")
def common_keys(spark, d):
    return paired.common_keys(runs(spark, d), "arm", ["task"], [1, 2, 3]).select("arm", "n", r6("rate").alias("rate"))


_RATE = {c: f"least(greatest(h{c} / n{c}::double, 1 / (2.0::double * n{c})), 1 - 1 / (2.0::double * n{c}))" for c in "dt"}
_AT = "list_sort(list({0}) filter (where draw >= 0 and {0} is not null))[{1}]"
_LOW, _HIGH = "greatest(floor({q} * count({c}) filter (where draw >= 0) + 1e-9)::int, 0) + 1", "greatest(floor((1 - {q}) * count({c}) filter (where draw >= 0) + 1e-9)::int, 1)"


def detection_sql(level: float) -> str:
    q = (1 - level) / 2
    ends = ", ".join(f"round({_AT.format(c, e.format(q=q, c=c))}, 6) as {c}_{side}" for c in ("d", "c", "dd", "dc") for side, e in (("low", _LOW), ("high", _HIGH)))
    point = ", ".join(f"round(max({c}) filter (where draw = -1), 6) as {c}" for c in ("h", "f", "d", "c", "dd", "dc"))
    return RUNS + f""", per0 as (select cluster, arm, count(*) filter (where is_defect) as nd, count(*) filter (where not is_defect) as nt, count(*) filter (where is_defect and hit) as hd, count(*) filter (where not is_defect and hit) as ht from runs group by all),
 whole as (select cluster from per0 group by 1 having count(*) = (select count(distinct arm) from runs)), {_boot("count(*) as n0 from per0 where cluster in (from whole)")},
 s as (select draw, arm, sum(nd) as nd, sum(nt) as nt, sum(hd) as hd, sum(ht) as ht from picks join num using (slot) join per0 using (cluster) group by all union all select -1, arm, sum(nd), sum(nt), sum(hd), sum(ht) from per0 where cluster in (from whole) group by arm),
 r as (select draw, arm, nd::bigint as nd, nt::bigint as nt, {_RATE['d']} as h, {_RATE['t']} as f from s where nd > 0 and nt > 0), z0 as (select *, {probit_sql('h')} as zh, {probit_sql('f')} as zf from r), z1 as (select *, zh - zf as d, -(zh + zf) / 2 as c from z0),
 z as (select z1.*, z1.d - b.d as dd, z1.c - b.c as dc from z1 left join (select draw, d, c from z1 where arm = 1) b using (draw)) select arm, max(nd) filter (where draw = -1) as nd, max(nt) filter (where draw = -1) as nt, {point}, {ends} from z group by arm"""


def detection(spark, d, level):
    out = roc.detection_intervals(spark, runs(spark, d), "cluster", "arm", 1, F.col("hit"), F.col("is_defect"), TRIALS, 0, level)
    return out.select("arm", "nd", "nt", *[r6(c).alias(c) for c in out.columns if c not in ("arm", "nd", "nt")])


@query(detection_sql(0.95))
def detection_intervals(spark, d):
    return detection(spark, d, 0.95)


@query(detection_sql(1 - 0.05 / 8))
def detection_bonferroni(spark, d):
    return detection(spark, d, 1 - 0.05 / 8)


# ---------------------------------------------------------------- logs, audits, generation


@query("with c as (select 'r' || user_id % 5 as run, case when event_type = 'view' then 'structure' else 'failed' end as record, value as cost, user_id as out from events) select run, record, count(*) as calls, round(sum(coalesce(cost, 0)), 4) as cost, sum(out)::bigint as output_tokens from c group by all")
def call_log(spark, d):
    e = t(spark, d, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("run"), "event_type", F.col("value").alias("cost"), "user_id")
    log = audit.calls({"structure": e.where("event_type = 'view'").withColumn("output_tokens", F.col("user_id")), "failed": e.where("event_type != 'view'").withColumn("usage_tokens", F.col("user_id"))})
    tokens = audit.output_tokens(F.col("output_tokens"), F.col("usage_tokens"))
    return log.groupBy("run", "record").agg(F.count("*").alias("calls"), F.round(F.sum(rollup.cost_of(F.lit(None).cast("double"), F.col("cost"))), 4).alias("cost"), F.sum(tokens).alias("output_tokens"))


@query("with s as (select avg(coalesce(value, 0)) as per from events where event_id % 100 = 0), u as (select sum(value) as spent from events where event_id % 1000 = 0) select round(per, 6) as per_call, round(per * 564 * 1.5 + spent, 4) as projected, case when per * 564 * 1.5 + spent > 4 then 'OVER' else 'WITHIN' end as status, (select round(4.0 - sum(coalesce(value, 0)), 4) from events) as remaining from s, u")
def cost_projection(spark, d):
    e = t(spark, d, "events")
    out = audit.project(e.where("event_id % 100 = 0"), F.col("value"), 564, 4.0, 1.5, e.where("event_id % 1000 = 0"))
    left = audit.remaining(e, F.lit(None).cast("double"), F.col("value"), 4.0)
    return out.join(left).select(r6("per_call").alias("per_call"), F.round("projected", 4).alias("projected"), "status", F.round("remaining", 4).alias("remaining"))


@query("select event_type, sum(user_id)::bigint as input_tokens, sum(user_id % 7)::bigint as output_tokens, round(sum(coalesce(value, 0)), 4) as cost_usd, count(*) as calls from events group by event_type")
def usage_totals(spark, d):
    rows = t(spark, d, "events").select("event_type", F.col("user_id").alias("input_tokens"), (F.col("user_id") % 7).alias("output_tokens"), F.col("value").alias("cost_usd"))
    out = audit.usage_sum(rows, ["event_type"])
    return out.withColumn("cost_usd", F.round("cost_usd", 4))


@query("select o_orderpriority, floor(avg(case o_orderkey % 4 when 0 then o_custkey % 10 when 1 then o_custkey % 10 when 2 then -(o_custkey % 10) else 0 end) + 0.5)::int as rating from orders group by 1")
def average_rating(spark, d):
    n = (F.col("o_custkey") % 10).cast("string")
    value = F.when(F.col("o_orderkey") % 4 == 0, F.concat(n, F.lit("/10"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" +"), n)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("-"), n, F.lit(".7"))).otherwise("n/a")
    return audit.average_rating(t(spark, d, "orders").select("o_orderpriority", value.alias("v")), ["o_orderpriority"], "v")


@query("with r as (select o_orderkey as k, case when o_orderkey % 6 = 0 then 'timeout; after ' || o_custkey when o_orderkey % 6 = 1 then 'no index' else '' end as error, o_orderkey % 6 > 0 as indexed, o_custkey % 3 as pe, o_custkey % 4 as seeds, o_custkey % 9 as hits, case when o_custkey % 5 = 0 then 0 else o_custkey % 700 end as tok, o_custkey % 5 as kept from orders) select count(*) as tasks, count(*) filter (where indexed) as indexed, count(*) filter (where error <> '') as failed, count(*) filter (where indexed and pe > 0) as with_parse_errors, count(*) filter (where seeds > 0) as with_seeds, count(*) filter (where hits > 0) as with_hits, sum(hits)::bigint as hits, quantile_cont(hits::double, 0.5) as hits_median, count(*) filter (where kept > 0) as delivered, quantile_cont(hits::double, 0.5) as offered_median, quantile_cont(tok::double, 0.5) as tokens_median, quantile_cont(tok::double, 0.5) filter (where tok > 0) as tokens_median_of_some from r")
def coverage_report(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = t(spark, d, "orders")
    records = o.select(F.when(k % 6 == 0, F.concat(F.lit("timeout; after "), c.cast("string"))).when(k % 6 == 1, "no index").otherwise("").alias("error"), (k % 6 > 0).alias("indexed"), (c % 3).alias("parse_errors"), (c % 4).alias("seeds"), (c % 9).alias("hits"))
    given = o.select(F.when(c % 5 == 0, 0).otherwise(c % 700).alias("tokens"), (c % 5).alias("kept"), (c % 9).alias("offered"))
    return audit.coverage(records, given)


@query("select case when o_orderkey % 6 = 0 then 'timeout' else 'no index' end as reason, count(*) as n from orders where o_orderkey % 6 < 2 group by 1")
def failure_reasons(spark, d):
    k = F.col("o_orderkey")
    error = F.when(k % 6 == 0, F.concat(F.lit("timeout; after "), F.col("o_custkey").cast("string"))).when(k % 6 == 1, "no index")
    return audit.failure_reasons(t(spark, d, "orders").select(error.alias("error")))


@query("with p as (select distinct l_orderkey as task, l_partkey as k from lineitem where l_linenumber <= 5), r as (select distinct l_orderkey as task, l_partkey as k from lineitem), s as (select distinct l_orderkey as task, l_partkey as k from lineitem where l_returnflag = 'R') select task, count(*) as pool, count(*) filter (where k % 2 = 0) as pool_src, (select count(*) from r where r.task = p.task) as repo, (select count(*) from r where r.task = p.task and k % 2 = 0) as repo_src, round(case when (select count(*) from r where r.task = p.task and k % 2 = 0) > 0 then count(*) filter (where k % 2 = 0) / (select count(*) from r where r.task = p.task and k % 2 = 0) end, 6) as share, count(*) >= 4 as at_cap, (select count(*) from s where s.task = p.task) as shown, (select count(*) from s where s.task = p.task and (s.task, s.k) not in (from p)) = 0 as holds_shown from p group by task")
def file_pools(spark, d):
    path = F.concat(F.lit("d/p"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".py").otherwise(".md"))
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), path.alias("path"), "l_linenumber", "l_returnflag")
    out = audit.file_pools(li.where("l_linenumber <= 5"), li, li.where("l_returnflag = 'R'"), 4)
    return out.withColumn("share", F.round("share", 6))


@query("select s_suppkey as task, true as import_resolves, (case when s_suppkey % 3 = 0 then 1 else 0 end)::int as distractors_changing_tree, s_suppkey % 2 = 0 as defect_last from supplier join nation on s_nationkey = n_nationkey")
def task_audit(spark, d):
    """The nation's file as the definition, the supplier's as its caller; line 5 is the defect, lines 1 or 8 others."""
    src = materialize(sources(spark, d), "sources")
    sup = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, n = F.col("s_suppkey"), F.col("n_nationkey").cast("string")
    rows = sup.select(F.concat(F.lit("r"), "n_regionkey").alias("repo"), k.cast("string").alias("task_id"), F.concat(F.lit("n/nation"), n, F.lit(".py")).alias("defect_path"), F.concat(F.lit("s/sup"), k.cast("string"), F.lit(".py")).alias("caller_path"), F.concat(F.lit("load"), n).alias("name"), k, F.lit(5).alias("defect_line"), n.alias("n"))
    text_of = lambda name: src.select("repo", F.col("path").alias(f"{name}_path"), F.col("text").alias(f"{name}_text"))
    rows = rows.join(text_of("defect"), ["repo", "defect_path"]).join(text_of("caller"), ["repo", "caller_path"]).withColumn("defect_text", F.concat("defect_text", F.lit("\n\ny = 'a'\n")))
    hunk = lambda line, a, b: F.concat(F.lit(f"@@ -{line},1 +{line},1 @@\n-"), a, F.lit("\n+"), b, F.lit("\n"))
    line4 = F.concat(F.lit("def load"), F.col("n"), F.lit("(x):"))
    other = F.when(F.col("s_suppkey") % 2 == 0, hunk(4, line4, F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("def load"), F.col("n"), F.lit("(y):"))).otherwise(F.concat(line4, F.lit("  "))))).otherwise(hunk(8, F.lit("y = 'a'"), F.when(F.col("s_suppkey") % 3 == 0, "y = 'b'").otherwise('y = "a"')))
    rows = rows.withColumn("diff", F.concat(other, hunk(5, F.lit("    return base(x)"), F.lit("    return None"))))
    return audit.audit_tasks(rows).select(F.col("task_id").cast("bigint").alias("task"), "import_resolves", "distractors_changing_tree", "defect_last")


@query("select p_brand as k, count(*) as tests, count(*) filter (where p_size > 10) as passed_before, count(*) filter (where p_size > 10 and p_size % 3 = 0) as n_flipped, case when count(*) filter (where p_size > 10) = 0 then 'no passing tests before mutation' when count(*) filter (where p_size > 10 and p_size % 3 = 0) > 0 then 'test-verified' else 'not caught by selected tests' end as status from part group by 1")
def flipped_tests(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("test"), (F.col("p_size") > 10).alias("passed_before"), (F.col("p_size") % 3 != 0).alias("passed_after"))
    return p.groupBy("k").agg(F.count("*").alias("tests")).join(audit.flipped(p, ["k"]), "k")


@query("with f as (select 'd' || p_size % 6 as dir, p_partkey, case p_partkey % 5 when 0 then 'test_p' else 'p' end || p_partkey || '.py' as name, 500 + p_size * 100 as size, p_brand as repo from part), k as (select *, count(*) over (partition by repo, dir) as n from f where size > 800 and name not like 'test%' and dir <> 'd3') select repo, dir || '/' || name as path, row_number() over (partition by repo order by n desc, dir, dir || '/' || name)::int as rank from k qualify rank <= 8")
def production_files(spark, d):
    path = F.concat(F.lit("d"), (F.col("p_size") % 6).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "/test_p").otherwise("/p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    files = t(spark, d, "part").select(F.col("p_brand").alias("repo"), path.alias("path"), (500 + F.col("p_size") * 100).alias("size"))
    return audit.production_files(files, 8, ["d3"])


@query("with c as (select 'r' || o_custkey % 20 as repo, o_orderkey as ord, o_custkey % 4 as files, o_orderkey % 3 as kind, o_orderkey % 5 as intro from orders) select repo, ord from c where kind in (0, 1) and files between 1 and 2 and intro <> 0 qualify row_number() over (partition by repo order by ord) <= 4")
def fix_commits(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("src/f"), i.cast("string"), F.lit(".py")))
    files = F.concat(F.slice(names, 1, (c % 4).cast("int")), F.array(F.lit("tests/test_a.py"), F.lit("README.md")))
    rows = t(spark, d, "orders").select(F.concat(F.lit("r"), (c % 20).cast("string")).alias("repo"), k.alias("ord"), F.when(k % 3 == 2, "Fix typo in docs").otherwise("Fix crash").alias("subject"), files.alias("files"), F.when(k % 5 == 0, F.slice(names, 1, 1)).otherwise(F.array(F.lit("src/other.py"))).alias("introduced"))
    return audit.fix_commits(rows, r"\bfix\b", r"\b(typo|docs)\b", 4).select("repo", "ord")


@query("with recursive links as (select p_partkey as a, unnest([p_partkey * 3 % 997 + 1, p_partkey * 7 % 997 + 1]) as b from part), known as (select p_partkey as k from part where p_partkey % 11 <> 0), walk(task, k, hop) as (select s_suppkey, s_suppkey, 0 from supplier where s_suppkey in (from known) union select task, b, hop + 1 from walk join links on a = k where hop < 2 and b in (from known)) select task, k as path, min(hop)::int as hop from walk group by all")
def collect_sources(spark, d):
    part = t(spark, d, "part")
    links = part.select(F.col("p_partkey").alias("path"), F.posexplode(F.array(F.col("p_partkey") * 3 % 997 + 1, F.col("p_partkey") * 7 % 997 + 1)).alias("pos", "target"))
    first = t(spark, d, "supplier").select(F.col("s_suppkey").alias("task"), F.lit(0).alias("pos"), F.col("s_suppkey").alias("path"))
    return audit.collect_sources(first, links, part.where("p_partkey % 11 != 0").select(F.col("p_partkey").alias("path")), 2, 60)


@query("select 'n/nation' || n_nationkey || '.py' as path, 'n/region' || n_regionkey || '.py' as first, 4 as candidates from nation")
def imported_paths(spark, d):
    rows = t(spark, d, "nation").select(F.concat(F.lit("n/nation"), "n_nationkey", F.lit(".py")).alias("path"), F.concat(F.lit("from .region"), "n_regionkey", F.lit(" import top\nimport os\n")).alias("text"))
    found = code.imported_paths("text", "path", F.array().cast("array<string>"))
    return rows.select("path", found[0].alias("first"), F.size(found).alias("candidates"))


# ---------------------------------------------------------------- evidence

EVIDENCE = "with e as (select o_orderkey as k, 'f' || o_custkey % 9 || '.call' as src, 'g' || o_custkey % 5 || '.def' as dst, case when o_orderkey % 5 = 4 then 'depends-on' when o_orderkey % 7 = 0 then case o_orderkey % 5 when 0 then 'catches' when 1 then 'checks-return-of' when 2 then 'calls-with-argument' else 'unpacks-return-of' end else case o_orderkey % 5 when 0 then 'catches' when 1 then 'checks-return-of' when 2 then 'calls-without-argument' else 'unpacks-return-of' end end as kind, case when o_orderkey % 3 = 0 then 'KeyError' when o_orderkey % 3 = 1 then 'deep' else '' end as arg from orders)"


def relations(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("exception_type", "none_sentinel", "default_flip", "tuple_order", "boundary"))), (k % 5 + 1).cast("int"))
    r = evidence.relation_of(kind, F.when(k % 3 == 1, "deep"), F.when(k % 3 == 0, "    except KeyError as e:"), k % 7 != 0)
    src = evidence.label(F.concat(F.lit("a/f"), (c % 9).cast("string"), F.lit(".py")), F.lit("call"))
    dst = evidence.label(F.concat(F.lit("g"), (c % 5).cast("string"), F.lit(".py")), F.lit("def"))
    rows = t(spark, d, "orders").select(k.alias("k"), F.array(F.struct(src.alias("source"), dst.alias("target"), r["kind"].alias("kind"), r["argument"].alias("argument"))).alias("relations"))
    return rows.withColumn("snippets", F.array(*[F.struct(F.lit(p).alias("path"), F.lit(n).alias("first"), F.lit(n + 1).alias("last"), F.lit(f"{p} code").alias("text"), x.alias("label")) for p, n, x in (("b.py", 5, F.col("relations")[0]["source"]), ("a.py", 9, F.col("relations")[0]["target"]), ("a.py", 2, F.lit("a.other")))]))


@query(EVIDENCE + """ select k, src || ' --' || kind || case when arg <> '' then '(' || arg || ')' else '' end || '--> ' || dst as flat, '<dependency type="' || kind || '"' || case when arg <> '' then ' argument="' || arg || '"' else '' end || ' source="' || src || '" target="' || dst || '"/>' as tag, src || ' ' || replace(kind, '-', ' ') || ' ' || dst || case when arg <> '' then ' on ' || arg else '' end || '.' as prose, src || ' --depends-on--> ' || dst as topology, src || ' --' || kind || '--> ' || dst as typed, src || ' --' || kind || case when arg <> '' then '(' || arg || ')' else '' end || '--> a.other' as corrupted from e""")
def evidence_blocks(spark, d):
    block = lambda arm, enc="flat": evidence.metadata_block(F.col("snippets"), F.col("relations"), arm, enc, F.col("k").cast("string"))
    return relations(spark, d).select("k", block("5-attributed").alias("flat"), block("5-attributed", "tag").alias("tag"), block("5-attributed", "prose").alias("prose"), block("3-topology").alias("topology"), block("4-typed").alias("typed"), block("6-corrupted").alias("corrupted"))


@query(EVIDENCE + " select k, length(src || ' --' || kind || case when arg <> '' then '(' || arg || ')' else '' end || '--> ' || dst) as size, true as same_letters from e")
def scrambled_evidence(spark, d):
    """The scrambled block is as long as the true one and has the same letters."""
    rows = relations(spark, d)
    true = evidence.serialise(F.col("relations"))
    made = evidence.metadata_block(F.col("snippets"), F.col("relations"), "2-evidence", "flat", F.col("k").cast("string"))
    letters = lambda c: F.array_sort(F.split(F.regexp_replace(c, "[0-9]", ""), ""))
    return rows.select("k", true.alias("t"), made.alias("m")).select("k", F.length("m").cast("bigint").alias("size"), (letters(F.col("t")) == letters(F.col("m"))).alias("same_letters"))


@query("select o_orderkey as k, '# a.py:2-3' || chr(10) || 'a.py code' || chr(10) || chr(10) || '# a.py:9-10' || chr(10) || 'a.py code' || chr(10) || chr(10) || '# b.py:5-6' || chr(10) || 'b.py code' as shown from orders")
def rendered_evidence(spark, d):
    return relations(spark, d).select("k", evidence.rendered(F.col("snippets")).alias("shown"))


@query("with l as (select doc_id, string_split(text, chr(10)) as lines, 1 + doc_id % 9 as mid from documents where text is not null) select doc_id, greatest(1, mid - 2)::int as first, least(len(lines), mid + 2)::int as last, array_to_string(lines[greatest(1, mid - 2) : greatest(least(len(lines), mid + 2), greatest(1, mid - 2) - 1)], chr(10)) as text, array_to_string(lines[1:3], chr(10)) || case when len(lines) - (lines[-1] = '')::int > 3 then chr(10) || '    # ... ' || (len(lines) - (lines[-1] = '')::int - 3) || ' more lines' else '' end as head from l where mid - 2 <= len(lines)")
def source_windows(spark, d):
    rows = t(spark, d, "documents").where("text is not null").withColumn("at", (1 + F.col("doc_id") % 9).cast("int")).withColumn("w", text.window(F.col("text"), F.col("at"), 2))
    rows = rows.where(F.col("at") - 2 <= F.size(F.split("text", "\n")))
    head = F.regexp_replace(text.cut(F.col("text"), 3), r"\n$", "")
    return rows.select("doc_id", "w.first", "w.last", F.col("w.text").alias("text"), text.cut(F.col("text"), 3).alias("head"))


POOL = "pool as (select 'x' || s_suppkey || '.py' as path, (s_suppkey)::int as first, repeat('y', (s_suppkey * 13 % 400 + 20)::int) as text, 'x' || s_suppkey || '.f' as label, row_number() over (order by 'x' || s_suppkey || '.f') - 1 as slot, count(*) over () as n from supplier)"


def foreign(spark, d):
    s = F.col("s_suppkey")
    return t(spark, d, "supplier").select(F.concat(F.lit("x"), s.cast("string"), F.lit(".py")).alias("path"), s.cast("int").alias("first"), (s + 1).cast("int").alias("last"), F.repeat(F.lit("y"), (s * 13 % 400 + 20).cast("int")).alias("text"), F.concat(F.lit("x"), s.cast("string"), F.lit(".f")).alias("label"))


def evidence_tasks(spark, d):
    k = F.col("c_custkey")
    piece = lambda i: F.struct(F.lit("m.py").alias("path"), F.lit(i).alias("first"), F.lit(i + 1).alias("last"), F.repeat(F.lit("z"), (k % 200).cast("int")).alias("text"), F.lit("m.g").alias("label"))
    return t(spark, d, "customer").select(k.cast("string").alias("task_id"), F.array(piece(1), piece(5)).alias("snippets"))


@query(f"with {POOL}, c as (select c_custkey::varchar as task_id, c_custkey % 200 * 2 as target, unnest(range(0, 25)) as draw from customer), p as (select task_id, target, draw, list_transform(range(0, 49), lambda i: ('0x' || substr(md5('foreign|' || task_id || '|' || draw || '|' || i), 1, 8))::bigint % m) as picks from c cross join (select max(n) as m from pool)), q as (select *, list_filter(picks, lambda x, i: list_position(picks, x) = i)[1:2] as two from p), s as (select task_id, target, draw, sum(length(text)) as size from (select *, unnest(two) as slot from q) join pool using (slot) group by all) select task_id, min(abs(size - target))::bigint as off, 2 as snippets from s group by task_id")
def random_evidence(spark, d):
    tasks = evidence_tasks(spark, d)
    size = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x["text"]))
    out = evidence.random_evidence(tasks, foreign(spark, d)).withColumnRenamed("snippets", "picked").join(tasks, "task_id")
    return out.select("task_id", F.abs(size("picked") - size("snippets")).cast("bigint").alias("off"), F.size("picked").alias("snippets"))


@query(f"with {POOL}, c as (select c_custkey::varchar as task_id, list_transform(range(0, 57), lambda i: ('0x' || substr(md5('noise3|' || c_custkey || '|0|' || i), 1, 8))::bigint % m) as picks from customer cross join (select max(n) as m from pool)), q as (select task_id, list_filter(picks, lambda x, i: list_position(picks, x) = i)[1:3] as three from c), s as (select task_id, pool.path, pool.first from (select task_id, unnest(three) as slot from q) join pool using (slot) union all select c_custkey::varchar, 'm.py', unnest([1, 5]) from customer) select task_id, string_agg(path || ':' || first, ',' order by path, first) as places from s group by task_id")
def noisy_evidence(spark, d):
    out = evidence.with_noise(evidence_tasks(spark, d), foreign(spark, d), 3)
    return out.select("task_id", F.array_join(F.transform("snippets", lambda s: F.concat(s["path"], F.lit(":"), s["first"].cast("string"))), ",").alias("places"))


@query("select s_suppkey::varchar as task_id, 3 as snippets, 'sup' || s_suppkey || '.go --catches(KeyError)--> region' || n_regionkey || '.top' || n_regionkey as block, 'region' || n_regionkey || '.other' as decoy, true as inside from supplier join nation on s_nationkey = n_nationkey")
def task_evidence(spark, d):
    src = materialize(sources(spark, d), "sources")
    far = F.concat("text", F.lit("\n" * 20 + "def other():\n    pass\n"))
    src = src.withColumn("text", F.when(F.startswith("path", F.lit("lib/")), far).otherwise(F.col("text")))
    sup = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.lit(None)
    tasks = sup.select(F.col("s_suppkey").cast("string").alias("task_id"), F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.lit("exception_type").alias("kind"), F.lit("KeyError").alias("argument"), F.lit("").alias("evidence"), F.lit(True).alias("is_defect"), F.concat(F.lit("lib/region"), "n_regionkey", F.lit(".py")).alias("defect_path"), F.lit(3).alias("defect_line"), F.concat(F.lit("s/sup"), "s_suppkey", F.lit(".py")).alias("caller_path"), F.lit(7).alias("caller_line"), none.cast("string").alias("via_path"), none.cast("int").alias("via_line"))
    out = evidence.evidence_for(tasks, src)
    inside = F.col("snippets")[0]
    return out.select("task_id", F.size("snippets").alias("snippets"), evidence.serialise(F.col("relations")).alias("block"), F.col("snippets")[2]["label"].alias("decoy"), ((inside["first"] <= 3) & (inside["last"] >= 3)).alias("inside"))


@query("select o_orderkey as k, array_to_string(list_distinct_ordered, ',') as paths from (select o_orderkey, case when o_custkey % 3 = 0 then ['a.py', 'b.py'] when o_custkey % 3 = 1 then ['a.py'] else ['a.py', 'c.py'] end as list_distinct_ordered from orders)")
def wanted_paths(spark, d):
    c = F.col("o_custkey") % 3
    paths = evidence.wanted_paths(F.lit("a.py"), F.when(c == 0, "b.py").when(c == 1, "a.py").otherwise(""), F.when(c == 2, "c.py"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(paths, ",").alias("paths"))


# ---------------------------------------------------------------- generated tasks

DEF_FILE = "name = 'a'\nitems = [1,2]\n\n\ndef find{0}(x, strict=True):\n    if strict:\n        raise KeyError(x)\n    return None\n\n\ndef both{0}(a, b):\n    left = a + 1\n    return left, b\n"
CALL_FILE = "from lib.def{0} import find{0}, both{0}\n\n\ndef use{0}(x):\n    try:\n        got = find{0}(x)\n    except KeyError:\n        return 1\n    if got is None:\n        return 2\n    one, two = both{0}(x, 1)\n    return one\n"
SAFE_FILE = "from lib.def{0} import find{0}\n\n\ndef safe{0}(x):\n    return find{0}(x, strict=False)\n"


def toy_sources(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    fill = lambda s: F.concat(*[F.col("k") if x == 0 else F.lit(x) for x in _parts(s)])
    repo = F.concat(F.lit("t"), "k").alias("repo")
    files = [("lib/def", DEF_FILE), ("app/use", CALL_FILE), ("app/safe", SAFE_FILE)]
    out = None
    for path, body in files:
        part = n.select(repo, F.concat(F.lit(path), "k", F.lit(".py")).alias("path"), fill(body).alias("text"))
        out = part if out is None else out.union(part)
    return out


@query("select 't' || n_nationkey as repo, unnest([{'kind': 'exception_type', 'name': 'find' || n_nationkey, 'line': 7, 'caller_line': 7, 'argument': 'KeyError'}, {'kind': 'none_sentinel', 'name': 'find' || n_nationkey, 'line': 8, 'caller_line': 9, 'argument': 'None'}, {'kind': 'default_flip', 'name': 'find' || n_nationkey, 'line': 5, 'caller_line': 6, 'argument': 'strict'}, {'kind': 'tuple_order', 'name': 'both' || n_nationkey, 'line': 13, 'caller_line': 11, 'argument': 'one,two'}], recursive := true) from nation")
def find_defects(spark, d):
    src = materialize(toy_sources(spark, d), "sources")
    out = generate.find_defects(src, code.parse_tags(src), 9, least=1)
    return out.select("repo", "kind", "name", "line", "caller_line", "argument")


@query("select n_nationkey::bigint as k, 'default_flip' as kind, 5 as caller_line, 'strict' as argument, 'lib/alone.py' as path from nation")
def find_twins(spark, d):
    """Only the safe caller is there, so that the flipped default minds nobody."""
    src = toy_sources(spark, d).where("path not like 'app/use%'").withColumn("path", F.when(F.startswith("path", F.lit("lib/")), F.lit("lib/alone.py")).otherwise(F.col("path")))
    src = materialize(src.withColumn("text", F.regexp_replace("text", r"lib\.def\d+", "lib.alone")), "sources")
    out = generate.find_twins(src, code.parse_tags(src), 8, least=1)
    return out.select(F.substring("repo", F.lit(2), F.lit(9)).cast("bigint").alias("k"), "kind", "caller_line", "argument", F.col("definition_path").alias("path"))


@query("select 't' || n_nationkey as repo, 'none_sentinel' as kind, 'mid/m.py' as via_path, 5 as via_line, 'end/e.py' as caller_path, 6 as caller_line from nation")
def find_chains(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("repo"))
    mid = "from lib.f import find\n\n\ndef through(x):\n    return find(x)\n"
    end = "from mid.m import through\n\n\ndef last(x):\n    got = through(x)\n    if got is None:\n        return 1\n    return got\n"
    base = "name = 'a'\nother = \"b\"\n\n\ndef find(x):\n    if x:\n        return None\n    return x\n"
    files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(b).alias("text")) for p, b in (("lib/f.py", base), ("mid/m.py", mid), ("end/e.py", end))])
    src = materialize(n.select("repo", F.explode(files).alias("f")).select("repo", "f.*"), "sources")
    return generate.find_chains(src, code.parse_tags(src), 8, least=1).select("repo", "kind", "via_path", "via_line", "caller_path", "caller_line")


@query("select o_orderkey as k, 'diff --git a/x.py b/x.py' || chr(10) || '--- a/x.py' || chr(10) || '+++ b/x.py' || chr(10) || case when o_custkey % 20 < 7 then '@@ -' || o_custkey % 20 || ',1 +' || o_custkey % 20 || ',1 @@' || chr(10) || '-old' || chr(10) || '+new' || chr(10) else '' end || '@@ -7,1 +7,1 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10) || case when o_custkey % 20 >= 7 then '@@ -' || o_custkey % 20 || ',1 +' || o_custkey % 20 || ',1 @@' || chr(10) || '-old' || chr(10) || '+new' || chr(10) else '' end as diff from orders")
def build_diff(spark, d):
    line = (F.col("o_custkey") % 20).cast("int")
    others = F.array(F.struct(F.lit(7).alias("line"), F.lit("a").alias("before"), F.lit("b").alias("after")))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), generate.build_diff(F.lit("x.py"), line, F.lit("old"), F.lit("new"), others).alias("diff"))


# ---------------------------------------------------------------- the store


@query("with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as is_last from conversations) select conv_id, turn, case when turn % 4 = 3 then null when is_last then '{\"repo\": \"r\", \"messages\": [1]}' else '{\"repo\": \"r\"}' end as data from c")
def thread_comments(spark, d):
    data = F.when(F.col("turn") % 4 == 3, "[1]").otherwise('{"repo": "r", "secret": 2, "messages": [1]}')
    rows = t(spark, d, "conversations").withColumn("data", data)
    return store.thread_comments(rows, "conv_id", ["turn", "role", "text"], "data").select("conv_id", "turn", "data")


@query("with v as (select o_custkey as review, o_custkey % 10 as usr, (o_orderkey % 7)::int as rating, o_orderkey as sent from orders where o_orderkey % 7 between 1 and 5 and o_orderkey % 4 <> 0), l as (select review, usr, arg_max(rating, sent) as rating from v group by all) select review, usr, rating from l union all select c_custkey, c_custkey % 10, 9 from customer where (c_custkey, c_custkey % 10) not in (select review, usr from l)")
def submit_ratings(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("review"), (F.col("c_custkey") % 10).alias("user"), F.lit(9).alias("rating"), F.lit("old").alias("feedback"))
    sent = t(spark, d, "orders").select(F.col("o_custkey").alias("review"), (F.col("o_custkey") % 10).alias("user"), (F.col("o_orderkey") % 7).cast("int").alias("rating"), F.when(F.col("o_orderkey") % 4 != 0, "text").alias("feedback"), F.col("o_orderkey").alias("at"))
    usage = spark.createDataFrame([], "review long, user long, llm_model string, input_tokens int, output_tokens int, cost double")
    out, _ = store.submit_ratings(old, usage, sent, F.lit("m"))
    return out.select("review", F.col("user").alias("usr"), "rating")


@query("with m as (select o_custkey as thread, o_orderkey as id, o_orderkey % 3 as p from orders where o_orderkey % 5 <> 0), k as (select thread, id, p from m where p <> 1 or thread in (select c_custkey from customer where c_custkey % 2 = 0)) select thread, count(*) filter (where true) + (thread % 2 = 0)::int + count(*) filter (where id % 2 = 0) as comments, count(*) filter (where id % 2 = 0) as answers from k group by thread")
def thread_reply(spark, d):
    """Even threads have a first comment 0; messages with remainder 1 answer it; even messages are answered."""
    none = F.lit(None)
    base = t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("thread"), F.lit(0).cast("bigint").alias("id"), F.lit("u").alias("user"), F.lit("first").alias("comment"), F.lit("request").alias("type"), none.cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("at"))
    o = t(spark, d, "orders")
    said = o.select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("id"), F.lit("u").alias("user"), F.when(F.col("o_orderkey") % 5 != 0, "text").alias("comment"), F.when(F.col("o_orderkey") % 3 == 1, F.lit(0).cast("bigint")).alias("parent"), F.col("o_orderkey").alias("at"))
    answers = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("request"), (-F.col("o_orderkey")).alias("id"), F.lit("answer").alias("comment"), F.col("o_orderkey").alias("at"))
    out = store.reply(base, said, answers).groupBy("thread").agg(F.count("*").alias("comments"), F.count_if(F.col("type") == "response").alias("answers"), F.max("at").alias("m"))
    return out.where("m > 0").drop("m")


@query("with r as (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as k from conversations) select conv_id, string_agg(role || turn, ',' order by k desc) as history from r where k <= 3 group by conv_id")
def conversation(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.concat("role", F.col("turn").cast("string")).alias("type"), F.lit("").alias("comment"), F.col("turn").alias("at"), F.concat_ws("|", "role", "text").alias("id"))
    out = store.conversation(rows, limit=3)
    return out.select(F.col("thread").alias("conv_id"), F.array_join(F.transform("history", lambda h: h["type"]), ",").alias("history"))


@query("select c_custkey, o as system_id, o is not null as is_registered_in_system from customer left join (select o_custkey, min(o_orderkey) as o from orders where o_orderstatus = 'F' group by 1) on o_custkey = c_custkey")
def registered_repositories(spark, d):
    ours = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return store.registered(t(spark, d, "customer").select("c_custkey"), ours, "c_custkey", "o_orderkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey = 7 or (l_partkey = 11 and l_suppkey = (select max(l_suppkey) from lineitem where l_partkey = 11))")
def keyed_lookups(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    best = li.where("l_partkey = 11").agg(F.max("l_suppkey").alias("l_suppkey"))
    natural = store.by_natural_key(li, l_partkey=11).join(F.broadcast(best), "l_suppkey", "left_semi").where("l_orderkey != 7")
    return store.children_of(li, "l_orderkey", 7).unionByName(natural).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_custkey as usr, string_agg('User prefers p' || o_orderkey || ' (Category: c, Context: x)', '; ' order by o_orderkey) as preferences from orders where o_orderkey % 4 <> 0 and o_orderkey % 10 > 7 group by 1")
def user_preferences(spark, d):
    k = F.col("o_orderkey")
    inner = F.concat(F.lit('{"preference": "p'), k.cast("string"), F.lit('", "category": "c", "context": "x", "confidence": 0.'), (k % 10).cast("string"), F.lit("}"))
    data = F.when(k % 2 == 0, F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(inner)
    value = F.when(k % 4 == 0, "no json").otherwise(F.concat(F.lit('{"type": "preference", "data": '), data, F.lit("}")))
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("usr"), k, value.alias("value"))
    return store.preferences(rows, ["usr"], "value", ["o_orderkey"]).select("usr", F.array_join("preferences", "; ").alias("preferences"))


@query("select p_partkey, p_name, 'remote' as source, case when p_partkey % 2 = 0 then 'author' || p_partkey end as author from part")
def with_source(spark, d):
    part = t(spark, d, "part").select("p_partkey", "p_name")
    extra = part.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("author"), F.col("p_partkey").cast("string")).alias("author"))
    return store.with_source(part, extra, "p_partkey", ["author"], "remote")


@query("select doc_id, 1 as first, least(2, len(string_split(text, chr(10))))::int as last, array_to_string(string_split(text, chr(10))[1:2], chr(10)) as content from documents where text is not null")
def read_lines(spark, d):
    rows = t(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return retrieve.read_lines(rows, "text", "doc_id", 1, 2)


# ---------------------------------------------------------------- loading, verdicts and records


@query(f"with {FIRST}, r as (select 'a::r' || o_custkey % 9 || '::' || l_orderkey as task_id, l_linenumber as arm, l_returnflag = 'R' as correct, l_linestatus = 'F' as failed, l_partkey % 3 as kind, o_orderstatus = 'F' as is_defect, o_custkey % 9 as repo from first join orders on o_orderkey = l_orderkey) select 'r' || repo as repo, 'arm' || arm as arm, count(*) as n, count(*) filter (where not failed) as scored, count(*) filter (where not failed and correct) as correct, count(*) filter (where is_defect or arm = 3) as defects from r where arm in (1, 2, 3) and kind <> 1 group by all")
def structure_load(spark, d):
    """Structure records written as JSON lines and loaded: known arms, one kind (missing counts), failed parses without
    a metric, a missing is_defect as true."""
    rows = first_lines(spark, d).join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("l_partkey") % 3
    rows = rows.select(
        F.concat(F.lit("a::r"), (F.col("o_custkey") % 9).cast("string"), F.lit("::"), F.col("l_orderkey").cast("string")).alias("task_id"), F.concat(F.lit("arm"), F.col("l_linenumber").cast("string")).alias("arm"),
        (F.col("l_returnflag") == "R").alias("correct"), (F.col("l_linestatus") == "F").alias("parse_failed"), F.when(k == 0, "default_flip").when(k == 1, "tuple_order").alias("kind"), F.when(F.col("l_linenumber") != 3, F.col("o_orderstatus") == "F").alias("is_defect"),
    )
    path = f"{shared_dir(spark)}/plumbline/structure-{uuid.uuid4().hex}"
    write_jsonl(rows, path, [])
    loaded = structure_runs(spark, path, ["arm1", "arm2", "arm3"])
    return loaded.groupBy(text.repo_of(F.col("task_id")).alias("repo"), "arm").agg(F.count("*").alias("n"), F.count("correct").alias("scored"), F.count_if("correct").alias("correct"), F.count_if("is_defect").alias("defects"))


@query("select doc_id, quality = 1 as label from labels where quality is not null and doc_id % 3 <> 0")
def labels_load(spark, d):
    """Labels written as CSV with YES and NO, and others that go, and loaded."""
    value = F.when(F.col("doc_id") % 3 == 0, "maybe").when(F.col("quality") == 1, " yes").otherwise("NO")
    rows = t(spark, d, "labels").where("quality is not null").select("doc_id", value.alias("label"))
    path = f"{shared_dir(spark)}/plumbline/labels-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return read_labels(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "label")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resumed_work(spark, d):
    planned = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return remaining(planned, t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("with i as (select n_nationkey as k, case when n_nationkey % 5 <> 0 then (n_nationkey - 12) / 10 end::double as low, (n_nationkey - 8)::double / 10 as high from nation) select k, case when low is not null then case when low > 0 then 'higher' when high < 0 then 'lower' else 'not distinguishable' end end as verdict, case when low is not null then low > 0 or high < 0 end as excludes, case when low > -0.5 and high < 0.5 and low > 0 then 'gain and equivalence' when low > 0 then 'gain' when low > -0.5 and high < 0.5 then 'equivalence' else 'inconclusive' end as reading from i")
def interval_verdicts(spark, d):
    n = F.col("n_nationkey")
    rows = t(spark, d, "nation").select(n.alias("k"), F.when(n % 5 != 0, ((n - 12) / 10).cast("double")).alias("low"), ((n - 8) / 10).cast("double").alias("high"))
    low, high = F.col("low"), F.col("high")
    return rows.select("k", roc.verdict(low, high).alias("verdict"), roc.excludes_zero(low, high).alias("excludes"), roc.reading(low, low, high, 0.5).alias("reading"))


@query(f"with {FIRST}, c as (select l_orderkey as task_id, l_linenumber as k, 'f' || l_suppkey % 4 as answer, 'f' || l_partkey % 4 as expected, l_returnflag = 'R' as pinned, l_quantity::int as tokens, repeat('e', (l_quantity * 10)::int) as error from first) select task_id, k, case when k <> 4 then answer = expected end as right_, case when pinned then tokens end as reasoning_tokens, length(substr(error, 1, 300)) as error from c")
def call_records(spark, d):
    rows = first_lines(spark, d).select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("k"), F.when(F.col("l_linenumber") != 4, F.concat(F.lit(" f"), (F.col("l_suppkey") % 4).cast("string"), F.lit(" "))).alias("answer"), F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")).alias("expected"), (F.col("l_returnflag") == "R").alias("pinned"), F.col("l_quantity").cast("int").alias("reasoning_tokens"), F.repeat(F.lit("e"), (F.col("l_quantity") * 10).cast("int")).alias("why"))
    out = audit.failed_record(audit.call_meta(audit.manipulation_check(rows), F.col("pinned"), ["reasoning_tokens"]), F.lit("review"), F.col("why"))
    return out.select("task_id", "k", F.col("right").alias("right_"), "reasoning_tokens", F.length("error").cast("bigint").alias("error"))


@query(f"with {FIRST}, dd as (select o_orderkey as task, (o_custkey % 50)::int as line from orders), f as (select l_orderkey as task, case when l_linenumber <= 3 then 'A' else 'B' end as condition, l_linenumber as pos, l_quantity::int as line from first where l_partkey % 2 = 0), c as (select distinct task, condition from f), h as (select task, condition, arg_min(abs(f.line - dd.line), (abs(f.line - dd.line), pos)) as best from f join dd using (task) group by all) select c.task::varchar as task_id, c.condition, 'd' || c.task as defect_id, coalesce(best <= 5, false) as hit from c join dd using (task) left join h using (task, condition)")
def model_hits(spark, d):
    """One defect a task, findings of two conditions matched to it."""
    defects = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("defect_id"), F.lit("a/src/x.py").alias("path"), (F.col("o_custkey") % 50).cast("int").alias("line"))
    found = first_lines(spark, d).where("l_partkey % 2 = 0").select(F.col("l_orderkey").cast("string").alias("task_id"), F.when(F.col("l_linenumber") <= 3, "A").otherwise("B").alias("condition"), F.lit("src/x.py").alias("path"), F.col("l_quantity").cast("int").alias("line"), F.col("l_linenumber").alias("pos"))
    return bench.hits_of(defects, found)


@query("""with o as (select o_orderkey as task, (o_custkey % 60 + 1)::int as line, (o_custkey % 3)::int as k from orders), h as (select task, line, k, md5('0|' || blk || '|' || task || '|A') as h, blk from o cross join (select unnest(range(0, 375)) as blk)),
 n as (select task, line, k, blk * 4 + i as j, ('0x' || substr(h, i * 8 + 1, 8))::bigint % 60 + 1 as found from h cross join (select unnest(range(0, 4)) as i)), u as (select task, j // k as draw, bool_or(abs(found - line) <= 5) as hit from n where k > 0 and j < 500 * k group by all)
 select o.task::varchar as task, round(coalesce((select avg(hit::int) from u where u.task = o.task), 0), 6) as rate from o""")
def chance_rematch(spark, d):
    """Random findings on the lines of a diff, as many as the review had, matched to the task's defect."""
    lines = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.struct(F.lit("x.py").alias("path"), i.alias("line")))
    defects = F.array(F.struct(F.lit("d").alias("defect_id"), F.lit("x.py").alias("path"), (F.col("o_custkey") % 60 + 1).cast("int").alias("line")))
    orders = spread(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    tasks = orders.select(F.col("o_orderkey").cast("string").alias("task"), F.lit("A").alias("condition"), lines.alias("lines"), defects.alias("defects"), (F.col("o_custkey") % 3).cast("int").alias("findings"))
    return resample.chance_baseline(tasks, 5, 500).select("task", r6("rate").alias("rate"))


@query("with f as (select p_brand as repo, 'tests/test_p' || p_partkey || '.py' as path, (p_size % 4)::int as n from part where p_partkey % 3 <> 0), t as (select p_brand as task_id from part group by 1) select task_id, path, n as score, row_number() over (partition by task_id order by n desc, path desc)::int as rank from t join f on f.repo = task_id where n > 0 qualify rank <= 10")
def select_tests(spark, d):
    path = F.concat(F.when(F.col("p_partkey") % 3 == 0, "src/p").otherwise("tests/test_p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    files = t(spark, d, "part").select(F.col("p_brand").alias("repo"), path.alias("path"), F.concat(F.repeat(F.lit("find(x) ; "), (F.col("p_size") % 4).cast("int")), F.lit("finder find_all")).alias("text"))
    words = files.groupBy(F.col("repo").alias("task_id")).agg(F.first("repo").alias("repo")).withColumn("words", F.array(F.lit("find"), F.lit("m.x")))
    return audit.select_tests(files, words)


@query(detection_sql(0.95).rsplit(" select arm, ", 1)[0] + f", mm as (select z.draw, avg(z.d) - any_value(b.d) as dd from z join (select draw, d from z where arm = 1) b using (draw) where arm in (2, 3) group by z.draw having count(*) = 2) select round(max(dd) filter (where draw = -1), 6) as change, round({_AT.format('dd', _LOW.format(q=0.025, c='dd'))}, 6) as low, round({_AT.format('dd', _HIGH.format(q=0.025, c='dd'))}, 6) as high from mm")
def mean_detection_change(spark, d):
    out = roc.detection_intervals(spark, runs(spark, d), "cluster", "arm", 1, F.col("hit"), F.col("is_defect"), TRIALS, mean_of=[2, 3])
    return out.where("arm is null").select(r6("dd").alias("change"), r6("dd_low").alias("low"), r6("dd_high").alias("high"))


@query("with g as (select c_nationkey as repo, count(*) as nodes from customer group by 1) select repo, nodes, 'built' as version from g")
def cached_table(spark, d):
    """A table built once under its key and read again from the cache."""
    root = f"{shared_dir(spark)}/plumbline/cache-{uuid.uuid4().hex}"
    build = lambda: t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.count("*").alias("nodes")).withColumn("version", F.lit("built"))
    cached(spark, root, {"commit": "abc", "hops": 3}, build)
    return cached(spark, root, {"commit": "abc", "hops": 3}, lambda: build().withColumn("version", F.lit("again")))
