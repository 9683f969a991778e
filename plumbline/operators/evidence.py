"""Evidence for a reviewed change: snippets of code, relations between them, and how both are shown.

A snippet is struct<path, first, last, text, label>, a relation struct<source, target, kind, argument>; both come in
arrays, one row a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import corrupt_targets, enclosing_name, jitter, shuffle_labels
from ..functions.hashing import hash32
from ..functions.text import window
from ..tables import materialize, placed, spread

# Arms, encodings, and the relation that a defect's kind stands for.
ARMS = ("1-diff", "2-evidence", "3-topology", "4-typed", "5-attributed", "6-corrupted", "7-random", "8-header", "2b-snippets")
FLAT, TAG, PROSE = "flat", "tag", "prose"
RELATIONS = {
    "exception_type": "catches",
    "none_sentinel": "checks-return-of",
    "default_flip": "calls-without-argument",
    "tuple_order": "unpacks-return-of",
    "empty_to_none": "iterates-return-of",
}
TWIN_RELATIONS = {"default_flip": "calls-with-argument", "exception_type": "catches"}
RADIUS, DRAWS = 12, 25


def wanted_paths(*paths: Column) -> Column:
    """The given paths in order, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.array(*paths), lambda p: F.coalesce(p, F.lit("")) != ""))


def label(path: Column, name: Column) -> Column:
    """stem.name of a snippet."""
    return F.concat(F.replace(F.substring_index(path, "/", -1), F.lit(".py"), F.lit("")), F.lit("."), name)


def snippet(path: Column, text: Column, centre: Column, line: Column, radius: int = RADIUS) -> Column:
    """The lines around `centre`, labelled by what encloses `line`."""
    w = window(text, centre, radius)
    return F.struct(path.alias("path"), w["first"].alias("first"), w["last"].alias("last"), w["text"].alias("text"), label(path, enclosing_name(text, line)).alias("label"))


def decoy_line(text: Column, avoid: Column, radius: int = RADIUS) -> Column:
    """The nearest line that begins a definition more than two radii from `avoid`, the upper of two; null if none."""
    at = F.filter(F.transform(F.split(text, "\n"), lambda l, i: F.when(l.rlike(r"(?U)^\s*def\s+\w+"), i + 1)), lambda i: i.isNotNull() & (F.abs(i - avoid) > 2 * radius))
    return F.array_min(F.transform(at, lambda i: F.struct(F.abs(i - avoid).alias("distance"), i.alias("line"))))["line"]


def relation_of(kind: Column, argument: Column, evidence: Column, is_defect: Column) -> Column:
    """struct<kind, argument>: what a caller does with the definition, and with which argument; without one, the type
    that the evidence line catches."""
    of = lambda table, rest: F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind], rest)
    true = of(RELATIONS, F.lit("depends-on"))
    caught = F.regexp_extract(F.coalesce(evidence, F.lit("")), r"(?U)except\s+(\w+)", 1)
    argument = F.when(F.coalesce(argument, F.lit("")) != "", argument).otherwise(caught)
    return F.struct(F.when(F.coalesce(is_defect, F.lit(True)), true).otherwise(of(TWIN_RELATIONS, true)).alias("kind"), argument.alias("argument"))


def evidence_for(tasks: DataFrame, sources: DataFrame, radius: int = RADIUS, hide: bool = False) -> DataFrame:
    """tasks(task_id, repo, kind, argument, evidence, is_defect, defect_path, defect_line, caller_path, caller_line,
    via_path, via_line), sources(repo, path, text) -> (task_id, snippets, relations).

    The definition and its caller in windows that a hash of the task shifts, a decoy of the definition's file if it
    has one, and the file between in a chain of two calls, whose relations are then two.  With hide, the caller's
    window ends above the evidence; kinds whose evidence is the call itself have none then.  Tasks without the
    sources that they need are left out."""
    rows = tasks.where("defect_path != '' and caller_path != '' and caller_line is not null")
    chain = (F.coalesce("via_path", F.lit("")) != "") & F.col("via_line").isNotNull()
    text = lambda name: sources.select("repo", F.col("path").alias(f"{name}_path"), F.col("text").alias(f"{name}_text"))
    rows = rows.join(text("defect"), ["repo", "defect_path"]).join(text("caller"), ["repo", "caller_path"]).join(text("via"), ["repo", "via_path"], "left").where(~chain | F.col("via_text").isNotNull())
    moved = lambda line, what: F.col(line) + jitter(F.concat("task_id", F.lit(what)), F.lit(radius))
    caller_at = F.col("caller_line") - radius - 1 if hide else moved("caller_line", "caller")
    rows = rows.withColumn("definition", snippet(F.col("defect_path"), F.col("defect_text"), moved("defect_line", "def"), F.col("defect_line"), radius))
    rows = rows.withColumn("caller", snippet(F.col("caller_path"), F.col("caller_text"), caller_at, F.col("caller_line"), radius))
    if hide:
        rows = rows.where(F.col("kind").isin("exception_type", "none_sentinel") & (F.col("caller.last") < F.col("caller_line")))
    rows = rows.withColumn("at", decoy_line(F.col("defect_text"), F.col("defect_line"), radius))
    beyond = F.coalesce("at", F.lit(1))
    rows = rows.withColumn("decoy", F.when(F.col("at").isNotNull(), snippet(F.col("defect_path"), F.col("defect_text"), beyond, beyond, radius)))
    rows = rows.withColumn("via", F.when(chain, snippet(F.col("via_path"), F.coalesce("via_text", F.lit("")), F.coalesce("via_line", F.lit(1)), F.coalesce("via_line", F.lit(1)), radius)))
    r = relation_of(F.col("kind"), F.col("argument"), F.col("evidence"), F.col("is_defect"))
    edge = lambda a, b, kind, argument: F.struct(F.col(f"{a}.label").alias("source"), F.col(f"{b}.label").alias("target"), kind.alias("kind"), argument.alias("argument"))
    direct = F.array(edge("caller", "definition", r["kind"], r["argument"]))
    through = F.array(edge("caller", "via", r["kind"], r["argument"]), edge("via", "definition", F.lit("returns-result-of"), F.lit("")))
    return rows.select("task_id", F.array_compact(F.array("definition", "caller", "decoy", "via")).alias("snippets"), F.when(chain, through).otherwise(direct).alias("relations"))


def ordered(snippets: Column) -> Column:
    """Snippets by path and first line, whatever their order was."""
    return F.transform(F.array_sort(F.transform(snippets, lambda s: F.struct(s["path"].alias("path"), s["first"].alias("first"), s.alias("s")))), lambda x: x["s"])


def rendered(snippets: Column) -> Column:
    """Snippets as text, each below a line with its place."""
    one = lambda s: F.concat(F.lit("# "), s["path"], F.lit(":"), s["first"].cast("string"), F.lit("-"), s["last"].cast("string"), F.lit("\n"), s["text"])
    return F.array_join(F.transform(ordered(snippets), one), "\n\n")


def serialise(relations: Column, encoding: str = FLAT) -> Column:
    """Relations as text, one a line: arrows, tags or sentences."""

    def one(r: Column) -> Column:
        has = r["argument"] != ""
        if encoding == FLAT:
            return F.concat(r["source"], F.lit(" --"), r["kind"], F.when(has, F.concat(F.lit("("), r["argument"], F.lit(")"))).otherwise(""), F.lit("--> "), r["target"])
        if encoding == TAG:
            return F.concat(F.lit('<dependency type="'), r["kind"], F.lit('"'), F.when(has, F.concat(F.lit(' argument="'), r["argument"], F.lit('"'))).otherwise(""), F.lit(' source="'), r["source"], F.lit('" target="'), r["target"], F.lit('"/>'))
        return F.concat_ws(" ", r["source"], F.replace(r["kind"], F.lit("-"), F.lit(" ")), F.concat(r["target"], F.when(has, F.concat(F.lit(" on "), r["argument"])).otherwise(""), F.lit(".")))

    return F.array_join(F.transform(relations, one), "\n")


def _relations(relations: Column, kind=None, argument=None) -> Column:
    return F.transform(relations, lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), (kind if kind is not None else r["kind"]).alias("kind"), (argument if argument is not None else r["argument"]).alias("argument")))


def metadata_block(snippets: Column, relations: Column, arm: str, encoding: str = FLAT, seed: Column | None = None) -> Column:
    """The relations as an arm shows them: scrambled (2, 8), as mere topology (3), typed (4), whole (5), with wrong
    targets (6); other arms have no block."""
    seed = seed if seed is not None else F.lit("")
    if arm in ("2-evidence", "8-header"):
        return serialise(shuffle_labels(relations, seed), encoding)
    if arm == "3-topology":
        return serialise(_relations(relations, F.lit("depends-on"), F.lit("")), encoding)
    if arm == "4-typed":
        return serialise(_relations(relations, None, F.lit("")), encoding)
    if arm == "5-attributed":
        return serialise(relations, encoding)
    if arm == "6-corrupted":
        return serialise(corrupt_targets(relations, F.transform(snippets, lambda s: s["label"]), seed), encoding)
    return F.lit("")


def _slots(rows: DataFrame, key: str, k: Column, n: int, what: str) -> DataFrame:
    """(key, draw, place, slot) of rows with a key and a draw: k of n slots without repeats, picked by hashes."""
    picks = lambda last: F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(hash32(F.lit(what), F.col(key), F.col("draw"), i), F.lit(n)).cast("int")))
    rows = rows.select(key, "draw", k.alias("_k")).withColumn("_few", picks(F.col("_k") + 1))
    # Two picks more than needed mostly do; the others are hashed only where they do not.
    rows = rows.withColumn("_p", F.when(F.size("_few") >= F.col("_k"), F.col("_few")).otherwise(picks(8 * F.col("_k") + 32)))
    # So many picks leave k different slots unless n is about k; then the rest is taken in order.
    filled = F.when(F.size("_p") >= F.col("_k"), F.col("_p")).otherwise(F.array_distinct(F.concat("_p", F.sequence(F.lit(0), F.lit(n - 1)))))
    return rows.select(key, "draw", F.posexplode(F.slice(filled, 1, F.col("_k"))).alias("place", "slot"))


def random_evidence(tasks: DataFrame, pool: DataFrame, draws: int = DRAWS) -> DataFrame:
    """tasks(task_id, snippets), pool(path, first, last, text, label) -> (task_id, snippets): as many foreign snippets,
    of `draws` samples the one whose text is nearest in length to the task's own.  A task with more snippets than the
    pool keeps its own.

    Samples are judged by lengths; texts are joined to the chosen ones only."""
    n = pool.count()
    sized = tasks.select("task_id", "snippets", F.size("snippets").alias("k"), F.aggregate("snippets", F.lit(0), lambda s, x: s + F.length(x["text"])).alias("target"))
    fits = sized.where(F.col("k") <= n).select("task_id", "k", "target")
    numbered = materialize(placed(pool, ["label", "path", "first", "text"], "slot").withColumn("size", F.length("text")), "pool")
    all_draws = spread(fits, "task_id").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = _slots(all_draws, "task_id", F.col("k"), n, "foreign").join(numbered.select("slot", "size"), "slot")
    off = F.abs(F.col("size") - F.col("target"))
    sample = drawn.groupBy("task_id", "draw").agg(F.sum("size").alias("size")).join(fits, "task_id")
    best = sample.groupBy("task_id", "k").agg(F.min(F.struct(off, "draw"))["draw"].alias("draw"))
    chosen = _slots(best, "task_id", F.col("k"), n, "foreign").join(numbered, "slot")
    picked = chosen.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct("path", "first", "last", "text", "label").alias("s")))).alias("picked"))
    return sized.join(picked, "task_id", "left").select("task_id", F.coalesce(F.transform("picked", lambda x: x["s"]), F.col("snippets")).alias("snippets"))


def with_noise(tasks: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """tasks(task_id, snippets) with k foreign snippets more, in the order of path and line; as they are if the pool
    has fewer."""
    if k <= 0 or pool.count() < k:
        return tasks.select("task_id", "snippets")
    rows = spread(tasks.select("task_id"), "task_id").withColumn("draw", F.lit(0))
    drawn = _slots(rows, "task_id", F.lit(k), pool.count(), f"noise{k}").join(placed(pool, ["label", "path", "first", "text"], "slot"), "slot")
    extra = drawn.groupBy("task_id").agg(F.collect_list(F.struct("path", "first", "last", "text", "label")).alias("extra"))
    return tasks.join(extra, "task_id").select("task_id", ordered(F.concat("snippets", "extra")).alias("snippets"))
