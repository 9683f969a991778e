"""Run logs, coverage and audits: what was called, what it cost, what the pools hold, whether tasks are sound."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.code import python_tags
from ..functions.text import TEST_PATH_ANY
from ..tables import materialize, spread
from .rollup import cost_of

CALL = ("structure", "manipulation", "failed")


def calls(records: dict[str, DataFrame]) -> DataFrame:
    """All calls of the given kinds of records, each DataFrame with `run`, as one table with (run, kind); a column that
    a kind lacks is null."""
    out = None
    for kind, df in records.items():
        df = df.withColumn("record", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_calls(spark, runs: str, schema: str, kinds: tuple[str, ...] = CALL) -> DataFrame:
    """The call logs below runs/<run>/<kind>.jsonl, with their run and kind taken from the path."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(runs)
    path = F.col("_metadata.file_path")
    df = df.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+\.jsonl$", 1).alias("run"), F.regexp_extract(path, r"([^/]+)\.jsonl$", 1).alias("record"))
    return df.where(F.col("record").isin(*kinds))


def output_tokens(own: Column, usage: Column) -> Column:
    """A call's own count of output tokens, else the usage's."""
    return F.coalesce(own, usage)


def total_cost(rows: DataFrame, usage_cost: Column, cost: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(cost_of(usage_cost, cost)), F.lit(0.0)).alias("total"))


def remaining(rows: DataFrame, usage_cost: Column, cost: Column, budget: float = 4.0) -> DataFrame:
    """One row: what is left of a budget."""
    return total_cost(rows, usage_cost, cost).select((F.lit(budget) - F.col("total")).alias("remaining"))


def project(smoke: DataFrame, cost: Column, calls: int, cap: float, factor: float = 1.0, spent: DataFrame | None = None) -> DataFrame:
    """One row: the mean cost of the smoke calls times the planned ones (times a factor, plus what is spent), and
    whether that is OVER the cap or WITHIN it."""
    per = smoke.agg(F.coalesce(F.avg(F.coalesce(cost, F.lit(0.0))), F.lit(0.0)).alias("per_call"))
    used = spent.agg(F.coalesce(F.sum(F.coalesce(cost, F.lit(0.0))), F.lit(0.0)).alias("spent")) if spent is not None else per.select(F.lit(0.0).alias("spent"))
    both = per.join(F.broadcast(used)).withColumn("projected", F.col("per_call") * calls * factor + F.col("spent"))
    return both.withColumn("status", F.when(F.col("projected") > cap, "OVER").otherwise("WITHIN"))


def usage_sum(rows: DataFrame, by: list[str]) -> DataFrame:
    """Input and output tokens, cost to six places and calls per group."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(*by).agg(s("input_tokens").alias("input_tokens"), s("output_tokens").alias("output_tokens"), F.round(s("cost_usd"), 6).alias("cost_usd"), F.count("*").alias("calls"))


def manipulation_check(checks: DataFrame) -> DataFrame:
    """checks(expected, answer, …) with `right`: whether the answer, without surrounding white space, is the expected
    name; null without an answer."""
    return checks.withColumn("right", F.trim("answer") == F.col("expected"))


def call_meta(rows: DataFrame, pinned: Column, columns: list[str]) -> DataFrame:
    """Rows whose call metadata are null unless the run pins them."""
    return rows.withColumns({c: F.when(pinned, F.col(c)) for c in columns})


def failed_record(rows: DataFrame, call: Column, error: Column) -> DataFrame:
    """Calls that were billed but not scored, with at most 300 characters of why."""
    return rows.withColumn("call", call).withColumn("error", F.substring(error, 1, 300))


def average_rating(ratings: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of the leading integers of ratings, half up; what is no number counts as 0."""
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(value, r"^\s*([+-]?\d{1,9})", 1), F.lit("")), F.lit("S999999999")), F.lit(0))
    return ratings.groupBy(*by).agg(F.floor(F.avg(number.cast("double")) + 0.5).cast("int").alias("rating"))


def medians(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Rows, and the median, smallest and largest of each value, per group."""
    cells = [c for v in values for c in (F.percentile(v, 0.5).alias(f"{v}_median"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *cells)


def coverage(records: DataFrame, delivered: DataFrame) -> DataFrame:
    """records(task, error, indexed, parse_errors, seeds, hits), delivered(task, tokens, kept, offered) -> one row:
    tasks, indexed, failed and partly parsed ones, tasks with a seed, a hit and a delivered entity, medians of hits,
    offered entities and tokens, over all tasks and over those with any."""
    a = records.agg(
        F.count("*").alias("tasks"), F.count_if("indexed").alias("indexed"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), F.count_if(F.col("indexed") & (F.col("parse_errors") > 0)).alias("with_parse_errors"),
        F.count_if(F.col("seeds") > 0).alias("with_seeds"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.sum("hits").alias("hits"), F.percentile("hits", 0.5).alias("hits_median"),
    )
    b = delivered.agg(F.count_if(F.col("kept") > 0).alias("delivered"), F.percentile("offered", 0.5).alias("offered_median"), F.percentile("tokens", 0.5).alias("tokens_median"), F.percentile(F.when(F.col("tokens") > 0, F.col("tokens")), 0.5).alias("tokens_median_of_some"))
    return a.join(F.broadcast(b))


def failure_reasons(records: DataFrame) -> DataFrame:
    """(reason, n) of the failed: the first 90 characters up to a semicolon."""
    reason = F.substring(F.substring_index("error", ";", 1), 1, 90)
    return records.where(F.coalesce("error", F.lit("")) != "").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def file_pools(pools: DataFrame, trees: DataFrame, shown: DataFrame, cap: int = 60) -> DataFrame:
    """pools(task, path), trees(task, path), shown(task, path) -> one row a task with a pool: files and source files of
    the pool and of the whole repository, the pool's share of its sources, whether the pool reached the cap, files
    that were shown, and whether the pool holds them all."""
    source = F.col("path").rlike(r"\.(py|js|java|c)$")
    size = lambda df, name: df.groupBy("task").agg(F.countDistinct("path").alias(name), F.countDistinct(F.when(source, F.col("path"))).alias(f"{name}_src"))
    held = shown.select("task", "path").distinct().join(pools.select("task", "path").distinct().withColumn("_in", F.lit(1)), ["task", "path"], "left")
    held = held.groupBy("task").agg(F.count("*").alias("shown"), F.count("_in").alias("_held"))
    out = size(pools, "pool").join(size(trees, "repo"), "task", "left").join(held, "task", "left").fillna(0, ["shown", "_held"])
    share = F.when(F.col("repo_src") > 0, F.col("pool_src") / F.col("repo_src"))
    return out.select("task", "pool", "pool_src", "repo", "repo_src", share.alias("share"), (F.col("pool") >= cap).alias("at_cap"), "shown", (F.col("_held") == F.col("shown")).alias("holds_shown"))


def defect_last(lines: Column, defect: Column) -> Column:
    """Whether the defect is the last of a diff's changed lines."""
    return F.forall(lines, lambda l: l <= defect)


AUDIT = "task_id string, status string, import_resolves boolean, distractors_changing_tree int, defect_last boolean"
_CHANGE = re.compile(r"^@@ -(\d+),1 \+\d+,1 @@\n-(.*)\n\+(.*)$", re.M)


def _tree(source: str) -> str | None:
    try:
        return ast.dump(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError):
        return None


def audit_tasks(tasks: DataFrame) -> DataFrame:
    """tasks(task_id, defect_path, defect_line, diff, defect_text, caller_path, caller_text, name) -> one row a task:
    its status (null if it could be read), whether the caller imports `name` or its module from the defect's file, how
    many of the harmless changes change the syntax tree after all, and whether the defect is the last change."""
    def bound(r) -> bool:
        module = re.sub(r"(/__init__)?\.py$", "", r["defect_path"]).replace("/", ".")
        folder = re.sub(r"(/__init__)?\.py$", "", r["caller_path"]).split("/")[: None if r["caller_path"].endswith("__init__.py") else -1]
        fits = lambda m: bool(m) and (module == m or module.endswith("." + m))
        for t in python_tags(r["caller_text"]):
            if t["kind"] == "import":
                base = folder[: len(folder) - (t["level"] - 1)] if t["level"] else []
                m = ".".join([*base, *([t["module"]] if t["module"] else [])])
                symbol = t.get("imported")
                if symbol is None and fits(m) or symbol in (r["name"], "*") and fits(m) or symbol is not None and fits(f"{m}.{symbol}" if m else symbol):
                    return True
        return False

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                if not isinstance(r["defect_text"], str) or not isinstance(r["caller_text"], str):
                    rows.append((r["task_id"], "sources missing", None, None, None))
                    continue
                base = _tree(r["defect_text"])
                if base is None or _tree(r["caller_text"]) is None:
                    rows.append((r["task_id"], "unparseable", None, None, None))
                    continue
                lines, bad, last = r["defect_text"].split("\n"), 0, True
                for at, before, after in _CHANGE.findall(r["diff"] or ""):
                    at = int(at)
                    last = last and at <= r["defect_line"]
                    if at != r["defect_line"]:
                        same = at <= len(lines) and lines[at - 1] == before
                        bad += not same or _tree("\n".join([*lines[: at - 1], after, *lines[at:]])) != base
                rows.append((r["task_id"], None, bound(r), bad, last))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in AUDIT.split(", ")]).astype({"distractors_changing_tree": "Int32"})

    return tasks.select("task_id", "defect_path", "defect_line", "diff", "defect_text", "caller_path", "caller_text", "name").mapInPandas(run, AUDIT)


def audit_summary(audits: DataFrame, by: list[str]) -> DataFrame:
    """Per group: tasks, unresolved imports, tasks with a harmless change that is none, and defects that come last."""
    return audits.groupBy(*by).agg(
        F.count("*").alias("tasks"), F.count_if(~F.col("import_resolves")).alias("unresolved"), F.count_if(F.col("distractors_changing_tree") > 0).alias("tree_changing"), F.count_if("defect_last").alias("defect_last"), F.count_if(F.col("status").isNotNull()).alias("unread")
    )


def flipped(tests: DataFrame, by: list[str]) -> DataFrame:
    """tests(by…, test, passed_before, passed_after) -> per group: tests that passed and then failed, and the status."""
    s = tests.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if("passed_before").alias("passed_before"), F.count_if(F.col("passed_before") & (F.col("passed_after") == False)).alias("n_flipped"))  # noqa: E712
    status = F.when(F.col("passed_before") == 0, "no passing tests before mutation").when(F.col("n_flipped") > 0, "test-verified").otherwise("not caught by selected tests")
    return s.withColumn("status", status).drop("_n")


def select_tests(files: DataFrame, words: DataFrame, limit: int = 10) -> DataFrame:
    """files(repo, path, text), words(task_id, repo, words array) -> (task_id, path, score, rank): the test files that
    have a task's words most often, as whole words; later paths first among equals.

    Test files are split into tokens once, and a task meets only the files that have the first token of one of its
    words; a word without letters and digits meets all.  In these the words are counted as they are written."""
    tests = files.where(F.col("path").rlike(r"(^|/)test_[^/]*\.py$")).select("repo", "path", "text")
    token = r"(?U)\w+"
    known = tests.select("repo", "path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(token), 0)))).alias("_token"))
    asked = words.select("task_id", "repo", F.explode(F.array_distinct(F.transform("words", lambda w: F.regexp_extract(w, token, 0)))).alias("_token"))
    # Texts that repeat make small shuffles, which adaptive execution would join to few large tasks.
    pairs = spread(asked.join(known, ["repo", "_token"]).select("task_id", "repo", "path"), "repo", "path").distinct()
    pattern = F.concat(F.lit(r"(?U)\b(?:\Q"), F.array_join("words", r"\E|\Q"), F.lit(r"\E)\b"))
    scored = pairs.join(words, ["task_id", "repo"]).join(spread(tests, "repo", "path"), ["repo", "path"]).withColumn("score", F.regexp_count("text", pattern)).where("score > 0")
    order = W.partitionBy("task_id").orderBy(F.desc("score"), F.desc("path"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("task_id", "path", "score", "rank")


def production_files(files: DataFrame, cap: int, skip: list[str]) -> DataFrame:
    """files(repo, path, size) -> (repo, path, rank): Python files of 800 to 200,000 bytes outside tests and the
    skipped folders, whole folders with most files first, up to `cap` a repository."""
    parts = F.split("path", "/")
    name = F.substring_index("path", "/", -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    rows = files.where(F.endswith("path", F.lit(".py")) & (F.col("size") > 800) & (F.col("size") < 200_000)).where(~F.arrays_overlap(folders, F.array(*map(F.lit, skip))) & ~F.startswith(name, F.lit("test_")) & ~name.isin("setup.py", "conftest.py"))
    rows = rows.withColumn("_dir", F.array_join(folders, "/")).withColumn("_n", F.count("*").over(W.partitionBy("repo", "_dir")))
    order = W.partitionBy("repo").orderBy(F.desc("_n"), "_dir", "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("repo", "path", "rank")


def fix_commits(commits: DataFrame, include: str, exclude: str, limit: int, max_files: int = 2) -> DataFrame:
    """commits(repo, ord, sha, subject, files array, introduced array) -> the first `limit` a repository whose subject
    says fix and not else, that touch one to `max_files` source files besides tests, and whose faults were introduced
    by commits with other files."""
    source = F.filter("files", lambda f: F.endswith(f, F.lit(".py")) & ~f.rlike(TEST_PATH_ANY))
    rows = commits.where(F.col("subject").rlike("(?i)" + include) & ~F.col("subject").rlike("(?i)" + exclude)).withColumn("fixed", source)
    rows = rows.where((F.size("fixed") > 0) & (F.size("fixed") <= max_files) & (F.size(F.array_except("introduced", "fixed")) > 0))
    order = W.partitionBy("repo").orderBy("ord")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit).drop("_k")


def collect_sources(first: DataFrame, links: DataFrame, known: DataFrame, hops: int = 1, cap: int = 60) -> DataFrame:
    """first(task, pos, path), links(path, target, pos) of imports, known(path) -> (task, path, hop): the diff's files
    and then, hop by hop, the known files that they import and that were not tried before, at most `cap` a task."""
    exists = known.select("path").distinct()
    rank = lambda order: F.row_number().over(W.partitionBy("task").orderBy(*order))
    front = first.join(exists, "path", "left_semi").groupBy("task", "path").agg(F.min("pos").alias("pos"))
    front = materialize(front.withColumn("pos", rank(["pos", "path"])).where(F.col("pos") <= cap).withColumn("hop", F.lit(0)), "fetched")
    out = front
    for hop in range(1, hops + 1):
        held = out.groupBy("task").agg(F.count("*").alias("_held"))
        found = front.select("task", F.col("path").alias("_from"), F.col("pos").alias("_p")).join(links.select(F.col("path").alias("_from"), F.col("target").alias("path"), F.col("pos").alias("_q")), "_from")
        new = found.groupBy("task", "path").agg(F.min(F.struct("_p", "_q")).alias("by")).join(out.select("task", "path"), ["task", "path"], "left_anti").join(exists, "path", "left_semi")
        new = new.withColumn("pos", rank(["by", "path"])).join(held, "task").where(F.col("pos") <= cap - F.col("_held"))
        front = materialize(new.select("task", "path", "pos", F.lit(hop).alias("hop")).select(*front.columns), "fetched")
        if front.isEmpty():
            break
        out = out.union(front)
    return out.select("task", "path", "hop")


@F.pandas_udf(T.BooleanType())
def parses(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _tree(t) is not None, na_action="ignore")


def matrix_cells(models: DataFrame, seeds: list[int], conditions: list[str], depths: list[int], budget: int, graph: str = "B", whole: str = "E") -> DataFrame:
    """models(…) -> a row for each model, seed and condition, and for the graph condition each depth; other conditions
    have no depth, and whole files no budget."""
    kinds = [(c, d) for c in conditions for d in (depths if c == graph else [None])]
    cell = lambda c, d: F.struct(F.lit(c).alias("condition"), F.lit(d).cast("int").alias("depth"), F.lit(None if c == whole else budget).cast("int").alias("budget"))
    rows = models.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("_c", F.explode(F.array(*[cell(*k) for k in kinds])))
    return rows.select("*", "_c.*").drop("_c")


def matrix_cost(cells: DataFrame, usage: DataFrame, by: list[str]) -> DataFrame:
    """cells(by…, input_1k, output_1k) and one row of usage(input_tokens, output_tokens, tasks), the tokens of a task on
    average -> (by…, cells, runs, input_tokens, output_tokens, cost) of running every task in every cell."""
    every = cells.join(F.broadcast(usage))
    cost = F.col("tasks") * (F.col("input_tokens") * F.col("input_1k") + F.col("output_tokens") * F.col("output_1k")) / 1000
    return every.groupBy(*by).agg(F.count("*").alias("cells"), F.sum("tasks").alias("runs"), F.sum(F.col("tasks") * F.col("input_tokens")).alias("input_tokens"), F.sum(F.col("tasks") * F.col("output_tokens")).alias("output_tokens"), F.sum(cost).alias("cost"))
