"""Benchmark tasks from repositories: a change in one file that another file depends on, or verifiably does not.

Definitions meet their callers by joins on resolved imports, so a task sees one pair of files, never a repository;
each file is mutated once, each pair is verified once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mutate import CHAINS, TWINS, VERIFIED, dependency, distractors, mutations, pass_through, robustness
from ..functions.text import is_test_path
from ..tables import materialize
from .codegraph import definitions, import_table, reachable

TASK = "repo defect_id kind definition_path name line caller_path caller_line before after evidence argument distractors via_path via_line via_name".split()


def build_diff(path: Column, line: Column, before: Column, after: Column, others: Column) -> Column:
    """A diff of single-line hunks in the order of their lines: the change and the others."""
    changes = F.array_sort(F.concat(others, F.array(F.struct(line.cast("int").alias("line"), before.alias("before"), after.alias("after")))))
    hunk = lambda c: F.concat(F.lit("@@ -"), c["line"].cast("string"), F.lit(",1 +"), c["line"].cast("string"), F.lit(",1 @@\n-"), c["before"], F.lit("\n+"), c["after"], F.lit("\n"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"))
    return F.concat(head, F.array_join(F.transform(changes, hunk), ""))


def callers(sources: DataFrame, tags: DataFrame) -> DataFrame:
    """(repo, definition_path, name, caller_path, alias): functions and the other files, no tests, that import and call
    them; alias is the name under which the module is known there, null if the function itself is."""
    files = sources.select("repo", "path")
    names, _ = import_table(files, tags)
    names, defs = materialize(names, "imports"), materialize(definitions(tags), "definitions")
    via = reachable(defs, names).where("kind = 'function'")
    called = tags.where("kind = 'call'").select("repo", F.col("file").alias("caller_path"), "name", "receiver").distinct()
    bare = called.where("receiver is null").join(names.where("symbol is not null").select("repo", F.col("file").alias("caller_path"), F.col("local").alias("name"), F.col("target").alias("file"), "symbol"), ["repo", "caller_path", "name"])
    bare = bare.where("symbol = name").join(via.select("repo", "file", "name", "key"), ["repo", "file", "name"]).select("repo", F.substring_index("key", "::", 1).alias("definition_path"), "name", "caller_path", F.lit(None).cast("string").alias("alias"))
    whole = called.where("receiver is not null").join(names.where("symbol is null").select("repo", F.col("file").alias("caller_path"), F.col("local").alias("receiver"), F.col("target").alias("definition_path")), ["repo", "caller_path", "receiver"])
    whole = whole.join(defs.where("kind = 'function'").select("repo", F.col("file").alias("definition_path"), "name"), ["repo", "definition_path", "name"]).select("repo", "definition_path", "name", "caller_path", F.col("receiver").alias("alias"))
    both = bare.union(whole).distinct().where("caller_path != definition_path")
    return both.where(~is_test_path(F.col("caller_path"), True) & ~is_test_path(F.col("definition_path"), True))


def mutated(sources: DataFrame) -> DataFrame:
    """(repo, definition_path, name, kind, line, before, after, detail) of all mutations of Python files but tests."""
    python = sources.where(F.endswith("path", F.lit(".py")) & ~is_test_path(F.col("path"), True))
    return python.select("repo", F.col("path").alias("definition_path"), F.explode(mutations("text")).alias("m")).select("repo", "definition_path", "m.*")


def _text(sources: DataFrame, path: str, name: str) -> DataFrame:
    return sources.select("repo", F.col("path").alias(path), F.col("text").alias(name))


def _first(rows: DataFrame, sources: DataFrame, suffix: str, least: int, limit: int) -> DataFrame:
    """The first verified caller of each mutation with enough distractors, `limit` a repository, with their diff."""
    key = ["repo", "definition_path", "name", "kind", "line"]
    order = F.struct("caller_path", "caller_line", *[F.col(c) for c in ("before", "after", "evidence", "argument", "via_path", "via_line", "via_name")])
    once = rows.groupBy(*key).agg(F.min(order).alias("r")).select(*key, "r.*")
    seed = F.concat_ws(":", "definition_path", "line")
    once = once.join(_text(sources, "definition_path", "_text"), ["repo", "definition_path"]).withColumn("distractors", distractors("_text", "line", seed)).drop("_text").where(F.size("distractors") >= least)
    once = once.withColumn("defect_id", F.concat(F.concat_ws("::", "definition_path", "name", "kind", "line"), F.lit(suffix)))
    w = W.partitionBy("repo").orderBy("definition_path", "line", "kind", "name")
    once = once.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).select(*TASK)
    return once.withColumn("diff", build_diff(F.col("definition_path"), F.col("line"), F.col("before"), F.col("after"), F.col("distractors")))


def _pairs(sources: DataFrame, pairs: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(pairs, ["repo", "definition_path", "name"]).join(_text(sources, "caller_path", "_caller"), ["repo", "caller_path"])


def _found(rows: DataFrame, rule) -> DataFrame:
    """rows with what the rule finds in the caller as caller_line, evidence and argument, those without it left out."""
    rows = rows.withColumn("_e", rule("_caller", "name", "alias", "kind", "detail")).where("_e.line is not null")
    return rows.select("*", F.col("_e.line").alias("caller_line"), F.col("_e.text").alias("evidence"), F.col("_e.argument").alias("argument")).drop("_e")


def _no_via(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"via_path": F.lit(None).cast("string"), "via_line": F.lit(None).cast("int"), "via_name": F.lit(None).cast("string")})


def find_defects(sources: DataFrame, tags: DataFrame, limit: int = 3, kinds=VERIFIED, least: int = 2) -> DataFrame:
    """Mutations that a caller in another file depends on: (repo, defect_id, kind, definition_path, name, line, caller_path,
    caller_line, before, after, evidence, argument, distractors, via_*, diff)."""
    changes = materialize(mutated(sources).where(F.col("kind").isin(*kinds)), "mutations")
    rows = _found(_pairs(sources, materialize(callers(sources, tags), "callers"), changes), dependency)
    return _first(_no_via(rows), sources, "", least, limit)


def find_twins(sources: DataFrame, tags: DataFrame, limit: int = 8, kinds=TWINS, least: int = 2) -> DataFrame:
    """Mutations that a caller verifiably does not mind and on which no call of the repository's other files depends:
    resolved ones, those of the file itself, and those of an attribute of the name, whatever it belongs to."""
    changes = materialize(mutated(sources).where(F.col("kind").isin(*kinds)), "mutations")
    pairs = materialize(callers(sources, tags), "callers")
    named = tags.where("kind = 'call'").select("repo", F.col("file").alias("caller_path"), "name", F.col("receiver").isNotNull().alias("_attribute")).distinct()
    wanted = changes.select("repo", "definition_path", "name").distinct().join(named, ["repo", "name"])
    wanted = wanted.where("_attribute or caller_path = definition_path").where(~is_test_path(F.col("caller_path"), True)).select("repo", "definition_path", "name", "caller_path", F.when(F.col("_attribute") | (F.col("caller_path") == F.col("definition_path")), F.lit("*")).alias("alias")).distinct()
    key = ["repo", "definition_path", "name", "kind", "line"]
    unsafe = _found(_pairs(sources, pairs.union(wanted.select(pairs.columns)), changes), dependency).select(*key).distinct()
    rows = _found(_pairs(sources, pairs, changes.join(materialize(unsafe, "unsafe"), key, "left_anti")), robustness)
    return _first(_no_via(rows), sources, "::safe", least, limit)


def find_chains(sources: DataFrame, tags: DataFrame, limit: int = 8, kinds=CHAINS, least: int = 2) -> DataFrame:
    """Mutations on which a caller depends through a function of a second file that returns the result as it is."""
    changes = materialize(mutated(sources).where(F.col("kind").isin(*kinds)), "mutations")
    pairs = materialize(callers(sources, tags), "callers")
    through = _found(_pairs(sources, pairs, changes), pass_through).where(~F.startswith("argument", F.lit("_")))
    through = through.select("repo", "kind", "line", "before", "after", "detail", F.col("definition_path").alias("_path"), F.col("name").alias("_name"), F.col("caller_path").alias("definition_path"), F.col("caller_line").alias("via_line"), F.col("argument").alias("name"))
    ends = _found(_pairs(sources, pairs, materialize(through, "through")).where("caller_path != _path"), dependency)
    ends = ends.withColumns({"via_path": F.col("definition_path"), "via_name": F.col("name")}).drop("definition_path", "name").withColumnsRenamed({"_path": "definition_path", "_name": "name"})
    return _first(ends, sources, "::hop2", least, limit)


def resume(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that an earlier run has not written."""
    return planned.join(done.select("repo", "defect_id").distinct(), ["repo", "defect_id"], "left_anti")
