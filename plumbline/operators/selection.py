"""Selections that an order or a rule decides: agents' turns, validation samples, symbol seeds, first items that qualify."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..tables import materialize

# The tools of an agent and the kinds of symbols that are seeds.
SEARCH, READ = "search_code", "read_file"
SEED_KINDS = ("function", "class")


def transcripts(turns: DataFrame, callers: DataFrame, max_turns: int = 8) -> DataFrame:
    """turns(task, condition, turn from 1, error, text, input_tokens, output_tokens, calls array<struct<name, query, path,
    output>>) of agents and callers(task, caller_path) -> one row an agent: turns, tool_calls, searches, reads,
    searched_at_all, found_the_caller, first_found (the turn that did), input_tokens, output_tokens, text, error.

    An agent ends with its first turn that fails or calls no tool, or after max_turns; later turns do not count.  The
    turn that fails has no usage.  The caller is found by a search whose output names it, or by reading a path that
    ends like it."""
    rows = turns.where(F.col("turn") <= max_turns).join(callers.select("task", F.coalesce("caller_path", F.lit("")).alias("_caller")), "task", "left")
    calls = F.coalesce("calls", F.array().cast(dict(turns.dtypes)["calls"]))
    last = F.col("error").isNotNull() | (F.size(calls) == 0)
    own = W.partitionBy("task", "condition")
    rows = rows.withColumn("_end", F.min(F.when(last, F.col("turn"))).over(own)).where(F.col("_end").isNull() | (F.col("turn") <= F.col("_end")))
    known = F.coalesce("_caller", F.lit("")) != ""
    hit = lambda c: known & F.when(c["name"] == SEARCH, F.contains(F.coalesce(c["output"], F.lit("")), F.col("_caller"))).when(c["name"] == READ, F.endswith(F.coalesce(c["path"], F.lit("")), F.col("_caller")) | F.endswith(F.col("_caller"), F.coalesce(c["path"], F.lit("")))).otherwise(False)
    ended = F.col("turn") == F.col("_end")
    used = F.col("error").isNull()
    count = lambda name: F.sum(F.when(used, F.size(F.filter(calls, lambda c: F.lit(True) if name is None else c["name"] == name))).otherwise(0)).cast("long")
    out = rows.groupBy("task", "condition").agg(
        F.max("turn").alias("turns"), count(None).alias("tool_calls"), count(SEARCH).alias("searches"), count(READ).alias("reads"),
        F.min(F.when(used & F.exists(calls, hit), F.col("turn"))).alias("first_found"),
        F.sum(F.when(used, F.col("input_tokens"))).alias("input_tokens"), F.sum(F.when(used, F.col("output_tokens"))).alias("output_tokens"),
        F.max(F.when(ended & used, F.col("text"))).alias("text"), F.max(F.when(ended, F.col("error"))).alias("_error"), F.max("_end").alias("_end"),
    )
    error = F.when(F.col("_end").isNull(), F.lit(f"did not finish within {max_turns} turns")).otherwise(F.col("_error"))
    return out.select("task", "condition", "turns", "tool_calls", "searches", "reads", (F.col("searches") > 0).alias("searched_at_all"), F.col("first_found").isNotNull().alias("found_the_caller"), "first_found", "input_tokens", "output_tokens", "text", error.alias("error"))


def validation_sample(targets: DataFrame, callers: DataFrame, per_repo: int = 50, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """targets(repo, file, name) and callers(repo, file, name, caller) -> (sample, summary).

    Targets are drawn in the order of a hash until a repository has per_repo with callers.  sample(repo, file, name,
    callers, unique_name) has those; summary(repo, definitions, sampled_with_callers, sampled_without_callers,
    unique_name_targets) also counts the drawn ones without.  The smallest hashes of parts of a repository are merged,
    so that no task orders all of it; the others are only compared with where the draw stopped."""
    key = ["repo", "file", "name"]
    named = targets.groupBy("repo", "name").agg((F.count("*") == 1).alias("unique_name"))
    listed = callers.groupBy(*key).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    place = F.struct(hash32(F.lit(seed), *[F.col(c) for c in key]).alias("h"), "file", "name")
    drawn = targets.select(*key).distinct().join(listed, key, "left").withColumn("place", place)
    drawn = materialize(drawn.join(named, ["repo", "name"]), "drawn")
    hits = drawn.where("callers is not null")
    part = hits.withColumn("_part", F.pmod(F.col("place.h"), F.lit(64)))
    part = part.withColumn("_k", F.row_number().over(W.partitionBy("repo", "_part").orderBy("place"))).where(F.col("_k") <= per_repo)
    sample = part.withColumn("_k", F.row_number().over(W.partitionBy("repo").orderBy("place"))).where(F.col("_k") <= per_repo)
    sample = materialize(sample.select(*key, "callers", "unique_name", "place"), "sample")
    stop = sample.groupBy("repo").agg(F.count("*").alias("sampled_with_callers"), F.count_if("unique_name").alias("unique_name_targets"), F.max("place").alias("_last"))
    whole = drawn.join(stop, "repo", "left")
    before = F.col("callers").isNull() & ((F.coalesce("sampled_with_callers", F.lit(0)) < per_repo) | (F.col("place") < F.col("_last")))
    summary = whole.groupBy("repo").agg(F.count("*").alias("definitions"), F.coalesce(F.max("sampled_with_callers"), F.lit(0)).alias("sampled_with_callers"), F.count_if(before).alias("sampled_without_callers"), F.coalesce(F.max("unique_name_targets"), F.lit(0)).alias("unique_name_targets"))
    return sample.drop("place"), summary


def kind_of_text(text: Column) -> Column:
    """class, function or other, by the first line of a source that is neither empty nor a decorator; null if none is."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("@")))
    first = F.get(lines, F.lit(0))
    return F.when(F.startswith(first, F.lit("class ")), "class").when(first.rlike(r"^(async )?def "), "function").when(first.isNotNull(), "other")


def symbol_seeds(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """symbols(task, identity, qualified_name, path, kind, text, first, last) of an outside index and changed(task, path,
    first, last) -> (task, rank, identity, qualified_name, path, kind) of the seeds.

    A function or class that a changed range touches is a seed, its kind read from its source where none is given; a
    class is none if something named below it is; an identity counts once, by its first place.  A changed file without
    a seed has its own node, last.  Names below a class are found by the prefixes that a seed's own name has, in one
    equi-join."""
    kind = F.when(F.coalesce("kind", F.lit("")) == "", kind_of_text(F.col("text"))).otherwise(F.lower("kind"))
    known = symbols.withColumn("kind", kind)
    spans = changed.select("task", "path", F.col("first").alias("_from"), F.col("last").alias("_to"))
    found = known.where((F.col("qualified_name") != F.col("path")) & F.col("kind").isin(*SEED_KINDS)).join(spans, ["task", "path"])
    found = found.where((F.col("first") <= F.col("_to")) & (F.col("last") >= F.col("_from"))).select("task", "identity", "qualified_name", "path", "kind", "first", "last").distinct()
    found = materialize(found, "touched")
    parts = F.split("qualified_name", r"\.")
    above = found.select("task", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("_name"), F.col("qualified_name").alias("_own"))
    above = above.where("_name != _own").select("task", F.col("_name").alias("qualified_name")).distinct()
    kept = found.join(above, ["task", "qualified_name"], "left_anti")
    order = F.struct("first", (F.col("last") - F.col("first")).alias("n"), "qualified_name", "path", "kind")
    once = kept.groupBy("task", "identity").agg(F.min(order).alias("r")).select("task", "identity", F.lit(0).alias("_hub"), "r.*")
    bare = changed.select("task", "path").distinct().join(found.select("task", "path").distinct(), ["task", "path"], "left_anti")
    hubs = symbols.where(F.col("qualified_name") == F.col("path")).join(bare, ["task", "path"]).groupBy("task", "path").agg(F.min("identity").alias("identity"))
    hubs = hubs.select("task", "identity", F.lit(1).alias("_hub"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.col("path").alias("qualified_name"), "path", F.lit("file").alias("kind"))
    rows = once.unionByName(hubs)
    rank = F.row_number().over(W.partitionBy("task").orderBy("_hub", "first", "n", "qualified_name", "identity"))
    return rows.select("task", rank.alias("rank"), "identity", "qualified_name", "path", "kind")


def first_qualifying(items: DataFrame, order: str, qualifies: Callable[[DataFrame], DataFrame], k: int, block: int = 64) -> DataFrame:
    """The first k items, by the unique column `order`, that `qualifies` keeps, with what it adds to them.

    Items are taken in blocks of that order, each four times as large as the one before, until k are found; so the
    predicate, which may be dear, is not evaluated on more than about four times the items that had to be seen.  The
    driver holds the order of a block's last item and counts."""
    kept, found, last = None, 0, None
    while found < k:
        rest = items if last is None else items.where(F.col(order) > F.lit(last))
        taken = materialize(rest.orderBy(order).limit(block), "block")
        seen, last_seen = taken.agg(F.count("*"), F.max(order)).first()
        if not seen:
            break
        good = materialize(qualifies(taken.repartition(min(seen, 64))), "qualified")
        found += good.count()
        kept = good if kept is None else kept.unionByName(good)
        if seen < block:
            break
        last, block = last_seen, block * 4
    if kept is None:
        kept = qualifies(items.limit(0))
    return kept.orderBy(order).limit(k)


def folders(files: DataFrame) -> DataFrame:
    """files(repo, path, bytes) -> (repo, folder, depth, files, bytes, children): every folder with all that lies below
    it, and the names that lie in it.  A file counts for each folder above it, so one aggregation folds the tree; the
    top has an empty name."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder"), F.get(parts, n).alias("child")))
    rows = files.select("repo", "bytes", F.explode(steps).alias("s")).select("repo", "bytes", "s.*")
    return rows.groupBy("repo", "folder", "depth").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_set("child")).alias("children"))


def structure(files: DataFrame) -> DataFrame:
    """files(repo, path, info) -> (repo, structure): the nested JSON object of each repository, folders as objects of
    their children by name and files as their info, which is JSON.

    It is folded from the deepest level up: at each level the children of a folder become its object, and only a
    folder's own object goes on."""
    parts = F.split("path", "/")
    rows = files.select("repo", F.slice(parts, 1, F.size(parts) - 1).alias("folders"), F.get(parts, F.size(parts) - 1).alias("name"), F.coalesce("info", F.lit("{}")).alias("info"))
    rows = materialize(rows.withColumn("depth", F.size("folders")), "level")
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    key = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'))
    for depth in range(deepest, -1, -1):
        here, above = rows.where(F.col("depth") == depth), rows.where(F.col("depth") < depth)
        entries = F.transform(F.array_sort(F.collect_list(F.struct("name", "info"))), lambda e: F.concat(key(e["name"]), e["info"]))
        made = here.groupBy("repo", "folders").agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("info"))
        if depth == 0:
            return made.select("repo", F.col("info").alias("structure"))
        up = made.select("repo", F.slice("folders", 1, depth - 1).alias("folders"), F.get("folders", F.lit(depth - 1)).alias("name"), "info", F.lit(depth - 1).alias("depth"))
        rows = materialize(above.unionByName(up), "level")
