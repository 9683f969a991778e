"""Context retrieval over code graphs: seeds, walks, selection by condition and payloads within a token budget.

All of it runs for a table of queries at once.  nodes(repo, id, type, name, relative_path, first, last, ord), edges
(repo, src, dst, label), sources(repo, path, text) as codegraph.build() gives them; queries(query, repo, node), where
node holds one seed a line: path, path::type or path::type::name."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hex32
from ..functions.text import TEST_PATH, entity_source
from ..tables import materialize, spread
from .codegraph import matches

#: Conditions: none, graph, random, lexical, whole file, fault location, dense.
CONDITIONS = tuple("ABCDEFG")
NEIGHBOURS, DEPTH, LINES, BUDGET = 12, 2, 40, 1500
ENTRY = ("id", "name", "type", "relative_path")


def seeds(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, repo, pos, id): for each line of a query the first node that fits it; lines without one are left out."""
    asked = queries.select("query", "repo", F.posexplode(F.filter(F.transform(F.split(F.coalesce("node", F.lit("")), "\n"), lambda l: F.trim(l)), lambda l: l != "")).alias("pos", "line"))
    parts = F.split("line", "::")
    asked = asked.select("query", "repo", "pos", parts[0].alias("relative_path"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("q_type"), F.get(parts, F.lit(2)).alias("q_name"))
    fits = matches(F.col("relative_path"), F.col("type"), F.col("name"), F.col("relative_path"), F.col("q_type"), F.col("q_name"))
    found = asked.join(nodes.select("repo", "id", "type", "name", "relative_path", "ord"), ["repo", "relative_path"]).where(fits)
    return found.groupBy("query", "repo", "pos").agg(F.min(F.struct("ord", "id"))["id"].alias("id"))


def steps(edges: DataFrame) -> DataFrame:
    """(repo, id, to, way): neighbours of a vertex once each, those that point to it (way 0) before others (1)."""
    there = edges.select("repo", F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(0).alias("way"))
    back = edges.select("repo", F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(1).alias("way"))
    return there.union(back).groupBy("repo", "id", "to").agg(F.min("way").alias("way"))


#: Vertices of a query, and neighbours of a vertex, that rows carry along as arrays; vertices of one block of a join.
FEW, BLOCK = 64, 512


def walk(nodes: DataFrame, edges: DataFrame, found: DataFrame, depth: int = DEPTH, types: list[str] | None = None, exclude_tests: bool = False, limit: int | None = None) -> DataFrame:
    """(query, repo, id, depth, pos): breadth first from all seeds of a query at once, along and against the edges.

    pos numbers the vertices in the order of discovery: by depth, by the vertex that leads there, callers before
    callees, then by node order; a query's first `limit` are kept.  Vertices of other types, and in test files if
    these are excluded, are neither given nor walked through; seeds are not given.  Each level but the last is a table."""
    allowed = nodes.select("repo", F.col("id").alias("to"), "ord", "type", "relative_path")
    allowed = allowed.where(F.col("type").isin(types)) if types else allowed
    allowed = allowed.where(~F.col("relative_path").rlike(TEST_PATH)) if exclude_tests else allowed
    step = _blocked(steps(edges).join(allowed.select("repo", "to", "ord"), ["repo", "to"]))
    front = found.groupBy("query", "repo", "id").agg(F.min("pos").alias("pos"))
    seen = front = materialize(front.select("query", "repo", "id", "pos").withColumn("depth", F.lit(0)), "walk")
    for d in range(1, depth + 1):
        front = _next_level(front, seen, step).select("query", "repo", "id", F.row_number().over(W.partitionBy("query").orderBy("by", "id")).alias("pos"), F.lit(d).alias("depth"))
        # What comes after the first `limit` of a level is not among the first of all, nor is what it leads to.
        front = front.where(F.col("pos") <= limit) if limit else front
        if d < depth:
            front = materialize(front, "walk")
            if front.isEmpty():
                break
        seen = seen.union(front)
    out = seen.where("depth > 0").withColumn("pos", F.row_number().over(W.partitionBy("query").orderBy("depth", "pos")))
    return out.where(F.col("pos") <= limit) if limit else out


def _blocked(step: DataFrame) -> DataFrame:
    """step as a table, a vertex's neighbours in blocks of about BLOCK, with all that lead to a neighbour as `froms`
    where these are at most FEW, else null."""
    step = materialize(step, "steps")
    few = step.groupBy("repo", "to").agg(F.count("*").alias("_n")).where(F.col("_n") <= FEW).select("repo", "to")
    froms = step.join(few, ["repo", "to"]).groupBy("repo", "to").agg(F.collect_list("id").alias("froms"))
    blocks = step.groupBy("repo", "id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    step = step.join(froms, ["repo", "to"], "left").join(blocks, ["repo", "id"])
    return materialize(step.withColumn("block", F.pmod(F.xxhash64("to"), F.col("blocks")).cast("int")), "steps")


def _next_level(front: DataFrame, seen: DataFrame, step: DataFrame) -> DataFrame:
    """(query, repo, id, by): what the front leads to and was not seen, by its first step (pos, way, ord).

    A pair of query and vertex is met once for each vertex that leads there.  Queries that have seen few vertices carry
    them along, so that of a vertex with few neighbours they keep the first meeting at once, and nothing is dealt
    anew: pairs may be as many as queries times vertices.  All other meetings are grouped."""
    few = seen.groupBy("query", "repo").agg(F.count("*").alias("_n")).where(F.col("_n") <= FEW).select("query", "repo")
    last = F.max("depth").over(W.partitionBy("query", "repo"))
    mine = seen.join(few, ["query", "repo"]).withColumn("_last", last).groupBy("query", "repo")
    mine = mine.agg(F.collect_list("id").alias("_seen"), F.collect_list(F.when(F.col("depth") == F.col("_last"), F.struct("pos", "id"))).alias("_front"))
    hubs = step.select("repo", "id", "blocks").distinct()
    rows = front.select("query", "repo", "id", "pos").join(mine, ["query", "repo"], "left").join(hubs, ["repo", "id"])
    ahead = F.transform(F.filter("_front", lambda x: x["pos"] < F.col("pos")), lambda x: x["id"])
    rows = rows.withColumn("_ahead", ahead).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "_front")
    met = spread(rows, "repo", "id", "block").join(spread(step.drop("blocks"), "repo", "id", "block"), ["repo", "id", "block"])
    by = F.struct("pos", "way", "ord").alias("by")
    alone = F.col("_seen").isNotNull() & F.col("froms").isNotNull()
    first = met.where(alone & ~F.array_contains("_seen", F.col("to")) & ~F.arrays_overlap("_ahead", "froms")).select("query", "repo", F.col("to").alias("id"), by)
    others = met.where(~alone).groupBy("query", "repo", F.col("to").alias("id")).agg(F.min(by).alias("by"))
    return first.union(others.join(seen.select("query", "repo", "id"), ["query", "repo", "id"], "left_anti"))


def ranked(nodes: DataFrame, edges: DataFrame, found: DataFrame, walked: DataFrame, limit: int, cross_file: bool = False, callers_first: bool = False) -> DataFrame:
    """A walk's first `limit` vertices a query, as (query, repo, id, depth, rank).  With callers_first, direct callers
    of a seed come first, then direct callees, then the rest of depth 1; with cross_file, files other than the seeds'
    come first within that."""
    out = walked
    calls = edges.where("label = 'calls'").select("repo", "src", "dst").distinct()
    here = found.select("query", "repo", F.col("id").alias("_seed")).distinct()
    callers = here.join(calls, (here["repo"] == calls["repo"]) & (F.col("_seed") == F.col("dst"))).select("query", F.col("src").alias("id"), F.lit(0).alias("_to"))
    callees = here.join(calls, (here["repo"] == calls["repo"]) & (F.col("_seed") == F.col("src"))).select("query", F.col("dst").alias("id"), F.lit(1).alias("_to"))
    near = callers.union(callees).groupBy("query", "id").agg(F.min("_to").alias("_to"))
    homes = found.join(nodes.select("repo", "id", "relative_path"), ["repo", "id"]).select("query", "relative_path").distinct().withColumn("_home", F.lit(1))
    out = out.join(near, ["query", "id"], "left").join(nodes.select("repo", "id", "relative_path"), ["repo", "id"]).join(homes, ["query", "relative_path"], "left")
    tier = F.when(F.col("depth") > 1, 3).otherwise(F.coalesce("_to", F.lit(2)))
    order = [tier if callers_first else F.lit(0), F.coalesce("_home", F.lit(0)) if cross_file else F.lit(0), F.col("depth") if cross_file or callers_first else F.lit(0), F.col("pos")]
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= limit)
    return out.select("query", "repo", "id", "depth", "rank")


def query_terms(node: Column) -> Column:
    """Lower-case terms of the last :: part of every line: runs of letters and digits, cut at capitals."""
    tails = F.transform(F.filter(F.split(node, "\n"), lambda l: F.trim(l) != ""), lambda l: F.substring_index(F.trim(l), "::", -1))
    words = F.flatten(F.transform(tails, lambda t: F.regexp_extract_all(t, F.lit(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"), 0)))
    return F.transform(words, lambda w: F.lower(w))


#: Letters of a term by whose beginning it looks up names, at most.
GRAM = 32


def lexical(nodes: DataFrame, queries: DataFrame, found: DataFrame, limit: int, types: list[str] | None = None) -> DataFrame:
    """(query, repo, id, rank): nodes of the query's repository whose names have most of its terms, shorter names and
    then smaller ids first; seeds and names without a term are left out.

    A term meets the names that hold it, in an equi-join on the names' parts of the lengths that terms have.  Nodes of
    one name are met in the order of their ids, in blocks, only as far as a query can keep them."""
    pool = _pool(nodes, types).select("repo", "id", F.lower("name").alias("low")).where("low != ''")
    cut = F.substring("_term", 1, GRAM)
    asked = queries.select("query", "repo", F.posexplode(query_terms(F.coalesce("node", F.lit("")))).alias("_k", "_term")).withColumn("_part", cut)
    lengths = asked.groupBy("repo", F.length("_part").alias("_n")).agg(F.lit(1).alias("_one")).drop("_one")
    names = spread(pool.select("repo", "low").distinct(), "repo", "low").join(lengths, "repo").where(F.length("low") >= F.col("_n"))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - F.col("_n") + 1), lambda i: F.substring("low", i, F.col("_n"))))
    held = names.select("repo", "low", F.explode(parts).alias("_part")).join(asked.select("repo", "_part").distinct(), ["repo", "_part"], "left_semi")
    named = asked.join(held, ["repo", "_part"]).where(F.contains("low", F.col("_term"))).groupBy("query", "repo", "low").agg(F.count("*").cast("int").alias("score"))
    place = F.row_number().over(W.partitionBy("repo", "low").orderBy("id")) - 1
    placed = pool.select("repo", "low", "id", F.floor(place / limit).alias("_block"))
    known = found.groupBy("query").agg(F.countDistinct("id").alias("_seeds"))
    last = F.floor(F.coalesce("_seeds", F.lit(0)) / limit) + 1
    named = named.join(known, "query", "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    scored = _without(named.join(placed, ["repo", "low", "_block"]).select("query", "repo", "id", "low", "score"), found)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.length("low"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "repo", "id", "score", "rank")


def _pool(nodes: DataFrame, types: list[str] | None) -> DataFrame:
    return nodes.where(F.col("type").isin(types)) if types else nodes


def _without(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select("query", "id").distinct(), ["query", "id"], "left_anti")


SLOTS = 256


def hashing_vector(text: str, slots: int = SLOTS) -> np.ndarray:
    """Counts of the character 3- and 4-grams of a lower-cased text in hashed slots, of unit length."""
    out, low = np.zeros(slots), text.lower()
    for size in (3, 4):
        for k in range(len(low) - size + 1):
            out[zlib.crc32(f"{size}{low[k : k + size]}".encode()) % slots] += 1
    norm = math.sqrt(float(out @ out))
    return out / norm if norm else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashing_embedder(text: pd.Series) -> pd.Series:
    return text.fillna("").map(lambda t: hashing_vector(t).tolist())


#: Nodes of a repository whose vectors are one matrix.
MATRIX = 16_384


def _best_of_matrix(limit: int):
    """Rows of blocks of repositories, sorted so that a block's nodes (id, v) come before its queries (query, v, seeds)
    -> each query's best nodes of the block.  A task holds one block's nodes, and queries only as they come."""
    names = ("query", "repo", "id", "score")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, parts, vectors, by_id = None, [], [], None, None
        for batch in batches:
            keys, a = list(zip(*(batch.column(n).to_pylist() for n in ("repo", "_block", "_asked")))), 0
            for (repo, block, asked), same in groupby(keys):
                rows = batch.slice(a, len(list(same)))
                a += rows.num_rows
                v = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                if not asked:
                    if held != (repo, block):
                        held, ids, parts, vectors = (repo, block), [], [], None
                    ids += rows.column("id").to_pylist()
                    parts.append(v)
                elif held == (repo, block):
                    if vectors is None:
                        vectors, parts = np.concatenate(parts).T, []
                        by_id = np.argsort(np.argsort(np.array(ids, object).astype(str), kind="stable"))
                    for k in range(0, rows.num_rows, 256):
                        out: list[tuple] = []
                        scores = np.round(v[k : k + 256] @ vectors, 9)
                        part = rows.slice(k, 256)
                        for query, seeds, row in zip(part.column("query").to_pylist(), part.column("seeds").to_pylist(), scores):
                            gone = set(seeds or ())
                            order = np.lexsort((by_id, -row))[: limit + len(gone)]
                            out += [(query, repo, ids[i], float(row[i])) for i in order if ids[i] not in gone][:limit]
                        columns = list(zip(*out)) or [()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "score" else batch.schema.field(n).type) for n, c in zip(names, columns)], names)

    return run


def dense(nodes: DataFrame, queries: DataFrame, found: DataFrame, limit: int, types: list[str] | None = None, embed=hashing_embedder) -> DataFrame:
    """(query, repo, id, score, rank): nodes of the query's repository by the cosine of the embeddings of their name,
    type and path and of the query's terms; equal scores by id, seeds are left out.

    The nodes of a repository are matrices of bounded size, each of which meets the repository's queries in one task,
    where they stream by, and gives its own best; these are merged."""
    pool = _pool(nodes, types).select("repo", "id", embed(F.concat_ws(" ", "name", "type", "relative_path")).alias("v"))
    blocks = _pool(nodes, types).groupBy("repo").agg(F.ceil(F.count("*") / MATRIX).cast("int").alias("_blocks"))
    terms = F.array_join(query_terms(F.coalesce("node", F.lit(""))), " ")
    seeds_ = found.groupBy("query").agg(F.collect_set("id").alias("seeds"))
    asked = queries.select("query", "repo", embed(F.when(terms != "", terms).otherwise(F.coalesce("node", F.lit("")))).alias("q")).join(seeds_, "query", "left")
    pool = pool.join(blocks, "repo").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks")
    asked = asked.join(blocks, "repo").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    kinds = {**dict(nodes.dtypes), **dict(queries.dtypes)}
    schema = f"query {kinds['query']}, repo {kinds['repo']}, id {dict(nodes.dtypes)['id']}, score double"
    rows = pool.withColumn("_asked", F.lit(False)).unionByName(asked.withColumnRenamed("q", "v").withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    rows = spread(rows, "repo", "_block").sortWithinPartitions("repo", "_block", "_asked")
    scored = rows.mapInArrow(_best_of_matrix(limit), schema)
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def random_matched(nodes: DataFrame, found: DataFrame, reference: DataFrame, types: list[str] | None = None, other_files: bool = False, exclude_tests: bool = False, seed: int = 0) -> DataFrame:
    """(query, repo, id, rank): as many random nodes of each type as `reference`(query, repo, id) has, not seeds; with
    other_files, of files without a seed.  The draw is the order of a hash of seed, query and id.

    Every node of the type is hashed for every query; only hashes below a bound, which holds more than enough of them
    nearly always, are dealt on.  Queries for which it does not are drawn again without a bound."""
    pool = _pool(nodes, types)
    pool = pool.where(~F.col("relative_path").rlike(TEST_PATH)) if exclude_tests else pool
    sizes = pool.groupBy("repo", "type").agg(F.count("*").alias("_size")).withColumn("_blocks", F.ceil(F.col("_size") / BLOCK).cast("int"))
    pool = pool.select("repo", "type", "id", "relative_path").join(sizes.drop("_size"), ["repo", "type"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks")
    pool = materialize(spread(pool, "repo", "type", "_block"), "pool")
    wanted = reference.join(nodes.select("repo", "id", "type"), ["repo", "id"]).groupBy("query", "repo", "type").agg(F.count("*").alias("n"))
    wanted = materialize(wanted.join(sizes, ["repo", "type"]), "wanted")
    homes = found.join(nodes.select("repo", "id", "relative_path"), ["repo", "id"]).select("query", "relative_path").distinct()

    def drawn(asked: DataFrame, bound: Column | None) -> DataFrame:
        digits = hex32(F.lit(seed), F.col("query"), F.col("id"))
        asked = asked.withColumn("_bound", bound) if bound is not None else asked
        asked = spread(asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))), "repo", "type", "_block")
        rows = asked.join(pool, ["repo", "type", "_block"])
        rows = rows.where(digits <= F.col("_bound")) if bound is not None else rows
        rows = _without(rows.select("query", "repo", "type", "n", "id", "relative_path", digits.alias("_d")), found)
        rows = rows.join(homes, ["query", "relative_path"], "left_anti") if other_files else rows
        rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("query", "repo", "type").orderBy("_d", "id"))).where(F.col("_k") <= F.col("n"))
        return materialize(rows.select("query", "repo", "type", "n", "id", "_d"), "drawn")

    many = (F.col("n") + 6 * F.sqrt("n") + 24) / F.col("_size") * float(1 << 32)
    rows = drawn(wanted, F.lower(F.lpad(F.hex(F.least(many, F.lit(float((1 << 32) - 1))).cast("bigint")), 8, "0")))
    full = rows.groupBy("query", "repo", "type", "n").agg(F.count("*").alias("_got")).where(F.col("_got") == F.col("n"))
    full = materialize(full.select("query", "repo", "type"), "full")
    # A bound of all hashes has nothing to add.
    short = wanted.where(many < float((1 << 32) - 1)).join(full, ["query", "repo", "type"], "left_anti")
    if not short.isEmpty():
        short = materialize(short, "wanted")
        rows = rows.join(short.select("query", "repo", "type"), ["query", "repo", "type"], "left_anti").union(drawn(short, None))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("_d", "id"))).select("query", "repo", "id", "rank")


def fault_location(nodes: DataFrame, queries: DataFrame, found: DataFrame, targets: DataFrame, limit: int, tolerance: int = 0) -> DataFrame:
    """(query, repo, id, rank): the nodes, in their order, whose lines span a target(query, path, line); no seeds."""
    here = queries.select("query", "repo").join(targets.select("query", F.col("path").alias("relative_path"), "line"), "query")
    rows = here.join(nodes.select("repo", "relative_path", "id", "first", "last", "ord"), ["repo", "relative_path"])
    rows = rows.where((F.col("line") >= F.col("first") - tolerance) & (F.col("line") <= F.col("last") + tolerance))
    rows = _without(rows, found).groupBy("query", "repo", "id").agg(F.min("ord").alias("ord"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("ord", "id"))).where(F.col("rank") <= limit).select("query", "repo", "id", "rank")


def _entries(nodes: DataFrame, sources: DataFrame, picked: DataFrame, lines: int) -> DataFrame:
    """(query, entries): the picked nodes' entries in order of rank, with the first lines of their source."""
    rows = picked.join(nodes, ["repo", "id"]).join(sources.select("repo", F.col("path").alias("relative_path"), "text"), ["repo", "relative_path"], "left")
    entry = F.struct(*ENTRY, entity_source(F.col("text"), F.col("first"), F.col("last"), lines).alias("source"))
    listed = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return rows.groupBy("query").agg(F.transform(listed, lambda x: x["entry"]).alias("entries"))


PAYLOAD = T.StructType().add("payload", T.StringType()).add("kept", T.IntegerType()).add("offered", T.IntegerType()).add("used_tokens", T.IntegerType())


@F.pandas_udf(PAYLOAD)
def budgeted(node: pd.Series, condition: pd.Series, seeds: pd.Series, entries: pd.Series, budget: pd.Series, targets: pd.Series) -> pd.DataFrame:
    """The payload as JSON: the query, its seeds and the entries that fit.  The budget, at four characters a token,
    holds for the whole string; while it is exceeded, entries go from the end, as many as the excess suggests."""
    rows = []
    for query, letter, found, offered, limit, n in zip(node, condition, seeds, entries, budget, targets):
        plain = lambda r: r.asDict() if hasattr(r, "asDict") else dict(r)
        found = [] if found is None else [plain(s) for s in found]
        offered = [] if offered is None else [plain(e) for e in offered]
        out = {"query": query, "found": bool(found), "node": found[0] if found else None, "seeds": found, "condition": letter}
        if n is not None and not pd.isna(n):
            out["oracle_targets"] = int(n)
        kept = offered
        while True:
            out["neighbors"] = kept
            out["budget"] = {"budget_tokens": int(limit), "entries_kept": len(kept), "entries_offered": len(offered)}
            used = -(-len(json.dumps(out)) // 4)
            if used <= limit or not kept:
                break
            kept = kept[: max(0, len(kept) - max(1, len(kept) * (used - int(limit)) // max(used, 1)))]
        out["budget"] |= {"used_tokens": used, "entries_rejected": len(offered) - len(kept)}
        rows.append((json.dumps(out), len(kept), len(offered), used))
    return pd.DataFrame(rows, columns=[f.name for f in PAYLOAD.fields])


def select(condition: str, nodes: DataFrame, edges: DataFrame, queries: DataFrame, found: DataFrame, limit: int = NEIGHBOURS, depth: int = DEPTH, cross_file: bool = False, types: list[str] | None = None, exclude_tests: bool = False, callers_first: bool = False, seed: int = 0, targets: DataFrame | None = None, embed=hashing_embedder, tolerance: int = 0) -> DataFrame:
    """(query, repo, id, rank): what a condition selects for each query."""
    if condition == "D":
        return lexical(nodes, queries, found, limit, types).drop("score")
    if condition == "G":
        return dense(nodes, queries, found, limit, types, embed).drop("score")
    if condition == "F":
        return fault_location(nodes, queries, found, targets, limit, tolerance)
    rank = cross_file or callers_first
    walked = walk(nodes, edges, found, depth, types, exclude_tests, None if rank else limit)
    picked = ranked(nodes, edges, found, walked, limit, cross_file, callers_first)
    if condition == "B":
        return picked.drop("depth")
    return random_matched(nodes, found, picked.select("query", "repo", "id"), types, cross_file, exclude_tests, seed)


def retrieve(condition: str, nodes: DataFrame, edges: DataFrame, sources: DataFrame, queries: DataFrame, budget: int = BUDGET, lines: int = LINES, targets: DataFrame | None = None, **options) -> DataFrame:
    """(query, payload, kept, offered, used_tokens) of every query under a condition: B graph walk, C random nodes with
    the walk's mix of types, D lexical, F fault location, G dense.  A (nothing) and E (whole files) retrieve nothing
    and give no row.  A query without a seed has an empty payload, but for D and G, which search by its terms."""
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition {condition!r}, expected one of {CONDITIONS}")
    if condition in "AE":
        return queries.limit(0).select("query", F.lit("").alias("payload"), F.lit(0).alias("kept"), F.lit(0).alias("offered"), F.lit(0).alias("used_tokens"))
    found = materialize(seeds(nodes, queries), "seeds")
    picked = select(condition, nodes, edges, queries, found, targets=targets, **options)
    listed = found.join(nodes.select("repo", *ENTRY), ["repo", "id"]).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*ENTRY).alias("s")))), lambda x: x["s"]).alias("seeds"))
    rows = queries.select("query", "node").join(listed, "query", "left").join(_entries(nodes, sources, picked, lines), "query", "left")
    count = targets.groupBy("query").agg(F.count("*").cast("int").alias("n")) if condition == "F" else None
    rows = rows.join(count, "query", "left").fillna(0, ["n"]) if count is not None else rows.withColumn("n", F.lit(None).cast("int"))
    out = rows.select("query", budgeted("node", F.lit(condition), "seeds", "entries", F.lit(budget), "n").alias("p"))
    return out.select("query", "p.*")


def deliver(hits: DataFrame, seed_rows: DataFrame, kinds: list[str], limit: int) -> DataFrame:
    """hits(task, ord, grp, identity, qualified_name, path, kind, text) of an outside index, seed_rows(task, identity,
    path) -> (task, rank, identity, qualified_name, path): callers before what they expand to, other files first, each
    identity once, the first `limit` a task.  Whole files, other kinds, seeds, tests and hits without text go."""
    rows = hits.where(F.coalesce("path", F.lit("")) != "").where(F.contains("qualified_name", F.lit("::")) & (F.col("qualified_name") != F.col("path")))
    rows = rows.where((F.coalesce("kind", F.lit("")) == "") | F.lower("kind").isin(kinds)).where(~F.col("path").rlike(TEST_PATH) & (F.coalesce("text", F.lit("")) != ""))
    rows = rows.join(seed_rows.select("task", "identity").distinct(), ["task", "identity"], "left_anti")
    home = seed_rows.select("task", "path").distinct().withColumn("_home", F.lit(1))
    rows = rows.join(home, ["task", "path"], "left")
    order = F.struct(F.when(F.col("grp") == "caller", 0).otherwise(1).alias("g"), F.coalesce("_home", F.lit(0)).alias("h"), "ord")
    key = F.coalesce("identity", "qualified_name")
    once = rows.groupBy("task", key.alias("_key")).agg(F.min(F.struct(order.alias("o"), "identity", "qualified_name", "path")).alias("r"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("task").orderBy("r.o"))).where(F.col("rank") <= limit).select("task", "rank", "r.identity", "r.qualified_name", "r.path")
