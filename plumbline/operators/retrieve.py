"""Context retrieval: lexical, dense and random selection per query, ranking, and budgets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..functions.text import entity_source
from ..tables import placed


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def lexical(pool: DataFrame, terms: list[str], name: str, id_: str, k: int) -> DataFrame:
    """The k names with the most terms as substrings, shorter names first; names without a term are left out."""
    lower = F.lower(F.col(name))
    score = sum((F.contains(lower, F.lit(t)).cast("int") for t in terms), F.lit(0))
    hits = pool.withColumn("score", score).where("score > 0")
    return hits.orderBy(F.desc("score"), F.length(name), id_).limit(k)


def normalised(v: Column) -> Column:
    """A vector of unit length as doubles; a zero vector stays."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


#: Queries of one block: what a block broadcasts and a task keeps do not depend on the number of queries.
QUERY_BLOCK = 2048


def _best_of_block(ids: np.ndarray, vectors: np.ndarray, id_: str, vector: str, k: int):
    """Batches of the pool to the k best rows that the partition has for each query of a block."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"query_id": np.empty(0, ids.dtype), id_: np.empty(0, ids.dtype), "score": np.empty(0)})
        for batch in batches:
            names = batch[id_].to_numpy()
            for at in range(0, len(batch), 1024):
                part = slice(at, at + 1024)
                score = np.round(np.stack(batch[vector].iloc[part].to_numpy()) @ vectors.T, 9)
                score[names[part, None] == ids[None, :]] = -np.inf
                least = np.partition(score, -k, axis=0)[-k] if len(score) > k else -np.inf
                row, query = np.nonzero((score >= least) & (score > -np.inf))
                found = pd.DataFrame({"query_id": ids[query], id_: names[part][row], "score": score[row, query]})
                kept = pd.concat([kept, found]).sort_values(["query_id", "score", id_], ascending=[True, False, True]).groupby("query_id").head(k)
        yield kept

    return run


def dense(queries: DataFrame, pool: DataFrame, k: int, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """Exact top k by cosine, scores rounded to nine digits and equal ones by id.  Queries go in blocks of
    QUERY_BLOCK by the hash of their id; a block's vectors are multiplied with each partition of the pool, which
    hands on k rows a query.  Rows without an id or a vector are left out."""
    usable = F.col(id_).isNotNull() & F.col(vector).isNotNull()
    q = queries.where(usable).select(id_, normalised(F.col(vector)).alias(vector))
    p = pool.where(usable).select(id_, normalised(F.col(vector)).alias(vector))
    kind, out = dict(pool.dtypes)[id_], None
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64(id_), F.lit(blocks)) == b).orderBy(id_).toPandas()
        if len(rows):
            run = _best_of_block(rows[id_].to_numpy(), np.stack(rows[vector].to_numpy()), id_, vector, k)
            best = p.mapInPandas(run, f"query_id {kind}, {id_} {kind}, score double")
            out = best if out is None else out.union(best)
    if out is None:
        out = p.limit(0).select(F.col(id_).alias("query_id"), id_, F.lit(0.0).alias("score"))
    return top_k(out, ["query_id"], [F.desc("score"), F.col(id_)], k)


def seeded_sample(df: DataFrame, by: list[str], key: list[str], n: Column | int, seed: int = 0) -> DataFrame:
    """n rows per group without replacement, by the order of a hash."""
    order = hash32(F.lit(seed), *[F.col(c) for c in key])
    out = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(order, *key)))
    return out.where(F.col("_rank") <= n).drop("_rank")


def type_matched(wanted: DataFrame, pool: DataFrame, type_: str, key: list[str], seed: int = 0) -> DataFrame:
    """Random picks with the type mix of wanted(type, n)."""
    return seeded_sample(pool.join(F.broadcast(wanted), type_), [type_], key, F.col("n"), seed).drop("n")


def budget_prefix(df: DataFrame, by: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """The longest prefix per group whose tokens fit the budget."""
    run = F.sum(tokens).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("used", run).where(F.col("used") <= budget)


def greedy_fill(df: DataFrame, by: list[str], order: list[str], id_: str, tokens: str, budget: int) -> DataFrame:
    """Greedy fill per group: entries in order, one that does not fit is skipped and later ones still tried.  Returns
    (by…, offered, kept, used, remaining).

    Entries that alone exceed the budget are only counted.  The others are read in order with what is used so far, so
    that no group is held; a task keeps three numbers."""
    offered = df.groupBy(*by).agg(F.count("*").alias("offered"))
    fits = df.where(F.col(tokens) <= budget).select(F.xxhash64(*by).alias("_group"), *by, *[c for c in dict.fromkeys([*order, id_]) if c not in by], F.col(tokens).cast("long").alias("_t"))
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes) + ", kept long, used long"

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, kept, used = None, None, 0, 0
        names = [f.split()[0] for f in schema.split(", ")]

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key, pa.array([kept], pa.int64()), pa.array([used], pa.int64())], names)

        for batch in batches:
            groups, sizes = batch.column("_group").to_pylist(), batch.column("_t").to_pylist()
            for k, (group, size) in enumerate(zip(groups, sizes)):
                if group != at:
                    if at is not None:
                        yield result()
                    at, key, kept, used = group, [batch.column(c).slice(k, 1) for c in by], 0, 0
                if used + size <= budget:
                    kept, used = kept + 1, used + size
        if at is not None:
            yield result()

    filled = fits.repartition("_group").sortWithinPartitions("_group", *order, id_).mapInArrow(fill, schema)
    out = offered.join(filled, by, "left")
    used = F.coalesce("used", F.lit(0)).cast("bigint")
    return out.select(*by, "offered", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"), used.alias("used"), (F.lit(budget) - used).alias("remaining"))


def closest_prefix(df: DataFrame, by: list[str], order: list[str], size: str, target: int) -> DataFrame:
    """Prefix length per group whose total is closest to the target; the shorter of equals."""
    w = W.partitionBy(*by).orderBy(*order)
    run = df.withColumn("_k", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = F.min(F.struct(F.abs(F.col("_sum") - target).alias("off"), F.col("_k").alias("k"), F.col("_sum").alias("total")))
    return run.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.k").cast("bigint").alias("k"), F.col("b.total").alias("total"))


def tiered(df: DataFrame, by: list[str], tier: Column, same_file: Column, depth: str, order: str, k: int) -> DataFrame:
    """Neighbours by tier, other files first, depth, and the order in which they were found; the first k."""
    return top_k(df, by, [tier, same_file.cast("int"), F.col(depth), F.col(order)], k)


def round_robin(df: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """Shard by position in a total order, position modulo shards."""
    return placed(df, order, "_place").withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int")).drop("_place")


def grep(files: DataFrame, text: str, needle: str, limit: int, id_: str) -> DataFrame:
    """The first `limit` lines that contain the needle, by file and line."""
    lines = files.where(F.contains(F.col(text), F.lit(needle))).select(id_, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    return lines.where(F.contains("content", F.lit(needle))).orderBy(id_, "line").limit(limit).select(id_, (F.col("line") + 1).alias("line"), "content")


def read_lines(files: DataFrame, text: str, id_: str, first: int, last: int) -> DataFrame:
    """(id, first, last, content): the lines of each file from first to last, as far as it has them."""
    return files.select(id_, F.lit(first).alias("first"), F.least(F.lit(last), F.size(F.split(text, "\n"))).alias("last"), entity_source(F.col(text), F.lit(first), F.lit(last)).alias("content"))
