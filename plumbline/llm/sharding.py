"""Minimax contiguous sharding (operator 9).

Rows with equal texts form an atomic group.  Groups are ordered by size, largest first, then by the hash of their
text, and cut into contiguous shards so that the largest shard is as small as possible: the smallest feasible
capacity is found by binary search, each capacity checked by filling the shards greedily.

In that order groups of one size are a run, so the driver needs only the histogram (size, groups).  Its length is
at most sqrt(2 * total bytes), since its distinct sizes add up to no more than the total.  A group larger than the
fair share of what is left takes a shard of its own first; the rest is shared among the others.

A cut inside a run is found by counts of (size, hash bucket) for at most n_shards - 1 sizes, and by ranks inside a
single bucket; slots come from counts per (shard, bucket) in the same way.  So no task sees a whole run or shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, materialize

ROW_OVERHEAD = 16
#: Rows that a slot bucket holds on average.
BUCKET_ROWS = 4096
RUN_BUCKETS = 4096


def fill(sizes: np.ndarray, counts: np.ndarray, capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """Fill shards greedily up to capacity; the end (run, groups taken of it) of each shard, or None if groups are
    left over.  sizes falls strictly."""
    ends, run, taken = [], 0, 0
    total = np.concatenate([[0], np.cumsum(sizes * counts)])
    for _ in range(shards):
        if run < len(sizes):
            limit = int(total[run]) + taken * int(sizes[run]) + capacity
            stop = int(np.searchsorted(total, limit, side="right")) - 1
            if stop >= len(sizes):
                run, taken = len(sizes), 0
            else:
                begin = taken if stop == run else 0
                run, taken = stop, max(begin, (limit - int(total[stop])) // int(sizes[stop]))
                if taken >= counts[run]:
                    run, taken = run + 1, 0
        ends.append((run, taken))
    return ends if run >= len(sizes) else None


def minimax(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """Ends of the shards of the smallest feasible capacity, by binary search."""
    low, high = int(sizes[0]) if len(sizes) else 0, int((sizes * counts).sum())
    low = max(low, -(-high // shards))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fill(sizes, counts, mid, shards) is not None else (mid + 1, high)
    return fill(sizes, counts, low, shards) or []


def plan(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """Ends of all shards: groups beyond the fair share alone first, the others by minimax."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    ends: list[tuple[int, int]] = []
    run, taken, left = 0, 0, int((sizes * counts).sum())
    while shards - len(ends) > 1 and run < len(sizes) and int(sizes[run]) * (shards - len(ends)) >= left and left:
        left -= int(sizes[run])
        taken += 1
        if taken == counts[run]:
            run, taken = run + 1, 0
        ends.append((run, taken))
    rest = counts[run:].copy()
    if len(rest):
        rest[0] -= taken
    for r, t in minimax(sizes[run:], rest, shards - len(ends)):
        ends.append((run + r, t + (taken if r == 0 else 0)))
    return ends


def _ranked(df: DataFrame, by: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Number the rows of each `by` group gaplessly from 0 in hash order, through counts of hash buckets."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).drop("_n")
    at = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_at", at).join(before, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_bucket", "_at", "_before")


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs.

    Null texts count as empty: 0 bytes, CRC 0, one group with the empty texts.  Equal texts share a shard, whatever
    their doc_id; rows that repeat a doc_id or have none each get a slot.  Texts of any length are read for their size, CRC and hash
    only.  Texts of one size go in the order of their hashes, so ties are decided by content; extra columns are
    ignored; an empty table gives an empty result."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, 32).alias("key"),
        # Tells equal rows apart, so that they do not share a bucket; fixed by the table below.
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    runs = groups.groupBy("bytes").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).orderBy(F.desc("bytes")).toPandas()
    ends = plan(runs["bytes"].to_numpy(), runs["groups"].to_numpy(), shards) if len(runs) else []
    spark, total = docs.sparkSession, int(runs["n"].sum()) if len(runs) else 0

    sizes = runs["bytes"].tolist()
    cut = sorted({sizes[r] for r, t in ends if t})
    # A run's first shard: the number of shards that end at or before its start.
    begun = np.searchsorted(sorted(r + (t > 0) for r, t in ends), np.arange(len(sizes)), side="right")
    table = pd.DataFrame({"bytes": np.array(sizes, np.int64), "first": begun.astype(np.int64), "groups": runs["groups"].to_numpy(np.int64)})
    table = spark.createDataFrame(table, "bytes long, first long, groups long")
    inside = [(int(sizes[r]), int(t)) for r, t in ends if t]
    # Many different texts may have one size, so the runs with most groups are looked up in place.
    plain = lookup(groups, table, "bytes", "first", "groups", int(runs["groups"].sum())).withColumn("shard", F.col("first"))
    if cut:
        bucket = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
        split = plain.where(F.col("bytes").isin(cut)).withColumn("bucket", bucket)
        counts = split.groupBy("bytes", "bucket").agg(F.count("*").alias("m"))
        before = counts.withColumn("before", F.sum("m").over(W.partitionBy("bytes").orderBy("bucket")) - F.col("m")).drop("m")
        rank = F.row_number().over(W.partitionBy("bytes", "bucket").orderBy("key")) - 1
        split = split.withColumn("rank", rank).join(before, ["bytes", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
        past = sum((F.when((F.col("bytes") == s) & (F.col("rank") >= t), 1).otherwise(0) for s, t in inside), F.lit(0))
        split = split.withColumn("shard", F.col("first") + past)
        plain = plain.where(~F.col("bytes").isin(cut)).select("key", "shard", "n").union(split.select("key", "shard", "n"))
    # The copies of a frequent text stay where they are.
    placed = lookup(rows, materialize(plain.select("key", "shard", "n"), "shard-of-text"), "key", "shard", "n", total)
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "key", "row"), "shard-placed")
    slots = _ranked(placed, ["shard"], ["doc_id", "key", "row"], "slot", -(-total // shards))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
