"""Webhook events as a stream: replays dropped by event id, upserts by foreachBatch."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = "event_id string, event_type string, action string, repository string, number bigint, user string, received timestamp, payload string"


def signature_ok(secret: str):
    """Column function: does the signature header fit the payload?"""

    @F.pandas_udf("boolean")
    def check(payload: pd.Series, header: pd.Series) -> pd.Series:
        def one(p, h):
            want = "sha256=" + hmac.new(secret.encode(), (p or "").encode(), hashlib.sha256).hexdigest()
            return hmac.compare_digest(want, h or "")

        return pd.Series([one(p, h) for p, h in zip(payload, header)])

    return check


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def without_replays(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event once; state is kept for `delay`."""
    return stream.withWatermark("received", delay).dropDuplicatesWithinWatermark(["event_id"])


def dedupe_events(df: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """The batch form: the first arrival of each event."""
    w = W.partitionBy(id_).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def review_state(df: DataFrame, key: list[str], kind: str, order: list[str]) -> DataFrame:
    """Latest state per pull request: opened, reopened and synchronize make it pending, other events leave it."""
    opening = F.col(kind).isin("opened", "reopened", "synchronize")
    return df.groupBy(*key).agg(F.max_by(kind, F.struct(*order)).alias("last_event"), F.count_if(opening).alias("triggers"), F.count("*").alias("events"))


def upsert_sink(path: str, key: list[str]):
    """A foreachBatch function that writes the latest row per key of each micro-batch under its batch id, so that a
    batch that is run again replaces its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        row = F.struct("received", "event_id", *[c for c in batch.columns if c not in (*key, "received", "event_id")])
        last = batch.groupBy(*key).agg(F.max(row).alias("r")).select(*key, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The table that the sink's batches amount to."""
    df = spark.read.parquet(path)
    w = W.partitionBy(*key).orderBy(F.desc("received"), F.desc("event_id"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
