"""The life of reviews as a keyed state machine over webhook and job events.

Each pull request keeps, in the state store, its latest fields, its open reviews and the ids of the events that it has
seen.  A webhook event updates the fields; opened, reopened and synchronize make a pending review unless one is
pending, which is only enqueued again, or in progress, which is left alone.  A start takes the pending review, or makes
one that is in progress at once; complete and fail end the one that started last.  A review that is in progress for
too long fails by a timer.  The same function serves streams and batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPENING = ("opened", "reopened", "synchronize")
JOBS = ("start", "complete", "fail")
#: Characters of an error that are kept.
ERROR = 1023
EVENT = "event_id string, action string, repository string, number bigint, title string, status string, error string, received timestamp"
CHANGE = "repository string, number bigint, seq bigint, event_id string, review bigint, change string, review_status string, title string, error string, received timestamp"
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]


@dataclass
class PullRequest:
    """A pull request's state.  `open` has (review, whether it started, since, the event that did it), oldest first."""

    title: str | None = None
    status: str | None = None
    reviews: int = 0
    seq: int = 0
    latest: int = -(1 << 62)
    open: list[tuple[int, bool, int, str]] = field(default_factory=list)

    def _say(self, event_id, review, change, status, error, at) -> tuple:
        self.seq += 1
        return self.seq, event_id, review, change, status, self.title, error, at

    def advance(self, event_id: str, action: str, title: str | None, status: str | None, error: str | None, at: int) -> Iterator[tuple]:
        """Take one event, and yield (seq, event_id, review, change, review status, title, error, at) of each change."""
        if action not in JOBS:
            if at >= self.latest:  # an event that comes late does not overwrite what a newer one said
                self.latest, self.title, self.status = at, title, status
            yield self._say(event_id, None, "updated", None, None, at)
        pending = next((r for r in self.open if not r[1]), None)
        started = [r for r in self.open if r[1]]
        if action in OPENING:
            if pending:
                yield self._say(event_id, pending[0], "enqueued", "pending", None, at)
            elif not started:
                self.reviews += 1
                self.open.append((self.reviews, False, at, event_id))
                yield self._say(event_id, self.reviews, "created", "pending", None, at)
        elif action == "start":
            if pending:
                self.open.remove(pending)
                review = pending[0]
            else:
                self.reviews += 1
                review = self.reviews
            self.open.append((review, True, at, event_id))
            yield self._say(event_id, review, "started", "in_progress", None, at)
        elif action in ("complete", "fail") and started:
            self.open.remove(started[-1])
            ended = "completed" if action == "complete" else "failed"
            yield self._say(event_id, started[-1][0], ended, ended, (error or "")[:ERROR] if action == "fail" else None, at)

    def expire(self, before: int) -> Iterator[tuple]:
        """Fail the reviews that started at `before` or earlier."""
        for r in [r for r in self.open if r[1] and r[2] <= before]:
            self.open.remove(r)
            yield self._say(r[3], r[0], "failed", "failed", "timed out", r[2])


class Reviews(StatefulProcessor):
    """PullRequest in the state store; event ids go once the watermark has passed them by `keep` milliseconds."""

    def __init__(self, limit: int, keep: int):
        self.limit, self.keep = limit, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getValueState("fields", "title string, status string, reviews bigint, seq bigint, latest bigint")
        self.open = handle.getListState("open", "review bigint, started boolean, since bigint, event_id string")
        self.seen = handle.getMapState("seen", "event_id string", "received bigint")

    def _load(self) -> PullRequest:
        pr = PullRequest(*self.fields.get()) if self.fields.exists() else PullRequest()
        pr.open = [(r[0], bool(r[1]), r[2], r[3]) for r in self.open.get()] if self.open.exists() else []
        return pr

    def _store(self, pr: PullRequest) -> None:
        self.fields.update((pr.title, pr.status, pr.reviews, pr.seq, pr.latest))
        if pr.open:
            self.open.put(pr.open)
        elif self.open.exists():
            self.open.clear()

    @staticmethod
    def _frame(key, changes: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *c) for c in changes], columns=COLUMNS)
        out["received"] = pd.to_datetime(out["received"], unit="us")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows, ignore_index=True).sort_values(["received", "event_id"], kind="stable", na_position="first")
        pr, changes = self._load(), []
        for r in batch.itertuples(index=False):
            at = 0 if pd.isna(r.received) else int(r.received.value // 1000)
            if r.event_id is None or self.seen.containsKey((r.event_id,)):
                continue
            self.seen.updateValue((r.event_id,), (at,))
            given = (None if pd.isna(x) else x for x in (r.title, r.status, r.error))
            changes += pr.advance(r.event_id, r.action, *given, at)
            if r.action == "start" and self.limit:
                self.handle.registerTimer(at // 1000 + self.limit)
        self._store(pr)
        past = timerValues.getCurrentWatermarkInMs()
        if past > self.keep:
            for (event_id,), (at,) in list(self.seen.iterator()):
                if at // 1000 < past - self.keep:
                    self.seen.removeKey((event_id,))
        yield self._frame(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pr = self._load()
        changes = list(pr.expire((expiredTimerInfo.getExpiryTimeInMs() - self.limit) * 1000 + 999))
        if changes:
            self._store(pr)
        yield self._frame(key, changes)

    def close(self) -> None:
        pass


def _folded(events: DataFrame) -> DataFrame:
    """The changes of a batch: the events of a pull request lie together in a task, in order, and are folded as they
    come, so that a task holds the state of one pull request only.  Of an id's replays the first counts."""
    key = ["repository", "number"]
    said = F.struct(F.unix_micros("received").alias("at"), "action", "title", "status", "error")
    once = events.where("event_id is not null").repartition(*key).groupBy(*key, "event_id").agg(F.min(said).alias("e"))
    ordered = once.select(*key, "event_id", "e.*").sortWithinPartitions(*key, "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pr = None, PullRequest()
        for batch in batches:
            out: list[tuple] = []
            for repository, number, event_id, at, action, title, status, error in zip(*(c.to_pylist() for c in batch.columns)):
                if (repository, number) != of:
                    of, pr = (repository, number), PullRequest()
                out += [(repository, number, *c) for c in pr.advance(event_id, action, title, status, error, at or 0)]
            columns = list(zip(*out)) or [()] * len(COLUMNS)
            kinds = [pa.int64() if c in ("number", "seq", "review", "received") else pa.string() for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], COLUMNS)

    return ordered.mapInArrow(run, CHANGE.replace("received timestamp", "received bigint")).withColumn("received", F.timestamp_micros("received"))


def review_changes(events: DataFrame, delay: str = "1 hour", limit: int = 3_600_000, keep: int = 86_400_000) -> DataFrame:
    """events(event_id, action, repository, number, title, status, error, received) -> one row for each change of a pull
    request or of its reviews, numbered by pull request.

    Events of a batch are taken in the order of `received`, then of their ids; replays, and events without an id or
    pull request, change nothing.  In a stream a review in progress fails `limit` milliseconds after its start, once
    the watermark has passed that; ids are kept `keep` milliseconds behind the watermark.  Streams need the RocksDB
    state store (use_state_store)."""
    known = events.where("repository is not null and number is not null")
    if not events.isStreaming:
        return _folded(known)
    known = known.withWatermark("received", delay)
    return known.groupBy("repository", "number").transformWithStateInPandas(statefulProcessor=Reviews(limit, keep), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def use_state_store(spark) -> None:
    """Keep state in RocksDB, as keyed state of several variables requires, and start what coordinates the stores, which
    Spark does for a stream but not for a batch."""
    _ = spark.streams.active
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
