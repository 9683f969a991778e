"""The review state machine, alone, in a batch and in a stream with replays, late events and timers."""

import json
from datetime import datetime

import pytest

from plumbline.streaming import reviews


def changes(*events):
    pr = reviews.PullRequest()
    return pr, [c[2:5] for i, (action, error) in enumerate(events) for c in pr.advance(f"e{i}", action, f"t{i}", "open", error, i) if c[3 - 1] is not None]


@pytest.mark.parametrize(
    "events, want",
    [
        (["opened"], [(1, "created", "pending")]),
        (["opened", "synchronize"], [(1, "created", "pending"), (1, "enqueued", "pending")]),
        (["opened", "start", "reopened"], [(1, "created", "pending"), (1, "started", "in_progress")]),
        (["start"], [(1, "started", "in_progress")]),
        (["opened", "start", "complete", "synchronize"], [(1, "created", "pending"), (1, "started", "in_progress"), (1, "completed", "completed"), (2, "created", "pending")]),
        (["opened", "start", "fail", "complete"], [(1, "created", "pending"), (1, "started", "in_progress"), (1, "failed", "failed")]),
        (["closed", "complete"], []),
        (["start", "start", "complete", "fail"], [(1, "started", "in_progress"), (2, "started", "in_progress"), (2, "completed", "completed"), (1, "failed", "failed")]),
    ],
)
def test_transitions(events, want):
    assert changes(*((e, None) for e in events))[1] == want


def test_a_late_event_does_not_overwrite_newer_fields_and_errors_are_cut():
    pr = reviews.PullRequest()
    for at, title in ((5, "new"), (3, "old")):
        list(pr.advance(f"e{at}", "edited", title, "open", None, at))
    assert pr.title == "new"
    list(pr.advance("s", "start", None, None, None, 6))
    assert len(list(pr.advance("f", "fail", None, None, "x" * 5000, 7))[0][6]) == reviews.ERROR


def event(id_, action, number, at, title="t"):
    return {"event_id": id_, "action": action, "repository": "r", "number": number, "title": title, "status": "open", "error": "broke", "received": f"2024-01-01T{at}:00"}


BATCHES = [
    [event("1", "opened", 7, "10:00"), event("2", "start", 7, "10:05"), event("1", "opened", 7, "10:00"), event("9", "opened", 8, "10:01")],
    [event("2", "start", 7, "10:05"), event("3", "complete", 7, "10:20"), event("4", "synchronize", 7, "10:30", "newer"), event("10", "start", 8, "10:10")],
    [event("5", "edited", 7, "10:25", "older"), event("4", "synchronize", 7, "10:30", "newer"), {**event(None, "opened", 7, "10:31")}, {**event("x", "opened", None, "10:31")}],
    [event("6", "closed", 9, "13:00")],
]


def test_a_stream_drops_replays_keeps_late_events_in_order_and_fails_what_hangs(spark, tmp_path):
    reviews.use_state_store(spark)
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(reviews.EVENT).json(str(source))
    out = reviews.review_changes(stream, "30 minutes")
    for i, batch in enumerate(BATCHES):  # each run goes on from the state that the last one left
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("number", "seq").collect()
    seven = [(r.event_id, r.review, r.change, r.title) for r in got if r.number == 7]
    assert seven == [
        ("1", None, "updated", "t"), ("1", 1, "created", "t"), ("2", 1, "started", "t"), ("3", 1, "completed", "t"),
        ("4", None, "updated", "newer"), ("4", 2, "created", "newer"), ("5", None, "updated", "newer"),
    ]
    eight = [(r.review, r.change, r.review_status, r.error) for r in got if r.number == 8 and r.review]
    assert eight == [(1, "created", "pending", None), (1, "started", "in_progress", None), (1, "failed", "failed", "timed out")]
    assert [r.seq for r in got if r.number == 7] == list(range(1, 8))


def test_a_batch_gives_what_a_fold_gives(spark):
    reviews.use_state_store(spark)
    rows = [(e["event_id"], e["action"], e["repository"], e["number"], e["title"], e["status"], e["error"], datetime.fromisoformat(e["received"])) for b in BATCHES for e in b]
    got = reviews.review_changes(spark.createDataFrame(rows, reviews.EVENT)).collect()
    want = []
    for number in (7, 8, 9):
        pr, seen = reviews.PullRequest(), set()
        for r in sorted({r for r in rows if r[3] == number and r[0]}, key=lambda r: (r[7], r[0])):
            if r[0] not in seen:
                seen.add(r[0])
                want += [(number, *c[:4]) for c in pr.advance(r[0], r[1], r[4], r[5], r[6], int(r[7].timestamp() * 1e6))]
    assert sorted((r.number, r.seq, r.event_id, r.review, r.change) for r in got) == sorted(want)
