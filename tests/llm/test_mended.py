"""Faults that lost rows or gave wrong labels: items without ids, bad WARC records, contrary licences, equal rows."""

import gzip
import io

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import decontaminate, license_scan, recurrent, sharding, simhash, warc

ITEM = "what is the capital city of the small country that lies between the two great lakes"


def test_items_without_an_id_are_removed_and_not_reported(spark):
    docs = spark.createDataFrame([(1, f"before {ITEM} after"), (2, "something else entirely"), (3, f"x {ITEM.upper()}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (None, ITEM), (5, "another question of eight words or a few more")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.remove_leaks(docs, items).collect()] == [2]
    assert decontaminate.find_leaks(docs, items).collect() == []


def test_equal_items_are_reported_each_and_copies_of_a_text_too(spark):
    docs = spark.createDataFrame([(i, f"before {ITEM} after") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, ITEM.title()), (7, ITEM)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.overlap) for r in got) == sorted((i, k, 1.0) for i in range(30) for k in (7, 8))


GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text, labels",
    [
        (GRANT.format("General Public License"), {"gpl-3"}),
        (GRANT.format("Affero General Public License"), {"agpl-3"}),
        (GRANT.format("Lesser General Public License"), {"lgpl"}),
        ("He got an MIT license plate", set()),
        ("code released under MIT license", {"mit"}),
        (next(t for label, t, _ in license_scan.TEMPLATES if label == "bsl-1"), {"bsl-1"}),
        (GRANT.format("General Public License") + " " + "word " * 30 + "Affero is a village", {"gpl-3"}),
    ],
)
def test_a_contrary_word_forbids_a_label(text, labels):
    assert set(license_scan.Index().scan(license_scan.words_of(text.encode()))[1]) == labels


def record(body, length=None, kind="response"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"


GOOD = [record(b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + k]) * 3000) for k in range(4)]


def read(data):
    faults = []
    return [block[-1:].decode() for _, block in warc.records_of(io.BytesIO(data), faults)], len(faults)


@pytest.mark.parametrize("bad", [record(b"zz", "abc"), record(b"zz", -5), record(b"zz", 10**9), record(b"zz", ""), record(b"zz", "1e3")])
def test_a_record_with_a_bad_length_costs_no_other(bad):
    assert read(GOOD[0] + bad + b"".join(GOOD[1:])) == (["A", "B", "C", "D"], 1)
    members = [gzip.compress(x) for x in (GOOD[0], bad, *GOOD[1:])]
    assert read(b"".join(members)) == (["A", "B", "C", "D"], 1)
    assert read(gzip.compress(GOOD[0] + bad + b"".join(GOOD[1:]))) == (["A", "B", "C", "D"], 1)


def test_a_damaged_member_costs_no_other():
    members = [gzip.compress(x) for x in GOOD]
    broken = bytearray(members[1])
    broken[15:25] = b"\xff" * 10
    assert read(members[0] + bytes(broken) + members[2] + members[3]) == (["A", "C", "D"], 1)
    assert read(b"".join(members)[:-12]) == (["A", "B", "C"], 1)
    assert read(b"".join(GOOD)[:-50]) == (["A", "B", "C"], 1)
    assert read(members[0] + b"\0" * 100 + b"noise" * 50 + members[1])[0] == ["A", "B"]
    assert read(b"") == ([], 0) and read(b"\x1f\x8b") == ([], 1)


def test_faults_are_counted_by_file(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(GOOD[0] + record(b"zz", "abc") + GOOD[1])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, GOOD)))
    got = {r.path.rsplit("/", 1)[1]: (r.records, r.faults) for r in warc.faults(spark, str(tmp_path)).collect()}
    assert got == {"a.warc": (2, 1), "b.warc.gz": (4, 0)}
    assert warc.read(spark, str(tmp_path)).count() == 6


def test_of_rows_with_one_text_and_id_the_same_is_kept_in_every_order(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, s) for s in "cab"] + [(2, text, "z"), (3, "quite another text of a few words", "y")]
    schema = "doc_id long, text string, source string"
    kept = [sorted(map(tuple, simhash.keep_one(spark.createDataFrame(order, schema).repartition(n)).collect())) for order, n in ((rows, 1), (rows[::-1], 3), (sorted(rows, key=lambda r: r[2]), 5))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_equal_rows_of_one_id_are_numbered_without_meeting_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    docs = spark.createDataFrame([(7, "the same text")] * 600 + [(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 6).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 900 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id == 7 and r.size == 13 + 16}) == 1
    rows = spark.createDataFrame([(0, 7, "k", i) for i in range(600)], "shard int, doc_id long, key string, row long")
    buckets = sharding._ranked(rows, ["shard"], ["doc_id", "key", "row"], "slot", 600)
    assert sorted(r.slot for r in buckets.collect()) == list(range(600))


def test_recurrent_part_learns_from_every_training_text(spark, monkeypatch):
    """of more documents than a round takes, every one is in a round."""
    monkeypatch.setattr(recurrent, "ROUND_DOCS", 10)
    seen = []

    def note(p, texts, vocab, shards):
        seen.append([r["text"] for r in texts.select("text").collect()])
        return p

    monkeypatch.setattr(recurrent, "trained", note)
    docs = spark.createDataFrame([(k, f"w{k} a b") for k in range(200)], "doc_id long, text string")
    texts = recurrent._texts(docs)
    recurrent.fit(texts, recurrent.count_words(texts))
    assert len(seen) == recurrent.ROUNDS and all(seen)
    assert sorted(x for s in seen for x in s) == sorted(r["text"] for r in texts.where("not held_out").collect())


def test_recurrent_training_gives_its_parameters_once_a_shard(spark, monkeypatch):
    """where repartition() by a key deals to more partitions than were asked, training doesn't give more copies of its parameters."""
    shards = []

    def note(texts, run, schema, given=type(texts_of(spark)).mapInArrow):
        if schema.startswith("piece"):
            shards.append(texts.rdd.getNumPartitions())
        return given(texts, run, schema)

    frame = type(texts_of(spark))
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols, given=frame.repartition: given(self, max(n, 37), *cols))
    monkeypatch.setattr(frame, "mapInArrow", note)
    texts = recurrent._texts(texts_of(spark))
    recurrent.fit(texts, recurrent.count_words(texts), rounds=1)
    assert shards == [recurrent.SHARDS[0]]


def texts_of(spark):
    return spark.createDataFrame([(k, f"w{k} a b") for k in range(60)], "doc_id long, text string")


def test_recurrent_words_are_split_by_arrow_as_by_python():
    """a batch is split and numbered as a whole, with the words that each text has alone."""
    texts = [bytes([k, 65, k, k, 98, k]) for k in range(256)] + [b"", b" ", b"A b  a", "É é\x85x y".encode()]
    bounds, words = recurrent.split(pa.array(texts, pa.binary()).slice(2))
    got = words.to_pylist()
    assert [got[a:b] for a, b in zip(bounds, bounds[1:])] == [recurrent.tokens(t) for t in texts[2:]]


def test_recurrent_windows_with_few_lanes_move_the_parameters_by_their_share():
    """the end of the longest text, which goes on alone, does not undo what all others taught."""
    vocab = recurrent.Vocabulary([b"", b"a", b"b", b"c"], [65, 6400, 6400, 9000], 21865, 4)
    docs = [vocab.encode(t)[:2] for t in [b"a b " * 50] * 64 + [b"c " * 9000]]
    p, n = recurrent.train(recurrent.initial(vocab), docs, vocab)
    assert n == sum(len(k) + 1 for k, _ in docs)
    assert recurrent.log_likelihoods(p, docs[:1], vocab)[0] > -100 * np.log(2)
