"""Transcripts, validation samples, symbol seeds, early stopping, folder trees and archives."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import selection
from plumbline.sources import archives

TURNS = "task string, condition string, turn int, error string, text string, input_tokens int, output_tokens int, calls array<struct<name string, query string, path string, output string>>"


def search(output):
    return ("search_code", "q", None, output)


def read(path):
    return ("read_file", None, path, None)


def test_transcripts_end_with_the_first_turn_without_a_call(spark):
    rows = [
        ("t1", "A", 1, None, "", 10, 1, [search("a.py:1: x"), read("pkg/caller.py")]),
        ("t1", "A", 2, None, "", 20, 2, [("other", None, None, None)]),
        ("t1", "A", 3, None, "done", 30, 3, []),
        ("t1", "A", 4, None, "too late", 40, 4, [search("pkg/caller.py")]),
        ("t2", "A", 1, None, "", 1, 1, [search("src/pkg/caller.py:9: f()")]),
        ("t2", "A", 2, "boom", None, 5, 5, None),
        *[("t3", "A", k, None, "", 1, 1, [read("x.py")]) for k in range(1, 12)],
        ("t4", "A", 1, None, "at once", None, None, None),
    ]
    callers = spark.createDataFrame([("t1", "pkg/caller.py"), ("t2", "pkg/caller.py"), ("t3", "")], "task string, caller_path string")
    got = {r.task: r.asDict() for r in selection.transcripts(spark.createDataFrame(rows, TURNS), callers).collect()}
    pick = lambda t: tuple(got[t][c] for c in ("turns", "tool_calls", "searches", "reads", "searched_at_all", "found_the_caller", "first_found", "input_tokens", "text", "error"))
    assert pick("t1") == (3, 3, 1, 1, True, True, 1, 60, "done", None)
    assert pick("t2") == (2, 1, 1, 0, True, True, 1, 1, None, "boom")
    assert pick("t3") == (8, 8, 0, 8, False, False, None, 8, None, "did not finish within 8 turns")
    assert pick("t4") == (1, 0, 0, 0, False, False, None, None, "at once", None)


def test_a_validation_sample_stops_where_enough_are_found(spark):
    from hashlib import md5

    targets = [("r", f"f{i}.py", f"n{i % 90}") for i in range(100)] + [("none", "a.py", "x")]
    callers = [(*t, c) for i, t in enumerate(targets[:100]) if i % 3 == 0 for c in ("b", "a")]
    sample, summary = selection.validation_sample(spark.createDataFrame(targets, "repo string, file string, name string"), spark.createDataFrame(callers, "repo string, file string, name string, caller string"), 7, 4)
    order = sorted(targets[:100], key=lambda t: (int(md5(f"4|{'|'.join(t)}".encode()).hexdigest()[:8], 16), t[1], t[2]))
    called = {c[:3] for c in callers}
    want, without = [], 0
    for t in order:
        if len(want) == 7:
            break
        if t in called:
            want.append(t)
        else:
            without += 1
    assert sorted((r.repo, r.file, r.name) for r in sample.collect()) == sorted(want)
    assert all(r.callers == ["a", "b"] for r in sample.collect())
    by = {r.repo: r for r in summary.collect()}
    assert (by["r"].definitions, by["r"].sampled_with_callers, by["r"].sampled_without_callers) == (100, 7, without)
    assert by["r"].unique_name_targets == sum(sum(u[2] == t[2] for u in targets[:100]) == 1 for t in want)
    assert (by["none"].sampled_with_callers, by["none"].sampled_without_callers) == (0, 1)


def test_symbol_seeds(spark):
    symbols = [
        ("t", 1, "a.py::C", "a.py", None, "@x\nclass C:\n", 1, 9), ("t", 2, "a.py::C.m", "a.py", "", "def m(self):", 3, 5), ("t", 2, "a.py::C.m", "a.py", "function", None, 3, 5),
        ("t", 3, "a.py::x", "a.py", None, "x = 1", 4, 4), ("t", 4, "a.py::Cat", "a.py", "CLASS", None, 4, 8), ("t", 5, "b.py", "b.py", "file", None, 1, 99), ("t", 6, "b.py::f", "b.py", "function", None, 50, 60), ("t", 7, "a.py", "a.py", "file", None, 1, 9),
    ]
    changed = [("t", "a.py", 4, 4), ("t", "a.py", 5, 5), ("t", "b.py", 1, 2), ("t", "gone.py", 1, 1)]
    got = selection.symbol_seeds(spark.createDataFrame(symbols, "task string, identity int, qualified_name string, path string, kind string, text string, first int, last int"), spark.createDataFrame(changed, "task string, path string, first int, last int"))
    assert [(r.identity, r.kind) for r in got.orderBy("rank").collect()] == [(2, "function"), (4, "class"), (5, "file")]


def test_the_first_that_qualify_are_found_without_asking_for_all(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def dear(k):
        asked.add(1)
        return k % 10 == 0

    items = spark.range(100_000).withColumnRenamed("id", "k")
    got = selection.first_qualifying(items, "k", lambda block: block.where(dear("k")), 12, block=8)
    assert [r.k for r in got.collect()] == [10 * i for i in range(12)]
    assert asked.value < 2000
    assert [r.k for r in selection.first_qualifying(items.limit(0), "k", lambda b: b.where(dear("k")), 3).collect()] == []
    assert len(selection.first_qualifying(spark.range(25).withColumnRenamed("id", "k"), "k", lambda b: b.where(dear("k")), 9, block=4).collect()) == 3


FILES = [("r", "a.py", 1, '{"n":1}'), ("r", "s/b.py", 2, None), ("r", "s/t/u/c.py", 4, '{"n":"\\""}'), ("r", 's/q"uo\\te.py', 8, "{}"), ("q", "z.c", 3, "{}")]


def test_folder_trees(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, bytes long, info string")
    got = {(r.repo, r.folder): (r.files, r.bytes, r.children) for r in selection.folders(files).collect()}
    assert got["r", ""] == (4, 15, ["a.py", "s"]) and got["r", "s"] == (3, 14, ["b.py", 'q"uo\\te.py', "t"]) and got["r", "s/t/u"] == (1, 4, ["c.py"]) and got["q", ""] == (1, 3, ["z.c"])
    nested = {r.repo: json.loads(r.structure) for r in selection.structure(files).collect()}
    assert nested["r"] == {"a.py": {"n": 1}, "s": {"b.py": {}, 'q"uo\\te.py': {}, "t": {"u": {"c.py": {"n": '"'}}}}} and nested["q"] == {"z.c": {}}
    assert selection.structure(files.limit(0)).collect() == []


@pytest.fixture
def folder(tmp_path):
    members = {"repo-1/src/a.py": b"x = 1\n", "repo-1/src/b.js": b"f()", "repo-1/README": b"r" * 5000}
    for name, mode in (("one.tar.gz", "w:gz"), ("two.tar", "w")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for path, data in members.items():
                info = tarfile.TarInfo(path)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "three.zip", "w") as z:
        for path, data in members.items():
            z.writestr(path, data)
        z.writestr("repo-1/empty/", "")
    (tmp_path / "notes.txt").write_text("no archive")
    return tmp_path, members


def test_archives_are_read_by_members(spark, folder, monkeypatch):
    path, members = folder
    monkeypatch.setattr(archives, "SHARE", 1)
    rows = archives.read_archives(spark, str(path)).collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.path, bytes(r.content)) for r in rows) == sorted((a, p, d) for a in ("one.tar.gz", "two.tar", "three.zip") for p, d in members.items())
    few = archives.read_archives(spark, str(path), stripRoot=True, maxBytes=4).where(F.col("suffix").isin(".py", ".js"))
    assert sorted((r.path, r.content and bytes(r.content)) for r in few.collect()) == sorted([("src/a.py", None), ("src/b.js", b"f()")] * 3)


def test_filters_on_the_suffix_are_pushed_down():
    reader = archives.ArchiveReader({"path": "x"})
    rest = list(reader.pushFilters([archives.In(("suffix",), (".py", ".js")), archives.EqualTo(("suffix",), ".py"), archives.EqualTo(("path",), "a")]))
    assert reader.wanted == {".py"} and [f.attribute for f in rest] == [("path",)]
    assert reader._row("a", "x/y.c", 3, lambda: 1 / 0) is None


def test_a_folder_without_archives_is_empty(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).collect() == []


def test_episodes_tell_what_is_stored_and_skip_the_rest(spark):
    from plumbline.operators import store

    rows = [("u", 3, '{"feedback_received": "good", "ai_response_snippet": 5}'), ("u", 1, '{"ai_response_snippet": "first"}'), ("u", 2, "{broken"), ("u", 4, None), ("u", 5, '["feedback_received"]'), ("v", 1, "{}")]
    got = store.episodes(spark.createDataFrame(rows, "user string, at int, value string"), ["user"], "value", ["at"]).collect()
    assert [(r.user, r.episodes) for r in got] == [("u", ["Previous response: first", "Previous feedback: good", "Previous response: 5"])]


def test_a_runs_last_outcome_counts_and_exact_hits_stand_on_the_line(spark, tmp_path):
    from plumbline.sources import hits, load_run

    lines = [("t", "d", True, 0), ("t", "d", True, 2), ("t", "e", False, None), ("t", "f", True, 0), ("t", "g", None, 0)]
    (tmp_path / "outcomes.jsonl").write_text("\n\n".join(json.dumps(dict(zip(("task_id", "defect_id", "hit", "line_distance"), x))) for x in lines))
    (tmp_path / "raw.jsonl").write_text(json.dumps({"task_id": "t", "condition": "B", "usage": {"input_tokens": 7}}))
    outcomes, raw = load_run(spark, str(tmp_path))
    assert {r.defect_id: r.hit for r in hits(outcomes).collect()} == {"d": True, "e": False, "f": True, "g": False}
    assert {r.defect_id: r.hit for r in hits(outcomes, exact=True).collect()} == {"d": False, "e": False, "f": True, "g": False}
    assert raw.first().usage.input_tokens == 7
