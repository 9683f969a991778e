"""Phrase collocation mining (operator 11): sketch upper bounds, delimiter-guarded automata, thresholds.

Texts are dealt to chunks of one language, in which every piece stands on a line of its own and every word between
two spaces.  Each chunk counts its n-grams into the cells of a hash sketch; cells are kept sparsely and summed by
range, in more ranges the more words there are, so that the sketch is as wide as the corpus needs and no task holds
more than its range.  A cell's sum is an upper bound for each of its phrases; what can reach the least count goes back
to the chunks that hold it.  There the candidates, with their guards, compile into an Aho-Corasick automaton that
scans the chunk and counts overlapping matches; the sums over all chunks are exact, and thresholds follow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, tune

#: Bytes of a chunk; longer texts are cut between pieces, so only a longer piece makes a longer chunk.
CHUNK = 4 << 20
#: Bytes that a task holds for all languages together before it gives them away.
HELD = 3 * CHUNK
#: Sketch entries of a range, on average at most.
RANGE_ENTRIES = 1 << 21

#: Parts of a language's phrases of which each gives its first ones.
SHARES = 64

LEAST = 10
LONGEST = 3
TOP = 2000
#: A phrase goes if a longer candidate that holds it has this share of its count, in hundredths.
ABSORBED = 50

#: A-Z are lower-cased, ends of pieces become line ends and tabs become spaces.
FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def guarded(text: bytes) -> bytes:
    """The pieces of a text, a line each, every word between two spaces."""
    words = (piece.split() for piece in text.translate(FOLD).split(b"\n"))
    return b"\n".join(b" " + b" ".join(w) + b" " for w in words if w)


def _cut(lines: bytes, size: int) -> Iterator[bytes]:
    """lines in parts of about size bytes, cut between lines."""
    start = 0
    while start < len(lines):
        end = lines.find(b"\n", start + size)
        end = len(lines) if end < 0 else end
        yield lines[start:end]
        start = end + 1


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, lang, n, lines): guarded pieces of one language and the number of their words."""
    schema = "chunk long, lang string, n long, lines binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def give(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            lines, _ = b"\n".join(held.pop(lang)), sizes.pop(lang)
            for part in _cut(lines, size):
                words = part.count(b" ") - part.count(b"\n") - 1
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([words]), pa.array([part], pa.binary())], ["chunk", "lang", "n", "lines"])
                number += 1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lines := guarded(text):
                    held.setdefault(lang, []).append(lines)
                    sizes[lang] = sizes.get(lang, 0) + len(lines)
                    if sizes[lang] >= size:
                        yield from give(lang)
            if sum(sizes.values()) > HELD:
                for lang in list(held):
                    yield from give(lang)
        for lang in list(held):
            yield from give(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


class Words:
    """The words of a chunk by number: start and end of each place, whether the next word is in the same piece, and the
    hash of each place's n-grams."""

    def __init__(self, lang: str, lines: bytes):
        raw = np.frombuffer(lines, np.uint8)
        space = np.flatnonzero(raw == 32)
        order = np.flatnonzero(raw[np.minimum(space + 1, len(raw) - 1)] != 10)
        order = order[space[order] + 1 < len(raw)]
        self.start, self.end = space[order], space[order + 1]
        self.joined = np.diff(order) == 1
        index: dict[bytes, int] = {}
        self.ids = np.fromiter((index.setdefault(w, len(index)) for w in lines.split()), np.int64, len(order))
        self.words = list(index)
        self.lang = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 11))
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(index))

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, places, hashes) of the n-grams of each length that lie within a piece."""
        h, inside = self.hashes[self.ids], np.ones(len(self.ids), bool)
        for size in range(1, longest + 1):
            if size > 1:
                if len(h) < 2:
                    return
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.ids[size - 1 :]]
                inside = inside[:-1] & self.joined[size - 2 :]
            at = np.flatnonzero(inside)
            mixed = (h[at] ^ (h[at] >> np.uint64(31)) ^ self.lang) * np.uint64(0xD6E8FEB86659FD93)
            yield size, at, mixed ^ (mixed >> np.uint64(32))


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Cell of a hash in a sketch of 2^(bits + 32) cells."""
    return hashes >> np.uint64(32 - bits)


def sketch(parts: DataFrame, bits: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(chunk, range, cells, counts): what each chunk adds to the cells of each of 2^bits ranges; counts stop at
    `least`, as no more is asked of a bound."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, lines in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = np.concatenate([h for _, _, h in Words(lang, lines).grams(longest)])
                cells, counts = np.unique(_cells(found, bits), return_counts=True)
                counts = np.minimum(counts, least).astype(kind)
                low, high = cells.astype(np.uint32), (cells >> np.uint64(32)).astype(np.int64)
                at, first = np.unique(high, return_index=True)
                last = [*first[1:], len(cells)]
                columns = [[chunk] * len(at), at, [low[a:b].tobytes() for a, b in zip(first, last)], [counts[a:b].tobytes() for a, b in zip(first, last)]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["chunk", "range", "cells", "counts"])

    return parts.select("chunk", "lang", "lines").mapInArrow(run, "chunk long, range long, cells binary, counts binary")


def bounded(entries: DataFrame, least: int = LEAST) -> DataFrame:
    """(chunk, range, cells): of each chunk's cells those whose sum over all chunks reaches `least`."""
    kind = np.min_scalar_type(least)

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table["cells"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, kind) for x in table["counts"].to_pylist()])
        cells = np.concatenate(parts)
        order = np.argsort(cells, kind="stable")
        first = np.flatnonzero(np.diff(cells[order], prepend=np.int64(-1)))
        enough = np.add.reduceat(counts[order].astype(np.int64), first) >= least
        kept = np.empty(len(cells), bool)
        kept[order] = np.repeat(enough, np.diff(first, append=len(cells)))
        own = np.split(kept, np.cumsum([len(p) for p in parts])[:-1])
        out = [(c, p[k].tobytes()) for c, p, k in zip(table["chunk"].to_pylist(), parts, own) if k.any()]
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "range": pa.array(table["range"].to_pylist()[:1] * len(out), pa.int64()), "cells": pa.array([p for _, p in out], pa.binary())})

    return entries.groupBy("range").applyInArrow(run, "chunk long, range long, cells binary")


def _candidates(words: Words, lines: bytes, at: np.ndarray, size: int) -> list[bytes]:
    """The distinct phrases of `size` words at the given places, with their guards."""
    code = words.ids[at]
    for k in range(1, size):
        code = np.unique(code, return_inverse=True)[1] * len(words.words) + words.ids[at + k]
    first = at[np.unique(code, return_index=True)[1]]
    return [lines[a : b + 1] for a, b in zip(words.start[first].tolist(), words.end[first + size - 1].tolist())]


def scan(lines: bytes, phrases: list[bytes]) -> np.ndarray:
    """Occurrences of each distinct guarded phrase in the lines, overlaps included.  Bytes are read as characters of
    their own, so any text is matched exactly."""
    if not phrases:
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        automaton.add_word(phrase.decode("latin-1"), k)
    automaton.make_automaton()
    found = np.fromiter((k for _, k in automaton.iter(lines.decode("latin-1"))), np.int64)
    return np.bincount(found, minlength=len(phrases))


def count_phrases(parts: DataFrame, kept: DataFrame, bits: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, n): exact counts, summed over chunks, of all words and phrases that the sketch kept."""

    def run(chunk: pa.Table, cells: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, int]] = []
        if chunk.num_rows and cells.num_rows:
            lang, lines = chunk["lang"][0].as_py(), chunk["lines"][0].as_py()
            hot = np.sort(np.concatenate([np.frombuffer(c, np.uint32).astype(np.uint64) | np.uint64(r << 32) for r, c in zip(cells["range"].to_pylist(), cells["cells"].to_pylist())]))
            words, phrases, sizes = Words(lang, lines), [], []
            for size, at, hashes in words.grams(longest):
                asked = _cells(hashes, bits)
                place = np.minimum(np.searchsorted(hot, asked), len(hot) - 1)
                at = at[hot[place] == asked]
                if size == 1:
                    ids, n = np.unique(words.ids[at], return_counts=True)
                    out += zip((words.words[i] for i in ids), [1] * len(ids), n.tolist())
                else:
                    phrases += _candidates(words, lines, at, size)
                    sizes += [size] * (len(phrases) - len(sizes))
            del words
            out += zip((p[1:-1] for p in phrases), sizes, scan(lines, phrases).tolist())
        phrase, size, n = zip(*out) if out else ((), (), ())
        langs = pa.array([lang] * len(out) if out else [], pa.string())
        return pa.table({"lang": langs, "phrase": pa.array(phrase, pa.binary()), "words": pa.array(size, pa.int32()), "n": pa.array(n, pa.int64())})

    asked = parts.select("chunk", "lang", "lines").groupBy("chunk").cogroup(kept.groupBy("chunk"))
    counted = asked.applyInArrow(run, "lang string, phrase binary, words int, n long")
    return counted.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("n").alias("n"))


def _part(first: int | Column, size: int | Column) -> Column:
    """size words of the column `split`, from word `first` (from 1), space-joined."""
    return F.array_join(F.slice("split", first, size), " ")


def _scored(candidates: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """candidates with l, r and score of the cut with the lowest score, ties to the smallest k."""
    of = lambda side: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0]))
    cuts = candidates.withColumn("split", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(of("left"), ["lang", "left"]).join(of("right"), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_top", F.lit(1000000).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("_under", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("_top div _under"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def _independent(candidates: DataFrame, absorbed: int, longest: int) -> DataFrame:
    """Candidates that no longer candidate absorbs."""
    longer = candidates.where("words > 2").withColumn("split", F.split("phrase", " "))
    within = [F.when((F.col("words") > size) & (F.col("words") >= start + size - 1), _part(start, size)) for size in range(2, longest) for start in range(1, longest - size + 2)]
    if not within:
        return candidates
    held = longer.select("lang", F.explode(F.array(*within)).alias("phrase"), F.col("a").alias("over")).where("phrase is not null")
    held = held.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    joined = candidates.join(held, ["lang", "phrase"], "left")
    return joined.where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * absorbed)).select(candidates.columns)


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language with their rank; first within shares of a language, so that no task orders all
    of one, and the last task of a language orders SHARES * top rows at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    some = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED, chunk: int = CHUNK, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language, of 2 to `longest` words that
    occur `least` times, by score, count and phrase.

    A-Z are lower-cased; pieces end at any of .,;:!? and line ends; words are runs between spaces and tabs.  A null
    lang is `und`, a null text empty; texts of any length count whole; repeated rows count again; ids and extra
    columns are ignored; languages without a phrase, and an empty table, give no row."""
    tune(docs.sparkSession)
    parts = materialize(chunks(docs, chunk), "phrase-chunks")
    n_words = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(31, max(4, int(total * longest // range_entries).bit_length()))
    kept = bounded(sketch(parts, bits, least, longest), least)
    counts = materialize(count_phrases(parts, kept, bits, longest).where(F.col("n") >= least), "phrases")
    candidates = counts.where("words > 1").withColumnRenamed("n", "a")
    rows = _first(_scored(_independent(candidates, absorbed, longest), counts, longest), top)
    return rows.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
