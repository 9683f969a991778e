"""SimHash near-dedup (operator 3) by bit-sliced comparison.

Fingerprints that may link share a cell.  Within a cell the fingerprints are stored as vertical bit planes (one
packed bit per fingerprint and plane); mismatches are added to bitwise counters by carry-save adders, 64 distances
a machine word, and a block is abandoned as soon as every distance in it exceeds the radius.

Two ways to cells, each for its own purpose:
* blocks: the fingerprint is cut into `parts` blocks.  At most `radius` of them can differ, so two linked
  fingerprints agree on some `parts - radius` of them; a table per choice of these.  Exact.
* bands: MinHash bands of the shingles; for radii beyond what blocks can serve (near-dedup at a similarity).

Cells of more than CHUNK members are cut into chunks by hash, and every pair of chunks is a cell of its own, so that
no task holds more than two chunks and no link is lost.  A cell returns a forest, at most one edge a member.

The pipeline's stage takes the components of the comparison as candidate groups only: a link is a pair of texts of
one group whose shingle sets have an exact Jaccard of at least the similarity.  The sets of a group's texts, a small
part of all, go to one task, those of a large group to one task for each pair of its chunks, and again a forest comes
back.  So no table of pairs is ever made."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lookup, materialize, may_hold, text_bytes, tune
from .components import connected_components

CHUNK = 2048
SEED = 42
#: Cells with fewer members are compared pair by pair over many cells at once.
SMALL_CELL = 48
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every `size`-word shingle, repeats included.  Words are split at ASCII white space and
    A-Z lower-cased; with fewer words than `size` the whole sequence is the one shingle, with none there is none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """A fingerprint of 64 * lanes bits: a bit is 1 if it is set in over half the hashes; no hashes: all 0.
    Lane 0 takes the hashes themselves, lane j a mix of them with the j-th odd constant."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        total = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 15):
            h = hashes[i : i + (1 << 15)]
            if lane:
                h = (h ^ (h >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * lane + 1)) & 0xFFFFFFFFFFFFFFFF)
                h ^= h >> np.uint64(32)
            total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[lane] = np.packbits(total * 2 > len(hashes)).view(">u8")[0]
    return out


def minhash_bands(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """`bands` keys, each of `rows` minima under different mixes of the hashes; no hashes: one fixed key a band."""
    n = bands * rows
    seeds = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mix, least = np.uint64(0xD6E8FEB86659FD93), np.full(n, ONES)
    for i in range(0, len(hashes), 4096):
        h = (hashes[None, i : i + 4096] ^ seeds[:, None]) * mix
        h ^= h >> np.uint64(32)
        h *= mix
        least = np.minimum(least, h.min(axis=1))
    key = np.zeros(bands, np.uint64)
    for r in range(rows):
        key = (key ^ least[r::rows]) * mix
        key ^= key >> np.uint64(32)
    return key


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, bands: int = 0, rows: int = 0, distinct: bool = False) -> DataFrame:
    """(doc_id, fp array<long>, bands array<long>) of every document; a null text counts as empty.  With distinct, a
    shingle counts once in the fingerprint however often it is repeated."""
    tune(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, shingle)
                h = np.unique(h) if distinct else h
                fps.append(simhash(h, lanes).view(np.int64).tolist())
                keys.append(minhash_bands(h, bands, rows).view(np.int64).tolist() if bands else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp array<long>, bands array<long>")


# ---------------------------------------------------------------- bit-sliced comparison


def pack(bits: np.ndarray) -> np.ndarray:
    """Bits (…, n) to words (…, ceil(n / 64)), lane i in bit i % 64 of word i // 64."""
    short = -bits.shape[-1] % 64
    if short:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], short), bits.dtype)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Fingerprints (n, lanes) to bit planes (64 * lanes, words)."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return pack(np.ascontiguousarray(bits.T))


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count exceeds radius: a comparator over the counters' bits, highest first."""
    more, same = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def within_radius(planes: Iterable[np.ndarray], shape: tuple[int, ...], radius: int, every: int = 24) -> np.ndarray:
    """Packed mask of the lanes with at most `radius` mismatches.  planes: packed mismatch words, plane by plane.
    Three planes at a time go through a carry-save adder into saturating bitwise counters; every `every` planes the
    block is given up if all its lanes exceed the radius."""
    width = max(2, (radius + 1).bit_length())
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)

    def add(word: np.ndarray, at: int) -> None:
        nonlocal over
        for k in range(at, width):
            counters[k], word = counters[k] ^ word, counters[k] & word
        over = over | word

    held: list[np.ndarray] = []
    for n, plane in enumerate(planes, 1):
        held.append(plane)
        if len(held) == 3:
            a, b, c = held
            half = a ^ b
            add(half ^ c, 0)
            add((a & b) | (half & c), 1)
            held = []
        if n % every == 0 and not held and bool((_beyond(counters, over, radius) == ONES).all()):
            return np.zeros(shape, np.uint64)
    for word in held:
        add(word, 0)
    return ~_beyond(counters, over, radius)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def large_cell(fps: np.ndarray, radius: int, queries: int = 64) -> np.ndarray:
    """For each fingerprint of one cell, the index of its component's first member.  Blocks of `queries` members are
    compared with all members from the block on; the links of a member are folded into the components at once."""
    n, root = len(fps), np.arange(len(fps))
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(bool)
    for s in range(0, n, queries):
        planes = planes_of(fps[s:])
        q = np.where(bits[s : s + queries], ONES, np.uint64(0))
        mismatch = (planes[p][None, :] ^ q[:, p][:, None] for p in range(planes.shape[0]))
        hits = within_radius(mismatch, (len(q), planes.shape[1]), radius)
        if not hits.any():
            continue
        for found in unpack(hits, n - s):
            names = np.unique(root[s:][found])
            if len(names) > 1:
                root[np.isin(root, names[1:])] = names[0]
    return root


def small_cells(fps: np.ndarray, cell: np.ndarray, radius: int) -> np.ndarray:
    """The same for many small cells at once, members of a cell adjacent: at each distance d in the order, all
    pairs (i, i + d) of one cell are the lanes of one bit-sliced comparison."""
    root, pairs = np.arange(len(fps)), []
    for d in range(1, SMALL_CELL):
        i = np.flatnonzero(cell[:-d] == cell[d:]) if d < len(cell) else np.empty(0, int)
        if not len(i):
            break
        for part in np.array_split(i, -(-len(i) // 8192)):
            planes = planes_of(fps[part] ^ fps[part + d])
            hit = unpack(within_radius(planes, planes.shape[1:], radius), len(part))
            pairs.append(np.stack([part[hit], part[hit] + d]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), int)
    while len(a):
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            break
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
    return root


def _forest(ids: np.ndarray, fps: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the cells that begin at `start`."""
    size = np.diff(np.append(start, len(ids)))
    root = np.arange(len(ids))
    for s, n in zip(start[size >= SMALL_CELL], size[size >= SMALL_CELL]):
        root[s : s + n] = s + large_cell(fps[s : s + n], radius)
    few = np.repeat(size < SMALL_CELL, size)
    at = np.flatnonzero(few)
    root[at] = at[small_cells(fps[at], np.repeat(np.arange(len(size)), size)[at], radius)]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _cell_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy() for k in CELL], axis=1)


def _whole_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Arrow batches sorted by cell -> arrays (cell, fp, node) of whole cells.  Holds one batch and the cell that it
    ends in."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = _cell_of(batch)
        fps = np.asarray(batch.column("fp").flatten()).astype(np.int64).view(np.uint64).reshape(batch.num_rows, -1)
        now = [cell, fps, batch.column("node").to_numpy()]
        if kept:
            now = [np.concatenate(x) for x in zip(kept, now)]
        change = np.flatnonzero((now[0][1:] != now[0][:-1]).any(axis=1))
        cut = change[-1] + 1 if len(change) else 0
        if cut:
            yield [x[:cut] for x in now]
        kept = [x[cut:] for x in now]
    if kept:
        yield kept


def _starts(cell: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(axis=1)))


def _link_cells(radius: int):
    """Arrow batches sorted by cell (cell, node, fp) -> edges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, fps, ids in _whole_cells(batches):
            u, v = _forest(ids, fps, _starts(cell), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


# ---------------------------------------------------------------- cells


def block_masks(radius: int, distinct: int, bits: int = 64) -> list[int]:
    """Masks of the exact tables.  Keys get about log2(distinct) bits if up to eight blocks can give them, so that
    buckets of unrelated fingerprints stay small; any choice finds every link."""
    need = max(8, distinct.bit_length())
    parts = next((p for p in range(radius + 1, radius + 5) if (p - radius) * (bits // p) >= need), radius + 4)
    edge = [bits * i // parts for i in range(parts + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(parts)]
    return [sum(c) for c in combinations(block, parts - radius)]


#: A cell: its key, and the two chunks of it that are compared.
CELL = ("cell", "a", "b")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, chunks: str) -> DataFrame:
    """rows(cell, node, …, `chunks`) -> rows(cell, a, b, node, …) once for every cell that a node is in, sorted by it."""
    n = F.col(chunks).cast("int")
    others = F.filter(F.sequence(F.lit(0), n - 1), lambda j: j != F.col("own"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(others)))
    rows = rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("own", "other", chunks)
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """keyed(t int, key long, node long, fp) -> edges between nodes of one (t, key) within the radius."""
    keyed = keyed.select(F.xxhash64("t", "key").alias("cell"), "node", "fp")
    counts = keyed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    # A large cell's rows are dealt over its chunks right after this join, which adaptive execution splits if skewed.
    cells = keyed.join(materialize(counts, "cells"), "cell").select("cell", "node", "fp", "chunks")
    return _dealt(cells, "chunks").mapInArrow(_link_cells(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, lanes: int = 1, bands: int = 0, rows: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits.  bands = 0 finds
    every link through exact blocks (one lane); otherwise candidates share one of `bands` MinHash bands.

    Null and empty texts have fingerprint zero, which links as any other.  Rows that repeat a doc_id each return.
    A null doc_id never becomes a component's id while another id is in it.  Extra columns are ignored; an empty
    table gives an empty result."""
    marked = materialize(fingerprints(docs, shingle, lanes, bands, rows).withColumn("node", F.col("fp")[0] if lanes == 1 else F.xxhash64("fp")), "fingerprints")
    nodes = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.count("*").alias("n")), "nodes")
    if bands:
        keyed = nodes.select("node", "fp", F.posexplode("bands").alias("t", "key"))
    else:
        if lanes != 1:
            raise ValueError("exact blocks take fingerprints of one lane")
        masks = block_masks(radius, nodes.count())
        keys = F.array(*[F.col("node").bitwiseAND(F.lit(_signed(m))) for m in masks])
        keyed = nodes.select("node", "fp", F.posexplode(keys).alias("t", "key"))
    part = connected_components(_links(keyed.select("t", "key", "node", "fp"), radius))
    joined = materialize(nodes.select("node", "least", "n").join(part, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    sizes = joined.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    of_node = materialize(lookup(joined, ids, "component", "component_id", "nodes", sizes["nodes"]).select("node", "component_id", "n"), "members")
    hexed = F.array_join(F.transform("fp", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return lookup(marked, of_node, "node", "component_id", "n", sizes["rows"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- the pipeline's stage


#: Five-word shingles, similarity 0.8.  At 256 bits a similarity of 0.8 gives 39 differing bits on average (deviation
#: 6), for the shortest texts 48; unrelated texts give 128.  The radius only chooses what is compared exactly; of the pairs at 0.8, 14 bands of 3
#: miss 4 in 100,000.
STAGE = {"shingle": 5, "similarity": 0.8, "radius": 64, "lanes": 4, "bands": 14, "rows": 3}
#: Texts and shingles of a chunk of a candidate group.
MEMBERS, WEIGHT = 512, 1 << 19
#: Shingles whose bits are compared at once.
COLUMNS = 1 << 13


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts(node, text) -> (node, shingles array<long>), once a node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(text, shingle)).view(np.int64))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections of the sets, of which only those with i < j are filled."""
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    first = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.empty(0, bool)
    name = np.cumsum(first) - 1
    often = np.bincount(name) > 1
    held = often[name]  # a shingle of one set alone is in no intersection
    of, column = of[held], (np.cumsum(often) - 1)[name[held]]
    for start in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        bits = np.zeros((n, COLUMNS), bool)
        bits[of[a:b], column[a:b] - start] = True
        words = pack(bits)
        for i in range(n - 1):
            out[i, i + 1 :] += np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int32)
    return out


def similar_forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the index of the first one that it is connected to by pairs with a Jaccard of at least
    `similarity`; two empty sets have 1."""
    size = np.array([len(x) for x in sets])
    both, near = shared_counts(sets), [np.empty((2, 0), np.int64)]
    for i in range(len(sets) - 1):
        either = size[i] + size[i + 1 :] - both[i, i + 1 :]
        j = np.flatnonzero(np.where(either > 0, both[i, i + 1 :] / np.maximum(either, 1), 1.0) >= similarity)
        if len(j):
            near.append(np.stack([np.full(len(j), i), i + 1 + j]))
    a, b = np.concatenate(near, axis=1)
    root = np.arange(len(sets))
    while len(a):
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            break
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
    return root


def _link_sets(similarity: float):
    """Arrow batches sorted by cell (cell, a, b, node, shingles) -> edges (member, root)."""

    def edges(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        ids, root = np.array(nodes, np.int64), similar_forest(sets, similarity)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in batches:
            cells = _cell_of(batch)
            for k, (cell, node) in enumerate(zip(map(tuple, cells), batch.column("node").to_pylist())):
                if cell != at and nodes:
                    yield edges(nodes, sets)
                    nodes, sets = [], []
                at = cell
                nodes.append(node)
                sets.append(np.asarray(batch.column("shingles")[k].values).astype(np.int64))
        if nodes:
            yield edges(nodes, sets)

    return run


def similar_components(texts: DataFrame, shingle: int, similarity: float, radius: int, lanes: int, bands: int, rows: int) -> DataFrame:
    """texts(node, text binary) -> (node, component) of every text that has a link: the components over pairs of texts
    with an exact Jaccard of at least `similarity`."""
    prints = fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), shingle, lanes, bands, rows, True)
    prints = prints.withColumnRenamed("doc_id", "node")
    nodes = materialize(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("bands").alias("bands")), "nodes")
    keyed = nodes.select("node", "fp", F.posexplode("bands").alias("t", "key"))
    groups = materialize(connected_components(_links(keyed, radius)).withColumnRenamed("component", "cell"), "groups")
    wanted, _ = may_hold(texts, groups, ["node"])
    sets = materialize(groups.join(_shingle_sets(wanted.join(groups, "node", "left_semi"), shingle), "node"), "shingles")
    counts = sets.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("weight"))
    counts = materialize(counts.withColumn("chunks", F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("weight") / WEIGHT, F.lit(1)))), "group-sizes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = _dealt(lookup(sets, counts, "cell", "chunks", "n", total), "chunks")
    return materialize(connected_components(dealt.mapInArrow(_link_sets(similarity), "u long, v long")), "components")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near duplicates: of each component one row stays, with the columns of docs: the one with
    the smallest doc_id, a null one last.  A row is known by its text and doc_id, so rows that share only a doc_id, or
    only lack one, do not touch each other."""
    tune(docs.sparkSession)
    doc_id, key = F.col("doc_id").cast("long"), fresh(docs, "_node", "_id", "_none")
    node, id_, none = key
    own = docs.withColumns({node: F.xxhash64(F.coalesce("text", F.lit(""))), id_: F.coalesce(doc_id, F.lit(0)), none: doc_id.isNull()})
    part = similar_components(own.select(F.col(node).alias("node"), text_bytes().alias("text")), **(STAGE | options))

    # What happens to the rows of a key is decided without their texts.
    keys = own.groupBy(*key).agg(F.count("*").alias("n")).join(part.withColumnRenamed("node", node), node, "left")
    keys = materialize(keys.withColumn("component", F.coalesce("component", node)), "row-keys")
    first = keys.groupBy("component").agg(F.min(F.struct(none, id_, node)).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    first = materialize(first, "first-rows")
    total = first.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    goes = F.struct(none, id_, node) != F.col("first")
    fates = lookup(keys, first, "component", "first", "rows", total).where(goes | (F.col("n") > 1)).select(*key, goes.alias("goes"))
    fates = materialize(fates, "fates")

    (goes,) = fresh(own, "goes")
    touched, rest = may_hold(own, fates, key)
    told = touched.join(fates.withColumnRenamed("goes", goes), key, "left")
    # Of rows that are one by text and doc_id, the same is kept in every run, whatever their order.
    whole = F.struct(*own.columns)
    once = told.where(~F.col(goes)).groupBy(*key).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("_kept")).select("_kept.*")
    alone = told.where(F.col(goes).isNull()).select(rest.columns)
    return rest.unionByName(alone).unionByName(once.select(rest.columns)).select(docs.columns)
