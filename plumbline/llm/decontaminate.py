"""Benchmark decontamination (operator 2) by spaced-seed hashing, DataFrame functions only.

A seed is a fixed mask over a short stretch of words: positions marked 1 are hashed, the others may differ.  Seeds
of the benchmark and of the documents are joined by hash; each hit names a diagonal (document position less item
position) at which the whole item is laid against the document, word by word.  A document is a leak of an item if
enough of the item's words agree there, so that substituted words are tolerated.

Items of eight words and more are found by three masks of five words.  For shorter ones the masks go by the item's
length: the parts of the item that are left when the words that may differ are taken out of it in every way.

Documents' seeds pass a bitmap of the benchmark's seeds before the join.  Its size is fixed, whatever the benchmark's
size; a fuller bitmap lets more through to the join, which decides.  Documents are known by a hash of their text, so
that equal texts are judged once and rows without an id like any other."""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, tune

#: Five words each, as fixed masks; 1 is hashed, 0 is ignored.
MASKS = ("11111", "1101011", "10110011")
#: Items of fewer words have masks of their own.
SHORT = 8
SIMILARITY = 0.8
#: Slots of the bitmap, one byte each, and the hash bits that two probes take.
SLOTS = 1 << 21
#: Rows of a benchmark table that are broadcast at most; beyond it both sides are dealt by key and salt.
BROADCAST_ROWS = 100_000
SALTS = 16


def masks_of(n: int, similarity: float = SIMILARITY) -> list[tuple[int, str]]:
    """(offset, mask) of the seeds of a short item of n words, cut to their outermost 1s.  If m of its words may
    differ, the item is cut into m + 2 blocks and every choice of m blocks is ignored once, so that one seed at least
    has no differing word."""
    may_differ = int(n * (1 - similarity) + 1e-9)
    edges = [round(k * n / (may_differ + 2)) for k in range(may_differ + 3)]
    found = []
    for out in combinations([set(range(a, b)) for a, b in pairwise(edges)], may_differ):
        mask = "".join("0" if any(p in block for block in out) else "1" for p in range(n))
        seed = (mask.find("1"), mask.strip("0"))
        if seed[1] and seed not in found:
            found.append(seed)
    return found


def words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, letters of every script lower-cased."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def seed_hash(w: Column, i: Column, mask: str) -> Column:
    """Hash of the words of w under a mask at position i (0-based)."""
    return F.xxhash64(F.lit(mask), *[F.get(w, i + o) for o, c in enumerate(mask) if c == "1"])


def _seed(w: Column, mask: str):
    return lambda i: F.struct(seed_hash(w, i, mask).alias("hash"), i.alias("pos"))


NO_SEEDS = "array<struct<hash:bigint,pos:int>>"


def seeds(w: Column, masks, passes=None) -> Column:
    """array<struct<hash, pos>> of all seeds of w under the masks, of those whose hash passes.  A text shorter than a
    mask has no seed of it."""
    found = []
    for mask in masks:
        last = F.size(w) - len(mask)
        made = F.transform(F.sequence(F.lit(0), last), _seed(w, mask))
        if passes is not None:
            made = F.filter(made, lambda s: passes(s["hash"]))
        found.append(F.when(last >= 0, made).otherwise(F.array().cast(NO_SEEDS)))
    return F.flatten(F.array(*found))


def item_seeds(w: Column, short: list[int], similarity: float = SIMILARITY) -> Column:
    """The seeds of an item: of short ones by the masks of their length, which start at fixed places."""
    out = F.when(F.size(w) >= SHORT, seeds(w, MASKS))
    for n in short:
        own = F.array(*[F.struct(seed_hash(w, F.lit(o), mask).alias("hash"), F.lit(o).alias("pos")) for o, mask in masks_of(n, similarity)])
        out = out.when(F.size(w) == n, own)
    return out.otherwise(F.array().cast(NO_SEEDS))


def _slots(h: Column) -> list[Column]:
    return [F.pmod(h, F.lit(SLOTS)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(SLOTS)).cast("int")]


def _bitmap(marks: DataFrame) -> Column:
    """One byte per slot, 1 where a benchmark seed falls, as a scalar subquery.  At most SLOTS distinct slots reach
    the driver."""
    used = marks.select(F.explode(F.array(*_slots(F.col("hash")))).alias("slot")).distinct().toPandas()["slot"]
    out = bytearray(SLOTS)
    for s in used.tolist():
        out[s] = 1
    return materialize(marks.sparkSession.createDataFrame([(out,)], "bits binary"), "bitmap").scalar()


def _probe(bits: Column, h: Column) -> Column:
    a, b = (F.substring(bits, s + 1, F.lit(1)) == F.lit(b"\x01") for s in _slots(h))
    return a & b


def _join_marks(rows: DataFrame, marks: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined with a table of the benchmark on `key`.  The table goes to all executors if it has few rows; else
    it is repeated for every salt and the rows of a frequent key are spread over the salts."""
    if marks.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(marks), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    every = marks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [key, "_salt"]).drop("_salt")


def text_key(text: Column) -> Column:
    """128 bits that a text is known by; different texts do not share them."""
    return F.unhex(F.md5(text))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, _item, item): each row of the benchmark that has a word, its words, and 128 bits of these."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item")).where("size(item) > 0")
    return own.select("item_id", text_key(F.array_join("item", " ")).alias("_item"), "item")


def _leaks(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """(_text, _item, n_matched, n_words) of the texts and the different items that overlap enough."""
    items = materialize(_items(benchmark).groupBy("_item").agg(F.first("item").alias("item")), "items")
    short = sorted(r["n"] for r in items.where(F.size("item") < SHORT).select(F.size("item").alias("n")).distinct().collect())
    masks = [*MASKS, *sorted({m for n in short for _, m in masks_of(n, similarity)} - set(MASKS))]
    marks = items.select("_item", F.size("item").alias("n_words"), F.explode(item_seeds(F.col("item"), short, similarity)).alias("s"))
    marks = materialize(marks.select("_item", "n_words", F.col("s.hash").alias("hash"), F.col("s.pos").alias("item_pos")), "item-seeds")
    own = docs.where("text is not null").select(text_key(F.col("text")).alias("_text"), "text")
    # One lambda over the word array and the bitmap: the words are split once per text, and the bitmap is a reference.
    held = F.array(F.struct(words(F.col("text")).alias("w"), F.col("bits")))
    hits = own.withColumn("bits", _bitmap(marks)).select("_text", F.transform(held, lambda x: seeds(x["w"], masks, lambda h: _probe(x["bits"], h))).alias("s"))
    hits = hits.select("_text", F.explode(F.flatten("s")).alias("s"))
    hits = hits.select("_text", F.col("s.hash").alias("hash"), F.col("s.pos").alias("pos"))
    places = _join_marks(hits, marks, "hash", "_text").select("_text", "_item", "n_words", (F.col("pos") - F.col("item_pos")).alias("at")).distinct()
    places = materialize(places, "diagonals")

    # The whole item is laid against the words from `at` on; a part of it beyond either end of the text disagrees.
    wanted = places.select("_text").distinct()
    read = own.join(wanted, "_text", "left_semi").dropDuplicates(["_text"]).select("_text", words(F.col("text")).alias("w"))
    laid = read.join(places, "_text").select("_text", "_item", "n_words", "at", F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("n_words") + F.least(F.col("at"), F.lit(0))).alias("part"))
    same = F.aggregate(F.sequence(F.lit(0), F.col("n_words") - 1), F.lit(0), lambda n, i: n + F.when(F.get("item", i) == F.get("part", i + F.least(F.col("at"), F.lit(0))), 1).otherwise(0))
    scored = _join_marks(laid, items, "_item", "_text").select("_text", "_item", "n_words", same.alias("n_matched"))
    best = scored.groupBy("_text", "_item", "n_words").agg(F.max("n_matched").alias("n_matched"))
    return materialize(best.where(F.col("n_matched").cast("double") / F.col("n_words") >= similarity), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_matched, n_words, overlap) of every document and benchmark item of which the document has
    an overlap of at least `similarity`: the largest share of the item's words that agree at one diagonal.

    Null and empty texts and items have no leaks.  Rows of docs that repeat a doc_id count as one document, with its
    best overlap; rows without a doc_id count by their text and are reported with a null doc_id.  Equal items are
    reported each, items without an id not at all.  Items of eight words and more are found by seeds, so that an
    overlap whose differing words break every seed is missed (none in tests at random substitutions); shorter items
    are found always.  Texts and items of any length are read whole.  Extra columns are ignored; empty tables give an empty
    result."""
    tune(docs.sparkSession)
    ids = _items(benchmark).where("item_id is not null").select("_item", "item_id").distinct()
    leaks = _leaks(docs, benchmark, similarity).join(ids, "_item")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_text"))
    found = rows.join(leaks, "_text").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("_text")).alias("_text"), "item_id", "n_words").agg(F.max("n_matched").alias("n_matched"))
    overlap = F.col("n_matched").cast("double") / F.col("n_words")
    return found.select("doc_id", "item_id", F.col("n_matched").cast("long"), F.col("n_words").cast("long"), overlap.alias("overlap"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows without leaks, with the columns of docs.  Every row is judged by its own text, whatever its doc_id, and
    every item counts, with an id or without; null texts stay."""
    tune(docs.sparkSession)
    (leak,) = fresh(docs, "_leak")
    leaks = _leaks(docs.select("text"), benchmark, similarity).select(F.col("_text").alias(leak)).distinct()
    return docs.join(leaks, text_key(F.col("text")) == F.col(leak), "left_anti")
