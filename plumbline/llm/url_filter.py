"""URL filters (operator 1): rules first, then a ratio of character language models.

URLs that a rule decides train two smoothed variable-order Markov models, of accepted and of rejected URLs.  A URL
that no rule decides is judged by its log-likelihood difference per character, against a threshold calibrated on
rule-decided URLs that were kept from training.

Counts are keyed by the gram itself (up to five bytes and the order fit a long), so none is mixed with another, in
a table that grows with the URLs' grams.  The distinct keys of a chunk of URLs are joined with that table, and the
chunk is scored with what comes back; no count reaches the driver, and no key has more rows than there are chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, tune

# The rules (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

ORDERS = 5
#: Positions of a chunk of URLs, which are counted or scored together.
POSITIONS = 1 << 16
#: Weight of the next lower order.
BACKOFF = 2.0
#: One in CALIBRATE of the rule-decided URLs calibrates, the others train.
CALIBRATE = 5
BINS = 400
BIN_WIDTH = 0.05


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end.  Both
    empty if url is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null if none fits."""
    text = action = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        action = F.when(fits, what) if action is None else action.when(fits, what)
    return text, action


def _codes(url: str) -> np.ndarray:
    """Bytes of a URL after its scheme, between a start and an end mark."""
    return np.frombuffer(b"\x02" + (url.split("://", 1)[-1]).lower().encode("utf-8", "replace") + b"\x03", np.uint8).astype(np.uint64)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """(2 * ORDERS, positions) keys at each position but the first: row k is the gram of order k that ends there,
    row ORDERS + k its context, the k bytes before.  A key holds the row in its low four bits and then nine bits a
    byte (the byte plus 1, 0 before the URL's start), so that different grams have different keys."""
    n = len(codes) - 1
    out, context = np.zeros((2 * ORDERS, n), np.int64), np.zeros(n, np.int64)
    byte = codes.astype(np.int64) + 1
    for k in range(ORDERS):
        out[k] = (context << 9 | byte[1:]) << 4 | k
        out[ORDERS + k] = context << 4 | (ORDERS + k)
        back = np.zeros(n, np.int64)
        back[k:] = byte[: n - k] if k < n else back[k:]
        context = context | back << (9 * k)
    return out


def _chunks(urls: Iterable[str]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """URLs and their keys, about POSITIONS positions at a time."""
    held, keys, size = [], [], 0
    for url in urls:
        held.append(url)
        keys.append(keys_of(_codes(url)))
        size += keys[-1].shape[1]
        if size >= POSITIONS:
            yield held, keys
            held, keys, size = [], [], 0
    if held:
        yield held, keys


def count_grams(decided: DataFrame) -> DataFrame:
    """decided(url, verdict) -> (key, allow, block): occurrences of every gram and context in URLs of each verdict."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for side, name in enumerate(("allow", "block")):
                for _, found in _chunks(u for u, v in rows if v == name):
                    keys, n = np.unique(np.concatenate([k.ravel() for k in found]), return_counts=True)
                    counts = [n, np.zeros_like(n)][:: -1 if side else 1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, counts)], ["key", "allow", "block"])

    return decided.mapInArrow(run, "key long, allow long, block long").groupBy("key").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def _score(table: pa.Table) -> pa.Table:
    """A chunk (chunk, url, key, allow, block): URLs, and apart from them the counts of the keys that training has."""
    known = table.filter(table["key"].is_valid())
    keys = known["key"].to_numpy()
    order = np.argsort(keys)
    keys = np.append(keys[order], np.iinfo(np.int64).max)
    counts = np.stack([np.append(known[side].to_numpy()[order], 0.0) for side in ("allow", "block")])
    urls, out = table.filter(table["url"].is_valid())["url"].to_pylist(), []
    for url in urls:
        wanted = keys_of(_codes(url))
        at = np.searchsorted(keys, wanted)
        seen = np.where(keys[at] == wanted, counts[:, at], 0.0)
        p = np.full((2, wanted.shape[1]), 1 / 256)
        for k in range(ORDERS):
            p = (seen[:, k] + BACKOFF * p) / (seen[:, ORDERS + k] + BACKOFF)
        out.append(float((np.log(p[0]) - np.log(p[1])).mean()))
    return pa.table({"url": pa.array(urls, pa.string()), "difference": pa.array(out, pa.float64())})


def differences(urls: DataFrame, grams: DataFrame) -> DataFrame:
    """Distinct urls(url) -> (url, difference): log P(accepted) - log P(rejected), per character."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        rows = (u for batch in batches for u in batch.column(0).to_pylist())
        for n, (held, found) in enumerate(_chunks(rows)):
            keys = np.unique(np.concatenate([k.ravel() for k in found]))
            none = pa.nulls(len(keys), pa.string()), pa.nulls(len(held), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), first + n)), pa.array(held, pa.string()), none[1]], ["chunk", "url", "key"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), first + n)), none[0], pa.array(keys)], ["chunk", "url", "key"])

    chunks = materialize(urls.select("url").mapInArrow(run, "chunk long, url string, key long"), "url-chunks")
    seen = chunks.where("key is not null").join(grams, "key").select("chunk", "url", "key", "allow", "block")
    own = chunks.where("url is not null").withColumns({"allow": F.lit(None).cast("long"), "block": F.lit(None).cast("long")})
    return own.unionByName(seen).groupBy("chunk").applyInArrow(_score, "url string, difference double")


def calibrate(held: DataFrame) -> float:
    """The threshold with the best balanced accuracy on held(verdict, difference), from a histogram of BINS differences."""
    bin_ = F.least(F.greatest(F.floor(F.col("difference") / BIN_WIDTH) + BINS // 2, F.lit(0)), F.lit(BINS - 1))
    rows = held.groupBy("verdict", bin_.alias("bin")).count().collect()
    seen = np.zeros((2, BINS))
    for r in rows:
        seen[int(r["verdict"] == "block"), int(r["bin"])] += r["count"]
    if not seen.sum(axis=1).all():
        return 0.0
    share = np.concatenate([np.zeros((2, 1)), np.cumsum(seen, axis=1)], axis=1) / seen.sum(axis=1, keepdims=True)
    score = share[1] - share[0]  # below a threshold: rejected found less accepted lost
    best = np.flatnonzero(score == score.max())
    return float((best[len(best) // 2] - BINS // 2) * BIN_WIDTH)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) of every row; difference is null where a rule decides.

    Urls that are null or without :// have an empty host and path and are judged by the model, as all that no rule
    fits; with no rule-decided URL of either kind the threshold is 0 and ties are allowed.  Rows that repeat a url
    get the same verdict; null page_ids stay; extra columns are ignored; an empty table gives an empty result."""
    tune(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), path.alias("path"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text.cast("string")).withColumn("action", action.cast("string"))
    rows = rows.withColumn("held", F.col("action").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0))
    grams = materialize(count_grams(rows.where("action is not null and not held").select("url", "action")), "grams")
    # The model reads a null url as an empty one.
    asked = rows.where("action is null or held").withColumn("url", F.coalesce("url", F.lit("")))
    urls = materialize(asked.groupBy("url").agg(F.count("*").alias("n")), "urls")
    scored = materialize(urls.join(differences(urls, grams), "url"), "differences")
    total = scored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = lookup(asked, scored, "url", "difference", "n", total)
    threshold = calibrate(asked.where("held").select(F.col("action").alias("verdict"), "difference"))
    judged = asked.where("action is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("difference") >= threshold, "allow").otherwise("block").alias("verdict"), "difference")
    ruled = rows.where("action is not null").select("page_id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit(None).cast("double").alias("difference"))
    return ruled.unionByName(judged)
