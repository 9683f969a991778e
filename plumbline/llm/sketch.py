"""Threshold-scaled document sketches (operator 5), DataFrame functions only.

A sketch keeps every distinct hash of a text's five-word shingles that lies below a fixed fraction of the hash
range.  The threshold is the same for all texts, so sketches merge, and the share of A's hashes that are in B's
sketch estimates the containment of A in B however unequal the two are.  A text with too few hashes there keeps its
LEAST smallest, so that short texts are told apart; two sketches are compared up to where both are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tune

SHINGLE = 5
#: The fraction of the hash range that is retained.
FRACTION = 1 / 8
#: Hashes that a sketch has at least, if its text has as many shingles.
LEAST = 16
#: Bits of an id that the windows of next_ids share level by level; a window has at most 2 ** bits rows.
LEVELS = (10, 14, 20, 20)


def _limit(fraction: float) -> int:
    return int(-(2**63) + fraction * 2**64)


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words between ASCII white space."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[ \\t\\n\\u000B\\f\\r]+"), lambda w: w != "")


def shingle_hash(w: Column, i: Column, size: int) -> Column:
    """Hash of the `size` words of w from i (0-based); past the end nothing is added."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(size)])


def sketch(text: Column, size: int = SHINGLE, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Sorted distinct shingle hashes below the fraction; where fewer than `least` lie there, the `least` smallest
    (all, if there are fewer).  A text of fewer words than a shingle is one shingle; null and empty texts have an
    empty sketch."""
    below = F.lit(_limit(fraction))

    def keep(found: Column) -> Column:
        held = F.filter(found, lambda h: h < below)
        # One lambda over each array, so that it is computed once however often it is named.
        return F.transform(F.array(held), lambda x: F.when(F.size(x) >= least, F.array_sort(x)).otherwise(F.slice(F.array_sort(found), 1, least)))[0]

    def shingles(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: shingle_hash(w, i, size))
        return F.array_distinct(F.when(F.size(w) > 0, every).otherwise(F.array().cast("array<bigint>")))

    hashes = F.transform(F.array(words(F.coalesce(text, F.lit("")))), shingles)
    return F.transform(hashes, keep)[0]


def fingerprint(hashes: Column) -> Column:
    """The sketch as hex digits, 16 a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def horizon(a: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Up to where a sketch has every hash of its text: everywhere if it has less than `least`."""
    return F.when(F.size(a) < least, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(_limit(fraction) - 1), F.element_at(a, -1)))


def _shared(a: Column, b: Column, fraction: float, least: int) -> tuple[Column, Column, Column]:
    """Sizes of a, of b and of what they share, up to the horizon of both."""
    end = F.least(horizon(a, fraction, least), horizon(b, fraction, least))
    a, b = (F.filter(x, lambda h: h <= end) for x in (a, b))
    return F.size(a), F.size(b), F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Likeness of two sketches, 0 to 1, over the hashes that both would have kept; two texts without a word are
    alike.  Exact for texts of less than `least` shingles."""
    n, m, both = _shared(a, b, fraction, least)
    return F.when(n + m == 0, F.lit(1.0)).otherwise(both.cast("double") / (n + m - both))


def containment(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimated share of a's shingles that b has; null where no hash of a lies below the horizon of both."""
    n, _, both = _shared(a, b, fraction, least)
    return F.when(n > 0, both.cast("double") / n)


def merge(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of the union of two shingle sets, the same as if it had been taken of them."""
    union = F.array_sort(F.array_union(a, b))
    held = F.filter(union, lambda h: h < F.lit(_limit(fraction)))
    return F.when(F.size(held) >= least, held).otherwise(F.slice(union, 1, least))


def _next_lower(ids: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """ids(id, distinct) -> (id, next): the next lower id, null for the lowest.  Ids that agree above the lowest
    levels[0] bits share a window, of at most 2 ** levels[0] rows; across windows the same is done with the rest."""
    if not levels:
        return ids.withColumn("next", F.lead("id").over(W.orderBy(F.desc("id"))))
    up = F.shiftright("id", levels[0])
    inner = ids.withColumn("up", up).withColumn("near", F.lead("id").over(W.partitionBy("up").orderBy(F.desc("id"))))
    tops = ids.groupBy(up.alias("up")).agg(F.max("id").alias("top"), F.min("id").alias("low"))
    steps = _next_lower(tops.select(F.col("up").alias("id")), levels[1:])
    far = steps.join(tops.select(F.col("up").alias("next"), F.col("top").alias("far")), "next").select("id", "far")
    bridge = tops.select("up", "low").join(far.withColumnRenamed("id", "up"), "up").select(F.col("low").alias("id"), "far")
    return inner.join(bridge, "id", "left").select("id", F.coalesce("near", "far").alias("next"))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids(id) -> (id, next): the next lower id, after the lowest the highest.  No window has over 2 ** 20 rows:
    the last level holds at most all values of the sign-extended top 20 bits."""
    ids = ids.where("id is not null").distinct()
    wrap = ids.agg(F.min("id").alias("id"), F.max("id").alias("next")).where("id is not null")
    return _next_lower(ids, LEVELS[:-1]).where("next is not null").union(wrap)


def with_next(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Each document beside the next one in descending doc_id: (doc_id, text, s, next_text, next_s), s the sketch.

    The texts and their sketches are shuffled once, by doc_id >> 10, so that a window has at most 1024 ids; only the
    first document of each window is fetched again for the window above.  Rows that repeat a doc_id follow each other
    in text order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.where("doc_id is not null").withColumn("up", F.shiftright("doc_id", LEVELS[0]))
    window = W.partitionBy("up").orderBy(F.desc("doc_id"), "text")
    inner = own.withColumn("s", sketch(F.col("text"), size, fraction)).withColumn("near", F.lead(F.struct("text", "s")).over(window))
    ids = own.select("up", F.col("doc_id").alias("id"))
    tops = ids.groupBy("up").agg(F.max("id").alias("top"))
    order = next_ids(tops.select(F.col("up").alias("id"))).withColumnRenamed("id", "up")
    order = materialize(order.join(tops.withColumnRenamed("up", "next"), "next").select("up", "top"), "order")
    first = own.join(order.select(F.col("top").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("top")).agg(F.min("text").alias("far"))
    bridge = order.join(first, "top").select("up", F.struct(F.col("far").alias("text"), sketch(F.col("far"), size, fraction).alias("s")).alias("far"))
    linked = inner.join(bridge, "up", "left").select("doc_id", "text", "s", F.coalesce("near", "far").alias("x"))
    alone = rows.where("doc_id is null").select("doc_id", "text", sketch(F.col("text"), size, fraction).alias("s"), F.struct(F.lit("").alias("text"), sketch(F.lit("")).alias("s")).alias("x"))
    return linked.union(alone).select("doc_id", "text", "s", F.col("x.text").alias("next_text"), F.col("x.s").alias("next_s"))


def edited_pairs(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Sketches of every document, of its edited text and of the next document, with their likeness.

    The edited text has the last floor(n / 3) code points replaced by the first as many (or all) of the next
    document's; see with_next for the order.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (Jaccard) and the containments of a document in the other two.

    Null texts count as empty.  A null doc_id has no place in the order: its next text is empty.  A table of one
    document is its own next.  Extra columns are ignored; an empty table gives an empty result."""
    tune(docs.sparkSession)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    df = with_next(docs, size, fraction).withColumn("n_chars", n.cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "s", sketch(F.col("edited"), size, fraction).alias("e"), F.col("next_s").alias("x"))
    s, e, x = F.col("s"), F.col("e"), F.col("x")
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(s).alias("fingerprint"),
        fingerprint(e).alias("edited_fingerprint"),
        jaccard(s, e, fraction).alias("near_edited"),
        jaccard(s, x, fraction).alias("near_next"),
        containment(s, e, fraction).alias("contained_edited"),
        containment(s, x, fraction).alias("contained_next"),
    )
