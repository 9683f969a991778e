"""What the training-data operators share: table access, lineage cuts and Arrow batch helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ARROW_BYTES, ARROW_ROWS, tune  # noqa: F401
from ..tables import materialize

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Bits of the bitmap of may_hold(), whatever the number of keys: 4 MB.
BITMAP = 1 << 25


def may_hold(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows split in two: those that may have a key of keys(on…), and those that surely have none.

    The split is by a bitmap of fixed size, which goes to all tasks, so that the rows without a key, most of them as a
    rule, need not be shuffled for a join; with more keys than it has bits, all rows are in the first part."""
    slot = F.pmod(F.xxhash64(*on), F.lit(BITMAP)) + 1
    marks = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    marks = materialize(marks, "bitmap")
    bucket, bits, at = fresh(rows, "_bucket", "_bits", "_at")
    marked = rows.withColumn(at, slot)
    marked = marked.join(F.broadcast(marks.withColumnsRenamed({"_bucket": bucket, "_bits": bits})), F.bitmap_bucket_number(at) == F.col(bucket), "left")
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    return tuple(marked.where(c).select(rows.columns) for c in (held, ~held))


#: Keys that lookup() treats as hot, at most.
HOT_KEYS = 512


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, count: str, total: int) -> DataFrame:
    """rows with `value` from table(key, value, count) by an inner join on `key`; count is a key's number of rows,
    total at least their sum.

    A key with more than total / HOT_KEYS rows is hot.  There are fewer than HOT_KEYS of these, whatever the input,
    so their values go along with the tasks and the rows of a hot key stay where they are; only the others are
    shuffled, and no key brings more than that share of the rows to one task."""
    hot = table.where(F.col(count) > total / HOT_KEYS).select(key, value).collect()
    if not hot:
        return rows.join(table.select(key, value), key)
    values = rows.sparkSession.createDataFrame(hot, table.select(key, value).schema)
    is_hot = F.col(key).isin([r[key] for r in hot])
    rest = rows.where(~is_hot).join(table.where(~is_hot).select(key, value), key)
    return rest.unionByName(rows.where(is_hot).join(F.broadcast(values), key))
