"""Ranked lexical search (operator 13): postings in term buckets, joined with the items' terms and summed.

A posting is a row (bucket, term, row, doc_id, n, tf); one more row a document, in bucket -1 with an empty term, holds
its length, so that an index also gives the number of documents and of all terms.  A search takes from the index the
buckets and terms that some item asks for, weighs terms by their document frequency, joins item terms, scores every
match in integers, sums by item and document and ranks by row_number.  Terms of any frequency are spread, since the matches are dealt by document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, tune

BUCKETS = 256
TOP = 10
#: Terms are runs of digits, letters and non-ASCII characters; only A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Rows of a file of the items' terms.
FILE_ROWS = 200_000
LENGTHS = -1  # bucket of the rows with documents' lengths


def _counted(rows: DataFrame) -> DataFrame:
    """rows(id long, text binary) -> (row, id, n, terms, counts): a row for each text with a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            kept, numbers, sizes, starts, terms, counts = [], [], [], [0], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = text.translate(FOLD).split()
                if words:
                    seen = Counter(words)
                    kept.append(k)
                    numbers.append(row)
                    sizes.append(len(words))
                    terms += seen.keys()
                    counts += seen.values()
                    starts.append(len(terms))
                row += 1
            starts = pa.array(starts, pa.int32())
            columns = [pa.array(numbers, pa.int64()), batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(starts, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(starts, pa.array(counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n", "terms", "counts"])

    return rows.mapInArrow(run, "row long, id long, n long, terms array<binary>, counts array<int>")


def postings(docs: DataFrame) -> DataFrame:
    """(bucket, term, row, doc_id, n, tf) of all terms of whole texts, and a row with each document's length n.

    `row` tells rows with equal ids apart.  A null text, or one without a term, gives no row."""
    tune(docs.sparkSession)
    counted = _counted(docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")))
    terms = F.concat(F.array(F.lit(b"")), "terms").alias("term"), F.concat(F.array(F.lit(0)), "counts").alias("tf")
    rows = counted.select("row", F.col("id").alias("doc_id"), "n", F.inline(F.arrays_zip(*terms)).alias("term", "tf"))
    rows = rows.withColumn("term", F.col("term").cast("string"))
    bucket = F.when(F.col("term") == "", F.lit(LENGTHS)).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    return rows.select(bucket.alias("bucket"), "term", "row", "doc_id", "n", "tf")


def write_index(docs: DataFrame, path: str) -> None:
    """Write the postings to a folder for each bucket, sorted by term, so that a search reads its own terms only.
    Documents stay in the task that read them, so a frequent term is spread over all tasks."""
    postings(docs).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, bucket, term) of each row of items, a term once."""
    rows = postings(items.select(F.col("item_id").alias("doc_id"), "text")).where(F.col("bucket") != LENGTHS)
    return materialize(rows.select(F.col("row").alias("item"), F.col("doc_id").alias("item_id"), "bucket", "term"), "item-terms")


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents with the highest scores above 0, ties by doc_id,
    null ids last.

    Whole texts of both sides count.  Rows of items that repeat an id are ranked each by itself, and so are rows of
    documents; items that are null or have no term, or only terms that no document has, give no row; extra columns are
    ignored; empty tables give an empty result."""
    terms = _item_terms(items)
    asked = terms.select("bucket", "term").union(items.sparkSession.createDataFrame([(LENGTHS, "")], "bucket int, term string")).distinct()
    # Small tables are few files, so that a file's own overhead does not count as data when the join, which knows the
    # size, decides whether to send the table along.
    files = 1 + terms.count() // FILE_ROWS
    asked = materialize(asked.coalesce(files), "asked-terms")
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
    held = materialize(index.where(F.col("bucket").isin(buckets)).join(asked, ["bucket", "term"], "left_semi"), "postings")
    lengths, held = held.where(F.col("bucket") == LENGTHS), held.where(F.col("bucket") != LENGTHS)
    n_docs, n_terms = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = held.groupBy("term").agg(F.count("*").alias("df")).select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    weighted = materialize(terms.join(weights, "term").where("w > 0").select("item", "item_id", "term", "w").coalesce(files), "item-weights")
    matches = held.withColumn("m", F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {max(n_terms, 1)}L)"))
    # A document's postings meet before they are joined, so that the many more pairs of item and document that come of
    # it are summed and ranked where they are; only each task's best are shuffled.
    matches = matches.select("term", "row", "doc_id", F.expr("(1000000000L * tf) div (1000L * tf + 8 * m)").alias("gain")).repartition("row").join(weighted, "term")
    sums = matches.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("gain")).alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
