"""Tables in the shared folder: lineage cuts that outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a local master (tests), a folder that goes at exit.
    On a cluster it has to be set, as executors do not share local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by a key to several tasks a core.  For rows that are small but become much work: a small file is one
    task, and adaptive execution joins small shuffles to few, unless their number is given."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def placed(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with each row's place, from 0, in a total order.

    The order is dealt in ranges; rows are numbered within a range, and a range begins where those before it end."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).drop("_n")
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    out = ranged.withColumn("_at", at).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
