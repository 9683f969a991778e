"""Readers and sinks with explicit schemas; a column that a file lacks is null."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "struct<input_tokens int, output_tokens int, cost_usd double, calls int>"
STRUCTURE = f"""task_id string, arm string, encoding string, model string, kind string, prompt_chars int, hit boolean, precise boolean,
flagged_distractors int, findings int, parse_failed boolean, mechanism boolean, message string, is_defect boolean, correct boolean,
correct_precise boolean, finish_reason string, usage {USAGE}, cost double,
finding_scores array<struct<line int, hit boolean, confidence int>>, item_score int, hunk_score int, hunk_ratings map<string, int>,
raw_text string, called_at double, output_tokens int, reasoning_tokens int"""
OUTCOME = "defect_id string, task_id string, condition string, hit boolean, matched_finding_id string, line_distance int"
RAW_REVIEW = f"""task_id string, condition string, model string, context_chars int, context_text string, retrieval string,
findings array<struct<finding_id string, path string, line int, message string>>, parse_failed boolean, usage {USAGE}, raw_text string"""


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines, blank lines skipped, with `file` and `ordinal` (position within the file's splits) as the order in
    which "first" and "last" are meant: files by name, then lines."""
    df = spark.read.schema(schema).json(paths)
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))


def structure_runs(spark: SparkSession, paths: str | list[str], arms: list[str] | None = None, kind: str | None = "default_flip") -> DataFrame:
    """Structure records of known arms and one kind; a missing kind counts as default_flip, a missing is_defect as
    true, a failed parse has no metric."""
    df = read_jsonl(spark, paths, STRUCTURE)
    df = df.where(F.col("arm").isin(arms)) if arms else df
    df = df.where(F.coalesce("kind", F.lit("default_flip")) == kind) if kind else df
    return rescore(df.withColumn("is_defect", F.coalesce("is_defect", F.lit(True))))


def rescore(df: DataFrame) -> DataFrame:
    """Metrics of unparseable replies become null, never false."""
    failed = F.coalesce("parse_failed", F.lit(False))
    return df.withColumns({c: F.when(~failed, F.col(c)) for c in ("correct", "mechanism", "correct_precise") if c in df.columns})


def load_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, reviews) of a run's folder: outcomes.jsonl and raw.jsonl."""
    return read_jsonl(spark, f"{folder}/outcomes.jsonl", OUTCOME), read_jsonl(spark, f"{folder}/raw.jsonl", RAW_REVIEW)


def hits(outcomes: DataFrame, exact: bool = False) -> DataFrame:
    """(task_id, defect_id, hit): the last outcome of each defect; with exact, a hit is a finding on its very line."""
    hit = F.coalesce("hit", F.lit(False))
    hit = hit & F.coalesce(F.col("line_distance") == 0, F.lit(False)) if exact else hit
    order = F.struct("file", "ordinal")
    return outcomes.groupBy("task_id", "defect_id").agg(F.max_by(hit, order).alias("hit"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose last column is YES or NO; other rows go."""
    df = spark.read.option("header", True).csv(path)
    value = F.upper(F.trim(F.col(df.columns[-1])))
    return df.where(value.isin("YES", "NO")).withColumn(df.columns[-1], value == "YES")


def read_zip_results(spark: SparkSession, path: str, member: str = "result.json") -> DataFrame:
    """(archive, name, instance_id, comment, verified) of results[] in every such member of ZIP archives."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(member)):
                        for r in json.loads(z.read(name)).get("results", []):
                            rows.append((p, name, r.get("instance_id"), r.get("comment"), r.get("verified")))
            yield pd.DataFrame(rows, columns=["archive", "name", "instance_id", "comment", "verified"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return raw.mapInPandas(unzip, "archive string, name string, instance_id string, comment string, verified boolean")


def read_sources(spark: SparkSession, path: str, suffixes: str = "{py,js,java,c}") -> DataFrame:
    """(path, text, bytes, modified) of the source files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffixes}").load(path)
    return df.select("path", F.col("content").cast("string").alias("text"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that the output table lacks."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def write_jsonl(df: DataFrame, path: str, by: list[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).json(path)


def cached(spark: SparkSession, root: str, key: dict, build) -> DataFrame:
    """The table kept under a key, as root/name=value/…; it is built and written where there is none.

    Each builder writes a folder of its own, so that two at once do not mix; all readers take the same of them.  A
    table that is there but cannot be read is an error, not a reason to build it anew."""
    path = "/".join([root, *(f"{k}={v}" for k, v in sorted(key.items()))])
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        build().write.parquet(f"{path}/built=b{uuid.uuid4().hex}")
        table = spark.read.parquet(path)
    first = table.agg(F.min("built")).first()[0]
    return table.where(F.col("built") == first).drop("built")


def flat_paths(files: DataFrame) -> DataFrame:
    """files(path, …) with its folders as an array, its name and its suffix."""
    name = F.substring_index("path", "/", -1)
    parts = F.split("path", "/")
    return files.select("*", F.slice(parts, 1, F.size(parts) - 1).alias("folders"), name.alias("name"), F.regexp_extract(name, r".(\.[^.]*)$", 1).alias("suffix"))
