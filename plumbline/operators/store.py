"""The review store: what the API reads and writes, as table operators."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of a comment's data that are shown, and those that the last comment of a thread shows besides.
SHOWN = "repo user pr_id feedback llm_model standards metrics reviewer_id feedback_status feedback_suggestion feedback_explanation".split()
SHOWN_LAST = "messages original_review updated_review".split()


@F.pandas_udf(T.StringType())
def shown_data(data: pd.Series, last: pd.Series) -> pd.Series:
    """A comment's JSON data with the keys that are shown; null if none is left or it is no object."""

    def one(text, is_last):
        try:
            got = json.loads(text)
        except (TypeError, ValueError):
            return None
        keys = [*SHOWN, *(SHOWN_LAST if is_last else [])]
        kept = {k: got[k] for k in keys if k in got} if isinstance(got, dict) else {}
        return json.dumps(kept) if kept else None

    return pd.Series([one(t, l) for t, l in zip(data, last)], dtype=object)


def thread_comments(comments: DataFrame, thread: str, order: list[str], data: str) -> DataFrame:
    """Comments as a thread shows them: their data cut to the keys that are shown, more of the last one's."""
    w = W.partitionBy(thread).orderBy(*[F.desc(c) for c in order])
    rows = comments.withColumn("is_last", F.row_number().over(w) == 1)
    return rows.withColumn(data, shown_data(F.col(data), F.col("is_last")))


def with_source(rows: DataFrame, extra: DataFrame, key: str, fields: list[str], source: str | None = None) -> DataFrame:
    """Rows with the fields that a remote listing has for them, and where they come from."""
    more = extra.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(more, key, "left")
    return out.select(*rows.columns, *[F.col(f"_{f}").alias(f) for f in fields], F.lit(source).cast("string").alias("source"))


def submit_ratings(feedback: DataFrame, usage: DataFrame, submitted: DataFrame, model: Column) -> tuple[DataFrame, DataFrame]:
    """feedback(review, user, rating, feedback), submitted(review, user, rating, feedback, at) -> the feedback with
    the last valid submission of each review and user, and the usage with a row without tokens for each valid one.
    A rating of 1 to 5 and a text are needed."""
    valid = submitted.where(F.col("rating").between(1, 5) & (F.coalesce("feedback", F.lit("")) != ""))
    newest = valid.groupBy("review", "user").agg(F.max(F.struct("at", "rating", "feedback")).alias("r")).select("review", "user", "r.rating", "r.feedback")
    kept = feedback.select("review", "user", "rating", "feedback").join(newest.select("review", "user"), ["review", "user"], "left_anti")
    rows = valid.select("review", "user", model.alias("llm_model"), F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0.0).alias("cost"))
    return kept.unionByName(newest), usage.unionByName(rows, allowMissingColumns=True)


def reply(comments: DataFrame, messages: DataFrame, answers: DataFrame, ai_user: str = "ai_assistant") -> DataFrame:
    """comments(thread, id, user, comment, type, parent, at) with a request for each of messages(thread, id, user,
    comment, parent, at) and a response for each of answers(request, id, comment, at).  Messages without text, and
    replies to a comment that the thread does not have, are not taken."""
    known = comments.select("thread", F.col("id").alias("parent")).distinct().withColumn("_known", F.lit(True))
    asked = messages.where(F.coalesce("comment", F.lit("")) != "").join(known, ["thread", "parent"], "left").where("parent is null or _known")
    requests = asked.select("thread", "id", "user", "comment", F.lit("request").alias("type"), "parent", "at")
    said = answers.join(requests.select("thread", F.col("id").alias("request")), "request")
    responses = said.select("thread", "id", F.lit(ai_user).alias("user"), "comment", F.lit("response").alias("type"), F.col("request").alias("parent"), "at")
    return comments.select(requests.columns).union(requests).union(responses)


def conversation(comments: DataFrame, thread: str = "thread", limit: int | None = None) -> DataFrame:
    """(thread, history): each thread's comments in the order of their time as struct<type, comment>, the last
    `limit`."""
    w = W.partitionBy(thread).orderBy(F.desc("at"), F.desc("id"))
    rows = comments.withColumn("_k", F.row_number().over(w))
    rows = rows.where(F.col("_k") <= limit) if limit else rows
    return rows.groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "type", "comment"))), lambda x: F.struct(x["type"].alias("type"), x["comment"].alias("comment"))).alias("history"))


def children_of(rows: DataFrame, parent: str, value) -> DataFrame:
    """The rows of one parent, as collaborators of a repository."""
    return rows.where(F.col(parent) == value)


def by_natural_key(rows: DataFrame, **keys) -> DataFrame:
    """The row with the given natural key, as a pull request by repository and number."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == value)
    return rows


def registered(remote: DataFrame, ours: DataFrame, key: str, id_: str) -> DataFrame:
    """A remote listing with whether we have each row, and our id of it; the smallest if we have several."""
    known = ours.groupBy(key).agg(F.min(id_).alias("system_id"))
    return remote.join(known, key, "left").withColumn("is_registered_in_system", F.col("system_id").isNotNull())


@F.pandas_udf(T.StringType())
def preference_line(value: pd.Series) -> pd.Series:
    """A stored preference of more than 0.7 confidence as a sentence, null for all else.  Its data may be JSON within
    the JSON."""

    def one(text):
        try:
            got = json.loads(text)
            data = json.loads(got["data"]) if isinstance(got.get("data"), str) else got.get("data")
        except (TypeError, ValueError, AttributeError):
            return None
        if got.get("type") != "preference" or not isinstance(data, dict) or not data.get("confidence", 0) > 0.7:
            return None
        return f"User prefers {data.get('preference')} (Category: {data.get('category')}, Context: {data.get('context')})"

    return pd.Series([one(v) for v in value], dtype=object)


def preferences(memory: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """(by…, preferences): the confident preferences of each user in order."""
    rows = memory.withColumn("_line", preference_line(F.col(value))).where("_line is not null")
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"]).alias("preferences"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def episode_lines(value: pd.Series) -> pd.Series:
    """What a stored episode says of earlier feedback and answers; nothing of what is no JSON object."""

    def one(text):
        try:
            got = json.loads(text)
        except (TypeError, ValueError):
            return []
        said = (("feedback_received", "Previous feedback"), ("ai_response_snippet", "Previous response"))
        return [f"{title}: {got[key]}" for key, title in said if key in got] if isinstance(got, dict) else []

    return pd.Series([one(v) for v in value], dtype=object)


def episodes(memory: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """(by…, episodes): the lines of each user's episodes in order."""
    rows = memory.withColumn("_lines", episode_lines(F.col(value))).where(F.size("_lines") > 0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_lines"))), lambda x: x["_lines"])
    return rows.groupBy(*by).agg(F.flatten(listed).alias("episodes"))
