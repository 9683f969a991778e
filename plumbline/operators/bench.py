"""Benchmarks of reviews: tasks with known defects, what a review says of them, and how it is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import ratio
from .match import greedy_match

VERDICT = "instance_id string, comment string, comment_type string, test_verified boolean"


def comment_defects(instances: DataFrame, verdicts: DataFrame | None = None, languages: list[str] | None = None, located: bool = True, confirmed: bool = False, supported: bool = False) -> DataFrame:
    """instances(instance_id, repo, language, base_commit, head_commit, diff, comments array<struct<path, line,
    original_line, text>>), verdicts(instance_id, comment, comment_type, test_verified) -> one row a defect: task_id,
    defect_id, repo, language, diff, path, line, text, comment_type, test_verified.

    Verdicts are joined by the comment's text with white space squeezed.  Instances of other languages go, and
    defects without a place, unconfirmed or outside the parsed languages, as asked."""
    language = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    rows = instances.withColumn("language", language).where(language.isin(languages) if languages else text.is_supported_language(language))
    rows = rows.select("instance_id", "repo", "language", "base_commit", "head_commit", "diff", F.posexplode("comments").alias("pos", "c"))
    rows = rows.select(
        F.col("instance_id").alias("task_id"), F.concat_ws("#", "instance_id", "pos").alias("defect_id"), "repo", "language", "base_commit", "head_commit", F.coalesce("diff", F.lit("")).alias("diff"),
        F.coalesce("c.path", F.lit("")).alias("path"), F.coalesce("c.line", "c.original_line").cast("int").alias("line"), F.coalesce("c.text", F.lit("")).alias("text"),
    )
    if verdicts is not None:
        known = verdicts.groupBy(F.col("instance_id").alias("task_id"), text.comment_key(F.coalesce("comment", F.lit(""))).alias("_key")).agg(F.max(F.struct("comment_type", "test_verified")).alias("v"))
        rows = rows.withColumn("_key", text.comment_key(F.col("text"))).join(known, ["task_id", "_key"], "left").withColumn("comment_type", F.coalesce("v.comment_type", F.lit(""))).withColumn("test_verified", F.coalesce("v.test_verified", F.lit(False))).drop("_key", "v")
    else:
        rows = rows.withColumn("comment_type", F.lit("")).withColumn("test_verified", F.lit(False))
    keep = F.lit(True)
    keep = keep & text.has_location(F.col("path"), F.col("line")) if located else keep
    keep = keep & text.is_confirmed_defect(F.col("comment_type"), F.col("test_verified")) if confirmed else keep
    keep = keep & text.in_supported_source(F.col("path")) if supported else keep
    return rows.where(keep)


def generated_tasks(rows: DataFrame) -> DataFrame:
    """Generated tasks that can be used: neither file is a test, and the diff takes out two lines at least; with
    hops, is_defect (true if missing) and the distractor lines, from the diff if they are not given."""
    keep = ~text.is_test_path(F.coalesce("caller_path", F.lit("")), True) & ~text.is_test_path(F.coalesce("defect_path", F.lit("")), True) & (text.removed_lines(F.col("diff")) >= 2)
    lines = text.distractor_lines(F.col("diff"), F.col("defect_line"))
    given = F.when(F.size("distractor_lines") > 0, F.col("distractor_lines")) if "distractor_lines" in rows.columns else F.lit(None).cast("array<int>")
    via = F.col("via_path") if "via_path" in rows.columns else F.lit("")
    return rows.where(keep).withColumn("is_defect", F.coalesce("is_defect", F.lit(True))).withColumn("hops", F.when(F.coalesce(via, F.lit("")) != "", 2).otherwise(1)).withColumn("distractor_lines", F.coalesce(given, lines))


def summarise(defects: DataFrame) -> DataFrame:
    """One row: tasks, defects, confirmed ones, those in parsed languages, repositories and defects a task."""
    confirmed, source = text.is_confirmed_defect(F.col("comment_type"), F.col("test_verified")), text.in_supported_source(F.col("path"))
    s = defects.agg(F.countDistinct("task_id").alias("tasks"), F.count("*").alias("defects"), F.count_if(confirmed).alias("confirmed"), F.count_if(source).alias("in_supported_source"), F.countDistinct("repo").alias("repos"))
    return s.withColumn("defects_per_task", F.coalesce(F.round(F.col("defects") / F.nullif(F.col("tasks"), F.lit(0)), 2), F.lit(0.0)))


def first_tasks(tasks: DataFrame, limit: int = 400, max_diff: int = 40000) -> DataFrame:
    """The first tasks by id whose diff is not too long."""
    return tasks.where(F.length("diff") <= max_diff).orderBy("task_id").limit(limit)


def targets(defects: DataFrame) -> DataFrame:
    """(query, path, line) of the defects with a place, for the fault-location condition."""
    return defects.where(text.has_location(F.col("path"), F.col("line"))).select(F.col("task_id").alias("query"), "path", "line")


def review_scores(tasks: DataFrame, findings: DataFrame, tolerance: int = 0) -> DataFrame:
    """tasks(task_id, defect_path, defect_line, distractor_lines, kind), findings(task_id, condition, path, line, all)
    -> (task_id, condition, kind, hit, flagged, findings, precise): whether a finding in the defect's file is at its
    line, and how many others are at a distractor's.  Findings without a line count as reported only."""
    name = F.substring_index(text.normalise_path(F.col("defect_path")), "/", -1)
    rows = findings.withColumn("_own", text.normalise_path(F.col("path"))).join(tasks.withColumn("_name", name), "task_id")
    same_file = F.endswith("_own", F.col("_name")) & F.col("line").isNotNull()
    at = F.coalesce(same_file & (F.abs(F.col("line") - F.col("defect_line")) <= tolerance), F.lit(False))
    decoy = F.coalesce(same_file & F.exists(F.coalesce("distractor_lines", F.array().cast("array<int>")), lambda d: F.abs(F.col("line") - d) <= tolerance), F.lit(False))
    out = rows.groupBy("task_id", "condition", "kind").agg(F.bool_or(at).alias("hit"), F.count_if(~at & decoy).alias("flagged"), F.count("path").alias("findings"))
    return out.withColumn("precise", F.col("hit") & (F.col("flagged") == 0))


def score_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per group: tasks, recall, the share of precise reviews, confirmed false positives and precision."""
    s = scores.groupBy(*by).agg(F.count("*").alias("tasks"), F.count_if("hit").alias("hits"), F.count_if("precise").alias("precise"), F.sum("flagged").alias("confirmed_false_positives"), F.sum("findings").alias("findings_reported"))
    return s.select(
        *by, "tasks", ratio(F.col("hits"), F.col("tasks")).alias("recall"), ratio(F.col("precise"), F.col("tasks")).alias("precise_rate"), "confirmed_false_positives", "findings_reported",
        ratio(F.col("hits"), F.col("hits") + F.col("confirmed_false_positives"), 0.0).alias("confirmed_precision"),
    )


def split_by_reach(scores: DataFrame, reached: DataFrame, conditions: list[str]) -> DataFrame:
    """scores with `reached`: whether the task's caller is in reached(task_id); only tasks with every condition."""
    near = reached.select("task_id").distinct().withColumn("reached", F.lit(True))
    # Conditions seen are counted beside the scores, which so are computed once.
    own = W.partitionBy("task_id")
    seen = [F.max(F.when(F.col("condition") == c, 1).otherwise(0)).over(own) for c in dict.fromkeys(conditions)]
    whole = scores.withColumn("_all", F.least(*seen) if len(seen) > 1 else F.greatest(F.lit(0), *seen)).where("_all = 1").drop("_all")
    return whole.join(near, "task_id", "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def first_finding(findings: DataFrame) -> DataFrame:
    """The first finding of each review, by its position."""
    return findings.where("pos = 0")


def hits_of(defects: DataFrame, findings: DataFrame, tolerance: int = 5, top: bool = False) -> DataFrame:
    """(task_id, condition, defect_id, hit): each condition's findings matched one to one to the task's defects."""
    rows = first_finding(findings) if top else findings
    path = lambda df: df.withColumn("path", text.normalise_path(F.col("path"))).where("path != ''")
    conditions = findings.select("task_id", "condition").distinct()
    d = defects.join(conditions, "task_id").select("task_id", "condition", "path", F.concat_ws("|", "condition", "defect_id").alias("defect_id"), F.col("line").alias("d_line"), F.col("defect_id").alias("d_ord"))
    f = rows.select("task_id", "condition", "path", F.concat_ws("|", "condition", "task_id", "pos").alias("finding_id"), F.col("line").alias("f_line"), F.col("pos").alias("f_ord"))
    matched = greedy_match(path(d), path(f), ["task_id", "condition", "path"], tolerance)
    out = d.select("task_id", "condition", "defect_id", F.col("d_ord").alias("_plain")).join(matched.select("defect_id", "hit"), "defect_id", "left")
    return out.select("task_id", "condition", F.col("_plain").alias("defect_id"), F.coalesce("hit", F.lit(False)).alias("hit"))


def strict_mechanism(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows(task_id, mechanism, message, …) of tasks in tokens(task_id, tokens), with mechanism_strict: the mechanism is
    right and the message names a caller's token; null where the mechanism is."""
    strict = F.when(F.col("mechanism").isNotNull(), F.col("mechanism") & F.coalesce(text.names_caller(F.col("message"), F.col("tokens")), F.lit(False)))
    return rows.join(tokens, "task_id").withColumn("mechanism_strict", strict).drop("tokens")


def caller_tokens(path: Column, function: Column, own: Column) -> Column:
    """Lower-case words that name a caller: its file's stem and its function, if longer than two characters and not
    the defect's own function."""
    stem = F.regexp_replace(F.substring_index(F.coalesce(path, F.lit("")), "/", -1), r"\.py$", "")
    return F.array_distinct(F.array_compact(F.array(F.when(F.length(stem) > 2, F.lower(stem)), F.when((F.length(function) > 2) & (function != own), F.lower(function)))))


def evidence_recall(defects: DataFrame, contexts: DataFrame) -> DataFrame:
    """defects(task_id, defect_id, text, diff), contexts(task_id, condition, context) -> per condition: defects, those
    whose comment names something, those of them of which the context has a name, the same for names that the diff
    lacks, and tasks with a named and with a found defect."""
    names = text.names_in(F.col("text"))
    rows = defects.select("task_id", "defect_id", "diff", F.array_distinct(F.concat(names["paths"], names["idents"])).alias("names"))
    rows = rows.withColumn("outside", F.filter("names", lambda n: ~F.contains("diff", n)))
    on = contexts.select("task_id", "condition", F.coalesce("context", F.lit("")).alias("context")).join(rows, "task_id")
    has = lambda c: F.exists(c, lambda n: F.contains("context", n))
    on = on.select("task_id", "condition", (F.size("names") > 0).alias("named"), has("names").alias("found"), (F.size("outside") > 0).alias("out"), has("outside").alias("out_found"))
    return on.groupBy("condition").agg(
        F.count("*").alias("defects"), F.count_if("named").alias("named"), F.count_if("found").alias("found"), F.count_if("out").alias("outside_named"), F.count_if("out_found").alias("outside_found"),
        F.countDistinct(F.when(F.col("named"), F.col("task_id"))).alias("tasks_named"), F.countDistinct(F.when(F.col("found"), F.col("task_id"))).alias("tasks_found"),
    )


def line_distances(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings(task_id, condition, finding_id, path, line, message), lines(task_id, path, new_line, content) of the
    new side of the diffs -> (condition, finding_id, quoting, distance): whether the finding has a line and quotes
    something, and how far the nearest line of its file with a quoted token is, null if there is none.

    Tokens meet lines of one task and file only."""
    tokens = text.quoted_tokens(F.col("message"))
    rows = findings.withColumn("tokens", tokens).withColumn("quoting", (F.size("tokens") > 0) & F.col("line").isNotNull()).withColumn("_path", text.normalise_path(F.col("path")))
    near = lines.select("task_id", text.normalise_path(F.col("path")).alias("_path"), "new_line", "content").where("_path != ''")
    pairs = rows.where("quoting").join(near, ["task_id", "_path"]).where(F.exists("tokens", lambda t: F.contains("content", t)))
    best = pairs.groupBy("condition", "finding_id").agg(F.min(F.abs(F.col("line") - F.col("new_line"))).alias("distance"))
    return rows.select("condition", "finding_id", "quoting").join(best, ["condition", "finding_id"], "left")


def line_accuracy(distances: DataFrame) -> DataFrame:
    """Per condition and for all: findings, quoting ones, located ones, shares at distance 0, up to 5 and beyond, and
    the upper median."""
    both = distances.select(F.explode(F.array("condition", F.lit("all"))).alias("condition"), "quoting", "distance")
    share = lambda c: F.avg(F.when(F.col("distance").isNotNull(), c.cast("double")))
    d = F.col("distance")
    out = both.groupBy("condition").agg(F.count("*").alias("findings"), F.count_if("quoting").alias("quoting"), F.count("distance").alias("located"), share(d == 0).alias("exact"), share(d <= 5).alias("within_5"), share(d > 5).alias("beyond_5"))
    # Only the counts of equal distances are sorted, not the findings.
    counts = both.where("distance is not null").groupBy("condition", "distance").agg(F.count("*").alias("_c"))
    w = W.partitionBy("condition")
    counts = counts.withColumn("_to", F.sum("_c").over(w.orderBy("distance"))).withColumn("_at", F.floor(F.sum("_c").over(w) / 2) + 1)
    middle = counts.where((F.col("_at") > F.col("_to") - F.col("_c")) & (F.col("_at") <= F.col("_to")))
    return out.join(middle.select("condition", F.col("distance").alias("median")), "condition", "left")


def quality_table(rows: DataFrame, score: str = "hunk_score") -> DataFrame:
    """Per arm: items attempted and scored by class, replies without JSON and without the rating, ambiguous and
    unmatched ones, the share of parsed replies that rate every hunk, the share of tied pairs and distinct values."""
    d = F.coalesce("is_defect", F.lit(True))
    per = lambda c, name: [F.count_if(c & d).alias(f"{name}_defects"), F.count_if(c & ~d).alias(f"{name}_twins")]
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    odd = (F.size(F.coalesce("unmatched_rating_lines", F.array().cast("array<int>"))) > 0) | (F.coalesce("invalid_rating_entries", F.lit(0)) > 0)
    table = rows.groupBy("arm").agg(
        *per(F.lit(True), "attempted"), *per(F.col(score).isNotNull(), "scored"), *per(true("json_failed"), "no_json"), *per(true("rating_missing"), "missing"),
        F.count_if(F.size(F.coalesce("ratings_ambiguous", F.array().cast("array<int>"))) > 0).alias("ambiguous"), F.count_if(odd).alias("unmatched"),
        F.avg(F.when(F.col("json_failed") == False, (F.col("hunks_rated") == F.col("hunks_total")).cast("double"))).alias("all_rated"),  # noqa: E712
        F.countDistinct(score).alias("distinct_values"),
    )
    hist = rows.where(F.col(score).isNotNull()).groupBy("arm", score).agg(F.count_if(d).alias("hd"), F.count_if(~d).alias("ht"))
    pairs = F.sum("hd") * F.sum("ht")
    ties = hist.groupBy("arm").agg(F.when(pairs > 0, F.sum(F.col("hd") * F.col("ht")) / pairs).alias("tie_share"))
    return table.join(ties, "arm", "left")


def judged(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys…, hit, message) with mechanism_judge: the verdict of verdicts(keys…, answer), YES true and other
    answers false; without a verdict false for a hit that said nothing, null for others."""
    answer = verdicts.groupBy(*keys).agg(F.max("answer").alias("_a"))
    said = F.startswith(F.upper(F.trim("_a")), F.lit("YES"))
    silent = F.when(F.col("hit") & (F.coalesce("message", F.lit("")) == ""), F.lit(False))
    return rows.join(answer, keys, "left").withColumn("mechanism_judge", F.when(F.col("_a").isNotNull(), said).otherwise(silent)).drop("_a")


def decision(cells: DataFrame, by: list[str], models: int) -> DataFrame:
    """cells(by…, model, low, high) -> (by…, outcome): above zero for every model, below for every one, incomplete, or
    no detectable gain."""
    s = cells.groupBy(*by).agg(F.countDistinct("model").alias("_n"), F.bool_and(F.col("low") > 0).alias("_up"), F.bool_and(F.col("high") < 0).alias("_down"))
    out = F.when(F.col("_n") < models, "incomplete").when(F.col("_up"), "better on every model").when(F.col("_down"), "worse on every model").otherwise("no detectable gain")
    return s.select(*by, out.alias("outcome"))
