"""What keeps work spread and small: shares of tasks, bounds and blocks."""

from hashlib import md5

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.operators import audit, context, evidence, rundiff
from plumbline.plans import registry
from plumbline.tables import placed


def repartitions(df) -> int:
    return df._jdf.queryExecution().toString().count("REPARTITION_BY_NUM")


def test_evidence_draws_are_dealt_to_tasks_and_weighed_by_length(spark):
    pool = spark.range(30, numPartitions=1).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(1).alias("first"), F.lit(2).alias("last"), F.repeat(F.lit("y"), (F.col("id") + 1).cast("int")).alias("text"), F.format_string("l%02d", "id").alias("label"))
    snippet = F.struct(F.lit("m").alias("path"), F.lit(1).alias("first"), F.lit(2).alias("last"), F.lit("z" * 9).alias("text"), F.lit("m").alias("label"))
    # The second task needs the whole pool, which so many picks seldom hold; the third more than there is.
    tasks = spark.range(3, numPartitions=1).select(F.col("id").cast("string").alias("task_id"), F.array_repeat(snippet, F.element_at(F.array(*map(F.lit, (2, 30, 31))), (F.col("id") + 1).cast("int"))).alias("snippets"))
    out = evidence.random_evidence(tasks, pool)
    assert repartitions(out) > 0
    got = {r["task_id"]: r["snippets"] for r in out.collect()}
    assert len({s["path"] for s in got["0"]}) == 2 and len({s["path"] for s in got["1"]}) == 30
    assert [s["path"] for s in got["2"]] == ["m"] * 31
    slots = placed(pool.select("label"), ["label"], "slot").collect()
    assert sorted(r["slot"] for r in slots) == list(range(30)) and all(r["label"] == f"l{r['slot']:02d}" for r in slots)


def dealt(spark) -> int:
    """Records that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def star(spark, n: int):
    """n functions that call one hub, in a repository with a query of each."""
    f = spark.range(n).select(F.lit("r").alias("repo"), F.format_string("s/f%04d.py::function::go", "id").alias("id"), F.lit("function").alias("type"), F.lit("go").alias("name"), F.format_string("s/f%04d.py", "id").alias("relative_path"), F.lit(1).alias("first"), F.lit(2).alias("last"), F.lit(0).alias("ord"))
    hub = f.limit(1).withColumn("id", F.lit("h.py::function::hub")).withColumn("name", F.lit("hub")).withColumn("relative_path", F.lit("h.py"))
    edges = f.select("repo", F.col("id").alias("src"), F.lit("h.py::function::hub").alias("dst"), F.lit("calls").alias("label"))
    queries = f.select(F.col("id").alias("query"), "repo", F.col("id").alias("node"))
    return f.union(hub), edges, queries


def test_names_that_many_nodes_share_are_met_as_far_as_they_can_be_kept(spark):
    nodes, _, queries = star(spark, 400)
    found = context.seeds(nodes, queries)
    before = dealt(spark)
    rows = context.lexical(nodes, queries, found, 3).collect()
    assert dealt(spark) - before < 40_000  # 160,000 pairs
    ids = sorted(r["id"] for r in nodes.where("name = 'go'").collect())
    for r in rows:
        assert r["id"] == [x for x in ids if x != r["query"]][r["rank"] - 1]
    assert len(rows) == 1200


def test_a_walk_through_a_hub_deals_no_pair_of_query_and_vertex(spark):
    nodes, edges, queries = star(spark, 400)
    found = context.seeds(nodes, queries)
    before = dealt(spark)
    rows = context.walk(nodes, edges, found, 2).select("query", "id", "depth").collect()
    assert dealt(spark) - before < 40_000  # 160,000 pairs
    assert len(rows) == 400 * 400 and len(set(rows)) == len(rows)
    assert all((r["depth"] == 1) == (r["id"] == "h.py::function::hub") and r["id"] != r["query"] for r in rows)


def test_random_nodes_deal_no_pair_of_query_and_node_and_are_the_first_by_hash(spark):
    nodes, _, queries = star(spark, 1500)
    queries = queries.limit(100)
    found = context.seeds(nodes, queries)
    before = dealt(spark)
    rows = context.random_matched(nodes, found, found, other_files=True).collect()
    assert dealt(spark) - before < 60_000  # 150,000 pairs
    ids = [r["id"] for r in nodes.collect()]
    order = lambda q: min((x for x in ids if x != q), key=lambda x: (md5(f"0|{q}|{x}".encode()).hexdigest()[:8], x))
    assert {r["query"]: r["id"] for r in rows} == {r["query"]: order(r["query"]) for r in queries.collect()}
    # All nodes with a hash below the bound lie in the seeds' file: the query is drawn again.
    first = sorted(ids, key=lambda x: (md5(f"0|q|{x}".encode()).hexdigest()[:8], x))
    home = nodes.withColumn("relative_path", F.when(F.col("id").isin(first[:200]), "home.py").otherwise(F.col("relative_path")))
    seed = spark.createDataFrame([("q", "r", 0, first[0])], "query string, repo string, pos int, id string")
    assert [r["id"] for r in context.random_matched(home, seed, seed, other_files=True).collect()] == [first[200]]


def test_compared_runs_are_read_once(spark):
    rows = [(run, arm, f"t{k}", f"c{k % 3}", (k + len(arm)) % 5, bool(k % 2), k % 4 < 2) for run in "AB" for arm in ("x", "yy") for k in range(12)]
    df = spark.createDataFrame(rows, "run string, arm string, task string, cluster string, score int, hit boolean, defect boolean").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = rundiff.compare_runs(df.mapInArrow(note, df.schema), ["x", "yy"], F.col("defect"), scores=5, trials=5)
    assert got.where("statistic = 'd_auc_common'").first()["value"] is not None
    assert seen.value == len(rows)


def test_queries_stream_by_a_block_of_nodes():
    node = {"repo": "r", "_block": 0, "_asked": False, "query": None, "id": "a", "v": [1.0, 0.0], "seeds": None}
    rows = [node, node | {"id": "b", "v": [0.6, 0.8]}] + [node | {"_asked": True, "query": f"q{k}", "id": None, "v": [0.0, 1.0], "seeds": ["b"] if k else None} for k in range(3)]
    schema = pa.schema([("repo", pa.string()), ("_block", pa.int32()), ("_asked", pa.bool_()), ("query", pa.string()), ("id", pa.string()), ("v", pa.list_(pa.float64())), ("seeds", pa.list_(pa.string()))])
    read = []

    def batches():
        for row in rows:
            read.append(row["query"])
            yield pa.RecordBatch.from_pylist([row], schema)

    out = context._best_of_matrix(1)(batches())
    assert next(out).to_pylist() == [{"query": "q0", "repo": "r", "id": "b", "score": 0.8}]
    assert read == [None, None, "q0"]
    assert [r["id"] for b in out for r in b.to_pylist()] == ["a", "a"]


def test_workers_get_bounded_batches(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.range(5000).repartition(1).write.parquet(f"{tmp_path}/x.parquet")
    rows = registry.t(spark, str(tmp_path), "x").repartition(1)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([{"n": b.num_rows}]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 5000 and max(r["n"] for r in sizes) <= 1000


def test_texts_of_tests_are_dealt_to_tasks(spark):
    files = spark.range(40).select(F.lit("r").alias("repo"), F.format_string("test_%02d.py", "id").alias("path"), F.repeat(F.lit("find "), F.col("id").cast("int")).alias("text"))
    words = spark.createDataFrame([("t", "r", ["find"])], "task_id string, repo string, words array<string>")
    out = audit.select_tests(files, words)
    assert repartitions(out) >= 2
    assert [r["path"] for r in out.orderBy("rank").collect()] == [f"test_{k}.py" for k in range(39, 29, -1)]
