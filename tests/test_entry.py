import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows):
    return sorted((tuple(str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", ["paired_diff", "dedupe_balance", "auc", "nearest_match", "usage_rollup", "budget_fill", "unused_imports", "cluster_bootstrap", "auc_difference", "auc_permutation", "transitions", "difference_of_differences", "minimum_lift", "chance_baseline", "dense_topk", "diff_lines", "parse_findings", "greedy_match", "zroc_slope", "evidence_scope", "hunk_ratings", "code_graph", "graph_context", "comment_defects", "line_accuracy", "detection_intervals", "random_evidence", "find_defects", "chance_rematch", "submit_ratings", "auc_run_difference", "condition_intervals", "review_life", "brace_tags", "agent_transcripts", "validation_summary", "symbol_seeds", "first_large_orders", "nested_structure", "run_matrix", "power", "select_tests", "lexical_context"])
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert canon(tuple(r[c] for c in cols) for r in df.collect()) == canon(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
