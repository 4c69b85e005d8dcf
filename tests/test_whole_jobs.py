"""Queries that do their whole job, on rows of their own."""

import datetime

from difflens.operators import diff
from difflens.plans import catalog
from difflens.sources import corpus, store


def test_issue_text_is_of_whole_conversations(spark, tmp_path):
    rows = [(1, i, "user", f"t{i}. Then u{i}") for i in range(450)] + [(2, 0, "user", None), (2, 1, "user", "a"), (2, 1, "bot", " b"), (3, 0, "bot", None)]
    spark.createDataFrame(rows[::-1], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r.description for r in catalog.QUERIES["issue_text"](spark, str(tmp_path)).collect()}
    assert found == {1: " ".join(f"t{i} Then u{i}" for i in range(450)), 2: "b a", 3: ""}


def test_lines_are_dealt_by_their_bytes(spark):
    diffs = spark.createDataFrame([(i, "x" * 100) for i in range(40)], "pr_id long, diff_text string")
    tasks = diff.tasks_for(diffs, bytes_per_task=100)
    assert tasks == 40 and diff.tasks_for(diffs) == 4  # the session's shuffle partitions
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = diff.explode_diffs(diffs, tasks=tasks)._jdf.queryExecution().explainString(mode)
    assert plan.count(", 40), REPARTITION_BY_NUM") == 2 and plan.count("Exchange hashpartitioning") == 2


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"u{i:05}", "K", i, "", "", 0, 0, 0, 0, 100, "", "", day) for i in range(5000)]
    kinds = "id long, review_uuid string, issue_key string, pr_number long, pr_title string, pr_url string, errors long, warnings long, suggestions long, total long, scope_score long, summary string, diff_text string, created_at timestamp"
    reviews = spark.createDataFrame(rows, kinds)
    files = reviews.limit(0).selectExpr("id", "id as review_id", "created_at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write(str(tmp_path), {"reviews": reviews, "review_files": files, "review_issues": files}, "b", buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = list(tmp_path.glob("reviews/review_month=2024-01-01/bucket=0/*.parquet"))
    assert len(written) > 1 and sum(f.stat().st_size for f in written) < 1 << 20  # filters of a MB a file before
    assert spark.read.parquet(*map(str, written)).count() == 5000


def test_pull_requests_are_derived_once(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    spark.createDataFrame([(1, 1, 1, 1, 1.0, day, "N", "O")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, day)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    assert corpus.prs(spark, str(tmp_path)).inputFiles() == corpus.prs(spark, str(tmp_path)).inputFiles()
    assert [r.pr_id for r in corpus.prs(spark, str(tmp_path)).collect()] == [7]
