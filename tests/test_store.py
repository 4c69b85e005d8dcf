"""The review store through its files: publication, lookups, statistics."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from difflens.functions import values as V
from difflens.operators import analytics
from difflens.plans import presets
from difflens.sources import store

ISSUE = (
    "pr_id long, file_idx long, path string, line_no long, rule_id string, severity string, message string, original_line string, suggested_fix string, "
    "rule_ord long, phase long, emit_pos long, emit_sub long, suppressed boolean"
)


def tables(spark, prs, summary="s", per_pr=4):
    day = lambda n: dt.datetime(2024, 1 + n % 3, 1 + n % 28, 12)
    given = spark.createDataFrame(
        [(f"AB-{n}", n, f"sha{n}", day(n), 1, per_pr, n % 101, summary) for n in prs],
        "issue_key string, pr_number long, head_sha string, created_at timestamp, errors long, warnings long, scope_score long, summary string",
    )
    reviews = store.review_rows(given)
    found = spark.createDataFrame(
        [
            (n, i % 2, f"f{i % 2}.cs", 10 - i, f"R-{i % 3}", "error" if i == 0 else "warning", f'm"{i}', "x", None, 1, 1, i, 0, i == 3)
            for n in prs
            for i in range(per_pr)
        ],
        ISSUE,
    )
    return {"reviews": reviews, "review_files": store.file_rows(reviews, found), "review_issues": store.issue_rows(reviews, found)}


def state(spark, base):
    read = store.read(spark, base)
    return {name: sorted(map(str, df.drop("attempt").collect())) for name, df in read.items()}


def test_a_batch_is_published_once(spark, tmp_path):
    base = str(tmp_path / "store")
    assert store.write(base, tables(spark, range(5)), "one")
    once = state(spark, base)
    assert len(once["reviews"]) == 5 and len(once["review_files"]) == 10 and len(once["review_issues"]) == 20
    assert not store.write(base, tables(spark, range(5)), "one")
    assert state(spark, base) == once
    # Without any de-duplication: the rows themselves are there once.
    assert spark.read.parquet(f"{base}/review_issues").count() == 20


def test_a_write_that_died_is_invisible_and_can_be_repeated(spark, tmp_path):
    base = str(tmp_path / "store")
    store.write(base, tables(spark, range(3)), "one")
    before = state(spark, base)
    part = tables(spark, range(3, 6))
    store.write_attempt(base, {**part, "reviews": part["reviews"].limit(0)}, "two-dead")
    store.write_attempt(base, part, "two-dead-later")
    assert state(spark, base) == before
    assert store.write(base, part, "two")
    after = state(spark, base)
    assert len(after["reviews"]) == 6 and len(after["review_issues"]) == 24


def test_a_batch_that_is_replaced(spark, tmp_path):
    base = str(tmp_path / "store")
    store.write(base, tables(spark, range(4), per_pr=4), "one")
    store.write(base, tables(spark, range(2), summary="again", per_pr=2), "one", replace=True)
    read = store.read(spark, base)
    assert sorted((r.pr_number, r.summary) for r in read["reviews"].collect()) == [(0, "again"), (1, "again")]
    assert read["review_issues"].count() == 4 and store.detail(read).count() == 4


def test_nothing_committed_reads_as_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    store.write_attempt(base, tables(spark, range(2)), "never")
    assert all(df.count() == 0 for df in store.read(spark, base).values())


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_reads_one_place(spark, tmp_path):
    base = str(tmp_path / "store")
    given = tables(spark, range(40))
    store.write(base, given, "one", buckets=8)
    read = store.read(spark, base)
    wanted = read["reviews"].filter("pr_number = 17").first().review_uuid
    found = store.detail(read, wanted)
    assert sorted((r.file_path, r.line_number, r.suppressed) for r in found.collect()) == [
        ("f0.cs", 8, False), ("f0.cs", 10, False), ("f1.cs", 7, True), ("f1.cs", 9, False),
    ]
    text = plan(found := store.detail(read, wanted))
    final = text.split("== Initial Plan ==")[0]
    assert final.count("dynamicpruning") >= 2  # both children's partitions are pruned by the review found
    assert "EqualTo(review_uuid" in final and "hashpartitioning(review_id" not in final and "SortMergeJoin" not in final
    read_files = _files_read(found)
    assert read_files["review_files"] == [1] and read_files["review_issues"] == [1]
    assert store.detail(read, "unknown").count() == 0


def _files_read(df):
    """By table the number of files that its scans read."""
    out, nodes = {}, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif name == "FileSourceScanExec":
            table = node.relation().location().rootPaths().head().getName()
            out.setdefault(table, []).append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            nodes.append(node.children().apply(i))
    return out


def test_history_reads_no_diffs_and_shuffles_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    store.write(base, tables(spark, range(60)), "one", buckets=2)
    reviews = store.read(spark, base)["reviews"]
    rows = store.history(reviews).collect()
    assert len(rows) == V.HISTORY_ROWS and [r.created_at for r in rows] == sorted((r.created_at for r in rows), reverse=True)
    text = plan(store.history(reviews)).split("== Initial Plan ==")[0]
    assert "TakeOrderedAndProject" in text and "diff_text" not in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("part_bytes", [200, 1 << 20])
def test_stored_reviews_as_json(spark, tmp_path, part_bytes):
    base = str(tmp_path / "store")
    store.write(base, tables(spark, range(6)), "one", buckets=2)
    read = store.read(spark, base)
    wanted = read["reviews"].filter("pr_number = 4").first()
    parts = store.review_documents(read, wanted.review_uuid, part_bytes).orderBy("part").collect()
    assert (len(parts) > 3) == (part_bytes == 200)
    doc = json.loads("".join(p.text for p in parts))
    assert doc["pr_number"] == 4 and doc["total"] == 5 and doc["diff_text"] == "" and doc["created_at"] == "2024-02-05T12:00:00.000000"
    assert [f["file_path"] for f in doc["files"]] == ["f0.cs", "f1.cs"]
    assert [(f["error_count"], f["warning_count"]) for f in doc["files"]] == [(1, 1), (0, 1)]
    assert [[(i["line_number"], i["suppressed"]) for i in f["issues"]] for f in doc["files"]] == [[(8, False), (10, False)], [(7, True), (9, False)]]
    assert doc["files"][1]["issues"][0]["message"] == 'm"3'
    assert store.review_documents(read, "unknown").count() == 0
    assert store.review_documents(read).select("review_uuid").distinct().count() == 6


def test_statistics_of_a_store(spark, tmp_path):
    base = str(tmp_path / "store")
    store.write(base, tables(spark, range(9)), "one", buckets=2)
    store.write(base, tables(spark, range(9, 12)), "two", buckets=2)
    read = store.read(spark, base)
    assert [tuple(r) for r in analytics.top_violations(read["review_issues"]).collect()] == [("R-0", 12), ("R-1", 12), ("R-2", 12)]
    assert [tuple(r) for r in analytics.worst_files(read["review_files"]).collect()] == [("f0.cs", 24), ("f1.cs", 12)]
    assert tuple(analytics.review_stats(read["reviews"]).first()) == (12, 5.0)
    trend = analytics.score_trend(read["reviews"], "2024-03-12")
    assert {str(r.day) for r in trend.collect()} == {f"2024-{1 + n % 3:02d}-{1 + n % 28:02d}" for n in range(12) if (1 + n % 3, 1 + n % 28) >= (2, 11) or 1 + n % 3 == 3}
    assert "review_month" in plan(trend)


def test_diffs_are_stored_whole_unless_shortened(spark):
    df = spark.range(2).select(
        F.lit("AB-1").alias("issue_key"), F.col("id").alias("pr_number"), F.lit("s").alias("head_sha"),
        F.lit(dt.datetime(2024, 1, 1)).alias("created_at"),
        F.expr("repeat('x', if(id = 0, 500000, 500001))").alias("diff_text"), F.lit(2).alias("errors"),
    )
    rows = {r.pr_number: r for r in store.review_rows(df, diff_chars=V.MAX_DIFF_CHARS).collect()}
    assert len(rows[0].diff_text) == 500_000
    assert rows[1].diff_text.endswith("x\n[diff truncated]") and len(rows[1].diff_text) == 500_017
    assert (rows[0].total, rows[0].scope_score, rows[0].summary) == (2, 100, "")
    assert len(store.review_rows(df).filter("pr_number = 1").first().diff_text) == 500_001


def test_a_local_review_to_its_end(spark, tmp_path):
    base = str(tmp_path / "store")
    diff = "diff --git a/a.cs b/a.cs\n--- a/a.cs\n+++ b/a.cs\n@@ -1,1 +1,2 @@\n+Debugger.Break();\n+int orderId = 7;\n"
    now = dt.datetime(2024, 1, 5, 12)
    diffs = spark.createDataFrame([(1, diff), (2, " \n"), (4, "diff --git a/x.png b/x.png\n--- a/x.png\n+++ b/x.png\n@@ -0,0 +1,1 @@\n+x\n")], "pr_id long, diff_text string")
    sources = spark.createDataFrame([(1, "b.cs", "Debugger.Break();"), (2, "c.cs", "Debugger.Break();\n"), (2, "bin/d.cs", "Debugger.Break();"), (3, "e.cs", "")], "pr_id long, path string, text string")
    folders = spark.createDataFrame([(n, f"proj{n}", now) for n in (1, 2, 3, 4, 5)], "pr_id long, folder_name string, created_at timestamp")
    done = presets.local_review(diffs, sources, folders, base, "b1")
    got = {r.pr_id: r for r in done["responses"].collect()}
    assert {n: r.issue_description for n, r in got.items()} == {
        1: "Source: git diff HEAD · 1 file(s) analyzed", 2: "Source: full scan · 1 file(s) analyzed", 3: "Source: full scan · 1 file(s) analyzed",
    }
    assert got[1].total > got[2].total > got[3].total == 0 and {r.scope_score for r in got.values()} == {100}
    assert sorted(r.pr_id for r in done["nothing"].collect()) == [4, 5]
    docs = {r.pr_id: json.loads(r.text) for r in done["documents"].collect()}
    assert docs[2]["issue_key"] == "LOCAL" and docs[2]["pr_number"] == 0 and docs[2]["issue_title"] == "proj2" and docs[2]["files"][0]["file_path"] == "c.cs"
    assert docs[3]["scope_validation"] == {"in_scope": [], "out_of_scope": [], "missing": [], "score": 100}
    read = store.read(spark, base)
    stored = {r.pr_title: r for r in read["reviews"].collect()}
    assert set(stored) == {"Local: proj1", "Local: proj2", "Local: proj3"} and {r.pr_number for r in stored.values()} == {0}
    assert stored["Local: proj1"].diff_text == diff and stored["Local: proj1"].review_uuid == docs[1]["review_uuid"]
    assert store.detail(read, docs[2]["review_uuid"]).count() == got[2].total
