"""Documents in parts against plain string code."""

import json
import random

import pytest
from pyspark.sql import functions as F

from difflens.operators import documents, report

SCHEMA = "doc long, a long, b string, text string, enters string, leaves string"


def whole(rows):
    """What the pieces of one document amount to, and where each begins."""
    out, starts, left = "", [], None
    for _, _, _, text, enters, leaves in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        starts.append(len(out.encode()))
        out += ("," if enters is not None and enters == left else "") + (text or "")
        left = leaves
    return out, starts


@pytest.mark.parametrize("ranges, size", [(1, 40), (7, 40), (7, 1), (3, 1 << 20)])
def test_parts_equal_the_whole(spark, ranges, size):
    rng = random.Random(ranges * size)
    rows = []
    for doc, n in ((1, 300), (2, 1), (3, 40), (4, 0), (5, 6)):
        for _ in range(n):
            kind = rng.choice([None, "x", "x", "y"])
            text = rng.choice(["", "é" * rng.randint(1, 9), "abc" * rng.randint(0, 30)])
            rows.append((doc, rng.choice([None, *range(60)]), rng.choice("pq"), text, kind, rng.choice([kind, None])))
    # Pieces of equal order and text may differ in their lists, which leaves their order open.
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = documents.in_parts(df, ["doc"], ["a", "b"], size=size, ranges=ranges).orderBy("doc", "part").collect()
    for doc in {r[0] for r in rows}:
        text, starts = whole([r for r in rows if r[0] == doc])
        parts = [r for r in got if r.doc == doc]
        assert "".join(p.text for p in parts) == text
        first = {}
        for s in starts:
            first.setdefault(s // size, s)
        assert [(p.part, p.start) for p in parts] == sorted(first.items())
    assert {r.doc for r in got} == {r[0] for r in rows}


def test_no_list_columns_nulls_and_no_pieces(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "doc long, a long, text string")
    assert [tuple(r) for r in documents.in_parts(df, ["doc"], ["a"]).collect()] == [(1, 0, 0, "ab")]
    assert documents.in_parts(df.limit(0), ["doc"], ["a"]).count() == 0


def _found(spark, n):
    return spark.range(n).select(
        F.lit(7).cast("bigint").alias("pr_id"), F.lit(1).cast("bigint").alias("file_idx"), F.concat(F.lit("p/"), F.col("id") % 3, F.lit(".cs")).alias("path"),
        F.col("id").alias("line_no"), F.lit("R-1").alias("rule_id"), F.lit("warning").alias("severity"),
        F.concat(F.lit('say "no"\t<'), F.repeat(F.lit("z"), 400)).alias("message"), F.lit("x = 1;").alias("original_line"), F.lit(None).cast("string").alias("suggested_fix"),
        F.lit(1).cast("bigint").alias("rule_ord"), F.lit(1).cast("bigint").alias("phase"), F.col("id").alias("emit_pos"), F.lit(0).cast("bigint").alias("emit_sub"),
        (F.col("id") % 10 == 0).alias("suppressed"),
    )


def test_a_report_larger_than_the_memory_of_a_task(spark):
    """A third of a gigabyte in one report: no part is longer than its limit and a piece, none is missing."""
    n = 700_000
    found = _found(spark, n)
    review = spark.createDataFrame(
        [(7, "K-1", "t", 0, 0, 0, 100, "s")], "pr_id long, issue_key string, pr_title string, errors long, warnings long, suggestions long, scope_score long, summary string"
    ).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    parts = report.html_documents(report.html_pieces(review, found), part_bytes=1 << 20)
    measured = parts.select("part", "start", F.octet_length("html").alias("n"), F.regexp_count("html", F.lit("<tr>")).alias("rows")).orderBy("part").collect()
    assert sum(m["rows"] for m in measured) == n * 9 // 10
    assert sum(m["n"] for m in measured) > 300_000_000 and max(m["n"] for m in measured) < (1 << 20) + 1000
    assert [m["part"] for m in measured] == list(range(len(measured)))
    for one, two in zip(measured, measured[1:]):
        assert one["start"] + one["n"] == two["start"]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_response_is_one_json_document(spark):
    found = _found(spark, 2000)
    responses = spark.createDataFrame(
        [(7, "K-1", "it", None, "Bug", "t", "u", 1800, 0, 1800, 0, 200, 50, 'a "s"', "uu"), (8, "K-2", "it", "", "Bug", "t", "u", 0, 0, 0, 0, 0, 100, "fine", "vv")],
        "pr_id long, issue_key string, issue_title string, issue_description string, issue_type string, pr_title string, pr_url string, total long, errors long, "
        "warnings long, suggestions long, suppressed_count long, scope_score long, summary string, review_uuid string",
    )
    scoped = spark.createDataFrame([(7, 2, "b", True), (7, 1, "c", True), (7, 3, "a", False), (9, 1, "z", True)], "pr_id long, file_idx long, path string, in_scope boolean")
    missing = spark.createDataFrame([(7, "k2", "m2"), (7, "k1", "m1")], "pr_id long, keyword string, message string")
    visible = found.filter("not suppressed")
    parts = report.response_documents(responses, visible, scoped, missing, ["k0", "k1", "k2"], part_bytes=5000).orderBy("pr_id", "part").collect()
    docs = {}
    for p in parts:
        docs[p.pr_id] = docs.get(p.pr_id, "") + p.text
    assert set(docs) == {7, 8} and sum(p.pr_id == 7 for p in parts) > 100
    one = json.loads(docs[7])
    assert one["pr_number"] == 7 and one["total_issues"] == 1800 and one["issue_description"] is None and one["summary"] == 'a "s"'
    assert one["scope_validation"] == {"in_scope": ["c", "b"], "out_of_scope": ["a"], "missing": ["m1", "m2"], "score": 50}
    assert [f["file_path"] for f in one["files"]] == ["p/0.cs", "p/1.cs", "p/2.cs"]
    assert [f["warning_count"] for f in one["files"]] == [len(f["issues"]) for f in one["files"]]
    rows = visible.orderBy("path", "emit_pos").collect()
    assert [i["line"] for f in one["files"] for i in f["issues"]] == [r.line_no for r in rows]
    assert one["files"][0]["issues"][0] == {
        "line": 3, "message": rows[0].message, "severity": "warning", "rule_id": "R-1", "original_line": "x = 1;", "suggested_fix": None, "suppressed": False,
    }
    two = json.loads(docs[8])
    assert two["files"] == [] and two["scope_validation"] == {"in_scope": [], "out_of_scope": [], "missing": [], "score": 100}


def test_a_files_counts_are_whole_in_every_part(spark):
    visible = _found(spark, 3000).filter("not suppressed").withColumn("path", F.lit("one.cs"))
    parts = report.response_files(visible, part_bytes=10_000).orderBy("part").collect()
    assert len(parts) > 100 and {(p.errors, p.warnings, p.suggestions) for p in parts} == {(0, 2700, 0)}
    assert [i["line"] for i in json.loads("[" + "".join(p.issues for p in parts) + "]")] == [i for i in range(3000) if i % 10]
