"""Diff explode: hand-worked diffs, and the same result however a diff is cut into chunks."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from difflens.operators import diff, files
from pyspark.sql import functions as F

GIT = "diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n"
CASES = {
    "empty": ("", []),
    "one added line": (
        GIT.format(p="Test.cs") + "@@ -10,6 +10,7 @@ namespace Test\n {\n     class Foo\n     {\n+        private int customerId;\n     }\n }\n",
        [("Test.cs", 13, "        private int customerId;", 5)],
    ),
    "deletions only": (GIT.format(p="S.cs") + "@@ -5,3 +5,0 @@\n-a\n-b\n", []),
    "first line has position two": (GIT.format(p="a") + "@@ -1 +1 @@\n+x\n", [("a", 1, "x", 2)]),
    "no git header: only the last file survives": ("--- a/a\n+++ b/a\n@@ -1 +1 @@\n+x\n--- a/b\n+++ b/b\n@@ -1 +1 @@\n+y\n", [("b", 1, "y", 2)]),
    "added text that looks like a file header": (
        GIT.format(p="a") + "@@ -1 +1 @@\n+x\n+++ b/c\n+y\n", [("c", 2, "y", 1)]
    ),
    "deleted file": ("diff --git a/a b/a\n--- a/a\n+++ /dev/null\n@@ -1 +0,0 @@\n+x\n", []),
    "blank line without a space": (GIT.format(p="a") + "@@ -1 +5 @@\n+x\n\n+y\n", [("a", 5, "x", 2), ("a", 6, "y", 3)]),
    "unreadable hunk": (GIT.format(p="a") + "@@ bad @@\n+x\n", [("a", 1, "x", 2)]),
    "hunk without comma": (GIT.format(p="a") + "@@ -1 +5 @@\n+x\n", [("a", 5, "x", 2)]),
    "absurd hunk number": (GIT.format(p="a") + "@@ -1 +99999999999999999999 @@\n+x\n", [("a", 1, "x", 2)]),
    "line counter goes on in the next file": (
        GIT.format(p="a") + "@@ -1 +7 @@\n+x\n" + GIT.format(p="b") + "+y\n", [("a", 7, "x", 2), ("b", 8, "y", 1)]
    ),
    "overlapping hunks": (
        GIT.format(p="a") + "@@ -1 +1 @@\n+x\n+y\n@@ -1 +2 @@\n+z\n", [("a", 1, "x", 2), ("a", 2, "z", 5)]
    ),
    "same path twice": (GIT.format(p="a") + "@@ -1 +1 @@\n+x\n" + GIT.format(p="a") + "@@ -1 +1 @@\n+y\n", [("a", 1, "x", 2), ("a", 1, "y", 2)]),
    "carriage return stays": (GIT.format(p="a") + "@@ -1 +1 @@\n+x\r\n", [("a", 1, "x\r", 2)]),
    "no newline marker": (GIT.format(p="a") + "@@ -1 +1 @@\n+x\n\\ No newline at end of file\n+y\n", [("a", 1, "x", 2), ("a", 2, "y", 3)]),
}


def exploded(spark, texts, chunk_lines=diff.DEFAULT_CHUNK_LINES):
    df = spark.createDataFrame(list(enumerate(texts)), "pr_id long, diff_text string")
    out = {}
    for r in diff.explode_diffs(df, chunk_lines).orderBy("pr_id", "file_idx", "ord").collect():
        out.setdefault(r.pr_id, []).append(r)
    return out


@pytest.fixture(scope="module")
def results(spark):
    return exploded(spark, [text for text, _ in CASES.values()])


@pytest.mark.parametrize("i", range(len(CASES)), ids=list(CASES))
def test_case(results, i):
    _, expected = list(CASES.values())[i]
    assert [(r.path, r.line_no, r.content, r.diff_position) for r in results.get(i, [])] == expected


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_chunks_do_not_change_the_result(spark, results, n):
    assert exploded(spark, [text for text, _ in CASES.values()], n) == results


PIECES = ["diff --git a/a b/a", "+++ b/a", "+++ b/b", "+++ /dev/null", "--- a/a", "@@ -1 +1 @@", "@@ -9,2 +4,3 @@", "@@ x", "+x", "+y", " c", "-d", ""]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40), min_size=40, max_size=60))
def test_any_diff_is_cut_anywhere(spark, diffs):
    texts = ["\n".join(d) for d in diffs]
    assert exploded(spark, texts, 4) == exploded(spark, texts)


def test_reviewable_files(spark):
    paths = {
        "a/Service.cs": True, "test.dll": False, "image.png": False, "packages/NuGet/lib.cs": False,
        "node_modules/foo.js": False, "src/app.js": True, "cabin/x.cs": False, "a.min.js": False, "x.tsx": False,
        "Views/Home.CSHTML": True, "README": False, "a/obj/x.cs": False, "app.config": True, "x.lock": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.ok for r in df.select("path", files.is_reviewable(F.col("path")).alias("ok")).collect()}
    assert got == paths


def test_two_shuffles_three_sorts_and_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "pr_id long, diff_text string")
    plan = diff.explode_diffs(df)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 3 and "Python" not in plan
