import json

from conftest import changed_lines
from pyspark.sql import functions as F

from difflens.functions import text as T
from difflens.functions import values as V
from difflens.operators import counts, findings, fixes, linking, scope
from difflens.plans import presets

FINDING = (
    "pr_id long, file_idx long, path string, line_no long, rule_id string, severity string, message string, "
    "original_line string, suggested_fix string, rule_ord int, phase int, emit_pos long, emit_sub long"
)


def found(spark, rows):
    """rows: (path, line, rule, severity[, file_idx])"""
    return spark.createDataFrame(
        [(0, r[4] if len(r) > 4 else 1, r[0], r[1], r[2], r[3], f"m{i}", None, None, 1, 1, r[1], i) for i, r in enumerate(rows)],
        FINDING,
    )


def suppressed(spark, lines, rows):
    out = findings.suppress(found(spark, rows), changed_lines(spark, [("file.ts", lines)])).orderBy("emit_sub")
    return [r.suppressed for r in out.collect()]


def test_suppression(spark):
    one = [("file.ts", 5, "TS-001", "warning")]
    two = [("file.ts", 6, "TS-001", "warning")]
    assert suppressed(spark, {5: 'log("x"); // review-ignore: TS-001'}, one) == [True]
    assert suppressed(spark, {5: "// review-ignore: TS-001", 6: 'log("x");'}, two) == [True]
    assert suppressed(spark, {5: "x // review-ignore: TS-999"}, one) == [False]
    assert suppressed(spark, {5: "x // REVIEW-IGNORE:ts-001"}, one) == [True]
    assert suppressed(spark, {5: "x"}, one) == [False]
    assert suppressed(spark, {4: "// review-ignore: TS-001", 6: "x"}, two) == [False]
    assert suppressed(spark, {5: "x // review-ignore: A review-ignore: TS-001"}, one) == [False]
    both = [("file.ts", 5, "TS-001", "warning"), ("file.ts", 10, "TS-003", "warning"), ("other.ts", 5, "TS-001", "warning")]
    assert suppressed(spark, {5: "x // review-ignore: TS-001", 10: "y"}, both) == [True, False, False]


def test_suppression_sees_the_last_file_of_a_path(spark):
    rows = [(0, 1, "a.ts", 5, "x // review-ignore: TS-001", 2, 0), (0, 4, "a.ts", 5, "x", 2, 9)]
    lines = spark.createDataFrame(rows, changed_lines(spark, []).schema)
    out = findings.suppress(found(spark, [("a.ts", 5, "TS-001", "warning", 1)]), lines).collect()
    assert [r.suppressed for r in out] == [False]


def test_deduplicate_keeps_the_first(spark):
    rows = [("a", 10, "R-1", "warning"), ("a", 10, "R-1", "warning"), ("a", 10, "R-2", "warning"), ("a", 5, "R-1", "warning")]
    out = findings.deduplicate(found(spark, rows))
    assert sorted(r.message for r in out.collect()) == ["m0", "m2", "m3"]


def test_prioritise(spark):
    rows = [("a", i, "R-1", ["suggestion", "warning", "error", "odd"][i % 4]) for i in range(50)]
    out = findings.prioritise(found(spark, rows)).orderBy("rank").collect()
    assert len(out) == 30 and [r.rank for r in out] == list(range(1, 31))
    expected = [i for k in (2, 1, 0, 3) for i in range(50) if i % 4 == k][:30]
    assert [r.line_no for r in out] == expected


def test_top_rules_and_severities(spark):
    rows = [("b", 1, "R-2", "error"), ("a", 1, "R-3", "warning"), ("a", 2, "R-2", "warning"), ("a", 3, "R-1", "suggestion")]
    top = counts.top_rules(found(spark, rows), 2).orderBy("rank").collect()
    assert [(r.rule_id, r.n, r.bar) for r in top] == [("R-2", 2, 40), ("R-3", 1, 20)]
    seen = {r.path: r.severities for r in counts.file_severities(found(spark, rows)).collect()}
    assert seen == {"a": "warning,suggestion", "b": "error"}
    assert {r.path for r in findings.with_severity(found(spark, rows), "error").collect()} == {"b"}
    assert findings.with_severity(found(spark, rows), "all").count() == 4


def test_texts(spark):
    row = spark.range(1).select(
        T.shorten_path(F.lit("a/b/c")).alias("short3"), T.shorten_path(F.lit("a/b/c/d")).alias("short4"),
        T.chart_label(F.lit("a/b/c")).alias("chart"), T.report_path(F.lit("a/b/c/d")).alias("rep"),
        T.html_escape(F.lit("<a href=\"x\">&'")).alias("esc"), T.inline_code(F.lit("use `a<b>`")).alias("code"),
        T.format_message(F.lit("error"), F.lit("X-1"), F.lit("no")).alias("msg"),
        T.severity_phrase(F.lit(1), F.lit(2), F.lit(0)).alias("phrase"),
        T.review_summary(F.lit(0), F.lit(0), F.lit(75)).alias("sum"),
        T.expanded_length(F.lit("ab\tc\rde\tf")).alias("width"), T.strip(F.lit("\x1c a 　")).alias("strip"),
    ).first()
    assert (row.short3, row.short4, row.chart, row.rep) == ("a/b/c", ".../b/c/d", ".../b/c", "b/c/d")
    assert row.esc == "&lt;a href=&quot;x&quot;&gt;&amp;'" and row.code == "use <code>a&lt;b&gt;</code>"
    assert row.msg == "\U0001F534 **ERROR** (`X-1`): no" and row.phrase == "1 error, 2 warnings found"
    assert row.sum.startswith("No coding standard violations found. Most changes")
    assert row.width == len("ab\tc\rde\tf".expandtabs(4)) and row.strip == "a"


def test_scope(spark):
    pairs = spark.createDataFrame(
        [(1, "Search fix", "improve the cache"), (2, "Nothing known", "here"), (3, "API", ""), (4, "search", "")],
        "pr_id long, title string, description string",
    )
    files = spark.createDataFrame(
        [(1, 1, "Search/a.cs"), (1, 2, "Web/x.cs"), (1, 3, "app.config"), (2, 1, "any.cs"), (3, 1, "web/API.example.com/x.cs")],
        "pr_id long, file_idx long, path string",
    )
    areas = scope.scope_map("example.com")
    scoped = scope.files_in_scope(pairs, files, areas)
    assert {(r.pr_id, r.file_idx): r.in_scope for r in scoped.collect()} == {
        (1, 1): True, (1, 2): False, (1, 3): True, (2, 1): True, (3, 1): True,
    }
    assert {r.pr_id: r.score for r in scope.scope_scores(pairs, scoped).collect()} == {1: 66, 2: 100, 3: 100, 4: 100}
    missing = {(r.pr_id, r.message) for r in scope.missing_areas(pairs, files, areas).collect()}
    assert missing == {
        (1, "No changes found in CacheInvalidation (issue mentions 'cache')"),
        (4, "No changes found in Search/ (issue mentions 'search')"),
    }


def test_score_is_truncated(spark):
    pairs = spark.createDataFrame([(1, "t", "d")], "pr_id long, title string, description string")
    scoped = spark.range(100).select(F.lit(1).alias("pr_id"), (F.col("id") < 29).alias("in_scope"))
    assert scope.scope_scores(pairs, scoped).first().score == 28


def test_links(spark):
    prs = spark.createDataFrame(
        [(1, "Fix AB-12 now", None, None, 5), (2, "x", "feature/xab-1-y", None, 9), (3, None, "", "see ab-1.", 9), (4, "AB-1", "", "", 1)],
        "pr_id long, title string, branch string, body string, created_at long",
    )
    issues = spark.createDataFrame([("AB-1",), ("AB-12",), ("B-1",), ("AB-9",)], "key string")
    loose = {r.key: r.pr_id for r in linking.link_prs(issues, prs).collect()}
    assert loose == {"AB-1": 3, "AB-12": 1, "B-1": 3}
    exact = {r.key: r.pr_id for r in linking.link_prs(issues, prs, whole_keys=True).collect()}
    assert exact == {"AB-1": 3, "AB-12": 1}
    newest = {r.key: r.pr_id for r in linking.link_prs(issues, prs, newest=1).collect()}
    assert newest == {"AB-1": 3, "B-1": 3}


def test_fixes(spark):
    lines = spark.createDataFrame(
        [(1, "a.cs", 1, "\tint userId = this.x;"), (1, "a.cs", 2, "  changed();"), (1, "a.cs", 3, "int custId = f();"), (1, "a.cs", 4, "x")],
        "pr_id long, path string, line_no long, content string",
    )
    todo = [
        (1, "a.cs", 1, 1, "A", "\tint userId = this.x;", "\tint userID = this.x;"),
        (1, "a.cs", 1, 2, "B", "\tint userId = this.x;", "\tint userId = x;"),
        (1, "a.cs", 2, 1, "A", "original();", "fixed();"),
        (1, "a.cs", 3, 1, "A", "  int custId = f();", "int custID = f();\r\n"),
        (1, "a.cs", 9, 1, "A", "x", "y"),
        (1, "b.cs", 1, 1, "A", "x", "y"),
    ]
    df = spark.createDataFrame(
        todo, "pr_id long, path string, line_no long, fix_ord int, rule_id string, original_line string, suggested_fix string"
    )
    got = {(r.path, r.line_no, r.fix_ord): r.status for r in fixes.apply_fixes(lines, df).collect()}
    assert got == {
        ("a.cs", 1, 1): "ok", ("a.cs", 1, 2): "ok", ("a.cs", 2, 1): "conflict", ("a.cs", 3, 1): "ok",
        ("a.cs", 9, 1): "out_of_range", ("b.cs", 1, 1): "file_missing",
    }
    told = {r.status: r.message for r in fixes.apply_fixes(lines, df).collect()}
    assert told == {"ok": None, "out_of_range": None, "file_missing": None, "conflict": V.FIX_CONFLICT}
    after = {r.line_no: r.content for r in fixes.fixed_lines(lines, df).collect()}
    assert after == {1: "\tint userID = x;", 2: "  changed();", 3: "int custID = f();", 4: "x"}


DIFF = (
    "diff --git a/Search/a.cs b/Search/a.cs\n--- a/Search/a.cs\n+++ b/Search/a.cs\n@@ -1,2 +1,9 @@\n"
    "+int customerId = 1; // review-ignore: CS-NAME-001\n+Debugger.Break();\n+int orderId = 7;\n"
)


def test_presets(spark, tmp_path):
    import datetime as dt

    from difflens.sources import store

    diffs = spark.createDataFrame([(1, DIFF), (2, "")], "pr_id long, diff_text string")
    now = dt.datetime(2024, 1, 5, 12)
    prs = spark.createDataFrame(
        [(n, f"AB-{n}", "b", "", f"sha{n}", f"u/{n}", now, now) for n in (1, 2)],
        "pr_id long, title string, branch string, body string, head_sha string, html_url string, created_at timestamp, updated_at timestamp",
    )
    issues = spark.createDataFrame(
        [(f"AB-{n}", "search", "d" * 600, "Bug") for n in (1, 2)], "key string, title string, description string, type string"
    )
    assert presets.cli_review(diffs).count() == 4

    bot = presets.bot_review(prs, diffs, bot="X")
    ranked = bot["findings"].orderBy("rank").collect()
    assert [r.rule_id for r in ranked][0] == "GEN-003" and len(ranked) == 4
    bodies = {r.pr_id: r.body for r in bot["summaries"].collect()}
    assert bodies[2].endswith("No issues found. Code looks good!")
    assert "Found **4** issue(s)" in bodies[1] and "- **General Quality**: 1 issue(s)" in bodies[1] and bodies[1].endswith("*Automated review by X*")
    assert {r.pr_id: (r.conclusion, r.event) for r in bot["conclusions"].collect()} == {
        1: ("failure", "REQUEST_CHANGES"), 2: ("success", "COMMENT"),
    }
    assert [r.position for r in bot["comments"].orderBy("n").collect()][0] == 3
    assert '"annotation_level":"failure"' in bot["annotations"].first().annotations
    assert "### Details" in bot["fallback"].first().body
    posted = {r.pr_id: r for r in bot["reviews"].collect()}
    assert posted[1].commit_id == "sha1" and posted[1].comments.count('"position"') == 4 and posted[2].comments == "[]"
    checks = {r.pr_id: r for r in bot["checks"].collect()}
    assert checks[1].title == "1 error, 2 warnings, 1 suggestion found" and checks[2].conclusion == "success"

    base = str(tmp_path / "store")
    dash = presets.dashboard_review(prs, diffs, issues, linking.link_prs(issues, prs), "example.com", base, batch="one")
    heads = {r.pr_id: r for r in dash["responses"].collect()}
    assert (heads[1].total, heads[1].errors, heads[1].suppressed_count, heads[1].scope_score) == (3, 1, 1, 100)
    assert len(heads[1].issue_description) == 500 and heads[2].total == 0
    tables = store.read(spark, base)
    history = store.history(tables["reviews"]).collect()
    assert len(history) == 2 and {r.issue_key for r in history} == {"AB-1", "AB-2"}
    uuid = next(r.review_uuid for r in history if r.issue_key == "AB-1")
    stored = json.loads("".join(r.text for r in store.review_documents(tables, uuid).orderBy("part").collect()))
    assert [[i["line_number"] for i in f["issues"]] for f in stored["files"]] == [[1, 2, 3, 3]]
    assert sum(i["suppressed"] for i in stored["files"][0]["issues"]) == 1
    response = json.loads("".join(r.text for r in dash["documents"].filter("pr_id = 1").orderBy("part").collect()))
    assert response["review_uuid"] == uuid and len(response["files"][0]["issues"]) == 3
    assert response["scope_validation"]["in_scope"] == ["Search/a.cs"]
    assert dash["html"].filter("pr_id = 1").first().html.count("<tr>") == 3


def test_suppressed_only_files_are_stored_with_zero_counts(spark):
    from difflens.operators import counts

    df = found(spark, [("a", 1, "R-1", "error"), ("b", 1, "R-1", "error")]).withColumn("suppressed", F.col("path") == "a")
    assert {r.path: r.errors for r in counts.per_file_all(df).collect()} == {"a": 0, "b": 1}
