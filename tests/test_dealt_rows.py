"""Joins and sorts whose tasks keep their size while the tables grow."""

import datetime

from conftest import changed_lines
from pyspark.sql import functions as F

from difflens.operators import files, findings
from difflens.plans import presets
from difflens.sources import corpus, staging


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_order_lines_are_dealt_by_their_number_and_joined_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 5)
    day = datetime.date(2024, 1, 1)
    lines = [(i // 3, i % 3, i, i, 1.0, day, "N", "O") for i in range(60)]
    spark.createDataFrame(lines + lines[:2] + [(None, *lines[0][1:])], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i % 4, day) for i in range(18)] + [(None, 1, day), (3, 2, day)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    assert plan(corpus.lines_with_customer(spark, sf)).count(", 13), REPARTITION_BY_NUM") == 2
    assert corpus.order_lines(spark, sf).count() == 54 + 2 + 3
    assert corpus.order_lines(spark, sf).select("cust").inputFiles() == corpus.order_lines(spark, sf).select("cust").inputFiles()
    assert corpus.diffs(spark, sf).count() == corpus.prs(spark, sf).count() == 4


def some_findings(spark):
    rows = [
        (pr, i % 2, f"f{i % 2}.cs", None if i % 19 == 0 else i % 40, f"CS-{i % 3}", ["error", "warning", "suggestion"][i % 3], "m", None, None, 1, 1, i % 7, i)
        for pr in (1, 2, None) for i in range(200)
    ]
    kinds = "pr_id long, file_idx long, path string, line_no long, rule_id string, severity string, message string, original_line string, suggested_fix string, rule_ord int, phase int, emit_pos long, emit_sub long"
    return spark.createDataFrame(rows, kinds)


def test_the_top_findings_are_dealt_by_file_ranges(spark):
    found = some_findings(spark)
    top = findings.deduplicated_top(found, 9, limit=7, size=10)
    once = findings.prioritise(findings.deduplicate(found), 7)
    assert sorted(map(str, top.select(*once.columns).collect())) == sorted(map(str, once.collect()))
    assert plan(top).count(", 9), REPARTITION_BY_NUM") == plan(top).count("Exchange hashpartitioning") == 2


def test_suppression_and_positions_are_dealt(spark):
    lines = changed_lines(spark, [("a.cs", {1: "// review-ignore: CS-1", 2: "x"})])
    found = some_findings(spark).withColumn("path", F.lit("a.cs")).withColumn("pr_id", F.lit(0).cast("long"))
    for dealt, plain in ((findings.suppress(found, lines, 9), findings.suppress(found, lines)), (findings.positions(found, lines, 9), findings.positions(found, lines))):
        assert plan(dealt).count(", 9), REPARTITION_BY_NUM") == 2
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_paths_are_judged_without_a_regex_save_at_line_ends(spark):
    ends = ["", "\n", "\r", "\r\n", "\x85", " ", "\n\n", " ", "x"]
    names = ["a.cs", "A.CS", "a.Designer.cs", "a.csx", "bin/a.cs", "a.png", "a", "a.json", ".ts"]
    paths = spark.createDataFrame([(n + e,) for n in names for e in ends] + [(None,)], "path string")
    low = F.lower("path")
    for suffixes in (files.V.EXCLUDED_SUFFIXES, files.V.REVIEWABLE_SUFFIXES):
        assert paths.filter(~files._ends(low, suffixes).eqNullSafe(F.rlike(low, F.lit(files.suffix_regex(suffixes))))).count() == 0
    kinds = {r.path: r.lang for r in paths.select("path", files.language(F.col("path")).alias("lang")).collect()}
    assert (kinds["A.CS"], kinds["a.cs\n"], kinds["a"], kinds[None], kinds["a.json"], kinds[".ts"]) == ("cs", "other", "other", "other", "config", "ts")


def test_a_local_review_stages_its_lines_by_language(spark):
    text = "diff --git a/a.ts b/a.ts\n+++ b/a.ts\n@@ -1 +1 @@\n+console.log(1)\n"
    diffs = spark.createDataFrame([(1, text), (2, " \n")], "pr_id long, diff_text string")
    sources = spark.createDataFrame([(n, "b.cs", "Debugger.Break();") for n in (1, 2)], "pr_id long, path string, text string")
    folders = spark.createDataFrame([(1, "a"), (2, "b")], "pr_id long, folder_name string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    done = presets.local_review(diffs, sources, folders)
    assert {f.rsplit("/", 2)[1] for f in done["lines"].inputFiles()} == {"lang=ts", "lang=cs"}
    assert sorted((r.pr_id, r.path) for r in done["lines"].collect()) == [(1, "a.ts"), (2, "b.cs")]
    assert {r.issue_description for r in done["responses"].collect()} == {"Source: git diff HEAD · 1 file(s) analyzed", "Source: full scan · 1 file(s) analyzed"}
