"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``stage_diffs`` and ``stage_changed_lines`` are the one-time costs of deriving
the diffs and of parsing them into the staged table the rule queries scan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "diff_explode", "rules_cs_naming", "rules_sql_format", "rules_security", "rules_ts", "commented_code_runs",
    "unused_imports", "findings_all", "findings_suppressed", "findings_top30", "file_severity_counts", "review_markdown",
    "scope_score", "pr_issue_link", "review_summary", "review_detail", "html_report", "apply_fixes", "scan_long_lines",
    "rate_admission", "issue_text", "top_violations", "score_trend", "worst_files", "review_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("difflens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.session.timeZone", "UTC")
        # No call-site capture for every column expression: it doubles planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from difflens.plans import catalog
    from difflens.sources import corpus

    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    spark.range(10).count()
    timed("stage_diffs", lambda: corpus.diffs(spark, sf_dir))
    lines = timed("stage_changed_lines", lambda: catalog.staged_lines(spark, sf_dir))
    timed("stage_findings", lambda: catalog.staged_findings(spark, sf_dir))
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    n = lines.count()
    print(
        json.dumps(
            {
                "metric": "difflens headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "changed_lines": n,
                "rule_pass_lines_per_sec": round(n / times["findings_all"]) if "findings_all" in times else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
