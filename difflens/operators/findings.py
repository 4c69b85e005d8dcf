"""Findings of a set of changed lines, and what happens to them: suppress, de-duplicate, rank, place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import files, ordered, registry
from . import file_rules, rules_cs, rules_general, rules_sql  # noqa: F401  (register the rules)
from .registry import EMISSION_ORDER


def find(changed_lines: DataFrame, rule_ids=None, size: int = ordered.DEFAULT_RANGE) -> DataFrame:
    """Run the rules. Lines of files outside the review must already be filtered out."""
    ids = None if rule_ids is None else set(rule_ids)
    parts = [registry.line_findings(changed_lines, ids), registry.file_findings(changed_lines, ids)]
    parts += registry.window_findings(changed_lines, ids, size)
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def last_file_per_path(changed_lines: DataFrame) -> DataFrame:
    """A path that occurs twice in a diff: lookups by path see the last occurrence."""
    return changed_lines.groupBy("pr_id", "path").agg(F.max("file_idx").alias("file_idx"))


def directives(changed_lines: DataFrame) -> DataFrame:
    """``(pr_id, path, line_no, rule_key)`` each ignore directive covers: its own and the next line."""
    content = F.col("content")
    gate = F.contains(F.lower(content), F.lit("review-ignore")) | ~T.is_ascii(content)
    rule = T.extract(content, V.IGNORE_DIRECTIVE, 1, True)
    found = changed_lines.filter(gate & (rule != "")).select(
        "pr_id", "file_idx", "path", "line_no", F.upper(rule).alias("rule_key")
    )
    last = last_file_per_path(changed_lines)
    return (
        found.join(last, ["pr_id", "path", "file_idx"], "left_semi")
        .select(
            "pr_id", "path", "rule_key", F.explode(F.array("line_no", F.col("line_no") + 1)).alias("line_no")
        )
        .distinct()
    )


def _dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``tasks``: see ``staging.tasks_for``; by default as many as there are shuffle partitions."""
    return rows.repartition(tasks, *keys) if tasks else rows


def suppress(findings: DataFrame, changed_lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds ``suppressed``; one equi-join, no range condition."""
    keys = ["pr_id", "path", "line_no", "rule_key"]
    marks = directives(changed_lines).withColumn("suppressed", F.lit(True))
    return (
        _dealt(findings.withColumn("rule_key", F.upper("rule_id")), tasks, *keys)
        .join(_dealt(marks, tasks, *keys), keys, "left")
        .withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
        .drop("rule_key")
    )


def visible(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("suppressed"))


def deduplicate(findings: DataFrame, tasks: int | None = None) -> DataFrame:
    """First finding per PR, path, line and rule."""
    same = ["pr_id", "path", "line_no", "rule_id"]
    w = Window.partitionBy(*same).orderBy(*EMISSION_ORDER)
    return _dealt(findings, tasks, *same).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def prioritise(findings: DataFrame, limit: int = V.MAX_REVIEW_COMMENTS) -> DataFrame:
    """The ``limit`` most severe findings per PR, with their ``rank``; the limit is
    applied before the shuffle as well."""
    w = Window.partitionBy("pr_id").orderBy(T.severity_rank(F.col("severity")), *EMISSION_ORDER)
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def deduplicated_top(findings: DataFrame, tasks: int, limit: int = V.MAX_REVIEW_COMMENTS, size: int = ordered.DEFAULT_RANGE) -> DataFrame:
    """``prioritise`` of ``deduplicate``, dealt to ``tasks`` tasks.

    One shuffle by file and line range serves both the de-duplication and a first limit per range; what is left, at most
    ``limit`` rows a range, goes on to the PR."""
    area = ["pr_id", "path", "_range"]
    ranged = findings.withColumn("_range", F.expr(f"line_no div {int(size)}")).repartition(tasks, *area)
    same = Window.partitionBy(*area, "line_no", "rule_id").orderBy(*EMISSION_ORDER)
    near = Window.partitionBy(*area).orderBy(T.severity_rank(F.col("severity")), *EMISSION_ORDER)
    first = ranged.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") == 1)
    some = first.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= limit).drop("_n", "_range")
    return prioritise(some.repartition(tasks, "pr_id"), limit)


def positions(findings: DataFrame, changed_lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds ``diff_position`` of the finding's line, NULL when it cannot be commented inline."""
    last = last_file_per_path(changed_lines).withColumnRenamed("file_idx", "seen_idx")
    lines = changed_lines.select("pr_id", F.col("file_idx").alias("seen_idx"), "line_no", "diff_position")
    at = ["pr_id", "seen_idx", "line_no"]
    placed = findings.join(last, ["pr_id", "path"], "left")
    return _dealt(placed, tasks, *at).join(_dealt(lines, tasks, *at), at, "left").drop("seen_idx")


def with_severity(findings: DataFrame, severity: str) -> DataFrame:
    """Files that have at least one visible finding of the severity; ``all`` keeps every file."""
    if severity == "all":
        return findings
    keep = findings.filter(F.col("severity") == severity).select("pr_id", "path").distinct()
    return findings.join(keep, ["pr_id", "path"], "left_semi")


def reviewable(changed_lines: DataFrame) -> DataFrame:
    return changed_lines.filter(files.is_reviewable(F.col("path")))
