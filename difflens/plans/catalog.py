"""The registered queries: each a callable on the given tables, most with a SQL statement that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import diff, files, findings, registry
from ..sources import corpus, staging
from . import oracle as O
from . import presets

FINDING = ["pr_id", "path", "line_no", "rule_id", "severity", "message"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None, *needs, extra=None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = O.statement(sql, *needs, extra=extra)
        return build

    return register


# --------------------------------------------------------- shared inputs
def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines by language; lines of files outside the review keep only their place."""

    return staging.stage_once(
        spark, ("changed_lines", sf_dir), lambda: presets.lines_by_language(corpus.diffs(spark, sf_dir)), ("lang",)
    )


def reviewed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_lines(spark, sf_dir).filter(F.col("lang") != "outside")


def staged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        lines = reviewed_lines(spark, sf_dir)
        return findings.suppress(findings.find(lines), lines, presets.tasks_for(lines))

    return staging.stage_once(spark, ("findings", sf_dir), build)


def seen(spark, sf_dir):
    return findings.visible(staged_findings(spark, sf_dir))


def ranked(spark, sf_dir):
    """The bot's findings: de-duplicated, ranked, at most 30 per PR."""
    found = staged_findings(spark, sf_dir).drop("suppressed")
    return presets.ranked_findings(found, presets.tasks_for(found))


# ------------------------------------------------------------------ diffs
@query(
    "diff_explode",
    "SELECT pr_id, file_idx, path, line_no, content, diff_position, ord FROM all_lines",
    "all_lines",
)
def diff_explode(spark, sf_dir):
    diffs = corpus.diffs(spark, sf_dir)
    return diff.explode_diffs(diffs, tasks=diff.tasks_for(diffs))


@query(
    "diff_positions",
    "SELECT pr_id, path, count(*) AS n_lines, min(line_no) AS first_line, max(line_no) AS last_line, "
    "max(diff_position) AS last_position, CAST(sum(diff_position) AS BIGINT) AS position_sum FROM all_lines GROUP BY ALL",
    "all_lines",
)
def diff_positions(spark, sf_dir):
    return (
        staged_lines(spark, sf_dir)
        .groupBy("pr_id", "path")
        .agg(
            F.count("*").alias("n_lines"),
            F.min("line_no").alias("first_line"),
            F.max("line_no").alias("last_line"),
            F.max("diff_position").alias("last_position"),
            F.sum("diff_position").alias("position_sum"),
        )
    )


@query(
    "diff_file_counts",
    f"SELECT pr_id, count(*) AS parsed_files, count(*) FILTER (WHERE {O.REVIEWABLE}) AS reviewable_files "
    "FROM (SELECT DISTINCT pr_id, file_idx, path FROM all_lines) GROUP BY pr_id",
    "all_lines",
)
def diff_file_counts(spark, sf_dir):
    return files.file_counts(staged_lines(spark, sf_dir))


@query(
    "reviewable_files",
    "SELECT pr_id, file_idx, path, count(*) AS n_lines FROM lines GROUP BY ALL",
    "lines",
)
def reviewable_files(spark, sf_dir):
    return files.reviewable_files(staged_lines(spark, sf_dir))


# ------------------------------------------------------------------ rules
RULE_QUERIES = {
    "rules_cs_naming": ["CS-NAME-001", "CS-NAME-002", "CS-NAME-003", "CS-NAME-004", "CS-NAME-005"],
    "rules_cs_style": ["CS-STYLE-001", "CS-STYLE-002", "CS-STYLE-003", "CS-STYLE-004"],
    "rules_cs_async": ["CS-ASYNC-001", "CS-ASYNC-002"],
    "rules_cs_magic": ["CS-MAGIC-001"],
    "rules_sql_format": ["SQL-FMT-001", "SQL-FMT-003", "SQL-FMT-004", "SQL-FMT-005", "SQL-FMT-006"],
    "rules_sql_practice": ["SQL-BP-001", "SQL-BP-002", "SQL-BP-003", "SQL-BP-004", "SQL-BP-005"],
    "rules_sql_perf": ["SQL-PERF-001", "SQL-PERF-002"],
    "rules_security": ["SEC-001", "SEC-002", "SEC-003", "SEC-005"],
    "rules_log_leak": ["SEC-006"],
    "rules_quality": ["GEN-001", "GEN-002", "GEN-003", "GEN-005"],
    "rules_ts": ["TS-001", "TS-002", "TS-003"],
    "commented_code_runs": ["GEN-004"],
    "double_blank_lines": ["SQL-FMT-002"],
    "braceless_control_flow": ["CS-STYLE-003"],
    "unused_imports": ["TS-004"],
}


def _rule_query(name, ids):
    selects = O.rule_selects()
    body = " UNION ALL ".join(selects[i] for i in ids)

    @query(name, f"SELECT {', '.join(FINDING)} FROM ({body})", "lines")
    def run(spark, sf_dir):
        return findings.find(reviewed_lines(spark, sf_dir), ids).select(*FINDING)

    return run


for _name, _ids in RULE_QUERIES.items():
    _rule_query(_name, _ids)


@query("findings_all", f"SELECT {', '.join(FINDING)}, file_idx, rule_ord, phase, emit_pos, emit_sub FROM found", "found")
def findings_all(spark, sf_dir):
    return findings.find(reviewed_lines(spark, sf_dir)).select(*FINDING, *registry.EMISSION_ORDER)


@query(
    "suggested_fixes",
    "SELECT pr_id, path, line_no, rule_id, original_line, suggested_fix FROM found WHERE suggested_fix IS NOT NULL",
    "found",
)
def suggested_fixes(spark, sf_dir):
    return (
        findings.find(reviewed_lines(spark, sf_dir))
        .filter(F.col("suggested_fix").isNotNull())
        .select("pr_id", "path", "line_no", "rule_id", "original_line", "suggested_fix")
    )


@query(
    "rule_catalogue",
    "SELECT g.*, count(found.rule_id) AS n_findings, count(DISTINCT found.rule_id) AS n_rules_hit, "
    "count(DISTINCT struct_pack(p := found.pr_id, f := found.file_idx)) FILTER (WHERE found.rule_id IS NOT NULL) AS n_files "
    f"FROM (VALUES {O.RULE_GROUP_ROWS}) g(class_name, file_types, description, ord) LEFT JOIN found ON found.rule_ord = g.ord "
    "GROUP BY ALL",
    "found",
)
def rule_catalogue(spark, sf_dir):
    """The rule classes, and what each found in the reviewed lines."""
    hits = staged_findings(spark, sf_dir).groupBy("rule_ord").agg(
        F.count("*").alias("n_findings"),
        F.count_distinct("rule_id").alias("n_rules_hit"),
        F.count_distinct("pr_id", "file_idx").alias("n_files"),
    )
    return registry.rule_catalogue(spark).join(hits, "rule_ord", "left").select(
        "class_name", F.array_join("file_types", ", ").alias("file_types"), "description",
        F.col("rule_ord").alias("ord"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in hits.columns[1:]],
    )


@query("findings_suppressed", "SELECT pr_id, path, line_no, rule_id, message, suppressed FROM findings", "findings")
def findings_suppressed(spark, sf_dir):
    lines = reviewed_lines(spark, sf_dir)
    return findings.suppress(findings.find(lines), lines, presets.tasks_for(lines)).select(
        "pr_id", "path", "line_no", "rule_id", "message", "suppressed"
    )


@query("findings_dedup", f"SELECT {', '.join(FINDING)} FROM deduped", "deduped")
def findings_dedup(spark, sf_dir):
    found = staged_findings(spark, sf_dir).drop("suppressed")
    return findings.deduplicate(found, presets.tasks_for(found)).select(*FINDING)


@query("findings_top30", f"SELECT {', '.join(FINDING)}, rank FROM top", "top")
def findings_top30(spark, sf_dir):
    return ranked(spark, sf_dir).withColumn("rank", F.col("rank").cast("bigint")).select(*FINDING, "rank")


from . import catalog_reports, catalog_store  # noqa: E402,F401  (register the report and store queries)
