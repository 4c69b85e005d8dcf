"""Counts over findings: per file, per review, by category and rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import EMISSION_ORDER


def _of(severity: str) -> Column:
    return F.col("severity") == severity


def severity_counts(extra: Column | None = None) -> list[Column]:
    """``errors``, ``warnings``, ``suggestions`` as aggregates."""
    keep = F.lit(True) if extra is None else extra
    return [F.count_if(_of(s) & keep).alias(f"{s}s") for s in V.SEVERITIES]


def per_file(visible: DataFrame) -> DataFrame:
    """Files with visible findings and their counts."""
    return visible.groupBy("pr_id", "path").agg(*severity_counts())


def per_file_all(findings: DataFrame) -> DataFrame:
    """Every file with a finding, also when all of them are suppressed; only visible ones count."""
    return findings.groupBy("pr_id", "path").agg(*severity_counts(~F.col("suppressed")))


def per_review(findings: DataFrame) -> DataFrame:
    seen = ~F.col("suppressed")
    return findings.groupBy("pr_id").agg(
        *severity_counts(seen), F.count_if(seen).alias("total"), F.count_if(~seen).alias("suppressed_count")
    )


def per_review_of(prs: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts for every PR, zero for those without findings. ``suggestions`` is what is neither error nor warning."""
    counts = findings.groupBy("pr_id").agg(
        F.count_if(_of("error")).alias("errors"), F.count_if(_of("warning")).alias("warnings"), F.count("*").alias("total")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    joined = prs.select("pr_id").join(counts, "pr_id", "left").select("pr_id", zero("errors"), zero("warnings"), zero("total"))
    return joined.withColumn("suggestions", F.col("total") - F.col("errors") - F.col("warnings"))


def category(rule_id: Column) -> Column:
    return F.substring_index(rule_id, "-", 1)


def per_category(findings: DataFrame) -> DataFrame:
    code = category(F.col("rule_id"))
    counts = findings.groupBy("pr_id", code.alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("category_name", T.lookup(F.col("category"), V.CATEGORY_NAMES, F.col("category")))


def conclusions(counts: DataFrame) -> DataFrame:
    """Check conclusion, review event and commit state from per-review counts."""
    failed = F.col("errors") > 0
    return counts.select(
        "pr_id",
        F.when(F.col("total") == 0, "success").when(failed, "failure").otherwise("neutral").alias("conclusion"),
        F.when(failed, "REQUEST_CHANGES").otherwise("COMMENT").alias("event"),
        F.when(failed, "failure").otherwise("success").alias("state"),
    )


def check_titles(counts: DataFrame) -> DataFrame:
    return counts.select(
        "pr_id", T.severity_phrase(F.col("errors"), F.col("warnings"), F.col("suggestions")).alias("title")
    )


def top_rules(visible: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent rules of each review; ties in order of first appearance."""
    first_seen = F.min(F.struct("path", *EMISSION_ORDER))
    counts = visible.groupBy("pr_id", "rule_id").agg(F.count("*").alias("n"), first_seen.alias("first_seen"))
    w = Window.partitionBy("pr_id").orderBy(F.col("n").desc(), "first_seen")
    return (
        counts.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("pr_id", "rank", "rule_id", "n", F.least(F.lit(100), F.col("n") * 20).alias("bar"))
    )


def file_severities(visible: DataFrame) -> DataFrame:
    """The severities present in each file, comma-separated in order of rank."""
    present = F.concat_ws(",", *[F.when(F.bool_or(_of(s)), s) for s in V.SEVERITIES])
    return visible.groupBy("pr_id", "path").agg(present.alias("severities"))


def rollup_counts(findings: DataFrame) -> DataFrame:
    """Issues per file, per PR (path NULL) and in total (both NULL)."""
    return findings.rollup("pr_id", "path").agg(F.count("*").alias("issues"))
