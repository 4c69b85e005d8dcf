"""Statistics over all stored reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_violations(issues: DataFrame, k: int = 10) -> DataFrame:
    return (
        issues.filter(~F.col("suppressed") & (F.col("rule_id") != ""))
        .groupBy("rule_id")
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "rule_id")
        .limit(k)
    )


def score_trend(reviews: DataFrame, as_of: Column | str, days: int = 30) -> DataFrame:
    """Mean scope score per day over the last ``days`` days; the filter prunes a store's months."""
    since = F.date_sub(F.to_date(F.lit(as_of) if isinstance(as_of, str) else as_of), days)
    recent = reviews.filter(F.col("created_at") >= since)
    if "review_month" in reviews.columns:
        recent = recent.filter(F.col("review_month") >= F.trunc(since, "month"))
    return (
        recent.groupBy(F.to_date("created_at").alias("day"))
        .agg(F.round(F.avg("scope_score"), 1).alias("avg_score"))
        .orderBy("day")
    )


def worst_files(review_files: DataFrame, k: int = 10) -> DataFrame:
    issues = F.col("error_count") + F.col("warning_count") + F.col("suggestion_count")
    return (
        review_files.groupBy("file_path")
        .agg(F.sum(issues).alias("total_issues"))
        .orderBy(F.col("total_issues").desc(), "file_path")
        .limit(k)
    )


def review_stats(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count("*").alias("total_reviews"),
        F.coalesce(F.round(F.avg("total"), 1), F.lit(0.0)).alias("avg_issues_per_review"),
    )
