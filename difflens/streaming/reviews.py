"""Review pull requests as their events arrive, and keep statistics of finished reviews.

A PR event carries its whole diff, so a micro-batch can be reviewed on its own:
the batch operators run inside ``foreachBatch``. A redelivered event (same PR
and head commit) is dropped while the watermark covers it, and each batch owns
one partition of the output, which a retried batch overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import values as V
from ..operators import files, findings
from ..plans.presets import Lines

EVENT_SCHEMA = "pr_id bigint, head_sha string, action string, draft boolean, event_time timestamp, diff_text string"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """PR events landed as JSON lines."""
    return spark.readStream.schema(schema).json(path)


def admitted_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events that start a review, each PR state once."""
    return (
        events.filter(F.col("action").isin(V.TRIGGER_ACTIONS) & ~F.coalesce(F.col("draft"), F.lit(False)))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["pr_id", "head_sha"])
    )


def review_batch(batch: DataFrame) -> DataFrame:
    """Findings, with suppression, of the events of one batch that touch a relevant path.

    A PR pushed twice within a batch is two reviews, so a review is a PR at a commit."""
    keyed = batch.withColumn("review_key", F.xxhash64("pr_id", "head_sha"))
    lines = Lines.of(keyed.select(F.col("review_key").alias("pr_id"), "diff_text"))
    wanted = keyed.select(F.col("review_key").alias("pr_id"), "action", "draft")
    chosen = files.triggered_prs(wanted, lines.all).select("pr_id")
    reviewed = lines.reviewed.join(chosen, "pr_id", "left_semi")
    found = findings.suppress(findings.find(reviewed), reviewed).withColumnRenamed("pr_id", "review_key")
    return found.join(keyed.select("review_key", "pr_id", "head_sha"), "review_key").drop("review_key")


def review_stream(events: DataFrame, out: str, checkpoint: str, delay: str = "1 hour") -> DataStreamWriter:
    """Writer of findings to ``out/batch_id=…``; start it with the trigger of your choice."""

    def run(batch: DataFrame, batch_id: int) -> None:
        review_batch(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        admitted_events(events, delay)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def daily_statistics(reviews: DataFrame, delay: str = "2 days") -> DataFrame:
    """Reviews, issues and mean scope score per day over a stream of reviews (update mode)."""
    return (
        reviews.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(
            F.count("*").alias("reviews"),
            F.sum("total").alias("issues"),
            F.round(F.avg("scope_score"), 1).alias("avg_score"),
        )
        .select(F.to_date("w.start").alias("day"), "reviews", "issues", "avg_score")
    )


def running_violations(issues: DataFrame, delay: str = "2 days") -> DataFrame:
    """Visible violations per day and rule over a stream of issues; a top-n of any span is a sum of these."""
    return (
        issues.filter(~F.col("suppressed") & (F.col("rule_id") != ""))
        .withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day").alias("w"), "rule_id")
        .agg(F.count("*").alias("count"))
        .select(F.to_date("w.start").alias("day"), "rule_id", "count")
    )
