"""The three ways a review runs, over all pull requests at once.

=============  ====  ==========  =====
step           bot   dashboard   cli
=============  ====  ==========  =====
file filter    yes   yes         yes
suppression    no    yes         no
de-duplicate   yes   no          no
rank, cap 30   yes   no          no
scope score    no    yes         no
stored         no    yes         no
=============  ====  ==========  =====

The changed lines and the findings are each read by several steps, so both are
staged: written once to the shared folder and scanned by column after that.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions import values as V
from ..operators import counts, diff, documents, files, findings, registry, report, scope
from ..sources import landed, staging, store


def lines_by_language(diffs: DataFrame) -> DataFrame:
    """Changed lines with their language and the flags of file and window rules; lines of files outside the review keep
    only their place."""
    inside = files.is_reviewable(F.col("path"))
    lines = diff.explode_diffs(diffs, tasks=diff.tasks_for(diffs)).withColumn("content", F.when(inside, F.col("content"))).withColumn(
        "lang", F.when(inside, files.language(F.col("path"))).otherwise("outside")
    )
    return registry.with_flags(lines)


def tasks_for(staged: DataFrame) -> int:
    """Into how many tasks the rows of a staged table, or what is made of them, are dealt. Counts them."""
    return staging.tasks_for(staged.sparkSession, staged.count(), staging.ROWS_PER_TASK)


@dataclass
class Lines:
    """Staged changed lines of a batch of diffs."""

    all: DataFrame

    @classmethod
    def of(cls, diffs: DataFrame) -> Lines:
        return cls(staging.stage(lines_by_language(diffs), "changed_lines", ("lang",)))

    @property
    def reviewed(self) -> DataFrame:
        return self.all.filter(F.col("lang") != "outside")


def cli_review(diffs: DataFrame) -> DataFrame:
    """All findings, without suppression or cap."""
    return findings.find(Lines.of(diffs).reviewed)


def ranked_findings(found: DataFrame, tasks: int) -> DataFrame:
    return findings.deduplicated_top(found, tasks)


def bot_review(prs: DataFrame, diffs: DataFrame, bot: str = report.BOT_NAME) -> dict[str, DataFrame]:
    """Everything the bot posts: inline comments, summaries, annotations and conclusions."""
    lines = Lines.of(diffs)
    tasks = tasks_for(lines.reviewed)
    ranked = ranked_findings(findings.find(lines.reviewed), tasks)
    placed = staging.stage(findings.positions(ranked, lines.reviewed, tasks), "bot_findings")
    totals = counts.per_review_of(prs, placed)
    summaries = report.markdown_summaries(prs, placed, bot)
    # The check's summary counts every finding as placed.
    all_placed = placed.withColumn("diff_position", F.coalesce("diff_position", F.lit(0)))
    check_summaries = report.markdown_summaries(prs, all_placed, bot)
    comments = report.inline_comments(placed)
    conclusions = counts.conclusions(totals)
    titles = counts.check_titles(totals)
    annotated = report.annotation_payloads(placed)
    return {
        "findings": placed,
        "comments": comments,
        "summaries": summaries,
        "fallback": report.summary_comments(summaries, placed),
        "annotations": annotated,
        "conclusions": conclusions,
        "titles": titles,
        "reviews": report.review_payloads(prs, summaries, conclusions, comments),
        "checks": report.check_payloads(prs, check_summaries, conclusions, titles, annotated),
    }


def dashboard_heads(prs: DataFrame, issues: DataFrame, links: DataFrame) -> DataFrame:
    """``links(key, pr_id)`` with the texts of both sides."""
    issue = issues.select(
        "key", F.col("title").alias("issue_title"), F.col("description").alias("issue_description"),
        F.col("type").alias("issue_type"),
    )
    pr = prs.select(
        "pr_id", F.col("title").alias("pr_title"), F.col("html_url").alias("pr_url"), "head_sha",
        F.col("updated_at").alias("created_at"),
    )
    return links.join(issue, "key").join(pr, "pr_id").withColumnRenamed("key", "issue_key")


def store_tables(heads: DataFrame, responses: DataFrame, found: DataFrame, diffs: DataFrame) -> dict[str, DataFrame]:
    """The three tables of the review store for a batch; the reviews are staged, as all three need them."""
    texts = diffs.select("pr_id", "diff_text").repartition(diff.tasks_for(diffs), "pr_id")
    reviews = store.review_rows(
        responses.join(heads.select("pr_id", "head_sha", "created_at"), "pr_id")
        .join(texts, "pr_id", "left")
        .withColumnRenamed("pr_id", "pr_number")
    )
    reviews = staging.stage(reviews, "reviews")
    return {
        "reviews": reviews,
        "review_files": store.file_rows(reviews, found),
        "review_issues": store.issue_rows(reviews, found),
    }


def dashboard_review(
    prs: DataFrame,
    diffs: DataFrame,
    issues: DataFrame,
    links: DataFrame,
    domain: str,
    store_base: str | None = None,
    areas: dict | None = None,
    batch: str | None = None,
) -> dict[str, DataFrame]:
    """Findings with suppression, scope, responses; published in the store when its place is given, once for each ``batch``."""
    lines = Lines.of(diffs)
    found = staging.stage(findings.suppress(findings.find(lines.reviewed), lines.reviewed, tasks_for(lines.reviewed)), "findings")
    heads = dashboard_heads(prs, issues, links)
    pairs = heads.select("pr_id", F.col("issue_title").alias("title"), F.col("issue_description").alias("description"))
    changed = scope.changed_files(lines.all)
    areas = areas or scope.scope_map(domain)
    scoped = scope.files_in_scope(pairs, changed, areas)
    scores = scope.scope_scores(pairs, scoped)
    responses = report.review_responses(heads, found, scores.select("pr_id", "score"))
    tables = store_tables(heads, responses, found, diffs)
    if store_base is not None:
        store.write(store_base, tables, batch or uuid.uuid4().hex)
    uuids = tables["reviews"].select(F.col("pr_number").alias("pr_id"), "review_uuid")
    missing = scope.missing_areas(pairs, changed, areas)
    return {
        "findings": found,
        "responses": responses,
        "files": report.response_files(findings.visible(found)),
        "documents": report.response_documents(responses.join(uuids, "pr_id"), findings.visible(found), scoped, missing, list(areas)),
        "html": report.html_documents(report.html_pieces(responses.join(heads.select("pr_id", "created_at"), "pr_id"), found)),
        "scope": scoped,
        "missing": missing,
        **tables,
    }


def local_review(diffs: DataFrame, sources: DataFrame, folders: DataFrame, store_base: str | None = None, batch: str | None = None) -> dict[str, DataFrame]:
    """Folders by diff or full scan, to their stored reviews and responses.

    ``folders(pr_id, folder_name, created_at)``: what was asked for; ``diffs`` and ``sources`` belong to them by ``pr_id``.
    The scope score is always 100, and the scope lists are empty. Folders without anything to review have no response
    but a row in ``nothing``."""
    flagged = staging.stage(registry.with_flags(landed.local_review_lines(diffs, sources)), "local_lines", ("lang",))
    lines = flagged.select(*landed.LINE_SCHEMA)
    found = staging.stage(findings.suppress(findings.find(flagged), flagged, tasks_for(flagged)), "local_findings")
    by_diff = diffs.filter(text.lstrip(F.col("diff_text")) != "").select("pr_id", "diff_text")
    changed = lines.select("pr_id", "file_idx", F.lit(False).alias("scanned")).distinct()
    in_folder = sources.filter(landed.scanned_file(F.col("path"))).select("pr_id", F.xxhash64("path").alias("file_idx"), F.lit(True).alias("scanned"))
    # A folder with a diff is judged by the diff's files, any other by its own, empty ones too.
    judged = changed.unionByName(in_folder).join(by_diff.select("pr_id", F.lit(True).alias("by_diff")), "pr_id", "left")
    n_files = judged.filter(F.col("scanned") == F.col("by_diff").isNull()).groupBy("pr_id").agg(F.count("*").alias("n_files"))
    source = F.when(F.col("by_diff"), V.LOCAL_DIFF).otherwise(V.LOCAL_SCAN)
    asked = folders.join(n_files, "pr_id")
    heads = asked.join(by_diff.select("pr_id", F.lit(True).alias("by_diff")), "pr_id", "left").select(
        "pr_id", F.lit(V.LOCAL_KEY).alias("issue_key"), F.col("folder_name").alias("issue_title"),
        text.fill(V.LOCAL_DESCRIPTION, source, F.col("n_files")).alias("issue_description"), F.lit(V.LOCAL_TYPE).alias("issue_type"),
        F.lit("").alias("pr_title"), F.lit("").alias("pr_url"), "created_at",
    )
    responses = report.review_responses(heads, found, heads.select("pr_id", F.lit(100).alias("score")))
    # A stored local review has no PR number; the id keeps folders apart that are reviewed at one time.
    texts = by_diff.repartition(diff.tasks_for(by_diff), "pr_id")
    named = asked.join(texts, "pr_id", "left").select("pr_id", text.fill(V.LOCAL_TITLE, F.col("folder_name")).alias("pr_title"), "diff_text", "created_at")
    given = responses.drop("pr_title").join(named, "pr_id").withColumn("head_sha", F.lit(V.LOCAL_KEY)).withColumnRenamed("pr_id", "pr_number")
    reviews = staging.stage(store.review_rows(given), "local_reviews")
    tables = {
        "reviews": reviews.withColumn("pr_number", F.lit(0).cast("bigint")),
        "review_files": store.file_rows(reviews, found),
        "review_issues": store.issue_rows(reviews, found),
    }
    if store_base is not None:
        store.write(store_base, tables, batch or uuid.uuid4().hex)
    uuids = reviews.select(F.col("pr_number").alias("pr_id"), "review_uuid")
    none = diffs.sparkSession.createDataFrame([], "pr_id bigint, file_idx bigint, path string, in_scope boolean, keyword string, message string")
    shown = findings.visible(found)
    pieces = report.response_pieces(responses.join(uuids, "pr_id"), shown, none, none, pr_number=F.lit(0))
    return {
        "lines": lines,
        "findings": found,
        "totals": counts.per_review(found),
        "responses": responses.join(uuids, "pr_id"),
        "documents": documents.in_parts(pieces, ["pr_id"], report.RESPONSE_ORDER),
        "nothing": folders.join(n_files, "pr_id", "left_anti"),
        **tables,
    }
