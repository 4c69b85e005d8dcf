"""Landed inputs: diff files, source trees, and the JSON documents of PRs and issues."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import richtext
from ..functions import text as T
from ..functions import values as V
from ..operators import diff
from . import tree

# Everything that ends a line of a source file; a break at the very end opens no line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_SCHEMA = ["pr_id", "file_idx", "path", "line_no", "content", "diff_position", "ord"]


def _utf8(content: Column) -> Column:
    """Undecodable bytes become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """One diff per file → ``diffs(pr_id, source, diff_text)``; line ends are unified as a text reader does."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.xxhash64("path").alias("pr_id"),
        F.col("path").alias("source"),
        F.regexp_replace(_utf8(F.col("content")), r"\r\n?", "\n").alias("diff_text"),
    )


def scanned_file(path: Column) -> Column:
    """Whether a full scan takes the file."""
    name = F.substring_index(path, "/", -1)
    folders = "(?:^|/)(?:" + "|".join(re.escape(d) for d in V.SCAN_EXCLUDED_FOLDERS) + ")(?:/|$)"
    suffixes = "^.+(?:" + "|".join(re.escape(s) for s in V.REVIEWABLE_SUFFIXES) + ")$"
    skipped = "(?:" + "|".join(re.escape(s) for s in V.SCAN_EXCLUDED_NAMES) + ")$"
    return (
        ~F.rlike(path, F.lit(folders))
        & F.rlike(F.lower(name), F.lit(suffixes))
        & ~F.rlike(name, F.lit(skipped))
    )


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files below ``root/<repository>/`` → ``sources(pr_id, repo, path, text)``; excluded folders are not entered."""
    tree.register(spark)
    uri = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
    raw = spark.read.format(tree.SourceTree.name()).load(uri)
    return raw.select(F.xxhash64("repo").alias("pr_id"), "repo", "path", _utf8(F.col("content")).alias("text"))


def scan_lines(sources: DataFrame) -> DataFrame:
    """``sources(pr_id, path, text)`` → changed lines, every line counting as changed.

    No shuffle: a file's lines are made where the file is read.
    """
    breaks = F.split("text", LINE_BREAK)
    last_empty = F.element_at(breaks, -1) == ""
    kept = F.when(last_empty, F.slice(breaks, F.lit(1), F.size(breaks) - 1)).otherwise(breaks)
    return (
        sources.filter(scanned_file(F.col("path")))
        .select("pr_id", "path", F.posexplode(kept).alias("i", "content"))
        .select(
            "pr_id",
            F.xxhash64("path").alias("file_idx"),
            "path",
            (F.col("i") + 1).cast("bigint").alias("line_no"),
            "content",
            F.lit(None).cast("bigint").alias("diff_position"),
            F.col("i").cast("bigint").alias("ord"),
        )
    )


def local_review_lines(diffs: DataFrame, sources: DataFrame) -> DataFrame:
    """Repositories with a diff are reviewed by it, all others by a full scan."""
    has_diff = diffs.filter(T.lstrip(F.col("diff_text")) != "")
    from_diffs = diff.explode_diffs(has_diff, reviewable_only=True, tasks=diff.tasks_for(has_diff))
    from_scan = scan_lines(sources.join(has_diff.select("pr_id"), "pr_id", "left_anti"))
    return from_diffs.unionByName(from_scan.select(*LINE_SCHEMA))


def without_files(requested: DataFrame, lines: DataFrame) -> DataFrame:
    """Requested repositories in which there is nothing to review (an error to the caller)."""
    return requested.join(lines.select("pr_id").distinct(), "pr_id", "left_anti")


ISSUE_JSON = (
    "key string, fields struct<summary: string, description: string, issuetype: struct<name: string>, "
    "status: struct<name: string>, assignee: struct<displayName: string>, priority: struct<name: string>, updated: string>"
)
PR_JSON = (
    "number bigint, title string, head struct<ref: string, sha: string>, body string, html_url string, draft boolean, "
    "created_at string, updated_at string"
)


def parse_issues(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Issue documents → ``issues``, with the defaults for absent fields."""
    parsed = docs.select(F.from_json(column, ISSUE_JSON).alias("j"), F.col(column).alias("doc"))
    f = "j.fields."
    d = V.ISSUE_DEFAULTS
    description = F.get_json_object("doc", "$.fields.description")
    # A plain string loses its quotes here, whatever it begins with; an object stays JSON. The JSON type tells them apart.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("doc"), "$.fields.description", "variant"))
    text = F.when(F.startswith(kind, F.lit("OBJECT")), richtext.rich_text(description)).otherwise(
        F.coalesce(description, F.lit(""))
    )
    return parsed.select(
        F.col("j.key").alias("key"),
        F.coalesce(f + "summary", F.lit(d["title"])).alias("title"),
        text.alias("description"),
        F.coalesce(f + "issuetype.name", F.lit(d["type"])).alias("type"),
        F.coalesce(f + "status.name", F.lit(d["status"])).alias("status"),
        F.coalesce(f + "assignee.displayName", F.lit(d["assignee"])).alias("assignee"),
        F.coalesce(f + "priority.name", F.lit(d["priority"])).alias("priority"),
        F.to_timestamp(f + "updated").alias("updated"),
    )


def parse_prs(docs: DataFrame, column: str = "doc") -> DataFrame:
    """PR documents, bare or inside an event with an ``action``, → ``prs``."""
    inner = F.coalesce(F.get_json_object(column, "$.pull_request"), F.col(column))
    parsed = docs.select(F.from_json(inner, PR_JSON).alias("j"), F.get_json_object(column, "$.action").alias("action"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return parsed.select(
        F.col("j.number").alias("pr_id"),
        empty("j.title").alias("title"),
        empty("j.head.ref").alias("branch"),
        empty("j.body").alias("body"),
        F.col("j.head.sha").alias("head_sha"),
        empty("j.html_url").alias("html_url"),
        F.coalesce("j.draft", F.lit(False)).alias("draft"),
        "action",
        F.to_timestamp("j.created_at").alias("created_at"),
        F.to_timestamp("j.updated_at").alias("updated_at"),
    )
