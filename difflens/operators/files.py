"""File filters: which files are reviewed, which rules a file gets, which PRs start a review."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


LINE_ENDS = ["\n", "\r", "\x85", "\u2028", "\u2029"]
LANGUAGES = {
    "cs": "cs", "sql": "sql", **dict.fromkeys(["ts", "tsx", "js", "jsx"], "ts"),
    **dict.fromkeys(["config", "json", "xml", "yml", "yaml"], "config"),
}


def suffix_regex(suffixes) -> str:
    return "(?:" + "|".join(re.escape(s) for s in suffixes) + ")$"


def _any(tests) -> Column:
    return reduce(Column.__or__, tests)


def _ends(low: Column, suffixes) -> Column:
    """``suffix_regex`` without the regex, save for paths whose last character ends a line, as ``$`` matches before it."""
    plain = _any(F.endswith(low, F.lit(s)) for s in suffixes)
    broken = F.substring(low, -1, 1).isin(*LINE_ENDS)
    return F.when(broken, F.rlike(low, F.lit(suffix_regex(suffixes)))).otherwise(plain)


def has_suffix(path: Column, suffixes) -> Column:
    """Case-insensitive file suffix test; an empty list accepts every file."""
    return _ends(F.lower(path), suffixes) if suffixes else F.lit(True)


def is_reviewable(path: Column) -> Column:
    low = F.lower(path)
    return (
        ~_ends(low, V.EXCLUDED_SUFFIXES)
        & ~_any(F.contains(low, F.lit(s)) for s in V.EXCLUDED_FOLDERS)
        & _ends(low, V.REVIEWABLE_SUFFIXES)
    )


def extension(path: Column) -> Column:
    """Lower-case text behind the last dot, ``''`` without one."""
    low = F.lower(path)
    return F.when(F.contains(low, F.lit(".")), F.substring_index(low, ".", -1)).otherwise("")


def language(path: Column) -> Column:
    """Partition of the staged lines a rule family reads."""
    known = F.create_map(*[F.lit(x) for ext, lang in LANGUAGES.items() for x in (ext, lang)])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("other"))


def reviewable_files(changed_lines: DataFrame) -> DataFrame:
    """One row per reviewable file with its number of changed lines."""
    return (
        changed_lines.filter(is_reviewable(F.col("path")))
        .groupBy("pr_id", "file_idx", "path")
        .agg(F.count("*").alias("n_lines"))
    )


def file_counts(changed_lines: DataFrame) -> DataFrame:
    """Parsed and reviewable files per PR."""
    per_file = changed_lines.groupBy("pr_id", "file_idx", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("pr_id").agg(
        F.count("*").alias("parsed_files"), F.count_if(is_reviewable(F.col("path"))).alias("reviewable_files")
    )


def valid_issue_key(key: Column) -> Column:
    """Upper-cased key, NULL when it is not of the form ``ABC-123``."""
    from ..functions.text import java

    return F.when(F.rlike(key, F.lit(java(V.ISSUE_KEY))), F.upper(key))


def triggered_prs(prs: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """PR events that start a review: not a draft, a relevant action and a relevant path."""
    relevant = changed_paths.filter(F.rlike("path", F.lit(suffix_regex(V.TRIGGER_SUFFIXES)))).select("pr_id").distinct()
    ready = ~F.coalesce(F.col("draft"), F.lit(False))
    return prs.filter(F.col("action").isin(V.TRIGGER_ACTIONS) & ready).join(relevant, "pr_id", "left_semi")
