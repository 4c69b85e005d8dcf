"""Which pull request belongs to an issue, and the issues a person works on.

A PR mentions an issue when the issue's key is contained in its title, branch
or body, in any case. A key is letters, a dash and digits; so every key a text
can contain is a tail of the letters before a dash with a head of the digits
behind it. Listing those turns the substring condition into an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def _text_of(pr: str) -> Column:
    return F.coalesce(F.lower(pr), F.lit(""))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[a-z]+-\p{Nd}+"), F.lit(0))


def _keys_within(run: Column, max_letters: Column, max_digits: Column) -> Column:
    """Every key a run of letters, dash and digits contains, up to the lengths keys have."""
    letters = F.substring_index(run, "-", 1)
    digits = F.substring_index(run, "-", -1)
    n = F.char_length(letters)
    tails = F.transform(F.sequence(F.greatest(F.lit(1), n - max_letters + 1), n), lambda i: F.substring(letters, i, n))
    lengths = F.sequence(F.lit(1), F.least(F.char_length(digits), max_digits))
    heads = F.transform(lengths, lambda i: F.substring(digits, F.lit(1), i))
    return F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.concat(t, F.lit("-"), h))))


def mentions(issues: DataFrame, prs: DataFrame, whole_keys: bool = False) -> DataFrame:
    """``(pr_id, created_at, key_lower)`` of the issue keys a PR can mean. ``whole_keys``:
    only keys that stand alone, so that ``ab-1`` does not hit ``ab-12``."""
    runs = F.flatten(F.transform(F.array(*[_text_of(c) for c in ("title", "branch", "body")]), _runs))
    if whole_keys:
        return prs.select("pr_id", "created_at", F.explode(F.array_distinct(runs)).alias("key_lower"))
    longest = issues.agg(
        F.coalesce(F.max(F.char_length(F.substring_index("key", "-", 1))), F.lit(1)).alias("letters"),
        F.coalesce(F.max(F.char_length(F.substring_index("key", "-", -1))), F.lit(1)).alias("digits"),
    )
    sized = prs.select(
        "pr_id", "created_at", F.explode(F.array_distinct(runs)).alias("run"),
        longest.select("letters").scalar().alias("max_letters"), longest.select("digits").scalar().alias("max_digits"),
    )
    keys = _keys_within(F.col("run"), F.col("max_letters"), F.col("max_digits"))
    return sized.select("pr_id", "created_at", F.explode(F.array_distinct(keys)).alias("key_lower"))


def link_prs(issues: DataFrame, prs: DataFrame, whole_keys: bool = False, newest: int | None = None) -> DataFrame:
    """``(key, pr_id)``: the newest PR that mentions each issue. ``newest`` looks only
    at that many most recent PRs, as a paged search of a code host does."""
    if newest is not None:
        prs = prs.orderBy(F.col("created_at").desc(), F.col("pr_id").desc()).limit(newest)
    # The newest mention per key is found before the join, combined on the map side.
    best = mentions(issues, prs, whole_keys).groupBy("key_lower").agg(F.max(F.struct("created_at", "pr_id")).alias("pr"))
    keys = issues.select("key", F.lower("key").alias("key_lower"))
    return keys.join(best, "key_lower").select("key", F.col("pr.pr_id").alias("pr_id"))


def my_issues(issues: DataFrame, user: str, statuses=None, limit: int = V.MY_ISSUES_ROWS) -> DataFrame:
    """A person's open issues, last updated first."""
    return (
        issues.filter((F.col("assignee") == user) & F.col("status").isin(list(statuses or V.MY_ISSUE_STATUSES)))
        .orderBy(F.col("updated").desc(), "key")
        .limit(limit)
        .select("key", "title", F.coalesce("type", F.lit("Task")).alias("type"), "status", "priority")
    )
