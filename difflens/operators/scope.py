"""Does a change stay within the scope of its issue? Keyword heuristics over paths.

``pairs(pr_id, title, description)`` links PRs to issue texts;
``changed_files(pr_id, file_idx, path)`` are all files of the diff, also those
outside the review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def scope_map(domain: str, table: dict | None = None) -> dict[str, list[str]]:
    """Keyword → path fragments for a site domain."""
    return {k: [f.replace("{d}", domain) for f in parts] for k, parts in (table or V.SCOPE_MAP).items()}


def changed_files(changed_lines: DataFrame) -> DataFrame:
    return changed_lines.groupBy("pr_id", "file_idx", "path").agg(F.count("*").alias("n_lines")).drop("n_lines")


def _areas(areas: dict) -> Column:
    """Areas whose keyword the issue mentions."""
    text = F.lower(F.concat(F.col("title"), F.lit(" "), F.col("description")))
    rows = [
        F.struct(F.lit(k).alias("keyword"), F.array(*[F.lit(p) for p in parts]).alias("fragments"))
        for k, parts in areas.items()
    ]
    return F.filter(F.array(*rows), lambda a: F.contains(text, a["keyword"]))


def _touches(fragments: Column, path: Column) -> Column:
    return F.exists(fragments, lambda f: F.contains(F.lower(path), F.lower(f)))


def _joined(pairs: DataFrame, files: DataFrame, areas: dict) -> DataFrame:
    return files.join(pairs.select("pr_id", _areas(areas).alias("areas")), "pr_id")


def files_in_scope(pairs: DataFrame, files: DataFrame, areas: dict) -> DataFrame:
    """Adds ``in_scope``: a mentioned area, a shared path, or nothing mentioned at all."""
    fragments = F.flatten(F.transform("areas", lambda a: a["fragments"]))
    shared = _touches(F.array(*[F.lit(p) for p in V.SHARED_FRAGMENTS]), F.col("path"))
    inside = (F.size("areas") == 0) | _touches(fragments, F.col("path")) | shared
    return _joined(pairs, files, areas).select("pr_id", "file_idx", "path", inside.alias("in_scope"))


def scope_scores(pairs: DataFrame, scoped: DataFrame) -> DataFrame:
    """Share of files in scope, truncated; 100 for a PR without files."""
    counts = scoped.groupBy("pr_id").agg(F.count_if("in_scope").alias("n_in"), F.count("*").alias("n"))
    share = (F.col("n_in") / F.col("n") * 100).cast("bigint")
    return (
        pairs.select("pr_id")
        .join(counts, "pr_id", "left")
        .select(
            "pr_id",
            F.coalesce("n_in", F.lit(0)).cast("bigint").alias("in_scope"),
            F.coalesce(F.col("n") - F.col("n_in"), F.lit(0)).cast("bigint").alias("out_of_scope"),
            F.coalesce(share, F.lit(100)).alias("score"),
        )
    )


def missing_areas(pairs: DataFrame, files: DataFrame, areas: dict) -> DataFrame:
    """Areas the issue mentions that no changed file touches."""
    mentioned = pairs.select("pr_id", F.inline(_areas(areas)))
    touched = (
        _joined(pairs, files, areas)
        .select("pr_id", F.explode(F.filter("areas", lambda a: _touches(a["fragments"], F.col("path")))).alias("a"))
        .select("pr_id", F.col("a.keyword").alias("keyword"))
        .distinct()
    )
    return mentioned.join(touched, ["pr_id", "keyword"], "left_anti").select(
        "pr_id",
        "keyword",
        T.fill(V.MISSING_AREA, F.get(F.col("fragments"), F.lit(0)), F.col("keyword")).alias("message"),
    )

