"""Apply suggested fixes to a table of source lines; the result is a new version of the table.

Almost every fix meets the line it was made for and is a column expression.
Lines with several fixes, or that changed since, are split off, and only they
go through Python, which replays the edits one after another.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text as T
from ..functions import values as V
from ..sources import staging

LINE = ["pr_id", "path", "line_no"]


def _replay(current: str, original: str, fixed: str) -> tuple[str, str]:
    """One fix on the present text of its line: (status, text)."""
    before, after, now = original.strip(), fixed.strip(), current.strip()
    if now == before:
        return "ok", fixed.rstrip("\r\n")
    gone, new = [], []
    for op, a, b, c, d in difflib.SequenceMatcher(None, before, after).get_opcodes():
        if op != "equal":
            gone.append(before[a:b])
            new.append(after[c:d])
    gone_text = "".join(gone)
    if not gone_text or gone_text not in now:
        return "conflict", current
    indent = current[: len(current) - len(current.lstrip())]
    return "ok", indent + now.replace(gone_text, "".join(new), 1)


@F.pandas_udf(StructType().add("content", StringType()).add("statuses", ArrayType(StringType())))
def _replay_all(content: pd.Series, fixes: pd.Series) -> pd.DataFrame:
    texts, statuses = [], []
    for text, todo in zip(content, fixes):
        done = []
        for fix in todo:
            status, text = _replay(text, fix["original_line"], fix["suggested_fix"])
            done.append(status)
        texts.append(text)
        statuses.append(done)
    return pd.DataFrame({"content": texts, "statuses": statuses})


def _merged(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row per line that has fixes: its old and new text and the outcome of each fix."""
    per_line = fixes.groupBy(*LINE).agg(
        F.array_sort(F.collect_list(F.struct("fix_ord", "rule_id", "original_line", "suggested_fix"))).alias("fixes")
    )
    sizes = lines.groupBy("pr_id", "path").agg(F.max("line_no").alias("n_lines"))
    met = (
        per_line.join(lines.select(*LINE, "content"), LINE, "left")
        .join(sizes, ["pr_id", "path"], "left")
        .withColumn("only", F.get(F.col("fixes"), F.lit(0)))
    )
    fits = (F.size("fixes") == 1) & (T.strip(F.col("content")) == T.strip(F.col("only.original_line")))
    hard = F.col("content").isNotNull() & ~F.coalesce(fits, F.lit(False))
    placed = staging.stage(met.withColumn("hard", hard), "fixes")
    easy = placed.filter("not hard").withColumn("statuses", F.when(F.col("content").isNotNull(), F.array(F.lit("ok"))))
    easy = easy.withColumn("new_content", F.when(F.col("content").isNotNull(), F.regexp_replace("only.suggested_fix", "[\r\n]+$", "")))
    replayed = placed.filter("hard").withColumn("replayed", _replay_all("content", "fixes"))
    replayed = replayed.select("*", F.col("replayed.statuses").alias("statuses"), F.col("replayed.content").alias("new_content")).drop("replayed")
    return easy.unionByName(replayed).drop("only", "hard")


def apply_fixes(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """``fixes(pr_id, path, line_no, fix_ord, rule_id, original_line, suggested_fix)`` on
    ``lines(pr_id, path, line_no, content)`` → status of every fix and the line's new text:
    ``ok``, ``conflict`` (the line changed and the edit cannot be replayed, which its ``message`` says),
    ``out_of_range`` or ``file_missing``."""
    unplaced = F.when(F.col("n_lines").isNull(), "file_missing").when(F.col("content").isNull(), "out_of_range")
    status = F.coalesce(unplaced, F.get(F.col("statuses"), F.col("i")))
    rows = _merged(lines, fixes).select("*", F.posexplode("fixes").alias("i", "fix"))
    return rows.select(
        *LINE, F.col("fix.fix_ord").alias("fix_ord"), F.col("fix.rule_id").alias("rule_id"), status.alias("status"), "new_content",
        F.when(status == "conflict", V.FIX_CONFLICT).alias("message"),
    )


def fixed_lines(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """The lines table with all applicable fixes in place."""
    changed = _merged(lines, fixes).filter(F.col("new_content").isNotNull()).select(*LINE, "new_content")
    return (
        lines.join(changed, LINE, "left")
        .withColumn("content", F.coalesce("new_content", "content"))
        .select(*lines.columns)
    )
