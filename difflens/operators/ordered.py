"""Neighbours and dense positions of lines in a file, without putting a file into one task.

Rows are spread by file and line range; what a range needs from the ranges
before it is one small row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_RANGE = 100_000
FILE = ["pr_id", "file_idx"]


def _ranged(rows: DataFrame, order: str, size: int) -> DataFrame:
    return rows.withColumn("range_no", F.expr(f"{order} div {int(size)}"))


def with_previous(rows: DataFrame, order: str, value: Column, name: str, size: int = DEFAULT_RANGE) -> DataFrame:
    """Adds ``name``: ``value`` of the row before, in ``order``, within the file."""
    ranged = _ranged(rows.withColumn("_value", value), order, size)
    inside = Window.partitionBy(*FILE, "range_no").orderBy(order)
    across = Window.partitionBy(*FILE).orderBy("range_no")
    carry = (
        ranged.groupBy(*FILE, "range_no")
        .agg(F.max_by("_value", order).alias("_end"))
        .select(*FILE, "range_no", F.lag("_end").over(across).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    return (
        ranged.withColumn("_before", F.lag("_value").over(inside))
        .join(carry, [*FILE, "range_no"], "left")
        .withColumn(name, F.coalesce("_before", "_carry"))
        .drop("_value", "_before", "_carry", "range_no")
    )


def with_position(rows: DataFrame, order: str = "line_no", size: int = DEFAULT_RANGE) -> DataFrame:
    """Adds ``idx``: 0, 1, 2, … over a file's rows in ``order``."""
    ranged = _ranged(rows, order, size)
    inside = Window.partitionBy(*FILE, "range_no").orderBy(order)
    before = Window.partitionBy(*FILE).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*FILE, "range_no")
        .agg(F.count("*").alias("_n"))
        .select(*FILE, "range_no", F.sum("_n").over(before).alias("_offset"))
        .filter(F.col("_offset").isNotNull())
    )
    return (
        ranged.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [*FILE, "range_no"], "left")
        .withColumn("idx", F.col("_rn") + F.coalesce("_offset", F.lit(0)))
        .drop("_rn", "_offset", "range_no")
    )


def only_files_with(rows: DataFrame, wanted: Column, at_least: int = 1) -> DataFrame:
    """Rows of files in which ``wanted`` holds for at least that many rows."""
    counts = rows.filter(wanted).groupBy(*FILE).agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least)
    return rows.join(counts.select(*FILE), FILE, "left_semi")
