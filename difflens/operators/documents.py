"""Ordered documents of any size, as numbered parts of bounded size.

A document (a report, a nested response) is given as pieces of text with an order. No document is ever held by one task:
pieces are dealt out by ranges of (document, order), each range adds up its own pieces, and what lies before a range is
carried by one small row for each range a document touches. The running byte count then cuts the document at piece
borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import staging

PART_BYTES = 1 << 20
BYTES_PER_TASK = 32 << 20
#: A piece's place in its document, beside its text.
ROW_BYTES = 100
SEPARATOR = ","


def json_text(value: Column) -> Column:
    """One value as JSON text, null included."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def json_fields(row: Column) -> Column:
    """A struct's fields as JSON text, without the braces."""
    whole = F.to_json(row, {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.char_length(whole) - 2)


def in_parts(pieces: DataFrame, key: list[str], order: list[str], text: str = "text", size: int = PART_BYTES, ranges: int | None = None) -> DataFrame:
    """``(*key, part, start, text)``: the documents, each the concatenation of its parts in order.

    ``pieces`` has the key, the order columns and ``text``. Columns ``enters`` and ``leaves`` are optional: they name the
    list of which a piece begins or ends an element, and a separator goes between a piece that leaves a list and a next
    one that enters it. ``start`` counts the bytes before a part, and ``part`` is the start of its first piece divided by
    ``size``; a part ends with a whole piece, so it is at most one piece longer than ``size``, and behind a piece that is
    longer than that numbers are left out. Pieces equal in order follow their text. Null texts count as empty.
    ``ranges``: into how many ranges the pieces are dealt, by default so many that each has about ``BYTES_PER_TASK`` of
    text, and not fewer than there are shuffle partitions.
    """
    listed = [c if c in pieces.columns else F.lit(None).cast("string").alias(c) for c in ("enters", "leaves")]
    slim = pieces.select(*key, *order, F.coalesce(text, F.lit("")).alias("text"), *listed)
    # Written before they are dealt, as dealing by ranges reads its input twice.
    slim = staging.stage(slim, "loose_pieces")
    if not ranges:
        held = slim.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
        ranges = staging.tasks_for(slim.sparkSession, held, BYTES_PER_TASK)
    # Written once: the range a piece falls into must not change when a task runs again.
    placed = staging.stage(slim.repartitionByRange(ranges, *key, *order).withColumn("_range", F.spark_partition_id()), "pieces")
    placed = placed.repartition(ranges, *key, "_range")

    inside = Window.partitionBy(*key, "_range").orderBy(*order, "text")
    before = F.lag(F.struct("leaves")).over(inside)
    comma = lambda enters, left: F.coalesce(enters == left, F.lit(False))
    bytes_of = lambda joined: F.octet_length("text") + F.when(joined, len(SEPARATOR)).otherwise(0)
    rows = placed.select("*", before.isNull().alias("_first"), comma(F.col("enters"), before["leaves"]).alias("_joined"))

    across = Window.partitionBy(*key).orderBy("_range")
    borders = (
        rows.groupBy(*key, "_range")
        .agg(
            F.sum(bytes_of(F.col("_joined"))).alias("_bytes"),
            F.max(F.when(F.col("_first"), F.col("enters"))).alias("_enters"),
            F.max_by(F.struct("leaves"), F.struct(*order, "text")).alias("_last"),
        )
        .withColumn("_border", comma(F.col("_enters"), F.lag("_last").over(across)["leaves"]))
        .withColumn("_bytes", F.col("_bytes") + F.when(F.col("_border"), len(SEPARATOR)).otherwise(0))
        .select(
            *key, "_range", "_border",
            F.coalesce(F.sum("_bytes").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"),
        )
    )
    joined = F.col("_joined") | (F.col("_first") & F.col("_border"))
    whole = rows.join(borders, [*key, "_range"]).withColumn("_joined", joined)
    up_to = F.sum(bytes_of(F.col("_joined"))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    started = whole.withColumn("_start", F.col("_carry") + F.coalesce(up_to, F.lit(0)))
    separated = lambda p: F.concat(F.when(p["_joined"], SEPARATOR).otherwise(""), p["text"])
    return (
        started.withColumn("part", F.expr(f"_start div {int(size)}"))
        .select(*key, "part", "_start", F.struct(*order, "text", "_joined").alias("_piece"))
        .repartition(ranges, *key, "part")
        .groupBy(*key, "part")
        .agg(F.min("_start").alias("start"), F.array_sort(F.collect_list("_piece")).alias("_pieces"))
        .select(*key, "part", "start", F.array_join(F.transform("_pieces", separated), "").alias("text"))
    )
