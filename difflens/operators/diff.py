"""Unified-diff explode: one row per added line, with line number and diff position.

A diff is one row. It is split into lines inside its task; lines are then
spread by ``(pr_id, chunk)``, where a chunk holds at most ``chunk_lines`` lines.
Almost every diff is a single chunk, so this is the same shuffle as one by
``pr_id``, but a huge diff is numbered by many tasks. The state each later
chunk starts from (open file, line counter, position) is folded inside the
diff's own row, only for diffs longer than a chunk, and travels as one extra
row at the head of the chunk; so no join and no second scan are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import staging
from . import files

DEFAULT_CHUNK_LINES = 100_000
BYTES_PER_TASK = 16 << 20

# Line kinds: G git header, F new file, N deleted file, H hunk, A added,
# C context, D removed, O anything else; S / Z open and close a later chunk.


def _kind(line: Column) -> Column:
    sw = lambda p: F.startswith(line, F.lit(p))
    return (
        F.when(sw("diff --git"), "G")
        .when(sw("+++ b/"), "F")
        .when(sw("+++ /dev/null"), "N")
        .when(sw("@@"), "H")
        .when(sw("+"), "A")
        .when(sw(" "), "C")
        .when(sw("-"), "D")
        .otherwise("O")
    )


def _hunk_base(line: Column) -> Column:
    """Number of the line before the hunk's first; 0 for an unreadable (or absurdly large) number."""
    after_plus = F.split_part(line, F.lit("+"), F.lit(2))
    start = F.split_part(F.split_part(after_plus, F.lit("@@"), F.lit(1)), F.lit(","), F.lit(1))
    number = F.trim(start).try_cast("bigint")
    # Room is left for counting on from the number.
    return F.when(number.between(-9 * 10**18, 9 * 10**18), number - 1).otherwise(F.lit(0).cast("bigint"))


def _chunk_states(lines: Column, n: int) -> Column:
    """State at the start of chunks 1, 2, …: a fold over the lines of one long diff."""
    start = F.expr(
        "named_struct('i', 0, 'seg', 0L, 'live', false, 'path', '', 'line', 0L, 'pos', 0L, 'out', "
        "cast(array() as array<struct<seg:bigint,live:boolean,path:string,line:bigint,pos:bigint>>))"
    )

    def step(a: Column, line: Column) -> Column:
        kind = _kind(line)
        marker = kind.isin("G", "F", "N")
        live = F.when(marker, kind == "F").otherwise(a["live"])
        moves_line = a["live"] & kind.isin("A", "C")
        moves_pos = a["live"] & kind.isin("H", "A", "C", "D")
        state = F.struct(a["seg"], a["live"], a["path"], a["line"], a["pos"])
        return F.struct(
            (a["i"] + 1).alias("i"),
            (a["seg"] + F.when(marker, 1).otherwise(0)).alias("seg"),
            live.alias("live"),
            F.when(kind == "F", F.substring(line, 7, 2**31 - 1)).otherwise(a["path"]).alias("path"),
            F.when((kind == "H") & a["live"], _hunk_base(line))
            .otherwise(a["line"] + F.when(moves_line, 1).otherwise(0))
            .alias("line"),
            F.when(marker, F.lit(0).cast("bigint"))
            .otherwise(a["pos"] + F.when(moves_pos, 1).otherwise(0))
            .alias("pos"),
            F.when((a["i"] > 0) & (a["i"] % n == 0), F.array_append(a["out"], state)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda a: a["out"])


def diff_line_rows(diffs: DataFrame, chunk_lines: int = DEFAULT_CHUNK_LINES) -> DataFrame:
    """``diffs(pr_id, diff_text)`` → classified lines, still in the diff's own task.

    Lines that neither move a counter nor carry text are dropped here, and only
    added lines keep their text, so the shuffle carries what later steps use.
    """
    n = chunk_lines
    whole = diffs.select("pr_id", F.split("diff_text", "\n").alias("lines"))
    long = F.size("lines") > n

    def later_marker(firsts: Column, k: Column) -> Column:
        later = F.filter(F.slice(firsts, k + 2, F.size(firsts)), lambda x: x.isNotNull())
        return F.get(later, F.lit(0))

    chunk_ids = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / n).cast("int"))
    first_markers = F.transform(
        chunk_ids,
        lambda k: F.get(
            F.filter(
                F.transform(F.slice(F.col("lines"), k * n + 1, F.lit(n)), _kind), lambda x: x.isin("G", "F", "N")
            ),
            F.lit(0),
        ),
    )
    prepared = whole.select(
        "pr_id",
        "lines",
        F.when(long, _chunk_states(F.col("lines"), n)).alias("states"),
        F.when(long, first_markers).alias("firsts"),
    )
    null_line = F.array(F.lit(None).cast("string"))
    cut = F.transform(
        chunk_ids,
        lambda k: F.struct(
            F.when(k == 0, F.slice(F.col("lines"), F.lit(1), F.lit(n)))
            .otherwise(F.concat(null_line, F.slice(F.col("lines"), k * n + 1, F.lit(n))))
            .alias("lines"),
            F.get(F.col("states"), k - 1).alias("state"),
            later_marker(F.col("firsts"), k).alias("next_marker"),
        ),
    )
    # The closing row comes last in each chunk of a long diff.
    cut = F.transform(
        cut,
        lambda c: F.struct(
            F.concat(c["lines"], null_line).alias("lines"), c["state"].alias("state"), c["next_marker"].alias("next_marker")
        ),
    )
    one = F.array(
        F.struct(
            F.col("lines").alias("lines"),
            F.get(F.col("states"), F.lit(0)).alias("state"),
            F.lit(None).cast("string").alias("next_marker"),
        )
    )
    chunks = prepared.select(
        "pr_id", F.posexplode(F.when(F.col("states").isNull(), one).otherwise(cut)).alias("chunk", "c")
    )
    rows = chunks.select("pr_id", "chunk", F.posexplode("c.lines").alias("i", "line"), "c.state", "c.next_marker")

    line = F.col("line")
    opens = line.isNull() & (F.col("i") == 0) & (F.col("chunk") > 0)
    kind = F.when(opens, "S").when(line.isNull(), "Z").otherwise(_kind(line))
    rows = rows.withColumn("kind", kind).filter(F.col("kind") != "O")
    k = F.col("kind")
    return rows.select(
        "pr_id",
        "chunk",
        (F.col("chunk").cast("bigint") * n + F.col("i") - F.when(F.col("chunk") > 0, 1).otherwise(0)).alias("ord"),
        "kind",
        F.when(k == "A", F.substring(line, 2, 2**31 - 1))
        .when(k == "F", F.substring(line, 7, 2**31 - 1))
        .when(k == "S", F.col("state.path"))
        .alias("payload"),
        F.when(k == "H", _hunk_base(line)).when(k == "S", F.col("state.line")).alias("base"),
        F.when(k == "S", F.col("state.pos")).alias("pos_in"),
        F.when(k == "S", F.col("state.seg")).alias("seg_in"),
        F.when(k == "S", F.col("state.live")).alias("live_in"),
        F.when(k == "Z", F.col("next_marker")).alias("next_in"),
    )


def _number_lines(rows: DataFrame) -> DataFrame:
    """Running file, line and position counters within each chunk: one sort, as ``ord`` is unique there."""
    w = Window.partitionBy("pr_id", "chunk").orderBy("ord")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.col("kind")
    marker = k.isin("G", "F", "N")
    zero = F.lit(0).cast("bigint")
    opened = rows.select(
        "*",
        F.sum(F.when(k == "S", F.col("seg_in")).when(marker, 1).otherwise(0)).over(run).alias("file_idx"),
        F.last(F.when(k == "S", F.col("live_in")).when(marker, k == "F"), ignorenulls=True).over(run).alias("live"),
        F.last(F.when(k.isin("S", "F"), F.col("payload")), ignorenulls=True).over(run).alias("path"),
    )
    live = F.coalesce("live", F.lit(False))
    counted = opened.select(
        "*",
        F.sum(F.when(live & k.isin("A", "C"), 1).otherwise(0)).over(run).alias("lines_seen"),
        F.sum(F.when(live & k.isin("H", "A", "C", "D"), 1).otherwise(0)).over(run).alias("places_seen"),
    )
    line_base = F.when((k == "S") | (live & (k == "H")), F.col("base") - F.col("lines_seen"))
    place_base = F.when(k == "S", F.col("pos_in") - F.col("places_seen")).when(marker, -F.col("places_seen"))
    return counted.select(
        "pr_id",
        "chunk",
        "ord",
        "kind",
        "payload",
        "next_in",
        "file_idx",
        "path",
        live.alias("live"),
        (F.coalesce(F.last(line_base, ignorenulls=True).over(run), zero) + F.col("lines_seen")).alias("line_no"),
        (F.coalesce(F.last(place_base, ignorenulls=True).over(run), zero) + F.col("places_seen")).alias("diff_position"),
    )


def _drop_unclosed_files(numbered: DataFrame) -> DataFrame:
    """A file replaced by another ``+++`` line without a git header in between is
    lost, so look back from the end for the marker that closes each line's file."""
    k = F.col("kind")
    marker = k.isin("G", "F", "N")
    kept = numbered.filter((F.col("live") & (k == "A")) | marker | (k == "Z"))
    back = Window.partitionBy("pr_id", "chunk").orderBy(F.col("ord").desc())
    seen = back.rowsBetween(Window.unboundedPreceding, -1)
    closing = F.last(F.when(k == "Z", F.col("next_in")).when(marker, k), ignorenulls=True).over(seen)
    return kept.withColumn("closing", closing).filter((k == "A") & F.coalesce(F.col("closing") == "G", F.lit(True)))


def last_write_per_line(added: DataFrame, chunk_lines: int = DEFAULT_CHUNK_LINES, dealt=lambda rows, *keys: rows) -> DataFrame:
    """Overlapping hunks: the last text and position of a line win, the first order stays.

    Lines are spread by file and line range, so a huge file is shared out too.
    """
    ranged = dealt(added.withColumn("range_no", F.expr(f"line_no div {int(chunk_lines)}")), "pr_id", "file_idx", "range_no")
    peers = (
        Window.partitionBy("pr_id", "file_idx", "range_no").orderBy("line_no").rangeBetween(Window.currentRow, Window.currentRow)
    )
    return (
        ranged.select("*", F.max("ord").over(peers).alias("last_ord"), F.min("ord").over(peers).alias("first_ord"))
        .filter(F.col("ord") == F.col("last_ord"))
        .withColumn("ord", F.col("first_ord"))
    )


def tasks_for(diffs: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> int:
    """Into how many tasks the lines of ``diffs`` are dealt so that one has about so many bytes of them. Reads their lengths."""
    size = diffs.agg(F.sum(F.octet_length("diff_text"))).first()[0] or 0
    return staging.tasks_for(diffs.sparkSession, size, bytes_per_task)


def explode_diffs(
    diffs: DataFrame, chunk_lines: int = DEFAULT_CHUNK_LINES, reviewable_only: bool = False, tasks: int | None = None
) -> DataFrame:
    """``changed_lines(pr_id, file_idx, path, line_no, content, diff_position, ord)``.

    ``tasks``: into how many tasks lines are dealt (``tasks_for``), by default as many as there are shuffle partitions."""

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(tasks, *keys) if tasks else rows

    added = _drop_unclosed_files(_number_lines(dealt(diff_line_rows(diffs, chunk_lines), "pr_id", "chunk")))
    if reviewable_only:
        added = added.filter(files.is_reviewable(F.col("path")))
    lines = last_write_per_line(added, chunk_lines, dealt)
    return lines.select(
        "pr_id", "file_idx", "path", "line_no", F.col("payload").alias("content"), "diff_position", "ord"
    )
