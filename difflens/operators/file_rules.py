"""Rules that look beyond one line: neighbours, runs, whole files, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import ordered
from .ordered import FILE
from .registry import File, FileHit, Found, file_rule, window_rule


# ------------------------------------------------------------- whole files
@file_rule("SEC-001", "SecurityRules")
def sensitive_file(f: File) -> FileHit:
    return FileHit(T.matches(f.path, V.SENSITIVE_FILE, True))


@file_rule("GEN-001", "GeneralQualityRules")
def large_change(f: File) -> FileHit:
    return FileHit(f.n_lines > V.LARGE_CHANGE_LINES, (f.n_lines,))


def _word(content: Column, word: str, pattern: str) -> Column:
    return (F.contains(F.upper(content), F.lit(word)) | ~T.is_ascii(content)) & T.matches(content, pattern, True)


@file_rule(
    "SQL-BP-005",
    "SqlPerformanceRules",
    flags={
        "begins": lambda ln: _word(ln.content, "BEGIN", V.BEGIN_TRAN),
        "ends": lambda ln: _word(ln.content, "ROLLBACK", V.ROLLBACK),
    },
    measures=lambda flag: {
        "begin_line": F.min(F.when(flag("begins"), F.col("line_no"))),
        "rolled_back": F.bool_or(flag("ends")),
    },
)
def transaction_without_rollback(f: File) -> FileHit:
    begin = f.measured["begin_line"]
    return FileHit(begin.isNotNull() & ~f.measured["rolled_back"], line=begin)


# ---------------------------------------------------- neighbours and runs
@window_rule(
    "CS-STYLE-003",
    "CSharpStyleRules",
    branch=3,
    flags={
        "head": lambda ln: T.matches(ln.text, V.BARE_CONTROL_FLOW),
        "body": lambda ln: ~((ln.text == "") | F.startswith(ln.text, F.lit("{")) | F.startswith(ln.text, F.lit("//"))),
    },
)
def braceless_control_flow(lines: DataFrame, size: int):
    """The body must be the very next line number, so this is an equi-join."""
    heads = lines.filter("head").select(*FILE, "path", "line_no")
    bodies = lines.filter("body").select(*FILE, (F.col("line_no") - 1).alias("line_no"))
    return heads.join(bodies, [*FILE, "line_no"], "left_semi"), Found(F.lit(True))


@window_rule("SQL-FMT-002", "SqlFormattingRules", branch=2, flags={"blank": lambda ln: ln.text == ""})
def double_blank_lines(lines: DataFrame, size: int):
    """A blank line whose previous changed line is blank as well."""
    sql = lines.select(*FILE, "path", "line_no", "blank")
    some = ordered.only_files_with(sql, F.col("blank"), 2)
    hits = ordered.with_previous(some, "line_no", F.col("blank"), "blank_before", size)
    return hits.filter(F.col("blank") & F.col("blank_before")), Found(F.lit(True))


@window_rule(
    "GEN-004",
    "GeneralQualityRules",
    branch=3,
    suffixes=[".cs"],
    flags={"dead": lambda ln: F.startswith(ln.text, F.lit("//")) & T.matches(ln.text, V.COMMENTED_CODE)},
)
def commented_code_runs(lines: DataFrame, size: int):
    """Runs of at least three commented-out lines; a run that closes the file has a shorter text."""
    cs = lines.filter(F.endswith("path", F.lit(".cs"))).select(*FILE, "path", "line_no", "dead")
    placed = ordered.with_position(ordered.only_files_with(cs, F.col("dead"), V.COMMENTED_RUN_LINES), size=size)
    dead_lines = placed.filter("dead").withColumn("range_no", F.expr(f"idx div {int(size)}"))
    inside = Window.partitionBy(*FILE, "range_no").orderBy("idx")
    pieces = (
        dead_lines.withColumn("island", F.col("idx") - F.row_number().over(inside))
        .groupBy(*FILE, "path", "range_no", "island")
        .agg(F.min("line_no").alias("line_no"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    )
    # Only pieces at the edge of a range can continue in the next one.
    edge = (F.col("first") % size == 0) | (F.col("last") % size == size - 1)
    keyed = pieces.withColumn("part", F.when(edge, F.lit(-1)).otherwise(F.col("first")))
    w = Window.partitionBy(*FILE, "part").orderBy("first")
    starts = F.coalesce(F.lag("last").over(w) + 1 != F.col("first"), F.lit(True))
    runs = (
        keyed.withColumn("starts", starts.cast("int"))
        .withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*FILE, "path", "part", "run")
        .agg(
            F.min("line_no").alias("line_no"),
            (F.max("last") - F.min("first") + 1).alias("n"),
            (F.max("last") + 1).alias("idx"),
        )
        .filter(F.col("n") >= V.COMMENTED_RUN_LINES)
    )
    after = placed.select(*FILE, "idx", F.col("line_no").alias("line_after"))
    hits = runs.join(after, [*FILE, "idx"], "left")
    at_end = F.col("line_after").isNull()
    return hits, [
        Found(~at_end, (F.col("n"),), pos=F.col("line_after")),
        Found(at_end, (F.col("n"),), pos=F.lit(0), phase=2, template=V.GEN_004_AT_FILE_END),
    ]


@window_rule(
    "TS-002",
    "TypeScriptAsyncWithoutTryCatchRule",
    flags={
        "awaits": lambda ln: F.contains(ln.content, F.lit("await"))
        & T.matches(ln.content, V.AWAIT)
        & ~(F.startswith(ln.text, F.lit("//")) | F.startswith(ln.text, F.lit("*"))),
        "block": lambda ln: F.contains(ln.content, F.lit("try")) & T.matches(ln.content, V.TRY_BLOCK),
        "full": lambda ln: ln.text != "",
        "opener": lambda ln: F.endswith(ln.text, F.lit("try")) & T.matches(ln.text, r"\btry$"),
        "brace": lambda ln: F.startswith(ln.text, F.lit("{")),
    },
)
def await_without_try(lines: DataFrame, size: int):
    """``try`` and its brace may stand on different lines with only blank lines between."""
    full = lines.filter("full").select(*FILE, "ord", "opener", "brace")
    split_try = (
        ordered.with_previous(ordered.only_files_with(full, F.col("opener")), "ord", F.col("opener"), "after_try", size)
        .filter(F.col("brace") & F.col("after_try"))
        .select(*FILE)
    )
    safe = lines.filter("block").select(*FILE).unionByName(split_try)
    hits = lines.filter("awaits").join(safe, FILE, "left_anti")
    return hits, Found(F.lit(True), pos=F.col("ord"), original=T.rstrip(F.col("content")))


# ----------------------------------------------------------------- imports
def _listed(content: Column) -> Column:
    return T.extract(T.strip(content), V.NAMED_IMPORT, 1)


@window_rule(
    "TS-004",
    "TypeScriptUnusedImportRule",
    flags={"imports": lambda ln: F.contains(ln.content, F.lit("import")) & (_listed(ln.content) != "")},
)
def unused_imports(ts: DataFrame, size: int):
    """Imported names that occur at most once in the file's changed lines."""
    content = F.col("content")
    imports = (
        ts.filter("imports")
        .select(*FILE, "path", "line_no", "ord", "content", F.posexplode(F.split(_listed(content), ",")).alias("nth", "item"))
        .withColumn("name", T.strip(F.substring_index(T.strip(F.col("item")), " as ", 1)))
        .filter(F.col("name") != "")
    )
    plain = T.matches(F.col("name"), r"^\w+$")
    words = F.regexp_extract_all(content, F.lit(T.java(r"\w+")), F.lit(0))
    used_words = (
        ts.select(*FILE, F.explode(words).alias("name"))
        .groupBy(*FILE, "name")
        .agg(F.count("*").alias("uses"))
        .filter(F.col("uses") > 1)
        .select(*FILE, "name")
    )
    # Names such as ``type Foo`` or ``$x`` are counted only in lines that hold their first word or sign.
    first = lambda c: F.coalesce(
        F.nullif(T.extract(c, r"\w+", 0), F.lit("")), F.substring(c, 1, 1)
    )
    odd = imports.filter(~plain).select(*FILE, "name").distinct().withColumn("part", first(F.col("name")))
    signs = F.regexp_extract_all(content, F.lit(T.java(r"[^\w]")), F.lit(0))
    odd_files = odd.select(*FILE).distinct()
    parts = ts.join(odd_files, FILE, "left_semi").select(
        *FILE, "content", F.explode(F.array_distinct(F.concat(words, signs))).alias("part")
    )
    literal = F.concat(
        F.lit(r"(?U)\b\Q"), F.replace(F.col("name"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")
    )
    used_odd = (
        parts.join(odd, [*FILE, "part"])
        .groupBy(*FILE, "name")
        .agg(F.sum(F.regexp_count("content", literal)).alias("uses"))
        .filter(F.col("uses") > 1)
        .select(*FILE, "name")
    )
    hits = imports.join(used_words.unionByName(used_odd), [*FILE, "name"], "left_anti")
    return hits, Found(
        F.lit(True), (F.col("name"),), pos=F.col("ord"), sub=F.col("nth"), original=T.rstrip(content)
    )
