"""What a review shows: payload rows for the code host, Markdown, HTML and JSON.

Texts are built by expressions. What belongs to one PR without a natural limit
(its HTML report, its nested response) is produced as ordered pieces, which
``documents.in_parts`` joins to numbered parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import counts, documents
from .registry import EMISSION_ORDER

BOT_NAME = "Code Review Bot"
PRODUCT_NAME = "Code Review"


def _message() -> Column:
    return T.format_message(F.col("severity"), F.col("rule_id"), F.col("message"))


def inline_comments(placed: DataFrame, limit: int = V.MAX_INLINE_COMMENTS) -> DataFrame:
    """The first ``limit`` findings per PR that have a diff position."""
    w = Window.partitionBy("pr_id").orderBy("rank")
    return (
        placed.filter(F.col("diff_position").isNotNull())
        .withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= limit)
        .select("pr_id", "n", "path", F.col("diff_position").alias("position"), _message().alias("body"))
    )


def annotations(ranked: DataFrame, limit: int = V.MAX_INLINE_COMMENTS) -> DataFrame:
    """Check annotations: the first ``limit`` findings per PR."""
    w = Window.partitionBy("pr_id").orderBy("rank")
    return (
        ranked.withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= limit)
        .select(
            "pr_id",
            "n",
            "path",
            F.col("line_no").alias("start_line"),
            F.col("line_no").alias("end_line"),
            T.lookup(F.col("severity"), V.ANNOTATION_LEVELS, "notice").alias("annotation_level"),
            _message().alias("message"),
            F.col("rule_id").alias("title"),
        )
    )


def annotation_payloads(ranked: DataFrame, limit: int = V.MAX_INLINE_COMMENTS) -> DataFrame:
    """The annotations of each PR as one JSON array."""
    one = F.struct("n", "path", "start_line", "end_line", "annotation_level", "message", "title")
    rows = annotations(ranked, limit).groupBy("pr_id").agg(F.array_sort(F.collect_list(one)).alias("items"))
    return rows.select("pr_id", F.to_json(F.transform("items", lambda a: a.dropFields("n"))).alias("annotations"))


def markdown_summaries(prs: DataFrame, placed: DataFrame, bot: str = BOT_NAME) -> DataFrame:
    """``(pr_id, body)``: the review body of each PR, the clean text where nothing was found.

    ``placed``: ranked findings with their diff position."""
    row = lambda label, n: F.when(F.col(n) > 0, F.format_string(f"| {label} | %d |", F.col(n)))
    totals = placed.groupBy("pr_id").agg(
        *counts.severity_counts(),
        F.count("*").alias("total"),
        F.count_if(F.col("diff_position").isNull()).alias("unpostable"),
    )
    # As many entries per PR as there are rule categories.
    categories = (
        counts.per_category(placed)
        .groupBy("pr_id")
        .agg(F.array_sort(F.collect_list(F.struct("category", "category_name", "n"))).alias("categories"))
    )
    per_category = F.transform(
        "categories", lambda c: F.format_string("- **%s**: %d issue(s)", c["category_name"], c["n"])
    )
    body = F.concat_ws(
        "\n",
        F.lit("## Auto Code Review\n"),
        F.format_string("Found **%d** issue(s) across the changed files.\n", F.col("total")),
        F.lit("| Severity | Count |"),
        F.lit("|----------|-------|"),
        row("Errors", "errors"),
        row("Warnings", "warnings"),
        row("Suggestions", "suggestions"),
        F.lit("\n### By Category\n"),
        per_category,
        F.when(
            F.col("unpostable") > 0,
            F.format_string("\n*%d comment(s) could not be posted inline (lines not part of the diff).*", F.col("unpostable")),
        ),
        F.lit("\n---"),
        F.lit(f"*Automated review by {bot}*"),
    )
    return (
        prs.select("pr_id")
        .join(totals.join(categories, "pr_id"), "pr_id", "left")
        .select("pr_id", F.when(F.col("total").isNull(), V.CLEAN_BODY).otherwise(body).alias("body"))
    )


def review_payloads(prs: DataFrame, summaries: DataFrame, conclusions: DataFrame, comments: DataFrame) -> DataFrame:
    """One review per PR to post: commit, body, event and the inline comments as JSON."""
    one = F.struct("n", "path", "position", "body")
    inline = comments.groupBy("pr_id").agg(F.array_sort(F.collect_list(one)).alias("items"))
    bare = F.to_json(F.transform("items", lambda c: c.dropFields("n")))
    return (
        prs.select("pr_id", F.col("head_sha").alias("commit_id"))
        .join(summaries, "pr_id")
        .join(conclusions.select("pr_id", "event"), "pr_id")
        .join(inline, "pr_id", "left")
        .select("pr_id", "commit_id", "body", "event", F.coalesce(bare, F.lit("[]")).alias("comments"))
    )


def check_payloads(
    prs: DataFrame, summaries: DataFrame, conclusions: DataFrame, titles: DataFrame, annotated: DataFrame
) -> DataFrame:
    """One finished check per PR. ``summaries``: of findings that all count as placed."""
    return (
        prs.select("pr_id", "head_sha")
        .join(conclusions.select("pr_id", "conclusion"), "pr_id")
        .join(titles, "pr_id")
        .join(summaries.withColumnRenamed("body", "summary"), "pr_id")
        .join(annotated, "pr_id", "left")
        .withColumn("status", F.lit("completed"))
        .withColumn("annotations", F.coalesce("annotations", F.lit("[]")))
    )


def summary_comments(summaries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Fallback when inline comments are refused: the summary and one bullet per (ranked) finding."""
    bullet = F.concat(
        F.lit("- **"), F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit("** — "), _message(), F.lit("\n")
    )
    details = ranked.groupBy("pr_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", bullet.alias("text")))), lambda x: x["text"]), ""
        ).alias("details")
    )
    return summaries.join(details, "pr_id").select(
        "pr_id", F.concat("body", F.lit("\n\n### Details\n\n"), "details").alias("body")
    )


def status_payloads(reviews: DataFrame, product: str = PRODUCT_NAME, description_chars: int = V.MAX_STATUS_CHARS) -> DataFrame:
    """Commit status and fallback comment of stored reviews; the code host takes descriptions of a limited length."""
    e, w, s = F.col("errors"), F.col("warnings"), F.col("suggestions")
    failed = e > 0
    description = T.severity_phrase(e, w, s)
    row = lambda label, n: F.when(n > 0, F.format_string(f"| {label} | %d |\n", n)).otherwise("")
    comment = F.concat(
        F.lit("## "), F.when(failed, "❌").otherwise("✅"), F.lit(f" {product}\n\n"),
        F.coalesce("summary", description), F.lit("\n\n| Severity | Count |\n|----------|-------|\n"),
        row("❌ Errors", e), row("⚠️ Warnings", w), row("\U0001F4A1 Suggestions", s),
        F.lit("\n---\n*Posted from the [Code Review Dashboard]("), F.col("pr_url"), F.lit(")*"),
    )
    return reviews.select(
        "review_uuid",
        "pr_number",
        F.when(failed, "failure").otherwise("success").alias("state"),
        F.substring(description, 1, description_chars).alias("description"),
        F.lit(product).alias("context"),
        comment.alias("comment"),
    )


def review_responses(heads: DataFrame, findings: DataFrame, scores: DataFrame, description_chars: int | None = V.MAX_DESCRIPTION_CHARS) -> DataFrame:
    """The head of each dashboard response. ``heads(pr_id, issue_key, issue_title,
    issue_description, issue_type, pr_title, pr_url)``; PRs without findings have zero counts.
    A response shows the beginning of the issue's description, or all of it without a limit."""
    totals = counts.per_review(findings)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    numbers = ["total", "errors", "warnings", "suggestions", "suppressed_count"]
    joined = heads.join(totals, "pr_id", "left").join(scores, "pr_id", "left")
    rows = joined.select(
        "pr_id", "issue_key", "issue_title",
        (F.substring("issue_description", 1, description_chars) if description_chars else F.col("issue_description")).alias("issue_description"),
        "issue_type", "pr_title", "pr_url", *[zero(c) for c in numbers],
        F.coalesce("score", F.lit(100)).cast("bigint").alias("scope_score"),
    )
    return rows.withColumn("summary", T.review_summary(F.col("errors"), F.col("warnings"), F.col("scope_score")))


def _issue_json() -> Column:
    return F.to_json(
        F.struct(F.col("line_no").alias("line"), "message", "severity", "rule_id", "original_line", "suggested_fix", "suppressed"),
        {"ignoreNullFields": "false"},
    )


def response_files(visible: DataFrame, part_bytes: int = documents.PART_BYTES) -> DataFrame:
    """The files of each response: (pr_id, path, part, start, errors, warnings, suggestions, issues).

    The counts are the whole file's. ``issues`` is JSON, the elements of the file's issues in order of emission with
    commas between; only a file with more than ``part_bytes`` of it has further parts, which follow on directly."""
    per_file = counts.per_file(visible)
    pieces = visible.select("pr_id", "path", *EMISSION_ORDER, _issue_json().alias("text"), F.lit("issues").alias("enters"), F.lit("issues").alias("leaves"))
    parts = documents.in_parts(pieces, ["pr_id", "path"], EMISSION_ORDER, size=part_bytes)
    return parts.join(per_file, ["pr_id", "path"]).withColumnRenamed("text", "issues")


RESPONSE_ORDER = ["section", "path", "kind", *EMISSION_ORDER]


def _piece(section: int, kind: int, text: Column, path: str | None = None, enters: str | None = None, leaves: str | None = None, order: dict | None = None) -> list[Column]:
    """The columns of one piece of a nested response."""
    named = lambda name: F.lit(name).cast("string")
    return [
        "pr_id", F.lit(section).alias("section"), (F.lit("") if path is None else F.col(path)).alias("path"), F.lit(kind).alias("kind"),
        *[(F.col(order[c]) if order and c in order else F.lit(None)).cast("bigint").alias(c) for c in EMISSION_ORDER],
        text.alias("text"), named(enters).alias("enters"), named(leaves).alias("leaves"),
    ]


def response_pieces(
    responses: DataFrame, visible: DataFrame, scoped: DataFrame, missing: DataFrame, areas=(), pr_number: Column | None = None
) -> DataFrame:
    """The full nested response of each PR as ordered pieces of JSON (``RESPONSE_ORDER``).

    ``responses``: ``review_responses``, with ``review_uuid``. ``scoped(pr_id, file_idx, path, in_scope)``: files of these
    PRs, listed in diff order. ``missing(pr_id, keyword, message)``: listed in the order of ``areas``, the scope map's
    keywords. Files are in order of path with their issues in order of emission.
    """
    head = F.struct(
        "review_uuid", "issue_key", "issue_title", "issue_description", "issue_type", (F.col("pr_id") if pr_number is None else pr_number).alias("pr_number"),
        "pr_title", "pr_url", F.col("total").alias("total_issues"), "errors", "warnings", "suggestions", "suppressed_count",
    )
    tail = F.concat(
        F.lit('],"score":'), F.col("scope_score").cast("string"), F.lit('},"summary":'), documents.json_text(F.col("summary")), F.lit("}"),
    )
    frame = [
        _piece(0, 0, F.concat(F.lit("{"), documents.json_fields(head), F.lit(',"files":['))),
        _piece(2, 0, F.lit('],"scope_validation":{"in_scope":[')),
        _piece(4, 0, F.lit('],"out_of_scope":[')),
        _piece(6, 0, F.lit('],"missing":[')),
        _piece(8, 0, tail),
    ]
    per_file = counts.per_file(visible)
    opened = F.concat(F.lit('{"file_path":'), documents.json_text(F.col("path")), F.lit(',"issues":['))
    numbers = F.struct(*[F.col(f"{s}s").alias(f"{s}_count") for s in V.SEVERITIES])
    closed = F.concat(F.lit("],"), documents.json_fields(numbers), F.lit("}"))
    files = [_piece(1, 0, opened, "path", enters="files"), _piece(1, 2, closed, "path", leaves="files")]
    emitted = {c: c for c in EMISSION_ORDER}
    issue = _piece(1, 1, _issue_json(), "path", "issues", "issues", emitted)
    place = F.array_position(F.array(*[F.lit(c) for c in areas]).cast("array<string>"), F.col("keyword"))
    path_text = documents.json_text(F.col("path"))

    def inlined(rows: DataFrame, choices: list[list[Column]]) -> DataFrame:
        """Several pieces of each row, in one pass over the rows."""
        return rows.select("pr_id", F.inline(F.array(*[F.struct(*c[1:]) for c in choices])))

    inside = scoped.filter("in_scope").select(*_piece(3, 0, path_text, None, "paths", "paths", {"file_idx": "file_idx"}))
    outside = scoped.filter("not in_scope").select(*_piece(5, 0, path_text, None, "paths", "paths", {"file_idx": "file_idx"}))
    gaps = missing.withColumn("_place", place).select(
        *_piece(7, 0, documents.json_text(F.col("message")), None, "paths", "paths", {"file_idx": "_place"})
    )
    parts = [inlined(responses, frame), inlined(per_file, files), visible.select(*issue), inside, outside, gaps]
    wanted = responses.select("pr_id")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.join(wanted, "pr_id", "left_semi"))
    return out


def response_documents(responses, visible, scoped, missing, areas=(), part_bytes: int = documents.PART_BYTES) -> DataFrame:
    """``(pr_id, part, start, text)``: the full nested response of each PR as JSON, in parts."""
    return documents.in_parts(response_pieces(responses, visible, scoped, missing, areas), ["pr_id"], RESPONSE_ORDER, size=part_bytes)


def html_pieces(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """HTML reports as ordered pieces ``(pr_id, section, path, kind, line_no, rule_ord, …, html)``.

    ``reviews``: pr_id, issue_key, pr_title, errors, warnings, suggestions, scope_score, summary,
    created_at. ``issues``: findings with ``suppressed``. A report is its pieces in order; each
    finding is a piece of its own, so nothing is collected here.
    """
    esc = T.html_escape
    score = F.col("scope_score")
    (hi, hi_colour), (mid, mid_colour), (_, low_colour) = V.SCOPE_COLOURS
    colour = F.when(score >= hi, hi_colour).when(score >= mid, mid_colour).otherwise(low_colour)
    stamp = F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    total = F.col("errors") + F.col("warnings") + F.col("suggestions")
    card = lambda label, n: F.format_string(f'<li class="{label}">{label}: <b>%d</b></li>', n)
    order = [F.lit(None).cast("bigint").alias(c) for c in ("line_no", "rule_ord", "phase", "emit_pos", "emit_sub")]

    def piece(section, kind, html, path=""):
        return F.struct(
            F.lit(section).alias("section"), (F.lit(path) if isinstance(path, str) else path).alias("path"),
            F.lit(kind).alias("kind"), *order, html.alias("html"),
        )

    shown = issues.filter(~F.col("suppressed"))
    per_file = shown.groupBy("pr_id", "path").agg(*counts.severity_counts())
    with_files = per_file.select("pr_id").distinct().withColumn("any", F.lit(True))
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>Code Review Report — '),
        esc(F.col("issue_key")),
        F.lit("</title></head><body>\n<h1>Code Review Report</h1>\n<p>"),
        esc(F.col("issue_key")), F.lit(" &mdash; PR #"), F.col("pr_id").cast("string"), F.lit(": "),
        esc(F.col("pr_title")), F.lit(" &mdash; Generated "), stamp, F.lit("</p>\n<ul>"),
        card("Total", total), card("Errors", F.col("errors")), card("Warnings", F.col("warnings")),
        card("Suggestions", F.col("suggestions")),
        F.lit('</ul>\n<p>Scope Score: <b style="color:'), colour, F.lit('">'), score.cast("string"),
        F.lit("%</b></p>\n<p>"), esc(F.col("summary")), F.lit("</p>\n<h2>File Analysis</h2>\n"),
        F.when(F.col("any").isNull(), "<p>No issues found.</p>\n").otherwise(""),
    )
    foot = F.concat(F.lit(f"<p>{BOT_NAME} &mdash; "), stamp, F.lit("</p>\n</body></html>\n"))
    frame = reviews.join(with_files, "pr_id", "left").select(
        "pr_id", F.inline(F.array(piece(0, 0, head), piece(2, 0, foot)))
    )
    opened = F.concat(
        F.lit("<h3>"), esc(T.report_path(F.col("path"))), F.lit(" <small>"),
        F.format_string("%dE / %dW / %dS", "errors", "warnings", "suggestions"), F.lit("</small></h3>\n<table>\n"),
    )
    tables = per_file.select(
        "pr_id", F.inline(F.array(piece(1, 0, opened, F.col("path")), piece(1, 2, F.lit("</table>\n"), F.col("path"))))
    )
    row = F.concat(
        F.lit('<tr><td style="color:'), T.lookup(F.col("severity"), V.SEVERITY_COLOURS, V.DEFAULT_COLOUR), F.lit('">'),
        F.col("severity"), F.lit("</td><td>L"), F.col("line_no").cast("string"), F.lit("</td><td>"),
        esc(F.col("rule_id")), F.lit("</td><td>"), esc(F.col("message")), F.lit("</td></tr>\n"),
    )
    rows = shown.select(
        "pr_id", F.lit(1).alias("section"), "path", F.lit(1).alias("kind"),
        *[F.col(c).cast("bigint").alias(c) for c in ("line_no", "rule_ord", "phase", "emit_pos", "emit_sub")],
        row.alias("html"),
    )
    return frame.unionByName(tables).unionByName(rows)


PIECE_ORDER = ["section", "path", "kind", "line_no", "rule_ord", "phase", "emit_pos", "emit_sub"]


def html_documents(pieces: DataFrame, part_bytes: int = documents.PART_BYTES) -> DataFrame:
    """``(pr_id, part, start, html)``: every report in parts of bounded size."""
    return documents.in_parts(pieces, ["pr_id"], PIECE_ORDER, "html", part_bytes).withColumnRenamed("text", "html")
