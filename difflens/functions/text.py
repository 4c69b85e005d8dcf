"""String helpers shared by all operators, written as JVM-side Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

# Every character that counts as whitespace in the texts we review.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def java(pattern: str, ignore_case: bool = False) -> str:
    """Adapt a pattern to java.util.regex with Unicode classes and ``\\n`` as the only line end."""
    out = (
        pattern.replace(r"\s", r"[\s\x1c-\x1f]")
        .replace(r"\w", r"[\p{L}\p{N}_]")
        .replace(r"\d", r"\p{Nd}")
    )
    return f"(?{'iu' if ignore_case else ''}dU){out}"


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.rlike(c, F.lit(java(pattern, ignore_case)))


def extract(c: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
    """First match's group, ``''`` when there is none."""
    return F.regexp_extract(c, java(pattern, ignore_case), group)


def replace_all(c: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, java(pattern, ignore_case), by)


def replace_first(c: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    """Replace the first match only; ``pattern`` must not contain groups."""
    flags = "iu" if ignore_case else ""
    body = java(pattern).split(")", 1)[1]
    return F.regexp_replace(c, f"(?{flags}dU)^((?s:.*?)){body}((?s:.*))$", f"$1{by}$2")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def expanded_length(c: Column, tab: int = V.TAB_WIDTH) -> Column:
    """Length after expanding tabs.

    Behind a tab the column is a multiple of the tab width, so a piece of n characters
    and its tab take the whole widths in n, plus one. A carriage return starts over.
    ``\\G`` and the possessive quantifiers keep this linear on very long lines."""
    piece = rf"\G((?:[^\t\r]*+\r)*+(?:[^\t\r]{{{tab}}})*+)[^\t\r]{{0,{tab - 1}}}+\t"
    expanded = F.regexp_replace(c, piece, "$1" + " " * tab)
    return F.when(F.contains(c, F.lit("\t")), F.char_length(expanded)).otherwise(F.char_length(c))


def fill(template: str, *parts: Column) -> Column:
    """Concatenate a ``{0}``-style template with columns."""
    pieces = re.split(r"\{(\d)\}", template)
    cols = [parts[int(p)].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*cols) if len(cols) > 1 else cols[0]


def lookup(c: Column, table: dict, default) -> Column:
    """CASE over a small fixed table."""
    out = None
    for key, value in table.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(default)


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def inline_code(c: Column) -> Column:
    """Escaped text with `back-ticked` parts as ``<code>``; quotes stay as they are in element text."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\xa0", "&nbsp;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.regexp_replace(c, "`([^`]+)`", "<code>$1</code>")


def _slashes(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))


def shorten_path(path: Column, parts: int = 3) -> Column:
    """Last ``parts`` components behind ``.../``; shorter paths unchanged."""
    return F.when(_slashes(path) >= parts, F.concat(F.lit(".../"), F.substring_index(path, "/", -parts))).otherwise(path)


def chart_label(path: Column) -> Column:
    return shorten_path(path, 2)


def report_path(path: Column) -> Column:
    return F.substring_index(path, "/", -3)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(V.SEVERITIES)}, len(V.SEVERITIES))


def format_message(severity: Column, rule_id: Column, message: Column) -> Column:
    icon = lookup(severity, V.SEVERITY_ICONS, V.DEFAULT_ICON)
    return F.concat(icon, F.lit(" **"), F.upper(severity), F.lit("** (`"), rule_id, F.lit("`): "), message)


def plural(n: Column, word: str) -> Column:
    """``3 errors`` / ``1 error``; NULL for zero so that concat_ws skips it."""
    return F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, "s").otherwise("")))


def severity_phrase(errors: Column, warnings: Column, suggestions: Column) -> Column:
    """``2 errors, 1 warning found`` or the clean title."""
    parts = F.concat_ws(", ", plural(errors, "error"), plural(warnings, "warning"), plural(suggestions, "suggestion"))
    return F.when(parts == "", V.CLEAN_TITLE).otherwise(F.concat(parts, F.lit(" found")))


def issue_type_icon(issue_type: Column) -> Column:
    return lookup(issue_type, V.ISSUE_TYPE_ICONS, V.DEFAULT_ISSUE_ICON)


def review_summary(errors: Column, warnings: Column, scope_score: Column) -> Column:
    found = F.when((errors == 0) & (warnings == 0), V.SUMMARY_CLEAN)
    return F.concat_ws(
        " ",
        found,
        F.when(errors > 0, fill(V.SUMMARY_ERRORS, errors)),
        F.when(warnings > 0, fill(V.SUMMARY_WARNINGS, warnings)),
        F.when(scope_score == 100, V.SUMMARY_IN_SCOPE)
        .when(scope_score >= 75, V.SUMMARY_MOSTLY_IN_SCOPE)
        .otherwise(V.SUMMARY_OUT_OF_SCOPE),
    )
