"""SQL line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import Hit, line_rule
from .rules_cs import too_long


def is_code(ln):
    return ~F.startswith(ln.text, F.lit("--"))


def without_strings_and_comments(c):
    return T.replace_all(T.replace_all(c, "'[^']*'", "''"), "--.*$", "")


@line_rule("SQL-FMT-001", "SqlFormattingRules", 1, by_line=True)
def long_line(ln):
    hit, width = too_long(ln)
    return Hit(is_code(ln) & hit, (width,))


@line_rule("SQL-FMT-006", "SqlFormattingRules", 3, by_line=True)
def keyword_casing(ln):
    code = without_strings_and_comments(ln.text)
    word = None
    for keyword in V.TWO_WORD_KEYWORDS:
        seen = T.extract(code, rf"\b{keyword}\b", 0, True)
        wrong = ln.has_ci(keyword) & (seen != "") & (seen != keyword.upper())
        word = F.when(wrong, seen) if word is None else word.when(wrong, seen)
    one = T.extract(code, r"\b(" + "|".join(V.ONE_WORD_KEYWORDS) + r")\b", 1)
    word = word.otherwise(one)
    return Hit(is_code(ln) & (ln.text != F.upper(ln.text)) & (word != ""), (word, F.upper(word)))


@line_rule("SQL-FMT-003", "SqlFormattingRules", 4, by_line=True)
def left_outer_join(ln):
    hit = is_code(ln) & ln.has_ci("outer") & T.matches(ln.text, V.LEFT_OUTER_JOIN, True)
    return Hit(hit, (), ln.content, T.replace_all(ln.content, V.LEFT_OUTER_JOIN, "LEFT JOIN", True))


@line_rule("SQL-FMT-004", "SqlFormattingRules", 5, by_line=True)
def dbo_brackets(ln):
    table = T.extract(ln.text, V.DBO_BRACKET, 1)
    creates = F.startswith(F.upper(ln.text), F.lit("CREATE"))
    return Hit(is_code(ln) & ln.has("[dbo].[") & ~creates & (table != ""), (table,))


@line_rule("SQL-FMT-005", "SqlFormattingRules", 6, by_line=True)
def extra_spaces(ln):
    return Hit(is_code(ln) & ln.has("  ") & T.matches(without_strings_and_comments(ln.text), V.EXTRA_SPACES))


@line_rule("SQL-BP-001", "SqlBestPracticeRules", 1)
def at_identity(ln):
    hit = is_code(ln) & ln.has("@@IDENTITY") & T.matches(ln.text, V.AT_IDENTITY)
    return Hit(hit, (), ln.content, T.replace_all(ln.content, V.AT_IDENTITY, "SCOPE_IDENTITY()"))


@line_rule("SQL-BP-002", "SqlBestPracticeRules", 2)
def not_is_null(ln):
    name = T.extract(ln.text, V.NOT_IS_NULL, 1, True)
    hit = is_code(ln) & ln.has_ci("null") & (name != "")
    return Hit(hit, (name,), ln.content, T.replace_all(ln.content, V.NOT_IS_NULL, "$1 IS NOT NULL", True))


@line_rule("SQL-BP-003", "SqlBestPracticeRules", 3)
def update_alias(ln):
    alias = T.extract(ln.text, V.UPDATE_ALIAS, 1, True)
    return Hit(is_code(ln) & ln.has_ci("update") & (alias != "") & (alias == F.lower(alias)))


@line_rule("SQL-BP-004", "SqlBestPracticeRules", 4)
def if_parentheses(ln):
    return Hit(is_code(ln) & ln.has_ci("if") & T.matches(ln.text, V.IF_WITHOUT_PAREN, True))


@line_rule("SQL-PERF-001", "SqlPerformanceRules", 1)
def select_star(ln):
    return Hit(is_code(ln) & ln.has("*") & ln.has_ci("select") & T.matches(ln.text, V.SELECT_STAR, True))


@line_rule("SQL-PERF-002", "SqlPerformanceRules", 2)
def cursor(ln):
    return Hit(is_code(ln) & ln.has_ci("cursor") & T.matches(ln.text, V.DECLARE_CURSOR, True))
