"""C# line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import Hit, line_rule


@line_rule("CS-NAME-001", "CSharpNamingRules", 1)
def lower_case_id(ln):
    word = T.extract(ln.content, V.ID_WORD, 0)
    fixed = F.concat(F.substring(word, F.lit(1), F.char_length(word) - 2), F.lit("ID"))
    hit = ~ln.slash_comment & ln.has("Id") & (word != "") & ~word.isin(V.ID_WORD_ALLOWED)
    at = F.instr(ln.content, word)
    return Hit(hit, (word, fixed), ln.content, F.overlay(ln.content, fixed, at))


@line_rule("CS-NAME-002", "CSharpNamingRules", 2)
def private_field_underscore(ln):
    name = T.extract(ln.text, V.PRIVATE_FIELD, 1)
    hit = ~ln.slash_comment & ln.has("private") & (name != "") & ~name.isin(V.PRIVATE_FIELD_ALLOWED)
    fix = F.regexp_replace(
        ln.content, F.concat(F.lit(r"(?dU)^((?s:.*?))\b"), name, F.lit(r"\b")), F.concat(F.lit("$1_"), name)
    )
    return Hit(hit, (name,), ln.content, fix)


@line_rule("CS-NAME-003", "CSharpNamingRules", 3)
def hungarian_notation(ln):
    hit = (
        ~ln.slash_comment
        & ln.has("int", "long", "short", "byte", "string", "bool", "double", "float", "decimal")
        & T.matches(ln.text, V.HUNGARIAN)
    )
    name = F.coalesce(*[F.nullif(T.extract(ln.text, V.HUNGARIAN, g), F.lit("")) for g in (1, 2, 3, 4)])
    return Hit(hit, (name,))


@line_rule("CS-NAME-004", "CSharpNamingRules", 4)
def var_for_primitive(ln):
    return Hit(~ln.slash_comment & ln.has("var") & T.matches(ln.text, V.VAR_PRIMITIVE))


@line_rule("CS-NAME-005", "CSharpNamingRules", 5)
def public_field(ln):
    name = T.extract(ln.text, V.PUBLIC_FIELD_HEAD + V.PUBLIC_FIELD_EXCLUDED + V.PUBLIC_FIELD_TAIL, 1)
    return Hit(~ln.slash_comment & ln.has("public", "protected") & (name != ""), (name,))


def too_long(ln):
    width = T.expanded_length(ln.content)
    can_be = F.octet_length(ln.content) * V.TAB_WIDTH > V.MAX_LINE_WIDTH
    return can_be & (width > V.MAX_LINE_WIDTH), width


@line_rule("CS-STYLE-001", "CSharpStyleRules", 1, by_line=True)
def long_line(ln):
    hit, width = too_long(ln)
    return Hit(~ln.slash_comment & hit, (width,))


@line_rule("CS-STYLE-002", "CSharpStyleRules", 2, by_line=True)
def this_qualifier(ln):
    hit = ~ln.slash_comment & ln.has("this.") & T.matches(ln.text, V.THIS_QUALIFIER)
    return Hit(hit, (), ln.content, T.replace_all(ln.content, V.THIS_QUALIFIER, ""))


@line_rule("CS-STYLE-004", "CSharpStyleRules", 4, by_line=True)
def entity_framework(ln):
    gate = ln.has_ci(
        "dbcontext", "dbset", ".include(", ".theninclude(", "entityframework", ".savechanges", ".tolistasync"
    )
    return Hit(~ln.slash_comment & gate & T.matches(ln.text, V.ENTITY_FRAMEWORK, True))


@line_rule("CS-ASYNC-001", "CSharpAsyncRules", 1)
def async_void(ln):
    name = T.extract(ln.text, V.ASYNC_VOID, 1)
    hit = ~ln.slash_comment & ln.has("async") & (name != "") & ~F.startswith(name, F.lit("On"))
    return Hit(hit, (), ln.content, T.replace_first(ln.content, V.ASYNC_VOID_WORDS, "async Task"))


@line_rule("CS-ASYNC-002", "CSharpAsyncRules", 2)
def async_suffix(ln):
    name = T.extract(ln.text, V.ASYNC_METHOD, 1)
    hit = (
        ~ln.slash_comment
        & ln.has("async")
        & (name != "")
        & (name != "Main")
        & ~F.startswith(name, F.lit("On"))
        & ~F.endswith(name, F.lit("Async"))
        & ~F.endswith(name, F.lit("AsyncCore"))
    )
    return Hit(hit, (name,))


def _spelled(number: float) -> str:
    """Every way to write an allowed number as a literal."""
    sign = "-" if number < 0 else ""
    return rf"{sign}0*{int(abs(number))}(?:\.0+)?"


# A number that is neither within [-1, 1] nor allowed: one expression, so that the
# test stays in generated code.
_SMALL = [r"-?0+(?:\.\d+)?", r"-?0*1(?:\.0+)?"]
_SKIPPED = "|".join(_SMALL + [_spelled(n) for n in V.ALLOWED_NUMBERS if abs(n) > 1])
MAGIC_NUMBER = rf"(?<![.\w])(?!(?:{_SKIPPED})(?![\w.])){V.NUMBER.split(')', 1)[1]}"


@line_rule("CS-MAGIC-001", "CSharpMagicNumberRules")
def magic_number(ln):
    code = T.replace_all(ln.text, '"[^"]*"', '""')
    code = T.replace_all(code, "'[^']*'", "''")
    code = T.replace_all(code, "//.*$", "")
    excluded = (
        T.matches(ln.text, V.CONST_WORD)
        | T.matches(ln.text, V.ENUM_VALUE)
        | T.matches(ln.text, V.ATTRIBUTE)
        | T.matches(ln.text, V.ARRAY_SIZE)
    )
    return Hit(~ln.slash_comment & T.matches(ln.text, r"\d") & ~excluded & T.matches(code, MAGIC_NUMBER))
