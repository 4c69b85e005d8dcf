"""Security, quality and TypeScript line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import Hit, line_rule


def _cs_file(ln):
    return F.endswith(ln.path, F.lit(".cs"))  # exact case, unlike the suffix lists


@line_rule("SEC-005", "SecurityRules", 1)
def security_todo(ln):
    return Hit(
        ln.slash_comment & ln.has_ci("todo", "hack", "fixme", "xxx") & T.matches(ln.text, V.SECURITY_TODO, True)
    )


@line_rule("SEC-002", "SecurityRules", 2)
def credential(ln):
    gate = ln.has_ci("password", "pwd", "secret", "apikey", "api_key", "connectionstring", "conn_str")
    return Hit(~ln.slash_comment & gate & T.matches(ln.text, V.CREDENTIAL, True))


@line_rule("SEC-003", "SecurityRules", 3)
def sql_concatenation(ln):
    found = T.matches(ln.text, V.SQL_CALL_CONCAT, True) | T.matches(ln.text, V.SQL_TEXT_CONCAT, True)
    return Hit(_cs_file(ln) & ~ln.slash_comment & ln.has("+") & found)


@line_rule("GEN-002", "GeneralQualityRules", 1, by_line=True)
def console_write(ln):
    exempt = F.contains(ln.path, F.lit("Tests")) | F.contains(ln.path, F.lit("Process/"))
    return Hit(_cs_file(ln) & ln.has("Console.Write") & T.matches(ln.text, V.CONSOLE_WRITE) & ~exempt)


@line_rule("GEN-003", "GeneralQualityRules", 2, by_line=True)
def debugger(ln):
    return Hit(_cs_file(ln) & ln.has("Debugger", "#if") & T.matches(ln.text, V.DEBUGGER))


@line_rule("GEN-005", "GeneralQualityRules", 4, by_line=True)
def empty_catch(ln):
    return Hit(_cs_file(ln) & ln.has("catch") & T.matches(ln.text, V.EMPTY_CATCH))


@line_rule("SEC-006", "SensitiveDataLoggingRules")
def sensitive_logging(ln):
    words = ln.has_ci("password", "passwd", "token", "secret", "apikey", "api_key", "credential", "ssn", "creditcard")
    return Hit(
        ~ln.slash_comment
        & ln.has_ci("log", "console")
        & words
        & T.matches(ln.text, V.LOG_CALL, True)
        & T.matches(ln.text, V.SENSITIVE_WORD, True)
    )


def ts_comment(ln):
    return F.startswith(ln.text, F.lit("//")) | F.startswith(ln.text, F.lit("*"))


@line_rule("TS-001", "TypeScriptConsoleLogRule")
def console_log(ln):
    hit = (
        ~ts_comment(ln)
        & ln.has("console.")
        & T.matches(ln.content, V.CONSOLE_CALL)
        & ~T.matches(ln.path, V.TEST_PATH, True)
    )
    return Hit(hit, (), T.rstrip(ln.content))


@line_rule("TS-003", "TypeScriptAnyTypeRule")
def any_type(ln):
    return Hit(~ln.slash_comment & ln.has("any") & T.matches(ln.content, V.ANY_TYPE), (), T.rstrip(ln.content))
