"""SQL statements that compute the registered queries on the same tables, for checking.

Each statement is assembled from named common table expressions; they follow
the definitions of the operators, not their Spark plans.
"""

from __future__ import annotations

import re

from ..functions import values as V
from ..operators.registry import GROUP_ORDER, SUB_STEP
from ..sources import corpus


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, *parts: str) -> str:
    pieces = re.split(r"\{(\d)\}", template)
    out = [f"CAST({parts[int(p)]} AS VARCHAR)" if i % 2 else lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return "(" + " || ".join(out) + ")"


def m(col: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({col}, {lit(pattern)}{', ' + lit(flags) if flags else ''})"


def x(col: str, pattern: str, group: int, flags: str = "") -> str:
    return f"regexp_extract({col}, {lit(pattern)}, {group}{', ' + lit(flags) if flags else ''})"


def rep(col: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({col}, {lit(pattern)}, {lit(by)}, {lit(flags)})"


def case(col: str, table: dict, default) -> str:
    q = lambda v: lit(v) if isinstance(v, str) else str(v)
    return f"(CASE {col} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END)"


def strip(col: str) -> str:
    return f"trim({col}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def rstrip(col: str) -> str:
    return f"rtrim({col}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def suffix(col: str, suffixes) -> str:
    return m(f"lower({col})", "(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


REVIEWABLE = (
    f"(NOT {suffix('path', V.EXCLUDED_SUFFIXES)} AND NOT "
    + m("lower(path)", "|".join(re.escape(s) for s in V.EXCLUDED_FOLDERS))
    + f" AND {suffix('path', V.REVIEWABLE_SUFFIXES)})"
)
SEVERITY_RANK = case("severity", {s: i for i, s in enumerate(V.SEVERITIES)}, 3)
# Rule classes with the kinds of files they look at, as SQL rows.
RULE_GROUP_ROWS = ", ".join(
    "('%s', '%s', '%s', %d)"
    % (
        name,
        ", ".join(k for k, tests in (("C#", {".cs"}), ("SQL", {".sql"}), ("JS/TS", {".js", ".ts"})) if tests & set(suffixes)) or "General",
        summary.replace("'", "''"),
        i,
    )
    for i, (name, suffixes, summary) in enumerate(V.RULE_GROUPS, 1)
)
EMISSION = "file_idx, rule_ord, phase, emit_pos, emit_sub"
ICON = case("severity", V.SEVERITY_ICONS, V.DEFAULT_ICON)
FORMATTED = f"({ICON} || ' **' || upper(severity) || '** (`' || rule_id || '`): ' || message)"


def _corpus() -> dict[str, tuple[tuple, str]]:
    texts, paths = "", ""
    t = "(l_partkey * 31 + l_linenumber * 7 + l_suppkey)"
    for i, (group, pattern) in enumerate(corpus.PATHS):
        lines = corpus.templates(group)
        listed = ", ".join(lit(s) for s in lines)
        texts += f" WHEN {i} THEN ([{listed}])[{t} % {len(lines)} + 1]"
        paths += f" WHEN {i} THEN replace(replace({lit(pattern)}, '{{pr}}', CAST(pr_id AS VARCHAR)), '{{slot}}', CAST(slot AS VARCHAR))"
    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_linestatus"
    return {
        "order_lines": (
            (),
            f"""SELECT CASE WHEN n <= {corpus.LINES_PER_PR} THEN 0 ELSE
                  (l_orderkey * 31 + l_partkey * 7 + l_suppkey * 3 + l_linenumber) % CAST(ceil(n / {corpus.LINES_PER_PR}.0) AS BIGINT) END
                * {corpus.PART_STEP} + cust AS pr_id, *
              FROM (SELECT o_custkey AS cust, o_orderdate, lineitem.*, count(*) OVER (PARTITION BY o_custkey) AS n
                    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
        ),
        "diffs": (
            ("order_lines",),
            f"""SELECT pr_id, string_agg(header || hunk || line, chr(10) ORDER BY slot, rn, line) AS diff_text
              FROM (SELECT pr_id, slot, rn,
                      CASE WHEN rn = 1 THEN 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10)
                        || '+++ b/' || path || chr(10) ELSE '' END AS header,
                      CASE WHEN (rn - 1) % {corpus.FIRST_HUNK_LINES} = 0 THEN '@@ -' || (1 + (rn - 1) // {corpus.FIRST_HUNK_LINES} * 40)
                        || ',12 +' || (1 + (rn - 1) // {corpus.FIRST_HUNK_LINES} * 40) || ',12 @@' || chr(10) ELSE '' END AS hunk,
                      CASE WHEN l_returnflag <> 'R' THEN '+' WHEN l_linestatus = 'F' THEN '-' ELSE ' ' END
                        || replace(text, '{{k}}', CAST(l_partkey AS VARCHAR)) AS line
                    FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, slot ORDER BY {order}) AS rn,
                            CASE (pr_id + slot) % 6{paths} END AS path, CASE (pr_id + slot) % 6{texts} END AS text
                          FROM (SELECT *, CASE WHEN cust % 5 = 0 THEN 0 ELSE l_suppkey % 4 END AS slot FROM order_lines)))
              GROUP BY pr_id""",
        ),
        "prs": (
            ("order_lines",),
            """SELECT pr_id, cust,
                CASE WHEN cust % 2 = 0 THEN 'DL-' || cust || ' update' ELSE 'Update' END AS title,
                CASE WHEN cust % 4 = 1 THEN 'feature/dl-' || cust || '-x' ELSE 'work' END AS branch,
                CASE WHEN cust % 4 = 3 THEN 'Fixes DL-' || cust || '.' END AS body,
                md5(CAST(pr_id AS VARCHAR)) AS head_sha, 'https://example.com/pull/' || pr_id AS html_url,
                cust % 7 = 0 AS draft, (['opened', 'synchronize', 'reopened', 'closed'])[cust % 4 + 1] AS action,
                min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
              FROM order_lines GROUP BY pr_id, cust""",
        ),
        "issues": (
            (),
            f"""SELECT 'DL-' || c_custkey AS key, c_custkey AS cust, 'Work for ' || c_name AS title,
                'Change ' || ([{', '.join(lit(k) for k in V.SCOPE_MAP)}])[c_custkey % {len(V.SCOPE_MAP)} + 1] || ' for ' || c_mktsegment AS description,
                (['Bug', 'Task', 'Story', 'Epic', 'Chore'])[c_custkey % 5 + 1] AS type,
                ([{', '.join(lit(k) for k in V.MY_ISSUE_STATUSES + ['Done'])}])[c_custkey % 7 + 1] AS status,
                (['Low', 'Medium', 'High'])[c_nationkey % 3 + 1] AS priority,
                'user-' || c_nationkey AS assignee,
                TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS updated
              FROM customer""",
        ),
        "history": (
            (),
            """SELECT event_id AS id, md5(CAST(event_id AS VARCHAR)) AS review_uuid, 'DL-' || user_id AS issue_key,
                event_id AS pr_number, 'Review ' || event_type AS pr_title, 'https://example.com/pull/' || event_id AS pr_url,
                event_id % 4 AS errors, event_id % 7 AS warnings, event_id % 3 AS suggestions,
                event_id % 4 + event_id % 7 + event_id % 3 AS total,
                CAST(floor(value) AS BIGINT) % 101 AS scope_score, ts AS created_at FROM events""",
        ),
    }


def _diff() -> dict[str, tuple[tuple, str]]:
    w = "OVER (PARTITION BY pr_id ORDER BY pos)"
    marker = "kind IN ('G', 'F', 'N')"
    return {
        "diff_lines": (
            ("diffs",),
            """SELECT pr_id, pos, line, CASE WHEN starts_with(line, 'diff --git') THEN 'G' WHEN starts_with(line, '+++ b/') THEN 'F'
                 WHEN starts_with(line, '+++ /dev/null') THEN 'N' WHEN starts_with(line, '@@') THEN 'H' WHEN starts_with(line, '+') THEN 'A'
                 WHEN starts_with(line, ' ') THEN 'C' WHEN starts_with(line, '-') THEN 'D' ELSE 'O' END AS kind
               FROM (SELECT pr_id, unnest(string_split(diff_text, chr(10))) AS line,
                       generate_subscripts(string_split(diff_text, chr(10)), 1) - 1 AS pos FROM diffs)""",
        ),
        "diff_marks": (
            ("diff_lines",),
            f"""SELECT *, sum(CASE WHEN {marker} THEN 1 ELSE 0 END) {w} AS file_idx,
                 last_value(CASE WHEN {marker} THEN kind END IGNORE NULLS) {w} AS opened,
                 last_value(CASE WHEN kind = 'F' THEN substr(line, 7) END IGNORE NULLS) {w} AS path,
                 first_value(CASE WHEN {marker} THEN kind END IGNORE NULLS) OVER (PARTITION BY pr_id ORDER BY pos
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closing,
                 CASE WHEN kind = 'H' THEN coalesce(TRY_CAST(trim(split_part(split_part(split_part(line, '+', 2), '@@', 1), ',', 1)) AS BIGINT) - 1, 0) END AS base
               FROM diff_lines""",
        ),
        "diff_counts": (
            ("diff_marks",),
            f"""SELECT *, sum(CASE WHEN opened = 'F' AND kind IN ('A', 'C') THEN 1 ELSE 0 END) {w} AS lines_seen,
                 sum(CASE WHEN opened = 'F' AND kind IN ('H', 'A', 'C', 'D') THEN 1 ELSE 0 END) {w} AS places_seen FROM diff_marks""",
        ),
        "diff_numbers": (
            ("diff_counts",),
            f"""SELECT *, coalesce(last_value(CASE WHEN opened = 'F' AND kind = 'H' THEN base - lines_seen END IGNORE NULLS) {w}, 0) + lines_seen AS line_no,
                 coalesce(last_value(CASE WHEN {marker} THEN -places_seen END IGNORE NULLS) {w}, 0) + places_seen AS diff_position FROM diff_counts""",
        ),
        "all_lines": (
            ("diff_numbers",),
            """SELECT pr_id, CAST(file_idx AS BIGINT) AS file_idx, path, CAST(line_no AS BIGINT) AS line_no, substr(line, 2) AS content,
                 CAST(diff_position AS BIGINT) AS diff_position, CAST(first_pos AS BIGINT) AS ord
               FROM (SELECT *, min(pos) OVER g AS first_pos, max(pos) OVER g AS last_pos FROM diff_numbers
                     WHERE kind = 'A' AND opened = 'F' AND coalesce(closing, 'G') = 'G'
                     WINDOW g AS (PARTITION BY pr_id, file_idx, line_no)) WHERE pos = last_pos""",
        ),
        "lines": (
            ("all_lines",),
            f"""SELECT *, {strip('content')} AS text, CASE WHEN contains(path, '.') THEN split_part(lower(path), '.', -1) ELSE '' END AS ext
               FROM all_lines WHERE {REVIEWABLE}""",
        ),
    }


SLASH = "(starts_with(text, '//') OR starts_with(text, '/*') OR starts_with(text, '*'))"
DASH = "starts_with(text, '--')"
TS_COMMENT = "(starts_with(text, '//') OR starts_with(text, '*'))"
WIDTH = (
    "(length(content) - (len(string_split(content, chr(9))) - 1) + coalesce(list_sum(list_transform("
    "string_split(content, chr(9))[1:-2], lambda p: 4 - length(p) % 4)), 0))"
)
SQL_CODE = rep(rep("text", "'[^']*'", "''"), "--.*$", "")


def _first_word(word: str, fixed: str) -> str:
    at = f"strpos(content, {word})"
    return f"(substr(content, 1, {at} - 1) || {fixed} || substr(content, {at} + length({word})))"


def _rules() -> dict[str, dict]:
    """rule id → group, branch, test, message parts, original, fix, sort column."""
    cs, sql, ts = "ext = 'cs'", "ext = 'sql'", "ext IN ('ts', 'tsx', 'js', 'jsx')"
    sec = "ext IN ('cs', 'sql', 'config', 'json', 'xml', 'yml', 'yaml')"
    cs_file = "ends_with(path, '.cs')"
    idw = x("content", V.ID_WORD, 0)
    id_fixed = f"(substr({idw}, 1, length({idw}) - 2) || 'ID')"
    field = x("text", V.PRIVATE_FIELD, 1)
    hung = "coalesce(" + ", ".join(f"nullif({x('text', V.HUNGARIAN, g)}, '')" for g in (1, 2, 3, 4)) + ")"
    pub_pattern = V.PUBLIC_FIELD_HEAD + r"((?:readonly\s+)?\w+(?:<[^>]+>)?)\s+([A-Z]\w*)\s*;"
    pub_type, pub_name = x("text", pub_pattern, 1), x("text", pub_pattern, 2)
    not_types = "^" + V.PUBLIC_FIELD_EXCLUDED.replace("(?!", "(?:", 1)
    void_name, task_name = x("text", V.ASYNC_VOID, 1), x("text", V.ASYNC_METHOD, 1)
    code = rep(rep(rep("text", '"[^"]*"', '""'), "'[^']*'", "''"), "//.*$", "")
    magic = (
        f"(len(list_filter(regexp_extract_all({code}, '[\\w.]+'), lambda n: regexp_full_match(n, '\\d+(\\.\\d+)?') "
        f"AND TRY_CAST(n AS DOUBLE) > 1 AND TRY_CAST(n AS DOUBLE) NOT IN (2, 100))) > 0 "
        f"OR {m(code, '(^|[^\\w.])-(2|100)(\\.0+)?([^\\w.]|$)')})"
    )
    dbo = x("text", V.DBO_BRACKET, 1)
    two = " ".join(
        f"WHEN {x(SQL_CODE, f'\\b{k}\\b', 0, 'i')} NOT IN ('', {lit(k.upper())}) THEN {x(SQL_CODE, f'\\b{k}\\b', 0, 'i')}"
        for k in V.TWO_WORD_KEYWORDS
    )
    keyword = f"(CASE {two} ELSE {x(SQL_CODE, '\\b(' + '|'.join(V.ONE_WORD_KEYWORDS) + ')\\b', 1)} END)"
    nnull = x("text", V.NOT_IS_NULL, 1, "i")
    out = {}

    def add(rid, group, branch, files, test, parts=(), original=None, fix=None, by_line=False):
        out[rid] = dict(group=group, branch=branch, test=f"{files} AND {test}", parts=parts, original=original, fix=fix, by_line=by_line)

    add("CS-NAME-001", "CSharpNamingRules", 1, cs, f"NOT {SLASH} AND {idw} <> '' AND {idw} NOT IN ({', '.join(map(lit, V.ID_WORD_ALLOWED))})", (idw, id_fixed), "content", _first_word(idw, id_fixed))
    add("CS-NAME-002", "CSharpNamingRules", 2, cs, f"NOT {SLASH} AND {field} <> '' AND {field} NOT IN ({', '.join(map(lit, V.PRIVATE_FIELD_ALLOWED))})", (field,), "content", f"regexp_replace(content, '\\b' || {field} || '\\b', '_' || {field})")
    add("CS-NAME-003", "CSharpNamingRules", 3, cs, f"NOT {SLASH} AND {m('text', V.HUNGARIAN)}", (hung,))
    add("CS-NAME-004", "CSharpNamingRules", 4, cs, f"NOT {SLASH} AND {m('text', V.VAR_PRIMITIVE)}")
    add("CS-NAME-005", "CSharpNamingRules", 5, cs, f"NOT {SLASH} AND {pub_name} <> '' AND NOT {m(pub_type, not_types)}", (pub_name,))
    add("CS-STYLE-001", "CSharpStyleRules", 1, cs, f"NOT {SLASH} AND {WIDTH} > 138", (f"CAST({WIDTH} AS BIGINT)",), by_line=True)
    add("CS-STYLE-002", "CSharpStyleRules", 2, cs, f"NOT {SLASH} AND {m(rep('text', r'\bthis\.(GetType|Equals|ReferenceEquals|MemberwiseClone)', ''), r'\bthis\.')}", (), "content", rep("content", r"\bthis\.", ""), True)
    add("CS-STYLE-004", "CSharpStyleRules", 4, cs, f"NOT {SLASH} AND {m('text', V.ENTITY_FRAMEWORK, 'i')}", by_line=True)
    add("CS-ASYNC-001", "CSharpAsyncRules", 1, cs, f"NOT {SLASH} AND {void_name} <> '' AND NOT starts_with({void_name}, 'On')", (), "content", f"regexp_replace(content, {lit(V.ASYNC_VOID_WORDS)}, 'async Task')")
    add("CS-ASYNC-002", "CSharpAsyncRules", 2, cs, f"NOT {SLASH} AND {task_name} NOT IN ('', 'Main') AND NOT starts_with({task_name}, 'On') AND NOT ends_with({task_name}, 'Async') AND NOT ends_with({task_name}, 'AsyncCore')", (task_name,))
    add("CS-MAGIC-001", "CSharpMagicNumberRules", 1, cs, f"NOT {SLASH} AND NOT {m('text', V.CONST_WORD)} AND NOT {m('text', V.ENUM_VALUE)} AND NOT {m('text', V.ATTRIBUTE)} AND NOT {m('text', V.ARRAY_SIZE)} AND {magic}")
    add("SQL-FMT-001", "SqlFormattingRules", 1, sql, f"NOT {DASH} AND {WIDTH} > 138", (f"CAST({WIDTH} AS BIGINT)",), by_line=True)
    add("SQL-FMT-006", "SqlFormattingRules", 3, sql, f"NOT {DASH} AND {keyword} <> ''", (keyword, f"upper({keyword})"), by_line=True)
    add("SQL-FMT-003", "SqlFormattingRules", 4, sql, f"NOT {DASH} AND {m('text', V.LEFT_OUTER_JOIN, 'i')}", (), "content", rep("content", V.LEFT_OUTER_JOIN, "LEFT JOIN", "gi"), True)
    add("SQL-FMT-004", "SqlFormattingRules", 5, sql, f"NOT {DASH} AND {dbo} <> '' AND NOT starts_with(upper(text), 'CREATE')", (dbo,), by_line=True)
    add("SQL-FMT-005", "SqlFormattingRules", 6, sql, f"NOT {DASH} AND {m(SQL_CODE, r'\S  +\s*\S')}", by_line=True)
    add("SQL-BP-001", "SqlBestPracticeRules", 1, sql, f"NOT {DASH} AND {m('text', V.AT_IDENTITY)}", (), "content", rep("content", V.AT_IDENTITY, "SCOPE_IDENTITY()"))
    add("SQL-BP-002", "SqlBestPracticeRules", 2, sql, f"NOT {DASH} AND {nnull} <> ''", (nnull,), "content", rep("content", V.NOT_IS_NULL, r"\1 IS NOT NULL", "gi"))
    add("SQL-BP-003", "SqlBestPracticeRules", 3, sql, f"NOT {DASH} AND {m('text', r'^\s*(?i:UPDATE)\s+[a-z]{1,5}\s+(?i:SET)\b')}")
    add("SQL-BP-004", "SqlBestPracticeRules", 4, sql, f"NOT {DASH} AND {m('text', r'^\s*IF\s+@', 'i')}")
    add("SQL-PERF-001", "SqlPerformanceRules", 1, sql, f"NOT {DASH} AND {m('text', V.SELECT_STAR, 'i')}")
    add("SQL-PERF-002", "SqlPerformanceRules", 2, sql, f"NOT {DASH} AND {m('text', V.DECLARE_CURSOR, 'i')}")
    add("SEC-005", "SecurityRules", 1, sec, f"{SLASH} AND {m('text', V.SECURITY_TODO, 'i')}")
    add("SEC-002", "SecurityRules", 2, sec, f"NOT {SLASH} AND {m('text', V.CREDENTIAL, 'i')}")
    add("SEC-003", "SecurityRules", 3, cs_file, f"NOT {SLASH} AND ({m('text', V.SQL_CALL_CONCAT, 'i')} OR {m('text', V.SQL_TEXT_CONCAT, 'i')})")
    add("GEN-002", "GeneralQualityRules", 1, cs_file, f"{m('text', V.CONSOLE_WRITE)} AND NOT contains(path, 'Tests') AND NOT contains(path, 'Process/')", by_line=True)
    add("GEN-003", "GeneralQualityRules", 2, cs_file, m("text", V.DEBUGGER), by_line=True)
    add("GEN-005", "GeneralQualityRules", 4, cs_file, m("text", V.EMPTY_CATCH), by_line=True)
    add("SEC-006", "SensitiveDataLoggingRules", 1, "ext IN ('cs', 'ts', 'js')", f"NOT {SLASH} AND {m('text', V.LOG_CALL, 'i')} AND {m('text', V.SENSITIVE_WORD, 'i')}")
    add("TS-001", "TypeScriptConsoleLogRule", 1, ts, f"NOT {TS_COMMENT} AND {m('content', V.CONSOLE_CALL)} AND NOT {m('path', V.TEST_PATH, 'i')}", (), rstrip("content"))
    add("TS-003", "TypeScriptAnyTypeRule", 1, "ext IN ('ts', 'tsx')", f"NOT {SLASH} AND {m('content', V.ANY_TYPE)}", (), rstrip("content"))
    return out


def _select(rid, group, source, line="line_no", phase=1, pos="ord", sub="0", parts=(), original="NULL", fix="NULL", template=None):
    severity, text = V.RULES[rid]
    return (
        f"SELECT pr_id, file_idx, path, CAST({line} AS BIGINT) AS line_no, '{rid}' AS rule_id, '{severity}' AS severity, "
        f"{fill(template or text, *parts)} AS message, CAST({original} AS VARCHAR) AS original_line, CAST({fix} AS VARCHAR) AS suggested_fix, "
        f"{GROUP_ORDER[group]} AS rule_ord, {phase} AS phase, CAST({pos} AS BIGINT) AS emit_pos, CAST({sub} AS BIGINT) AS emit_sub FROM {source}"
    )


def rule_selects() -> dict[str, str]:
    out = {}
    for rid, r in _rules().items():
        out[rid] = _select(
            rid, r["group"], f"lines WHERE {r['test']}", pos="line_no" if r["by_line"] else "ord",
            sub=str(r["branch"] * SUB_STEP), parts=r["parts"], original=r["original"] or "NULL", fix=r["fix"] or "NULL",
        )
    out["SEC-001"] = _select(
        "SEC-001", "SecurityRules",
        f"(SELECT pr_id, file_idx, path, min(line_no) AS first FROM lines WHERE ext IN ('cs', 'sql', 'config', 'json', 'xml', 'yml', 'yaml') AND {m('path', V.SENSITIVE_FILE, 'i')} GROUP BY ALL)",
        line="first", phase=0, pos="0",
    )
    out["GEN-001"] = _select(
        "GEN-001", "GeneralQualityRules",
        "(SELECT pr_id, file_idx, path, min(line_no) AS first, count(*) AS n FROM lines WHERE ext IN ('cs', 'sql') GROUP BY pr_id, file_idx, path HAVING count(*) > 50)",
        line="first", phase=0, pos="0", parts=("n",),
    )
    out["SQL-BP-005"] = _select(
        "SQL-BP-005", "SqlPerformanceRules",
        f"(SELECT pr_id, file_idx, path, min(CASE WHEN {m('content', V.BEGIN_TRAN, 'i')} THEN line_no END) AS first FROM lines WHERE ext = 'sql' "
        f"GROUP BY pr_id, file_idx, path HAVING first IS NOT NULL AND NOT bool_or({m('content', V.ROLLBACK, 'i')}))",
        line="first", phase=0, pos="0",
    )
    w = "(PARTITION BY pr_id, file_idx ORDER BY line_no)"
    out["CS-STYLE-003"] = _select(
        "CS-STYLE-003", "CSharpStyleRules",
        f"(SELECT *, lead(text) OVER {w} AS next_text, lead(line_no) OVER {w} AS next_no FROM lines WHERE ext = 'cs') "
        f"WHERE {m('text', V.BARE_CONTROL_FLOW)} AND next_no = line_no + 1 AND next_text <> '' AND NOT starts_with(next_text, '{{') AND NOT starts_with(next_text, '//')",
        pos="line_no", sub=str(3 * SUB_STEP),
    )
    out["SQL-FMT-002"] = _select(
        "SQL-FMT-002", "SqlFormattingRules",
        f"(SELECT *, lag(text) OVER {w} AS before FROM lines WHERE ext = 'sql') WHERE text = '' AND before = ''",
        pos="line_no", sub=str(2 * SUB_STEP),
    )
    runs = (
        "(SELECT pr_id, file_idx, path, min(line_no) AS first, count(*) AS n, max(after) AS after_run, bool_or(after IS NULL) AS at_end FROM "
        f"(SELECT *, sum(CASE WHEN dead THEN 0 ELSE 1 END) OVER {w} AS island FROM "
        f"(SELECT *, {m('text', V.COMMENTED_CODE)} AS dead, lead(line_no) OVER {w} AS after FROM lines WHERE ends_with(path, '.cs'))) "
        "WHERE dead GROUP BY pr_id, file_idx, path, island HAVING count(*) >= 3)"
    )
    out["GEN-004"] = (
        _select("GEN-004", "GeneralQualityRules", f"{runs} WHERE NOT at_end", line="first", pos="after_run", sub=str(3 * SUB_STEP), parts=("n",))
        + " UNION ALL "
        + _select("GEN-004", "GeneralQualityRules", f"{runs} WHERE at_end", line="first", phase=2, pos="0", parts=("n",), template=V.GEN_004_AT_FILE_END)
    )
    ts = "ext IN ('ts', 'tsx', 'js', 'jsx')"
    out["TS-002"] = _select(
        "TS-002", "TypeScriptAsyncWithoutTryCatchRule",
        f"(SELECT l.* FROM lines l JOIN (SELECT pr_id, file_idx, string_agg(content, chr(10) ORDER BY ord) AS whole FROM lines WHERE {ts} GROUP BY ALL) f "
        f"USING (pr_id, file_idx) WHERE NOT {m('whole', V.TRY_BLOCK)}) WHERE {m('content', V.AWAIT)} AND NOT {TS_COMMENT}",
        sub=str(SUB_STEP), original=rstrip("content"),
    )
    out["TS-004"] = _select(
        "TS-004", "TypeScriptUnusedImportRule",
        f"(SELECT i.*, coalesce(n, 0) AS uses FROM (SELECT *, trim(split_part(trim(item), ' as ', 1)) AS name FROM "
        f"(SELECT *, unnest(string_split({x('text', V.NAMED_IMPORT, 1)}, ',')) AS item, generate_subscripts(string_split({x('text', V.NAMED_IMPORT, 1)}, ','), 1) - 1 AS nth "
        f"FROM lines WHERE {ts} AND {x('text', V.NAMED_IMPORT, 1)} <> '')) i LEFT JOIN "
        f"(SELECT pr_id, file_idx, name, count(*) AS n FROM (SELECT pr_id, file_idx, unnest(regexp_extract_all(content, '\\w+')) AS name FROM lines WHERE {ts}) GROUP BY ALL) "
        "USING (pr_id, file_idx, name) WHERE name <> '') WHERE uses <= 1",
        sub=f"{SUB_STEP} + nth", parts=("name",), original=rstrip("content"),
    )
    return out


def _findings() -> dict[str, tuple[tuple, str]]:
    return {
        "found": (("lines",), " UNION ALL ".join(rule_selects().values())),
        "last_files": (("lines",), "SELECT pr_id, path, max(file_idx) AS file_idx FROM lines GROUP BY ALL"),
        "directives": (
            ("lines", "last_files"),
            f"""SELECT DISTINCT pr_id, path, rule_key, line_no + step AS line_no FROM
                 (SELECT pr_id, path, line_no, upper({x('content', V.IGNORE_DIRECTIVE, 1, 'i')}) AS rule_key FROM lines SEMI JOIN last_files USING (pr_id, path, file_idx)),
                 (VALUES (0), (1)) s(step) WHERE rule_key <> ''""",
        ),
        "findings": (
            ("found", "directives"),
            """SELECT f.*, d.rule_key IS NOT NULL AS suppressed FROM found f LEFT JOIN directives d
               ON f.pr_id = d.pr_id AND f.path = d.path AND f.line_no = d.line_no AND upper(f.rule_id) = d.rule_key""",
        ),
        "seen": (("findings",), "SELECT * FROM findings WHERE NOT suppressed"),
        "deduped": (
            ("found",),
            f"SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY pr_id, path, line_no, rule_id ORDER BY {EMISSION}) = 1",
        ),
        "top": (
            ("deduped",),
            f"SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY {SEVERITY_RANK}, {EMISSION}) AS rank FROM deduped QUALIFY rank <= {V.MAX_REVIEW_COMMENTS}",
        ),
    }


def parts(pieces: str, key: str, order: str, size: int, text: str = "text") -> dict[str, tuple[tuple, str]]:
    """CTEs that cut the documents of ``pieces`` (key, order, text, enters, leaves) into numbered parts: ``parts``."""
    by = ", ".join(f"{c.strip()} NULLS FIRST" for c in f"{order}, text".split(","))
    return {
        "joined": (
            (pieces,),
            f"SELECT *, CASE WHEN enters = lag(leaves) OVER (PARTITION BY {key} ORDER BY {by}) THEN ',' ELSE '' END || text AS t FROM {pieces}",
        ),
        "placed_pieces": (
            ("joined",),
            f"SELECT *, CAST(coalesce(sum(strlen(t)) OVER (PARTITION BY {key} ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "
            "AS place FROM joined",
        ),
        "parts": (
            ("placed_pieces",),
            f"SELECT {key}, place // {size} AS part, min(place) AS start, string_agg(t, '' ORDER BY {by}) AS {text} FROM placed_pieces GROUP BY {key}, place // {size}",
        ),
    }


CTES: dict[str, tuple[tuple, str]] = {**_corpus(), **_diff(), **_findings()}


def statement(body: str, *needs: str, extra: dict | None = None) -> str:
    """``body`` behind the common table expressions it needs."""
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(name):
        for dep in known[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({known[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body}" if parts else body
