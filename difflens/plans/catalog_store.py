"""Registered queries on documents in parts, on the review store through its files, and on local reviews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import analytics, report
from ..sources import corpus, staging, store
from . import oracle as O
from . import presets
from .catalog import query, seen, staged_findings
from .catalog_reports import (
    AREAS, DASHBOARD, SCANNED, SUMMARY, UUID, _counted, _heads, _responses, _sources, _store, scope_files, scope_missing,
)

#: Small parts, so that the given tables have documents of several.
PART_BYTES = 2048

# ----------------------------------------------------------------- documents
def _json(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


ISSUE_JSON = _json(
    "{'line': line_no, 'message': message, 'severity': severity, 'rule_id': rule_id, 'original_line': original_line, "
    "'suggested_fix': suggested_fix, 'suppressed': suppressed}"
)
NO_PLACE = "NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT"
FILE_PARTS = {
    "issue_pieces": (("seen",), f"SELECT pr_id, path, {O.EMISSION}, {ISSUE_JSON} AS text, 'issues' AS enters, 'issues' AS leaves FROM seen"),
    **O.parts("issue_pieces", "pr_id, path", O.EMISSION, PART_BYTES, "issues"),
}


@query(
    "review_response_files",
    f"SELECT parts.*, errors, warnings, suggestions FROM parts JOIN (SELECT pr_id, path, {_counted()} FROM seen GROUP BY ALL) USING (pr_id, path)",
    "parts",
    "seen",
    extra=FILE_PARTS,
)
def review_response_files(spark, sf_dir):
    return report.response_files(seen(spark, sf_dir), PART_BYTES)


AREA_PLACE = " ".join(f"WHEN {O.lit(k)} THEN {i + 1}" for i, k in enumerate(AREAS))
EXPORT = {
    **DASHBOARD,
    "gaps": (
        ("mentioned", "scope_paths"),
        "SELECT pr_id, keyword, 'No changes found in ' || fragment || ' (issue mentions ''' || keyword || ''')' AS message FROM mentioned m "
        "WHERE nth = 0 AND NOT EXISTS (SELECT 1 FROM mentioned f JOIN scope_paths p ON p.pr_id = f.pr_id AND contains(lower(path), lower(f.fragment)) "
        "WHERE f.pr_id = m.pr_id AND f.keyword = m.keyword)",
    ),
    "response_pieces": (
        ("responses", "seen", "scoped", "gaps"),
        f"""SELECT pr_id, 0 AS section, '' AS path, 0 AS kind, NULL::BIGINT AS file_idx, NULL::BIGINT AS rule_ord, NULL::BIGINT AS phase,
              NULL::BIGINT AS emit_pos, NULL::BIGINT AS emit_sub, CAST(to_json({{'review_uuid': {UUID}, 'issue_key': issue_key, 'issue_title': issue_title,
                'issue_description': issue_description, 'issue_type': issue_type, 'pr_number': pr_id, 'pr_title': pr_title, 'pr_url': pr_url,
                'total_issues': total, 'errors': errors, 'warnings': warnings, 'suggestions': suggestions, 'suppressed_count': suppressed_count}}) AS VARCHAR)[:-2]
              || ',"files":[' AS text, NULL::VARCHAR AS enters, NULL::VARCHAR AS leaves FROM responses
            UNION ALL SELECT pr_id, 2, '', 0, {NO_PLACE}, '],"scope_validation":{{"in_scope":[', NULL, NULL FROM responses
            UNION ALL SELECT pr_id, 4, '', 0, {NO_PLACE}, '],"out_of_scope":[', NULL, NULL FROM responses
            UNION ALL SELECT pr_id, 6, '', 0, {NO_PLACE}, '],"missing":[', NULL, NULL FROM responses
            UNION ALL SELECT pr_id, 8, '', 0, {NO_PLACE}, '],"score":' || scope_score || '}},"summary":' || {_json('summary')} || '}}', NULL, NULL FROM responses
            UNION ALL SELECT pr_id, 1, path, kind, {NO_PLACE}, text, CASE WHEN kind = 0 THEN 'files' END, CASE WHEN kind = 2 THEN 'files' END FROM
              (SELECT pr_id, path, unnest([0, 2]) AS kind, unnest(['{{"file_path":' || {_json('path')} || ',"issues":[',
                 '],"error_count":' || errors || ',"warning_count":' || warnings || ',"suggestion_count":' || suggestions || '}}']) AS text
               FROM (SELECT pr_id, path, {_counted()} FROM seen GROUP BY ALL))
            UNION ALL SELECT pr_id, 1, path, 1, {O.EMISSION}, {ISSUE_JSON}, 'issues', 'issues' FROM seen
            UNION ALL SELECT pr_id, CASE WHEN in_scope THEN 3 ELSE 5 END, '', 0, file_idx, NULL, NULL, NULL, NULL, {_json('path')}, 'paths', 'paths' FROM scoped
            UNION ALL SELECT pr_id, 7, '', 0, CASE keyword {AREA_PLACE} END, NULL, NULL, NULL, NULL, {_json('message')}, 'paths', 'paths' FROM gaps""",
    ),
    "wanted_pieces": (("response_pieces", "responses"), "SELECT * FROM response_pieces SEMI JOIN responses USING (pr_id)"),
    **O.parts("wanted_pieces", "pr_id", f"section, path, kind, {O.EMISSION}", PART_BYTES),
}


@query("json_export", "SELECT * FROM parts", "parts", extra=EXPORT)
def json_export(spark, sf_dir):
    """The full nested response of every review as JSON: files with their issues, scope lists, score and summary."""
    reviews = _store(spark, sf_dir)["reviews"].select(F.col("pr_number").alias("pr_id"), "review_uuid")
    responses = staging.stage(_responses(spark, sf_dir).join(reviews, "pr_id"), "responses")
    scoped = staging.stage(scope_files(spark, sf_dir), "scoped")
    return report.response_documents(responses, seen(spark, sf_dir), scoped, scope_missing(spark, sf_dir), list(AREAS), PART_BYTES)


def _html_pieces() -> str:
    esc = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    (hi, hic), (mid, midc), (_, low) = V.SCOPE_COLOURS
    card = lambda label, n: f"'<li class=\"{label}\">{label}: <b>' || {n} || '</b></li>'"
    short = "array_to_string(string_split(path, '/')[-3:], '/')"
    row = (
        f"'<tr><td style=\"color:' || {O.case('severity', V.SEVERITY_COLOURS, V.DEFAULT_COLOUR)} || '\">' || severity || '</td><td>L' || line_no || "
        f"'</td><td>' || {esc('rule_id')} || '</td><td>' || {esc('message')} || '</td></tr>' || chr(10)"
    )
    stamp = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
    return f"""SELECT r.pr_id, 0 AS section, '' AS path, 0 AS kind, NULL::BIGINT AS line_no, NULL::BIGINT AS rule_ord, NULL::BIGINT AS phase,
        NULL::BIGINT AS emit_pos, NULL::BIGINT AS emit_sub, '<!DOCTYPE html>' || chr(10) || '<html lang="en"><head><meta charset="UTF-8"><title>Code Review Report — ' || issue_key
        || '</title></head><body>' || chr(10) || '<h1>Code Review Report</h1>' || chr(10) || '<p>' || issue_key || ' &mdash; PR #' || r.pr_id || ': ' || {esc('pr_title')}
        || ' &mdash; Generated ' || {stamp} || ' UTC</p>' || chr(10) || '<ul>'
        || {card('Total', '(errors + warnings + suggestions)')} || {card('Errors', 'errors')} || {card('Warnings', 'warnings')} || {card('Suggestions', 'suggestions')}
        || '</ul>' || chr(10) || '<p>Scope Score: <b style="color:' || CASE WHEN scope_score >= {hi} THEN '{hic}' WHEN scope_score >= {mid} THEN '{midc}' ELSE '{low}' END
        || '">' || scope_score || '%</b></p>' || chr(10) || '<p>' || {esc('summary')} || '</p>' || chr(10) || '<h2>File Analysis</h2>' || chr(10)
        || CASE WHEN r.pr_id IN (SELECT pr_id FROM seen) THEN '' ELSE '<p>No issues found.</p>' || chr(10) END AS text, NULL::VARCHAR AS enters, NULL::VARCHAR AS leaves
      FROM responses r
      UNION ALL SELECT pr_id, 2, '', 0, {NO_PLACE}, '<p>{report.BOT_NAME} &mdash; ' || {stamp} || ' UTC</p>' || chr(10) || '</body></html>' || chr(10), NULL, NULL FROM responses
      UNION ALL SELECT pr_id, 1, path, 0, {NO_PLACE}, '<h3>' || {esc(short)} || ' <small>' || errors || 'E / ' || warnings || 'W / ' || suggestions || 'S</small></h3>'
          || chr(10) || '<table>' || chr(10), NULL, NULL FROM (SELECT pr_id, path, {_counted()} FROM seen GROUP BY ALL)
      UNION ALL SELECT DISTINCT pr_id, 1, path, 2, {NO_PLACE}, '</table>' || chr(10), NULL, NULL FROM seen
      UNION ALL SELECT pr_id, 1, path, 1, line_no, rule_ord, phase, emit_pos, emit_sub, {row}, NULL, NULL FROM seen"""


HTML = {
    **DASHBOARD,
    "html_pieces": (("responses", "seen"), _html_pieces()),
    "wanted_pieces": (("html_pieces", "responses"), "SELECT * FROM html_pieces SEMI JOIN responses USING (pr_id)"),
    **O.parts("wanted_pieces", "pr_id", "section, path, kind, line_no, rule_ord, phase, emit_pos, emit_sub", PART_BYTES, "html"),
}


@query("html_report", "SELECT * FROM parts", "parts", extra=HTML)
def html_report(spark, sf_dir):
    heads = _heads(spark, sf_dir).select("pr_id", "created_at")
    pieces = report.html_pieces(_responses(spark, sf_dir).join(heads, "pr_id"), staged_findings(spark, sf_dir))
    return report.html_documents(pieces, PART_BYTES)


# ----------------------------------------------------------------- the store, through its files
_STORES: dict[tuple, str] = {}


def _written_store(spark, sf_dir) -> str:
    """A store written in two batches, one of them twice, beside an attempt that was never committed."""
    full = (spark.sparkContext.applicationId, sf_dir)
    if full not in _STORES:
        base = f"{staging.folder(spark)}/store-{uuid.uuid4().hex[:8]}"
        tables = _store(spark, sf_dir)
        tables |= {name: staging.stage(tables[name], name) for name in ("review_files", "review_issues")}
        ids = {"reviews": "id", "review_files": "review_id", "review_issues": "review_id"}

        def half(rest):
            return {name: df.filter(F.pmod(ids[name], F.lit(2)) == rest) for name, df in tables.items()}

        store.write_attempt(base, half(0), "lost", buckets=2)
        for batch, rest in (("first", 0), ("second", 1), ("first", 0)):
            store.write(base, half(rest), batch, buckets=2)
        _STORES[full] = base
    return _STORES[full]


STORED_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}' AND NOT suppressed) OVER g AS {s}_count" for s in V.SEVERITIES)
STORED_ISSUES = (
    f"SELECT {UUID} AS review_uuid, f.path AS file_path, error_count, warning_count, suggestion_count, line_no AS line_number, rule_id, severity, "
    f"message, suppressed FROM responses JOIN (SELECT *, {STORED_COUNTS} FROM findings WINDOW g AS (PARTITION BY pr_id, path)) f USING (pr_id)"
)
SHOWN = [
    "review_uuid", "file_path", "error_count", "warning_count", "suggestion_count", "line_number", "rule_id", "severity", "message", "suppressed",
]


@query(
    "store_history",
    f"SELECT {', '.join(c for c in store.HISTORY_COLUMNS if c not in ('review_uuid', 'pr_number'))}, pr_id AS pr_number, {UUID} AS review_uuid FROM responses "
    f"ORDER BY created_at DESC, review_uuid DESC LIMIT {V.HISTORY_ROWS}",
    "responses",
    extra=DASHBOARD,
)
def store_history(spark, sf_dir):
    return store.history(store.read(spark, _written_store(spark, sf_dir))["reviews"], tie="review_uuid")


@query("store_detail", STORED_ISSUES, "responses", "findings", extra=DASHBOARD)
def store_detail(spark, sf_dir):
    return store.detail(store.read(spark, _written_store(spark, sf_dir))).select(*SHOWN)


@query("store_lookup", f"SELECT * FROM ({STORED_ISSUES}) WHERE review_uuid = (SELECT max({UUID}) FROM responses)", "responses", "findings", extra=DASHBOARD)
def store_lookup(spark, sf_dir):
    """One review by its uuid."""
    tables = store.read(spark, _written_store(spark, sf_dir))
    wanted = tables["reviews"].agg(F.max("review_uuid")).first()[0]
    return store.detail(tables, wanted).select(*SHOWN)


@query(
    "store_analytics",
    """SELECT 'top_violations' AS what, rule_id AS name, CAST(count(*) AS DOUBLE) AS value FROM findings SEMI JOIN responses USING (pr_id)
          WHERE NOT suppressed AND rule_id <> '' GROUP BY rule_id QUALIFY row_number() OVER (ORDER BY count(*) DESC, rule_id) <= 10
        UNION ALL SELECT 'worst_files', path, CAST(count(*) FILTER (WHERE NOT suppressed) AS DOUBLE) AS n FROM findings SEMI JOIN responses USING (pr_id)
          GROUP BY path QUALIFY row_number() OVER (ORDER BY n DESC, path) <= 10
        UNION ALL SELECT 'score_trend', CAST(CAST(created_at AS DATE) AS VARCHAR), round(avg(scope_score), 1) FROM responses
          WHERE created_at >= (SELECT max(CAST(created_at AS DATE)) FROM responses) - 30 GROUP BY CAST(created_at AS DATE)
        UNION ALL SELECT 'total_reviews', '', CAST(count(*) AS DOUBLE) FROM responses
        UNION ALL SELECT 'avg_issues_per_review', '', coalesce(round(avg(total), 1), 0.0) FROM responses""",
    "responses",
    "findings",
    extra=DASHBOARD,
)
def store_analytics(spark, sf_dir):
    """The statistics of all stored reviews, as of the last one's day."""
    tables = store.read(spark, _written_store(spark, sf_dir))
    as_of = tables["reviews"].agg(F.max(F.to_date("created_at"))).first()[0]
    stats = analytics.review_stats(tables["reviews"]).withColumn("none", F.lit(""))

    def named(what, df, name, value):
        return df.select(F.lit(what).alias("what"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))

    out = named("top_violations", analytics.top_violations(tables["review_issues"]), "rule_id", "count")
    for part in (
        named("worst_files", analytics.worst_files(tables["review_files"]), "file_path", "total_issues"),
        named("score_trend", analytics.score_trend(tables["reviews"], str(as_of)), "day", "avg_score"),
        named("total_reviews", stats, "none", "total_reviews"),
        named("avg_issues_per_review", stats, "none", "avg_issues_per_review"),
    ):
        out = out.unionByName(part)
    return out


# --------------------------------------------------------------- local reviews
#: SQL finds word borders by ASCII letters only, so the folders' texts have other letters as x.
NOT_ASCII = r"[^\x00-\x7F]"
LOCAL_SUMMARY = SUMMARY.replace("scope_score", "100")
LOCAL = {
    "scanned": ((), SCANNED["scanned"][1].replace("string_split_regex(text,", f"string_split_regex(regexp_replace(text, '{NOT_ASCII}', 'x', 'g'),")),
    "diff_reviewed": O.CTES["lines"],
    "scanned_only": (("scanned", "diffs"), "SELECT pr_id * 3 AS pr_id, path, content, line_no FROM scanned WHERE pr_id * 3 NOT IN (SELECT pr_id FROM diffs)"),
    "lines": (
        ("diff_reviewed", "scanned_only"),
        f"""SELECT pr_id, file_idx, path, line_no, content, diff_position, ord, text, ext FROM diff_reviewed
            UNION ALL SELECT pr_id, 1, path, line_no, content, NULL, line_no - 1, {O.strip('content')}, 'sql' FROM scanned_only""",
    ),
    "folders": (("diffs",), "SELECT pr_id FROM diffs UNION SELECT doc_id * 3 FROM documents"),
    "folder_files": (
        ("diffs", "diff_reviewed", "folders"),
        """SELECT pr_id, 'git diff HEAD' AS source, count(DISTINCT file_idx) AS n FROM diff_reviewed GROUP BY pr_id
           UNION ALL SELECT doc_id * 3, 'full scan', 1 FROM documents WHERE doc_id * 3 NOT IN (SELECT pr_id FROM diffs)""",
    ),
    "local_totals": (
        ("folder_files", "findings"),
        f"""SELECT f.pr_id, any_value(source) AS source, any_value(n) AS n, count(rule_id) FILTER (WHERE NOT suppressed) AS total,
              {_counted('NOT suppressed')}, count(rule_id) FILTER (WHERE suppressed) AS suppressed_count
            FROM folder_files f LEFT JOIN findings USING (pr_id) GROUP BY f.pr_id""",
    ),
}


@query(
    "local_review_totals",
    f"""SELECT pr_id, '{V.LOCAL_KEY}' AS issue_key, 'repo-' || pr_id AS issue_title, 'Source: ' || source || ' · ' || n || ' file(s) analyzed' AS issue_description,
        '{V.LOCAL_TYPE}' AS issue_type, total, errors, warnings, suggestions, suppressed_count, 100::BIGINT AS scope_score, {LOCAL_SUMMARY} AS summary,
        'Local: repo-' || pr_id AS stored_title, 0::BIGINT AS stored_number, errors + warnings + suggestions AS stored_total FROM local_totals""",
    "local_totals",
    extra=LOCAL,
)
def local_review_totals(spark, sf_dir):
    """Folders reviewed by their diff or in full, from the asked-for folders to their responses and stored reviews."""
    diffs = corpus.diffs(spark, sf_dir)
    sources = _sources(spark, sf_dir, 3).withColumn("text", F.regexp_replace("text", NOT_ASCII, "x"))
    ids = diffs.select("pr_id").union(sources.select("pr_id")).distinct()
    folders = ids.select("pr_id", F.concat(F.lit("repo-"), F.col("pr_id").cast("string")).alias("folder_name"), F.lit("2024-01-31").cast("timestamp").alias("created_at"))
    done = presets.local_review(diffs, sources, folders)
    stored = done["reviews"].select(
        "review_uuid", F.col("pr_title").alias("stored_title"), F.col("pr_number").alias("stored_number"), F.col("total").alias("stored_total")
    )
    return done["responses"].drop("pr_title", "pr_url").join(stored, "review_uuid").drop("review_uuid")
