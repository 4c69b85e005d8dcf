"""Registered queries on findings, issues and stored reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import richtext
from ..functions import text as T
from ..functions import values as V
from ..operators import admission, analytics, counts, files, findings, fixes, linking, report, scope
from ..sources import corpus, landed, staging, store
from ..streaming import reviews
from . import oracle as O
from . import presets
from .catalog import query, ranked, reviewed_lines, seen, staged_findings, staged_lines

AS_OF = "2024-01-31"


def _big(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


def _counted(cond=""):
    extra = f" AND {cond}" if cond else ""
    return ", ".join(f"count(*) FILTER (WHERE severity = '{s}'{extra}) AS {s}s" for s in V.SEVERITIES)


# ------------------------------------------------------------------ counts
@query("file_severity_counts", f"SELECT pr_id, path, {_counted()} FROM seen GROUP BY ALL", "seen")
def file_severity_counts(spark, sf_dir):
    return counts.per_file(seen(spark, sf_dir))


@query("file_counts_all", f"SELECT pr_id, path, {_counted('NOT suppressed')} FROM findings GROUP BY ALL", "findings")
def file_counts_all(spark, sf_dir):
    return counts.per_file_all(staged_findings(spark, sf_dir))


@query(
    "review_totals",
    f"SELECT pr_id, {_counted('NOT suppressed')}, count(*) FILTER (WHERE NOT suppressed) AS total, "
    "count(*) FILTER (WHERE suppressed) AS suppressed_count FROM findings GROUP BY pr_id",
    "findings",
)
def review_totals(spark, sf_dir):
    return counts.per_review(staged_findings(spark, sf_dir))


@query("findings_rollup", "SELECT pr_id, path, count(*) AS issues FROM found GROUP BY ROLLUP (pr_id, path)", "found")
def findings_rollup(spark, sf_dir):
    return counts.rollup_counts(staged_findings(spark, sf_dir))


CATEGORY = O.case("split_part(rule_id, '-', 1)", V.CATEGORY_NAMES, "?").replace("ELSE '?'", "ELSE split_part(rule_id, '-', 1)")


@query(
    "category_counts",
    f"SELECT pr_id, split_part(rule_id, '-', 1) AS category, count(*) AS n, {CATEGORY} AS category_name FROM top GROUP BY ALL",
    "top",
)
def category_counts(spark, sf_dir):
    return counts.per_category(ranked(spark, sf_dir))


BOT_TOTALS = {
    "bot_totals": (
        ("prs", "top"),
        "SELECT pr_id, count(rule_id) AS total, count(*) FILTER (WHERE severity = 'error') AS errors, "
        "count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'suggestion') AS suggestions "
        "FROM (SELECT pr_id FROM prs) LEFT JOIN top USING (pr_id) GROUP BY pr_id",
    )
}


def _bot_totals(spark, sf_dir):
    return counts.per_review_of(corpus.prs(spark, sf_dir), ranked(spark, sf_dir))


@query(
    "review_conclusion",
    "SELECT pr_id, CASE WHEN total = 0 THEN 'success' WHEN errors > 0 THEN 'failure' ELSE 'neutral' END AS conclusion, "
    "CASE WHEN errors > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event, "
    "CASE WHEN errors > 0 THEN 'failure' ELSE 'success' END AS state FROM bot_totals",
    "bot_totals",
    extra=BOT_TOTALS,
)
def review_conclusion(spark, sf_dir):
    return counts.conclusions(_bot_totals(spark, sf_dir))


def _phrase(e="errors", w="warnings", s="suggestions"):
    one = lambda n, word: f"CASE WHEN {n} <> 0 THEN {n} || ' {word}' || CASE WHEN {n} <> 1 THEN 's' ELSE '' END END"
    joined = f"concat_ws(', ', {one(e, 'error')}, {one(w, 'warning')}, {one(s, 'suggestion')})"
    return f"(CASE WHEN {joined} = '' THEN {O.lit(V.CLEAN_TITLE)} ELSE {joined} || ' found' END)"


@query("check_title", f"SELECT pr_id, {_phrase()} AS title FROM bot_totals", "bot_totals", extra=BOT_TOTALS)
def check_title(spark, sf_dir):
    return counts.check_titles(_bot_totals(spark, sf_dir))


@query(
    "review_top5_rules",
    f"""SELECT pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY n DESC, first_seen) AS rank, rule_id, n, least(100, n * 20) AS bar
        FROM (SELECT pr_id, rule_id, count(*) AS n, min(place) AS first_seen FROM
              (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY path, {O.EMISSION}) AS place FROM seen) GROUP BY ALL)
        QUALIFY rank <= 5""",
    "seen",
)
def review_top5_rules(spark, sf_dir):
    return _big(counts.top_rules(seen(spark, sf_dir)), "rank")


@query(
    "files_with_severity",
    "SELECT pr_id, path, concat_ws(',', " + ", ".join(
        f"CASE WHEN bool_or(severity = '{s}') THEN '{s}' END" for s in V.SEVERITIES
    ) + ") AS severities FROM seen GROUP BY pr_id, path HAVING bool_or(severity = 'error')",
    "seen",
)
def files_with_severity(spark, sf_dir):
    return counts.file_severities(findings.with_severity(seen(spark, sf_dir), "error"))


# --------------------------------------------------------------- positions
PLACED = {
    "placed": (
        ("top", "lines", "last_files"),
        "SELECT t.*, l.diff_position FROM top t LEFT JOIN (SELECT pr_id, path, line_no, diff_position FROM lines SEMI JOIN last_files "
        "USING (pr_id, path, file_idx)) l USING (pr_id, path, line_no)",
    )
}


def _placed(spark, sf_dir):
    lines = reviewed_lines(spark, sf_dir)
    return findings.positions(ranked(spark, sf_dir), lines, presets.tasks_for(lines))


@query(
    "inline_vs_unpostable",
    "SELECT pr_id, path, line_no, rule_id, rank, diff_position, diff_position IS NOT NULL AS inline FROM placed",
    "placed",
    extra=PLACED,
)
def inline_vs_unpostable(spark, sf_dir):
    return _big(_placed(spark, sf_dir), "rank").select(
        "pr_id", "path", "line_no", "rule_id", "rank", "diff_position", F.col("diff_position").isNotNull().alias("inline")
    )


@query(
    "inline_comments",
    f"SELECT pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY rank) AS n, path, diff_position AS position, {O.FORMATTED} AS body "
    f"FROM placed WHERE diff_position IS NOT NULL QUALIFY n <= {V.MAX_INLINE_COMMENTS}",
    "placed",
    extra=PLACED,
)
def inline_comments(spark, sf_dir):
    return _big(report.inline_comments(_placed(spark, sf_dir)), "n")


LEVEL = O.case("severity", V.ANNOTATION_LEVELS, "notice")


@query(
    "annotations",
    f"SELECT pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY rank) AS n, path, line_no AS start_line, line_no AS end_line, "
    f"{LEVEL} AS annotation_level, {O.FORMATTED} AS message, rule_id AS title FROM top QUALIFY n <= {V.MAX_INLINE_COMMENTS}",
    "top",
)
def annotations(spark, sf_dir):
    return _big(report.annotations(ranked(spark, sf_dir)), "n")


def _md_row(label, n):
    return f"CASE WHEN {n} > 0 THEN '| {label} | ' || {n} || ' |' END"


MARKDOWN = {
    **BOT_TOTALS,
    **PLACED,
    "categories": (
        ("top",),
        f"SELECT pr_id, string_agg('- **' || name || '**: ' || n || ' issue(s)', chr(10) ORDER BY category) AS lines FROM "
        f"(SELECT pr_id, split_part(rule_id, '-', 1) AS category, {CATEGORY} AS name, count(*) AS n FROM top GROUP BY ALL) GROUP BY pr_id",
    ),
    "summaries": (
        ("bot_totals", "categories", "placed"),
        f"""SELECT b.pr_id, CASE WHEN total = 0 THEN {O.lit(V.CLEAN_BODY)} ELSE concat_ws(chr(10), '## Auto Code Review' || chr(10),
              'Found **' || total || '** issue(s) across the changed files.' || chr(10), '| Severity | Count |', '|----------|-------|',
              {_md_row('Errors', 'errors')}, {_md_row('Warnings', 'warnings')}, {_md_row('Suggestions', 'suggestions')},
              chr(10) || '### By Category' || chr(10), c.lines,
              CASE WHEN unpostable > 0 THEN chr(10) || '*' || unpostable || ' comment(s) could not be posted inline (lines not part of the diff).*' END,
              chr(10) || '---', '*Automated review by {report.BOT_NAME}*') END AS body
            FROM bot_totals b LEFT JOIN categories c USING (pr_id)
            LEFT JOIN (SELECT pr_id, count(*) FILTER (WHERE diff_position IS NULL) AS unpostable FROM placed GROUP BY pr_id) USING (pr_id)""",
    ),
}


@query("review_markdown", "SELECT * FROM summaries", "summaries", extra=MARKDOWN)
def review_markdown(spark, sf_dir):
    return report.markdown_summaries(corpus.prs(spark, sf_dir), _placed(spark, sf_dir))


@query(
    "summary_comments",
    f"""SELECT pr_id, body || chr(10) || chr(10) || '### Details' || chr(10) || chr(10) || details AS body FROM summaries JOIN
        (SELECT pr_id, string_agg('- **' || path || ':' || line_no || '** — ' || {O.FORMATTED} || chr(10), '' ORDER BY rank) AS details
         FROM top GROUP BY pr_id) USING (pr_id)""",
    "summaries",
    "top",
    extra=MARKDOWN,
)
def summary_comments(spark, sf_dir):
    return report.summary_comments(review_markdown(spark, sf_dir), ranked(spark, sf_dir))


@query(
    "review_payloads",
    f"""SELECT p.pr_id, head_sha AS commit_id, s.body, CASE WHEN errors > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event,
        coalesce(n_comments, 0) AS n_comments FROM prs p JOIN summaries s USING (pr_id) JOIN bot_totals USING (pr_id) LEFT JOIN
        (SELECT pr_id, least(count(diff_position), {V.MAX_INLINE_COMMENTS}) AS n_comments FROM placed GROUP BY pr_id) USING (pr_id)""",
    "prs",
    "summaries",
    "bot_totals",
    "placed",
    extra=MARKDOWN,
)
def review_payloads(spark, sf_dir):
    prs = corpus.prs(spark, sf_dir)
    placed = staging.stage(_placed(spark, sf_dir), "bot_findings")
    posted = report.review_payloads(
        prs,
        report.markdown_summaries(prs, placed),
        counts.conclusions(counts.per_review_of(prs, placed)),
        report.inline_comments(placed),
    )
    n = F.json_array_length("comments").cast("bigint")
    return posted.withColumn("n_comments", n).drop("comments")


# ------------------------------------------------------------------- scope
AREAS = scope.scope_map(corpus.DOMAIN)


def _pairs(spark, sf_dir):
    prs = corpus.prs(spark, sf_dir).select("pr_id", "cust")
    return prs.join(corpus.issues_from_customers(spark, sf_dir), "cust").select("pr_id", "title", "description")


MAP_ROWS = ", ".join(
    f"({O.lit(k)}, {O.lit(f)}, {i})" for k, parts in AREAS.items() for i, f in enumerate(parts)
)
SHARED = " OR ".join(f"contains(lower(path), {O.lit(p.lower())})" for p in V.SHARED_FRAGMENTS)
SCOPE = {
    "scope_map": ((), f"SELECT * FROM (VALUES {MAP_ROWS}) t(keyword, fragment, nth)"),
    "pairs": (
        ("prs", "issues"),
        "SELECT pr_id, lower(issues.title || ' ' || description) AS words FROM prs JOIN issues USING (cust)",
    ),
    "mentioned": (
        ("pairs", "scope_map"),
        "SELECT pr_id, keyword, fragment, nth FROM pairs JOIN scope_map ON contains(words, keyword)",
    ),
    "scope_paths": (("all_lines",), "SELECT DISTINCT pr_id, file_idx, path FROM all_lines"),
    "scoped": (
        ("scope_paths", "pairs", "mentioned"),
        f"""SELECT pr_id, file_idx, path, NOT EXISTS (SELECT 1 FROM mentioned m WHERE m.pr_id = p.pr_id)
              OR EXISTS (SELECT 1 FROM mentioned m WHERE m.pr_id = p.pr_id AND contains(lower(p.path), lower(m.fragment))) OR {SHARED} AS in_scope
            FROM scope_paths p WHERE pr_id IN (SELECT pr_id FROM pairs)""",
    ),
    "scores": (
        ("scoped", "pairs"),
        """SELECT pr_id, count(*) FILTER (WHERE in_scope) AS in_scope, count(*) FILTER (WHERE NOT in_scope) AS out_of_scope,
             CASE WHEN count(path) = 0 THEN 100 ELSE CAST(trunc(count(*) FILTER (WHERE in_scope) / count(path) * 100) AS BIGINT) END AS score
           FROM pairs LEFT JOIN scoped USING (pr_id) GROUP BY pr_id""",
    ),
}


@query("scope_files", "SELECT * FROM scoped", "scoped", extra=SCOPE)
def scope_files(spark, sf_dir):
    return scope.files_in_scope(_pairs(spark, sf_dir), scope.changed_files(staged_lines(spark, sf_dir)), AREAS)


@query("scope_score", "SELECT * FROM scores", "scores", extra=SCOPE)
def scope_score(spark, sf_dir):
    return scope.scope_scores(_pairs(spark, sf_dir), scope_files(spark, sf_dir))


@query(
    "scope_missing",
    "SELECT pr_id, keyword, 'No changes found in ' || fragment || ' (issue mentions ''' || keyword || ''')' AS message FROM mentioned m "
    "WHERE nth = 0 AND NOT EXISTS (SELECT 1 FROM mentioned f JOIN scope_paths p ON p.pr_id = f.pr_id AND contains(lower(path), lower(f.fragment)) "
    "WHERE f.pr_id = m.pr_id AND f.keyword = m.keyword)",
    "mentioned",
    "scope_paths",
    extra=SCOPE,
)
def scope_missing(spark, sf_dir):
    return scope.missing_areas(_pairs(spark, sf_dir), scope.changed_files(staged_lines(spark, sf_dir)), AREAS)


# -------------------------------------------------------- issues and links
NEWEST = "row_number() OVER (PARTITION BY key ORDER BY p.created_at DESC, p.pr_id DESC) = 1"


@query(
    "pr_issue_link",
    "SELECT key, p.pr_id FROM issues JOIN prs p ON contains(lower(p.title), lower(key)) OR contains(lower(p.branch), lower(key)) "
    f"OR contains(lower(coalesce(p.body, '')), lower(key)) QUALIFY {NEWEST}",
    "issues",
    "prs",
)
def pr_issue_link(spark, sf_dir):
    return linking.link_prs(corpus.issues_from_customers(spark, sf_dir), corpus.prs(spark, sf_dir))


@query(
    "pr_issue_link_token",
    "SELECT key, p.pr_id FROM issues JOIN (SELECT DISTINCT pr_id, created_at, unnest(regexp_extract_all(lower(concat_ws(' | ', title, branch, body)), "
    f"'[a-z]+-[0-9]+')) AS word FROM prs) p ON word = lower(key) QUALIFY {NEWEST}",
    "issues",
    "prs",
)
def pr_issue_link_token(spark, sf_dir):
    return linking.link_prs(
        corpus.issues_from_customers(spark, sf_dir), corpus.prs(spark, sf_dir), whole_keys=True
    )


@query(
    "my_issues",
    "SELECT key, title, type, status, priority FROM issues WHERE assignee = 'user-7' AND status IN "
    f"({', '.join(O.lit(s) for s in V.MY_ISSUE_STATUSES)}) ORDER BY updated DESC, key LIMIT {V.MY_ISSUES_ROWS}",
    "issues",
)
def my_issues(spark, sf_dir):
    return linking.my_issues(corpus.issues_from_customers(spark, sf_dir), "user-7")


MIXED_KEYS = "CASE cust % 4 WHEN 0 THEN lower(key) WHEN 1 THEN key || 'x' WHEN 2 THEN replace(key, '-', '') ELSE key END"


@query(
    "issue_keys",
    f"SELECT cust, CASE WHEN regexp_matches(given, {O.lit(V.ISSUE_KEY)}) THEN upper(given) END AS key FROM (SELECT cust, {MIXED_KEYS} AS given FROM issues)",
    "issues",
)
def issue_keys(spark, sf_dir):
    given = corpus.issues_from_customers(spark, sf_dir).select("cust", F.expr(MIXED_KEYS).alias("given"))
    return given.select("cust", files.valid_issue_key(F.col("given")).alias("key"))



@query(
    "landed_issues",
    f"""SELECT 'DL-' || c_custkey AS key, c_name AS title,
        CASE c_custkey % 3 WHEN 0 THEN 'Plain ' || c_mktsegment WHEN 1 THEN 'First ' || c_mktsegment || ' second' ELSE '' END AS description,
        CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE 'Bug' END AS type, 'Unknown' AS status,
        CASE WHEN c_custkey % 2 = 0 THEN 'Unassigned' ELSE 'user-' || c_nationkey END AS assignee, 'Medium' AS priority FROM customer""",
)
def landed_issues(spark, sf_dir):
    """Issue documents as a tracker lands them, and the table read from them."""
    k = F.col("c_custkey")

    def node(text):
        return F.struct(F.lit("text").alias("type"), text.alias("text"))

    def para(*nodes):
        return F.struct(F.lit("paragraph").alias("type"), F.array(*nodes).alias("content"))

    tree = F.to_json(
        F.struct(
            F.lit("doc").alias("type"),
            F.array(para(node(F.concat(F.lit("First "), F.col("c_mktsegment")))), para(node(F.lit("second")))).alias("content"),
        )
    )
    plain = F.concat(F.lit('"Plain '), F.col("c_mktsegment"), F.lit('"'))
    doc = F.concat(
        F.lit('{"key":"DL-'), k.cast("string"), F.lit('","fields":{"summary":"'), F.col("c_name"), F.lit('","description":'),
        F.when(k % 3 == 0, plain).when(k % 3 == 1, tree).otherwise("null"),
        F.when(k % 5 == 0, "").otherwise(',"issuetype":{"name":"Bug"}'),
        F.when(k % 2 == 0, ',"assignee":null').otherwise(
            F.concat(F.lit(',"assignee":{"displayName":"user-'), F.col("c_nationkey").cast("string"), F.lit('"}'))
        ),
        F.lit("}}"),
    )
    docs = corpus.table(spark, sf_dir, "customer").select(doc.alias("doc"))
    return landed.parse_issues(docs).drop("updated")


@query(
    "landed_prs",
    "SELECT pr_id, title, branch, coalesce(body, '') AS body, head_sha, html_url, draft, action FROM prs",
    "prs",
)
def landed_prs(spark, sf_dir):
    pr = F.struct(
        F.col("pr_id").alias("number"), "title", F.struct(F.col("branch").alias("ref"), F.col("head_sha").alias("sha")).alias("head"),
        "body", "html_url", "draft",
    )
    docs = corpus.prs(spark, sf_dir).select(
        F.to_json(F.struct("action", pr.alias("pull_request"))).alias("doc")
    )
    return landed.parse_prs(docs).drop("created_at", "updated_at")


@query(
    "issue_text",
    # A document joins its paragraphs with blanks; each paragraph holds one sentence.
    "SELECT conv_id, regexp_replace(string_agg(replace(coalesce(text, ''), '. ', ' '), ' ' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), "
    "'^\\s+|\\s+$', '', 'g') AS description FROM conversations GROUP BY conv_id",
)
def issue_text(spark, sf_dir):
    """Each conversation, all its turns in order, as one rich-text document with a paragraph a sentence, and its plain text."""

    def paragraph(sentence):
        return F.struct(
            F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), sentence.alias("text"))).alias("content")
        )

    turns = corpus.table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    sentences = F.flatten(F.transform("turns", lambda t: F.split(F.coalesce(t["text"], F.lit("")), r"\. ")))
    doc = F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(sentences, paragraph).alias("content")))
    return whole.select("conv_id", richtext.rich_text(doc).alias("description"))


@query(
    "pr_trigger",
    "SELECT pr_id, action, title FROM prs WHERE action IN ('opened', 'synchronize', 'reopened') AND NOT draft AND pr_id IN "
    f"(SELECT pr_id FROM all_lines WHERE {O.m('path', '(?:' + '|'.join(s.replace('.', chr(92) + '.') for s in V.TRIGGER_SUFFIXES) + ')$')})",
    "prs",
    "all_lines",
)
def pr_trigger(spark, sf_dir):
    return files.triggered_prs(corpus.prs(spark, sf_dir), staged_lines(spark, sf_dir)).select(
        "pr_id", "action", "title"
    )


# --------------------------------------------------- dashboard and the store
def _heads(spark, sf_dir):
    prs = corpus.prs(spark, sf_dir)
    links = prs.select(F.concat(F.lit("DL-"), F.col("cust").cast("string")).alias("key"), "pr_id")
    return presets.dashboard_heads(prs, corpus.issues_from_customers(spark, sf_dir), links)


def _responses(spark, sf_dir):
    return report.review_responses(
        _heads(spark, sf_dir), staged_findings(spark, sf_dir), scope_score(spark, sf_dir).select("pr_id", "score")
    )


SUMMARY = f"""concat_ws(' ', CASE WHEN errors = 0 AND warnings = 0 THEN {O.lit(V.SUMMARY_CLEAN)} END,
    CASE WHEN errors > 0 THEN {O.fill(V.SUMMARY_ERRORS, 'errors')} END, CASE WHEN warnings > 0 THEN {O.fill(V.SUMMARY_WARNINGS, 'warnings')} END,
    CASE WHEN scope_score = 100 THEN {O.lit(V.SUMMARY_IN_SCOPE)} WHEN scope_score >= 75 THEN {O.lit(V.SUMMARY_MOSTLY_IN_SCOPE)} ELSE {O.lit(V.SUMMARY_OUT_OF_SCOPE)} END)"""
DASHBOARD = {
    **SCOPE,
    "responses": (
        ("prs", "issues", "findings", "scores"),
        f"""SELECT *, {SUMMARY} AS summary FROM (SELECT prs.pr_id, any_value(issues.key) AS issue_key, any_value(issues.title) AS issue_title,
              any_value(substr(description, 1, 500)) AS issue_description, any_value(issues.type) AS issue_type, any_value(prs.title) AS pr_title, any_value(html_url) AS pr_url,
              count(rule_id) FILTER (WHERE NOT suppressed) AS total, {_counted('NOT suppressed')},
              count(rule_id) FILTER (WHERE suppressed) AS suppressed_count, any_value(score) AS scope_score, any_value(updated_at) AS created_at,
              any_value(head_sha) AS head_sha
            FROM prs JOIN issues USING (cust) JOIN scores USING (pr_id) LEFT JOIN findings USING (pr_id) GROUP BY prs.pr_id)""",
    ),
}


@query("review_summary", "SELECT * EXCLUDE (created_at, head_sha) FROM responses", "responses", extra=DASHBOARD)
def review_summary(spark, sf_dir):
    return _responses(spark, sf_dir)


@query(
    "status_payload",
    f"""SELECT pr_id AS pr_number, CASE WHEN errors > 0 THEN 'failure' ELSE 'success' END AS state, substr({_phrase()}, 1, 140) AS description,
        '## ' || CASE WHEN errors > 0 THEN '❌' ELSE '✅' END || ' {report.PRODUCT_NAME}' || chr(10) || chr(10) || summary || chr(10) || chr(10)
        || '| Severity | Count |' || chr(10) || '|----------|-------|' || chr(10)
        || CASE WHEN errors > 0 THEN '| ❌ Errors | ' || errors || ' |' || chr(10) ELSE '' END
        || CASE WHEN warnings > 0 THEN '| ⚠️ Warnings | ' || warnings || ' |' || chr(10) ELSE '' END
        || CASE WHEN suggestions > 0 THEN '| \U0001F4A1 Suggestions | ' || suggestions || ' |' || chr(10) ELSE '' END
        || chr(10) || '---' || chr(10) || '*Posted from the [Code Review Dashboard](' || pr_url || ')*' AS comment FROM responses""",
    "responses",
    extra=DASHBOARD,
)
def status_payload(spark, sf_dir):
    return report.status_payloads(_store(spark, sf_dir)["reviews"]).select("pr_number", "state", "description", "comment")


def _store(spark, sf_dir):
    return presets.store_tables(
        _heads(spark, sf_dir), _responses(spark, sf_dir), staged_findings(spark, sf_dir), corpus.diffs(spark, sf_dir)
    )


UUID = "md5(concat_ws('|', pr_id, head_sha, created_at))"


@query(
    "stored_reviews",
    f"""SELECT {UUID} AS review_uuid, issue_key, pr_id AS pr_number, pr_title, pr_url, errors, warnings, suggestions, total, scope_score,
        summary, length(diff_text) AS diff_chars
        FROM responses JOIN diffs USING (pr_id)""",
    "responses",
    "diffs",
    extra=DASHBOARD,
)
def stored_reviews(spark, sf_dir):
    rows = _store(spark, sf_dir)["reviews"]
    return rows.withColumn("diff_chars", F.char_length("diff_text").cast("bigint")).drop("id", "diff_text", "created_at")


@query(
    "review_detail",
    f"""SELECT {UUID} AS review_uuid, f.path AS file_path, error_count, warning_count, suggestion_count, line_no AS line_number, rule_id, severity,
        message, suppressed FROM responses JOIN (SELECT *, {', '.join(f"count(*) FILTER (WHERE severity = '{s}' AND NOT suppressed) OVER g AS {s}_count" for s in V.SEVERITIES)}
          FROM findings WINDOW g AS (PARTITION BY pr_id, path)) f USING (pr_id)""",
    "responses",
    "findings",
    extra=DASHBOARD,
)
def review_detail(spark, sf_dir):
    return store.detail(_store(spark, sf_dir)).select(
        "review_uuid", "file_path", "error_count", "warning_count", "suggestion_count", "line_number", "rule_id", "severity",
        "message", "suppressed",
    )


SHORT = "CASE WHEN len(string_split(path, '/')) > {n} THEN '.../' || array_to_string(string_split(path, '/')[-{n}:], '/') ELSE path END"


@query(
    "display_texts",
    f"""SELECT pr_id, path, line_no, rule_id, message, {SHORT.format(n=3)} AS short_path, {SHORT.format(n=2)} AS chart_label,
        regexp_replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`([^`]+)`', '<code>\\1</code>', 'g') AS message_html FROM seen""",
    "seen",
)
def display_texts(spark, sf_dir):
    return seen(spark, sf_dir).select(
        "pr_id", "path", "line_no", "rule_id", "message",
        T.shorten_path(F.col("path")).alias("short_path"), T.chart_label(F.col("path")).alias("chart_label"),
        T.inline_code(F.col("message")).alias("message_html"),
    )


@query(
    "issue_icons",
    f"SELECT key, {O.case('type', V.ISSUE_TYPE_ICONS, V.DEFAULT_ISSUE_ICON)} AS icon FROM issues",
    "issues",
)
def issue_icons(spark, sf_dir):
    issues = corpus.issues_from_customers(spark, sf_dir)
    return issues.select("key", T.issue_type_icon(F.col("type")).alias("icon"))


# --------------------------------------------------------------- analytics
def _issue_table(spark, sf_dir):
    return staged_findings(spark, sf_dir)


@query(
    "top_violations",
    "SELECT rule_id, count(*) AS count FROM findings WHERE NOT suppressed AND rule_id <> '' GROUP BY rule_id ORDER BY count DESC, rule_id LIMIT 10",
    "findings",
)
def top_violations(spark, sf_dir):
    return analytics.top_violations(_issue_table(spark, sf_dir))


@query(
    "score_trend",
    f"SELECT CAST(created_at AS DATE) AS day, round(avg(scope_score), 1) AS avg_score FROM history WHERE created_at >= DATE '{AS_OF}' - 30 GROUP BY day",
    "history",
)
def score_trend(spark, sf_dir):
    return analytics.score_trend(corpus.history_from_events(spark, sf_dir), AS_OF)


@query(
    "worst_files",
    "SELECT path AS file_path, count(*) FILTER (WHERE NOT suppressed) AS total_issues FROM findings GROUP BY path ORDER BY total_issues DESC, file_path LIMIT 10",
    "findings",
)
def worst_files(spark, sf_dir):
    per_file = counts.per_file_all(staged_findings(spark, sf_dir)).select(
        F.col("path").alias("file_path"), F.col("errors").alias("error_count"), F.col("warnings").alias("warning_count"),
        F.col("suggestions").alias("suggestion_count"),
    )
    return analytics.worst_files(per_file)


@query(
    "review_stats",
    "SELECT count(*) AS total_reviews, coalesce(round(avg(total), 1), 0.0) AS avg_issues_per_review FROM history",
    "history",
)
def review_stats(spark, sf_dir):
    return analytics.review_stats(corpus.history_from_events(spark, sf_dir))


@query(
    "review_history",
    "SELECT review_uuid, issue_key, pr_number, pr_title, pr_url, errors, warnings, suggestions, total, scope_score, created_at FROM history "
    f"ORDER BY created_at DESC, id DESC LIMIT {V.HISTORY_ROWS}",
    "history",
)
def review_history(spark, sf_dir):
    rows = corpus.history_from_events(spark, sf_dir).withColumn("summary", F.lit(""))
    return store.history(rows).drop("summary")


# ------------------------------------------------------- fixes, scan, admission
def _fixes(spark, sf_dir):
    """Suggested fixes; some aim at a line that changed since, at no line, or at no file, and some lines have two."""
    found = staged_findings(spark, sf_dir).filter(F.col("suggested_fix").isNotNull())
    aim = F.col("line_no") % 50
    first = found.select(
        "pr_id",
        F.when(aim == 7, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(aim == 9, F.col("line_no") + 1_000_000).otherwise(F.col("line_no")).alias("line_no"),
        F.concat_ws("|", F.lpad(F.col("rule_ord").cast("string"), 2, "0"), F.col("emit_sub").cast("string")).alias("fix_ord"),
        "rule_id",
        F.when(aim == 13, "ÄÖ").otherwise(F.col("original_line")).alias("original_line"),
        F.when(aim == 13, "ÄÜ").otherwise(F.col("suggested_fix")).alias("suggested_fix"),
    )
    then = found.filter(aim == 11).select(
        "pr_id", "path", "line_no", F.lit("later").alias("fix_ord"), F.lit("SECOND").alias("rule_id"),
        F.col("suggested_fix").alias("original_line"), F.concat("suggested_fix", F.lit(" // ok")).alias("suggested_fix"),
    )
    return first.unionByName(then)


@query(
    "apply_fixes",
    f"""SELECT pr_id, CASE WHEN aim = 7 THEN path || '.gone' ELSE path END AS path, CASE WHEN aim = 9 THEN line_no + 1000000 ELSE line_no END AS line_no,
        rule_id, CASE aim WHEN 7 THEN 'file_missing' WHEN 9 THEN 'out_of_range' WHEN 13 THEN 'conflict' ELSE 'ok' END AS status,
        CASE WHEN aim = 13 THEN content WHEN aim = 11 THEN suggested_fix || ' // ok' WHEN aim NOT IN (7, 9) THEN suggested_fix END AS new_content,
        CASE WHEN aim = 13 THEN {O.lit(V.FIX_CONFLICT)} END AS message
       FROM aimed JOIN lines USING (pr_id, file_idx, path, line_no)
       UNION ALL SELECT pr_id, path, line_no, 'SECOND', 'ok', suggested_fix || ' // ok', NULL FROM aimed WHERE aim = 11""",
    "aimed",
    "lines",
    extra={"aimed": (("findings",), "SELECT *, line_no % 50 AS aim FROM findings WHERE suggested_fix IS NOT NULL")},
)
def apply_fixes(spark, sf_dir):
    todo = _fixes(spark, sf_dir)
    return fixes.apply_fixes(reviewed_lines(spark, sf_dir), todo).drop("fix_ord")


def _sources(spark, sf_dir, factor=1):
    d = corpus.table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".sql"))
    return d.select((F.col("doc_id") * factor).alias("pr_id"), path.alias("path"), "text")


BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SCANNED = {
    "scanned": (
        (),
        f"""SELECT pr_id, path, content, line_no FROM (SELECT pr_id, path, unnest(parts) AS content, generate_subscripts(parts, 1) AS line_no FROM
             (SELECT doc_id AS pr_id, path, CASE WHEN parts[-1] = '' THEN parts[1:-2] ELSE parts END AS parts FROM
               (SELECT doc_id, source || '/doc' || doc_id || '.sql' AS path, string_split_regex(text, '{BREAKS}') AS parts FROM documents)))
            WHERE NOT regexp_matches(path, '(?:^|/)(?:bin|obj|node_modules|packages|\\.vs|\\.git|__pycache__)(?:/|$)')""",
    )
}


@query(
    "scan_long_lines",
    f"SELECT pr_id, path, line_no, {O.fill(V.RULES['SQL-FMT-001'][1], f'CAST({O.WIDTH} AS BIGINT)')} AS message FROM scanned "
    f"WHERE NOT regexp_matches(content, '^\\s*--') AND {O.WIDTH} > 138",
    "scanned",
    extra=SCANNED,
)
def scan_long_lines(spark, sf_dir):
    lines = landed.scan_lines(_sources(spark, sf_dir))
    return findings.find(lines, {"SQL-FMT-001"}).select("pr_id", "path", "line_no", "message")


@query(
    "local_review_sources",
    "SELECT pr_id, path, count(*) AS n_lines FROM lines GROUP BY ALL UNION ALL "
    "SELECT pr_id * 3 AS pr_id, path, count(*) AS n_lines FROM scanned WHERE pr_id * 3 NOT IN (SELECT pr_id FROM diffs) GROUP BY ALL",
    "lines",
    "scanned",
    extra=SCANNED,
)
def local_review_sources(spark, sf_dir):
    lines = landed.local_review_lines(corpus.diffs(spark, sf_dir), _sources(spark, sf_dir, 3))
    return lines.groupBy("pr_id", "path").agg(F.count("*").alias("n_lines"))


ADMIT_LIMIT, ADMIT_SECONDS = 3, 86_400


def _admitted(key: str) -> str:
    """Per event whether it is accepted, with the events of each ``key`` taken one by one."""
    return f"""WITH walked AS (SELECT key, list_transform(list_reduce(list_transform(times, lambda t: [t]), lambda acc, t:
            CASE WHEN len(list_filter(acc, lambda a: a.t > t[1].t - {ADMIT_SECONDS * 1_000_000})) < {ADMIT_LIMIT} THEN list_append(acc, t[1]) ELSE acc END,
            []::STRUCT(t BIGINT, id BIGINT)[]), lambda a: a.id) AS accepted
          FROM (SELECT {key} AS key, list({{'t': epoch_us(ts), 'id': event_id}} ORDER BY ts, event_id) AS times FROM events GROUP BY {key}))
        SELECT e.key, ts, event_id, list_contains(accepted, event_id) AS accepted FROM (SELECT {key} AS key, ts, event_id FROM events) e JOIN walked USING (key)"""


@query("rate_admission", _admitted("user_id"))
def rate_admission(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    return admission.admit(events, "key", "ts", "event_id", ADMIT_LIMIT, ADMIT_SECONDS)


@query("rate_admission_busy", _admitted("'site'"))
def rate_admission_busy(spark, sf_dir):
    """All events under one key that never pauses, in blocks of a few hundred."""
    events = corpus.table(spark, sf_dir, "events").withColumn("key", F.lit("site"))
    return admission.admit(events, "key", "ts", "event_id", ADMIT_LIMIT, ADMIT_SECONDS, block=256)


@query(
    "daily_reviews",
    "SELECT CAST(created_at AS DATE) AS day, count(*) AS reviews, CAST(sum(total) AS BIGINT) AS issues, round(avg(scope_score), 1) AS avg_score FROM history GROUP BY ALL",
    "history",
)
def daily_reviews(spark, sf_dir):
    """The running statistics, read once as a batch."""
    return reviews.daily_statistics(corpus.history_from_events(spark, sf_dir))
