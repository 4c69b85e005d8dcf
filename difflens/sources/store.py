"""The review store: three Parquet tables and a table of commits, and reads on them.

Publication. A batch of reviews is written by attempts. The rows of an attempt carry its id, and what makes them visible is
one row in ``commits``, written last: readers join the latest attempt of each batch. A write that dies half way leaves rows
that no reader sees; a batch that is committed is not written again, and one that is replaced leaves its old rows unseen.

Layout. The tables lie by ``review_month`` and ``bucket`` (of the review's id), in files of ranges of ids sorted by id, the reviews with a
bloom filter on ``review_uuid``. All children of a review lie in one bucket of one month, so a lookup reads that place
alone: month and bucket are join keys, and the one review found prunes the partitions of its children.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import values as V
from ..operators import counts, documents

REVIEW_COLUMNS = [
    "id", "review_uuid", "issue_key", "pr_number", "pr_title", "pr_url", "errors", "warnings", "suggestions", "total",
    "scope_score", "summary", "diff_text", "created_at",
]
HISTORY_COLUMNS = [c for c in REVIEW_COLUMNS if c not in ("id", "diff_text")]
TABLES = ("reviews", "review_files", "review_issues")
BUCKETS = 64
PLACE = ["review_month", "bucket", "attempt"]
COMMITS = "batch string, attempt string, committed_at timestamp"
ISSUE_ORDER = ["line_number", "file_idx", "rule_ord", "phase", "emit_pos", "emit_sub"]


def review_rows(reviews: DataFrame, diff_chars: int | None = None) -> DataFrame:
    """Complete incoming reviews: total, defaults, and ids that a retried write repeats.
    ``reviews`` needs issue_key, pr_number, head_sha and created_at. Diffs are stored whole; with
    ``diff_chars`` (``V.MAX_DIFF_CHARS`` is the usual limit) longer ones are shortened, with a note."""
    have = set(reviews.columns)

    def col(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    diff_text = col("diff_text", "")
    stored = diff_text
    if diff_chars is not None:
        shortened = F.concat(F.substring(diff_text, 1, diff_chars), F.lit(V.DIFF_TRUNCATED_NOTE))
        stored = F.when(F.char_length(diff_text) > diff_chars, shortened).otherwise(diff_text)
    number = lambda c, d: col(c, d).cast("bigint").alias(c)
    rows = reviews.select(
        F.xxhash64("pr_number", "head_sha", "created_at").alias("id"),
        F.md5(F.concat_ws("|", F.col("pr_number").cast("string"), "head_sha", F.col("created_at").cast("string"))).alias(
            "review_uuid"
        ),
        "issue_key",
        F.col("pr_number").cast("bigint").alias("pr_number"),
        col("pr_title", "").alias("pr_title"),
        col("pr_url", "").alias("pr_url"),
        number("errors", 0),
        number("warnings", 0),
        number("suggestions", 0),
        number("scope_score", 100),
        col("summary", "").alias("summary"),
        stored.alias("diff_text"),
        "created_at",
    )
    total = F.col("errors") + F.col("warnings") + F.col("suggestions")
    return rows.withColumn("total", total).select(*REVIEW_COLUMNS)


def file_rows(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """``review_files``; files whose findings are all suppressed are kept with zero counts."""
    per_file = counts.per_file_all(findings)
    ids = reviews.select(F.col("id").alias("review_id"), F.col("pr_number").alias("pr_id"), "created_at")
    return per_file.join(ids, "pr_id").select(
        F.xxhash64("review_id", "path").alias("id"),
        "review_id",
        F.col("path").alias("file_path"),
        F.col("errors").alias("error_count"),
        F.col("warnings").alias("warning_count"),
        F.col("suggestions").alias("suggestion_count"),
        "created_at",
    )


def issue_rows(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """``review_issues``, with the order in which they were found."""
    ids = reviews.select(F.col("id").alias("review_id"), F.col("pr_number").alias("pr_id"), "created_at")
    return findings.join(ids, "pr_id").select(
        F.xxhash64("review_id", "path").alias("file_id"),
        "review_id",
        F.col("line_no").alias("line_number"),
        "rule_id",
        "severity",
        "message",
        "original_line",
        "suggested_fix",
        "suppressed",
        *["file_idx", "rule_ord", "phase", "emit_pos", "emit_sub"],
        "created_at",
    )


def _review_id(table: str) -> str:
    return "id" if table == "reviews" else "review_id"


def _committed(spark: SparkSession, base: str) -> DataFrame:
    """The latest committed attempt of each batch."""
    try:
        rows = spark.read.schema(COMMITS).parquet(f"{base}/commits")
    except AnalysisException:  # nothing was ever committed
        rows = spark.createDataFrame([], COMMITS)
    return rows.groupBy("batch").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))


def write_attempt(base: str, tables: dict[str, DataFrame], attempt: str, buckets: int = BUCKETS) -> None:
    """The rows of one attempt, invisible until :func:`commit`."""
    for name in reversed(TABLES):
        rid = _review_id(name)
        placed = (
            tables[name]
            .withColumn("review_month", F.trunc("created_at", "month"))
            .withColumn("bucket", F.pmod(F.xxhash64(rid), F.lit(buckets)).cast("int"))
            .withColumn("attempt", F.lit(attempt))
        )
        # By ranges of the id too, so that a large bucket is written by several tasks, each a file of its own ids.
        writer = placed.repartitionByRange("review_month", "bucket", rid).sortWithinPartitions("review_month", "bucket", rid).write
        if name == "reviews":
            # Filters as large as their file needs; they have a MB in each file otherwise.
            writer = writer.option("parquet.bloom.filter.enabled#review_uuid", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.mode("append").partitionBy("review_month", "bucket").parquet(f"{base}/{name}")


def commit(spark: SparkSession, base: str, batch: str, attempt: str) -> None:
    """Makes an attempt the one that readers see of its batch: one row in one file, there or not."""
    row = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"))
    row.coalesce(1).write.mode("append").parquet(f"{base}/commits")


def write(base: str, tables: dict[str, DataFrame], batch: str, buckets: int = BUCKETS, replace: bool = False) -> bool:
    """Publishes a batch of reviews once: ``reviews``, ``review_files`` and ``review_issues`` become visible together.

    ``batch`` names the batch, the same on a retry. If it is committed already nothing is written, unless ``replace``;
    then the new rows take the place of the old ones. Returns whether anything was written."""
    spark = tables["reviews"].sparkSession
    if not replace and not _committed(spark, base).filter(F.col("batch") == batch).isEmpty():
        return False
    attempt = f"{batch}-{uuid.uuid4().hex}"
    write_attempt(base, tables, attempt, buckets)
    commit(spark, base, batch, attempt)
    return True


def read(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The committed rows of the tables."""
    commits = _committed(spark, base).select("attempt")
    return {name: spark.read.parquet(f"{base}/{name}").join(commits, "attempt", "left_semi") for name in TABLES}


def history(reviews: DataFrame, limit: int = V.HISTORY_ROWS, tie: str = "id") -> DataFrame:
    """The newest reviews, without their diffs; those of one time in falling order of ``tie``."""
    return reviews.orderBy(F.col("created_at").desc(), F.col(tie).desc()).limit(limit).select(*HISTORY_COLUMNS)


def _of(tables: dict[str, DataFrame], review_uuid: str | None) -> tuple[DataFrame, list[str]]:
    """The reviews asked for, and the columns that place their children."""
    reviews = tables["reviews"]
    place = [c for c in PLACE if all(c in t.columns for t in tables.values())]
    if review_uuid is not None:
        # One row: small enough to be sent everywhere, so that its month and bucket prune what is read of the children.
        return F.broadcast(reviews.filter(F.col("review_uuid") == review_uuid)), place
    return reviews, place


def detail(tables: dict[str, DataFrame], review_uuid: str | None = None) -> DataFrame:
    """Reviews with their files and issues, one row per issue; one review when its uuid is given."""
    reviews, place = _of(tables, review_uuid)
    heads = reviews.select(F.col("id").alias("review_id"), "review_uuid", "issue_key", "pr_number", *place)
    files = tables["review_files"].select(
        F.col("id").alias("file_id"), "review_id", "file_path", "error_count", "warning_count", "suggestion_count", *place
    )
    issues = tables["review_issues"].drop("created_at", *[c for c in PLACE if c not in place])
    if review_uuid is not None:
        # The place of the one review goes to both children and prunes their partitions.
        chosen = heads.select("review_id", *place)
        files, issues = (child.join(chosen, ["review_id", *place], "left_semi") for child in (files, issues))
    return heads.join(files, ["review_id", *place]).join(issues, ["review_id", "file_id", *place])


DOCUMENT_ORDER = ["section", "file_path", "kind", *ISSUE_ORDER]


def review_documents(tables: dict[str, DataFrame], review_uuid: str | None = None, part_bytes: int = documents.PART_BYTES) -> DataFrame:
    """``(review_uuid, part, start, text)``: stored reviews in full as JSON, in parts of bounded size.

    A review's files are in order of path, each with all its issues, suppressed ones too, in order of line. No rows: an
    unknown review."""
    reviews, place = _of(tables, review_uuid)
    heads = reviews.select(F.col("id").alias("review_id"), "review_uuid", *place)
    files, issues = (tables[name].join(heads, ["review_id", *place]) for name in ("review_files", "review_issues"))
    paths = files.select("review_uuid", F.col("id").alias("file_id"), "file_path")
    name = lambda c: F.lit(c).cast("string")

    def piece(section, kind, text, path, enters=None, leaves=None, ordered=False) -> list[Column]:
        places = [(F.col(c) if ordered else F.lit(None)).cast("bigint").alias(c) for c in ISSUE_ORDER]
        return [F.lit(section).alias("section"), path.alias("file_path"), F.lit(kind).alias("kind"), *places, text.alias("text"), name(enters).alias("enters"), name(leaves).alias("leaves")]

    def inlined(rows, *choices):
        return rows.select("review_uuid", F.inline(F.array(*[F.struct(*c) for c in choices])))

    own = [c for c in REVIEW_COLUMNS if c != "created_at"]
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at")
    head = F.concat(F.lit("{"), documents.json_fields(F.struct(*own, stamp)), F.lit(',"files":['))
    file_fields = documents.json_fields(F.struct(F.col("id"), "review_id", "file_path", "error_count", "warning_count", "suggestion_count"))
    opened = F.concat(F.lit("{"), file_fields, F.lit(',"issues":['))
    issue = F.to_json(
        F.struct("file_id", "line_number", "rule_id", "severity", "message", "original_line", "suggested_fix", "suppressed"),
        {"ignoreNullFields": "false"},
    )
    none = F.lit("")
    frame = inlined(reviews, piece(0, 0, head, none), piece(2, 0, F.lit("]}"), none))
    shells = inlined(files, piece(1, 0, opened, F.col("file_path"), enters="files"), piece(1, 2, F.lit("]}"), F.col("file_path"), leaves="files"))
    rows = issues.drop("review_uuid").join(paths, "file_id").select("review_uuid", *piece(1, 1, issue, F.col("file_path"), "issues", "issues", True))
    return documents.in_parts(frame.unionByName(shells).unionByName(rows), ["review_uuid"], DOCUMENT_ORDER, size=part_bytes)
