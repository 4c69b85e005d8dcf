"""Review inputs derived from the order tables: diffs, PRs, issues, review history.

The given tables hold no diffs, so every order line becomes one line of a diff
of its customer's pull request. A customer with very many lines is split into
several PRs, so a diff stays a text of bounded size whatever the data's skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from . import staging

LINES_PER_PR = 5000
PART_STEP = 10_000_000_000
DOMAIN = "example.com"
FIRST_HUNK_LINES = 12

# The line templates per kind of file, {k} = part number, {x150} = 150 times x.
TEMPLATES = {
    "cs": r"""\tprivate int count{k};
\tint customerId = {k};
\tint iCounter = 0;
\tvar total = {k};
\tpublic string Label;
\tthis.total = this.count;
\tif (ready)
\tRun();
\tprivate DbContext _ctx;
\tpublic async void Load{k}()
\tpublic async Task Fetch{k}()
\tWait({k});
\tconst int Limit = {k};
\tstring password = "abcdefgh{k}";
\tdb.ExecuteReader("GetRow" + name);
\t// TODO: check auth token {k}
\tlogger.Info("x " + password);
\tConsole.WriteLine("row");
\tDebugger.Break();
\t// var old = {k};
\t// return old;
\t// int gone = 1;
\tcatch (Exception) { }
\tstring s = "{x150}";
\tint customerId = 1; // review-ignore: CS-NAME-001
\t// review-ignore: CS-MAGIC-001
\tDoWork();""",
    "sql": r"""select name FROM Users
SELECT * FROM Users WHERE userID = {k}
LEFT OUTER JOIN Orders o ON o.id = u.id
INSERT INTO [dbo].[Customer] (customerID) VALUES ({k})
SELECT a  FROM T
SELECT @id = @@IDENTITY
SELECT @id = @@IDENTITY -- review-ignore: SQL-BP-001
WHERE NOT @x IS NULL
UPDATE c SET c.x = {k}
IF @n > 0
BEGIN TRANSACTION
ROLLBACK
DECLARE cur CURSOR FOR
-- plain comment {k}

SELECT '{x150}' AS x
SELECT name FROM Users Order By name
CREATE TABLE [dbo].[T{k}] (id INT)""",
    "ts": r"""console.log("row {k}");
const x{k}: any = 1;
const d = await api.get(url);
try {
import { Foo, Bar as Baz } from './types';
const f = new Foo();
// review-ignore: TS-001
console.log(token);
const n = {k};
// console.warn("old");""",
    "json": r""""secret": "value",
password = "abcdefgh{k}"
"name": "n{k}\"""",
}


def templates(group: str) -> list[str]:
    text = TEMPLATES[group].replace(r"\t", "\t").replace(r"\"", '"').replace("{x150}", "x" * 150)
    return text.split("\n")


# (kind of file, path) by (PR + slot) % 6
PATHS = [
    ("cs", "Web/api/Core/Service{pr}_{slot}.cs"),
    ("sql", "DB/dbo/Stored Procedures/p{pr}_{slot}.sql"),
    ("ts", "Search/app{pr}_{slot}.ts"),
    ("json", "config/appsettings.Production{pr}.json"),
    ("ts", "node_modules/lib{pr}.js"),
    ("json", "assets/logo{pr}.png"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their customer; both sides are dealt by the number of lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag",
        "l_linestatus",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), "o_orderdate")
    tasks = staging.tasks_for(spark, lines.count(), staging.ROWS_PER_TASK)
    return lines.repartition(tasks, "l_orderkey").join(
        orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their customer and PR. They are joined once, for diffs and PRs."""
    joined = staging.stage_once(spark, ("order_lines", sf_dir), lambda: lines_with_customer(spark, sf_dir))
    large = (
        joined.groupBy("cust")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > LINES_PER_PR)
        .select("cust", F.ceil(F.col("n") / LINES_PER_PR).alias("parts"))
    )
    # At most one row for every LINES_PER_PR lines, so it is small enough to be sent everywhere.
    large = F.broadcast(large)
    spread = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")
    part = F.when(F.col("parts").isNull(), 0).otherwise(spread % F.col("parts"))
    return joined.join(large, "cust", "left").withColumn("pr_id", part * PART_STEP + F.col("cust")).drop("parts")


def diffs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``diffs(pr_id, diff_text)``."""
    slot = F.when(F.col("cust") % 5 == 0, 0).otherwise(F.col("l_suppkey") % 4)
    tasks = staging.tasks_for(spark, table(spark, sf_dir, "lineitem").count(), staging.ROWS_PER_TASK)
    keyed = order_lines(spark, sf_dir).withColumn("slot", slot).repartition(tasks, "pr_id")
    w = Window.partitionBy("pr_id", "slot").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag",
        "l_linestatus",
    )
    kind = (F.col("pr_id") + F.col("slot")) % 6
    t = F.col("l_partkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_suppkey")
    path, text = None, None
    for i, (group, pattern) in enumerate(PATHS):
        lines = templates(group)
        pick = F.element_at(F.array(*[F.lit(x) for x in lines]), (t % len(lines) + 1).cast("int"))
        name = F.replace(
            F.replace(F.lit(pattern), F.lit("{pr}"), F.col("pr_id").cast("string")),
            F.lit("{slot}"),
            F.col("slot").cast("string"),
        )
        path = F.when(kind == i, name) if path is None else path.when(kind == i, name)
        text = F.when(kind == i, pick) if text is None else text.when(kind == i, pick)
    text = F.replace(text, F.lit("{k}"), F.col("l_partkey").cast("string"))
    sign = (
        F.when(F.col("l_returnflag") != "R", "+").when(F.col("l_linestatus") == "F", "-").otherwise(" ")
    )
    start = (1 + F.floor((F.col("rn") - 1) / FIRST_HUNK_LINES) * 40).cast("string")
    hunk = F.when(
        (F.col("rn") - 1) % FIRST_HUNK_LINES == 0,
        F.concat(F.lit("@@ -"), start, F.lit(",12 +"), start, F.lit(",12 @@\n")),
    ).otherwise("")
    # The path is built for the first line of a file only.
    titles = F.replace(F.lit("diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n"), F.lit("{path}"), path)
    header = F.when(F.col("rn") == 1, titles).otherwise("")
    rows = keyed.select(
        "pr_id", "slot", F.row_number().over(w).alias("rn"), F.concat(sign, text).alias("line")
    ).select("pr_id", "slot", "rn", F.concat(header, hunk, F.col("line")).alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "rn", "line")))
    return rows.groupBy("pr_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("diff_text")
    )


def prs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR metadata; the issue key is in the title, the branch or the body."""
    cust = F.col("cust")
    key = F.concat(F.lit("DL-"), cust.cast("string"))
    actions = ["opened", "synchronize", "reopened", "closed"]
    return (
        order_lines(spark, sf_dir)
        .groupBy("pr_id", "cust")
        .agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
        .select(
            "pr_id",
            "cust",
            F.when(cust % 2 == 0, F.concat(key, F.lit(" update"))).otherwise("Update").alias("title"),
            F.when(cust % 4 == 1, F.concat(F.lit("feature/"), F.lower(key), F.lit("-x"))).otherwise("work").alias("branch"),
            F.when(cust % 4 == 3, F.concat(F.lit("Fixes "), key, F.lit("."))).alias("body"),
            F.md5(F.col("pr_id").cast("string")).alias("head_sha"),
            F.concat(F.lit("https://example.com/pull/"), F.col("pr_id").cast("string")).alias("html_url"),
            (cust % 7 == 0).alias("draft"),
            F.element_at(F.array(*[F.lit(a) for a in actions]), (cust % 4 + 1).cast("int")).alias("action"),
            "created_at",
            "updated_at",
        )
    )


def issues_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue per customer, with a keyword of the scope map in its description."""

    def pick(options, n):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))

    cust = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("DL-"), cust.cast("string")).alias("key"),
        cust.alias("cust"),
        F.concat(F.lit("Work for "), F.col("c_name")).alias("title"),
        F.concat(F.lit("Change "), pick(list(V.SCOPE_MAP), cust), F.lit(" for "), F.col("c_mktsegment")).alias("description"),
        pick(["Bug", "Task", "Story", "Epic", "Chore"], cust).alias("type"),
        pick(V.MY_ISSUE_STATUSES + ["Done"], cust).alias("status"),
        pick(["Low", "Medium", "High"], F.col("c_nationkey")).alias("priority"),
        F.concat(F.lit("user-"), F.col("c_nationkey").cast("string")).alias("assignee"),
        F.timestamp_seconds(F.lit(1704067200) + cust * 60).alias("updated"),
    )


def history_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored review per event."""
    e = F.col("event_id")
    counts = table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.md5(e.cast("string")).alias("review_uuid"),
        F.concat(F.lit("DL-"), F.col("user_id").cast("string")).alias("issue_key"),
        e.alias("pr_number"),
        F.concat(F.lit("Review "), F.col("event_type")).alias("pr_title"),
        F.concat(F.lit("https://example.com/pull/"), e.cast("string")).alias("pr_url"),
        (e % 4).alias("errors"),
        (e % 7).alias("warnings"),
        (e % 3).alias("suggestions"),
        (F.floor("value").cast("bigint") % 101).alias("scope_score"),
        F.col("ts").alias("created_at"),
    )
    return counts.withColumn("total", F.col("errors") + F.col("warnings") + F.col("suggestions"))


# ------------------------------------------------------------------ staged
def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage_once(spark, ("diffs", sf_dir), lambda: diffs_from_orders(spark, sf_dir))


def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage_once(spark, ("prs", sf_dir), lambda: prs_from_orders(spark, sf_dir))
