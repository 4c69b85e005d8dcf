import collections
import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from difflens.operators import admission, findings
from difflens.plans.presets import Lines
from difflens.streaming import admission as stream_admission
from difflens.streaming import reviews

DIFF = (
    "diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1,2 +1,3 @@\n+int customerId = 1; // review-ignore: CS-NAME-001\n"
    "+Debugger.Break();\n"
)


def write_lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def event(pr, sha, path, minute, action="opened", draft=False):
    return {
        "pr_id": pr, "head_sha": sha, "action": action, "draft": draft,
        "event_time": f"2024-01-01T00:{minute:02d}:00Z", "diff_text": DIFF.format(p=path),
    }


def test_reviews_as_they_arrive(spark, tmp_path):
    landed, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    landed.mkdir()
    write_lines(landed / "a.json", [event(1, "a", "x.cs", 1), event(2, "b", "y.cs", 2, draft=True), event(3, "c", "z.png", 3)])

    def run():
        q = reviews.review_stream(reviews.read_events(spark, str(landed)), str(out), str(check)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    run()
    write_lines(landed / "b.json", [event(1, "a", "x.cs", 5), event(1, "a2", "x.cs", 6), event(4, "d", "w.cs", 7, action="closed")])
    run()
    rows = spark.read.parquet(str(out)).select("pr_id", "head_sha", "rule_id", "suppressed")
    got = sorted(map(tuple, rows.collect()))

    diffs = spark.createDataFrame([(1, DIFF.format(p="x.cs"))], "pr_id long, diff_text string")
    lines = Lines.of(diffs).reviewed
    once = findings.suppress(findings.find(lines), lines).select("pr_id", "rule_id", "suppressed").collect()
    assert got == sorted((r.pr_id, sha, r.rule_id, r.suppressed) for r in once for sha in ("a", "a2"))
    assert any(r[3] for r in got)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(stream_admission.PROVIDER, stream_admission.ROCKSDB)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset(stream_admission.PROVIDER)


BASE = dt.datetime(2024, 1, 1)
EVENT = "user string, ts timestamp, n long"


def admitted(spark, folder, parts, **options):
    """Rows the stream decides when each of ``parts`` is a micro-batch."""
    src, result = folder / "in", folder / "out"
    spark.createDataFrame([], EVENT).write.parquet(str(src))
    for part in parts:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(src))
        events = spark.readStream.schema(EVENT).parquet(str(src))
        q = (
            stream_admission.admit_stream(events, "user", "ts", "n", 3, 60, "1 hour", **options)
            .writeStream.format("parquet").option("path", str(result))
            .option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(str(result))


def flushes(*hours):
    """Far events that move the watermark on, one a micro-batch."""
    return [[("flush", BASE + dt.timedelta(hours=h), 1000 + h)] for h in hours]


def test_admission_stream_equals_batch(spark, tmp_path, rocksdb):
    rows = [(f"u{i % 3}", BASE + dt.timedelta(seconds=(i * 37) % 900), i) for i in range(240)]
    rows += [("u0", BASE + dt.timedelta(seconds=s), 500 + s) for s in (59, 60, 119, 120)] + [(None, BASE, 600), (None, BASE, 601)]
    rows += [("u1", None, 700)]
    expected = sorted(map(str, admission.admit(spark.createDataFrame(rows, EVENT), "user", "ts", "n", 3, 60).collect()))
    # Two parts, mixed in time; packed rows of two events.
    got = admitted(spark, tmp_path, [rows[::2], rows[1::2]] + flushes(2, 3), rows=2).filter("key is null or key != 'flush'")
    named = got.select(F.col("key").alias("user"), "ts", F.col("seq").alias("n"), "accepted")
    assert sorted(map(str, named.collect())) == expected
    assert 0 < named.filter("accepted").count() < len(rows)


def test_state_rows_of_the_stream_do_not_grow(spark, tmp_path, rocksdb):
    """Many events of one key wait in many small rows, and leave none when they are decided."""
    rows = [("u", BASE + dt.timedelta(milliseconds=50 * i), i) for i in range(2000)]
    waiting = admitted(spark, tmp_path, [rows[:1000], rows[1000:]], rows=64)
    assert waiting.count() == 0

    def state(name):
        r = spark.read.format("statestore").option("path", str(tmp_path / "check"))
        return r.option("stateVarName", name).load()

    packed = state("packed").select("key.key", F.size("user_map_value.us").alias("n"))
    assert packed.agg(F.sum("n")).first()[0] == 2000 and packed.agg(F.max("n")).first()[0] <= 64
    assert state("counts").count() == 10
    for part in flushes(2, 3):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = admitted_again(spark, tmp_path)
    assert done.filter("key = 'u'").count() == 2000
    expected = admission.admit(spark.createDataFrame(rows, EVENT), "user", "ts", "n", 3, 60).filter("accepted").count()
    assert done.filter("key = 'u' and accepted").count() == expected
    assert state("packed").filter("key.key = 'u'").count() == 0 and state("accepted").filter("key.key = 'u'").count() == 0


def admitted_again(spark, folder):
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    decided = stream_admission.admit_stream(events, "user", "ts", "n", 3, 60, "1 hour", rows=64)
    q = decided.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.parquet(str(folder / "out"))


def test_admission_stream_names_the_state_store_it_needs(spark):
    events = spark.readStream.format("rate").load().selectExpr("'u' as user", "timestamp as ts", "value as n")
    with pytest.raises(ValueError, match="RocksDB"):
        stream_admission.admit_stream(events, "user", "ts", "n")


def test_admission_is_strict_and_ignores_rejected(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 1, 2, 59, 60, 61, 200]
    rows = [("a", t0 + dt.timedelta(seconds=s), s) for s in at]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n long")
    got = {r.n: r.accepted for r in admission.admit(df, "k", "ts", "n", 2, 60).collect()}
    # 60: the event at 0 is exactly one window old and no longer counts.
    assert got == {0: True, 1: True, 2: False, 59: False, 60: True, 61: True, 200: True}


def test_admission_equals_one_by_one(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", "c", None]), t0 + dt.timedelta(seconds=rng.randrange(400) * rng.choice([1, 1, 30])), i) for i in range(900)]
    rows += [("a", None, 1000), ("only", None, 1001)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n long").repartition(3)
    for limit, seconds, block in ((3, 60, 7), (1, 1, 64), (10, 600, 1 << 16), (0, 60, 5)):
        expected, walks = {}, {}
        for k, t, n in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
            walker = walks.setdefault(k, admission.Admission(limit, seconds * 1_000_000))
            expected[n] = walker.accept(round((t - t0).total_seconds() * 1e6))
        got = {r.n: r.accepted for r in admission.admit(df, "k", "ts", "n", limit, seconds, block).collect()}
        assert got == expected | {1000: False, 1001: False}


def test_one_busy_key_is_shared_out(spark):
    """Five million events of one key without a pause: many tasks pack and flag, and the walk steps over the rest."""
    n = 5_000_000
    events = spark.range(0, n, 1, 16).select(F.lit("busy").alias("k"), F.timestamp_micros(F.col("id") * 20_000).alias("ts"), F.col("id").alias("n"))
    done = admission.admit(events, "k", "ts", "n", 10, 60)
    # 50 events a second: ten are accepted at the start of each minute.
    per_minute = done.filter("accepted").groupBy(F.expr("n div 3000").alias("minute")).agg(F.count("*").alias("c"), F.min("n").alias("first"))
    rows = per_minute.collect()
    assert len(rows) == -(-n // 3000) and all(r.c == 10 and r["first"] == r.minute * 3000 for r in rows)
    numbered = spark.range(0, 4 * admission.BLOCK).select(F.lit("k").alias("key"), F.col("id").alias("_id"), F.col("id").alias("us"))
    assert admission.blocks_of(numbered).select(F.size("events")).distinct().first()[0] == admission.BLOCK
    assert admission.blocks_of(numbered).count() == 4


def test_the_walk_steps_from_accepted_to_accepted():
    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += not isinstance(i, slice)
            return super().__getitem__(i)

    times = np.arange(1_000_000, dtype=np.int64).view(Counted)
    found = admission.walk(times, collections.deque(maxlen=5), 100_000)
    assert found == [100_000 * i + j for i in range(10) for j in range(5)] and Counted.reads < 200


def test_daily_statistics_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24), i, i % 101) for i in range(60)]
    df = spark.createDataFrame(rows, "created_at timestamp, total long, scope_score long")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tmp_path / "out"

    def save(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(str(out))

    q = (
        reviews.daily_statistics(stream).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    latest = spark.read.parquet(str(out)).groupBy("day").agg(F.max_by(F.struct("reviews", "issues", "avg_score"), "batch").alias("s"))
    got = {r.day: tuple(r.s) for r in latest.collect()}
    want = df.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("reviews"), F.sum("total").alias("issues"), F.round(F.avg("scope_score"), 1).alias("avg_score")
    )
    assert got == {r.day: (r.reviews, r.issues, r.avg_score) for r in want.collect()}


def test_running_violations_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 2), f"R-{i % 4}", i % 5 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "created_at timestamp, rule_id string, suppressed boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (
        reviews.running_violations(stream).writeStream.outputMode("complete").format("memory").queryName("violations")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = sorted(map(tuple, spark.sql("select day, rule_id, count from violations").collect()))
    want = df.filter("not suppressed").groupBy(F.to_date("created_at").alias("day"), "rule_id").count()
    assert got == sorted(map(tuple, want.collect()))
