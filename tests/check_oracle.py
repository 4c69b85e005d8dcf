"""Run registered queries against their SQL: python tests/check_oracle.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(v):
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, build, sql):
    """(rows, rows that differ, problem)."""
    df = build(spark, sf_dir)
    ours = comparable([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = comparable(res.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return len(ours), -1, f"columns {sorted(df.columns)} / {sorted(names)}"
    if ours == theirs:
        return len(ours), 0, ""
    a, b = set(ours), set(theirs)
    return len(ours), len(a ^ b) or -1, f"\n  spark {len(ours)}: {sorted(a - b, key=repr)[:3]}\n  sql {len(theirs)}: {sorted(b - a, key=repr)[:3]}"


def session(cpus=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in sqls:
                n, diff, note = compare(spark, con, sf_dir, queries[name], sqls[name])
                bad += diff != 0
                state = "ok" if diff == 0 else "DIFF"
            else:
                n, state, note = queries[name](spark, sf_dir).count(), "rows only", ""
        except Exception as e:  # noqa: BLE001
            n, state, note, bad = 0, "FAIL", str(e)[:600], bad + 1
        print(f"{state:9} {name:28} {n:8} rows {time.time() - start:6.1f}s {note}", flush=True)
    print("bad:", bad)
