"""Intermediate tables that several steps read: written once, then scanned by column and partition.

The folder is the one the cluster names in ``spark.checkpoint.dir``, so any
executor can read them again after a loss. Only a local session without that
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of a join or sort is dealt.
ROWS_PER_TASK = 250_000

_FOLDERS: dict[str, str] = {}
_TABLES: dict[tuple, tuple] = {}


def folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="difflens-")
        _FOLDERS[app] = f"{base.rstrip('/')}/difflens-{app}-{uuid.uuid4().hex[:8]}"
    return _FOLDERS[app]


def tasks_for(spark: SparkSession, size: int, most: int) -> int:
    """Into how many tasks rows are dealt so that one has about ``most`` of ``size``, whatever the session's settings; not
    fewer than it has shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def _write(df: DataFrame, name: str, partition_by: tuple) -> str:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def stage(df: DataFrame, name: str, partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name, partition_by))


def stage_once(spark: SparkSession, key: tuple, build, partition_by: tuple = ()) -> DataFrame:
    """``stage`` remembered per application and key, for inputs many queries share."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _TABLES:
        df = build()
        _TABLES[full] = (_write(df, key[0], partition_by), df.schema)
    path, schema = _TABLES[full]
    return spark.read.schema(schema).parquet(path)
