import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("difflens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


LINES_SCHEMA = (
    "pr_id long, file_idx long, path string, line_no long, content string, diff_position long, ord long"
)


def changed_lines(spark, cases):
    """``cases``: list of (path, {line_no: text}); each becomes its own PR."""
    rows = []
    for pr, (path, lines) in enumerate(cases):
        for i, (no, text) in enumerate(lines.items()):
            rows.append((pr, 1, path, no, text, i + 2, i))
    return spark.createDataFrame(rows, LINES_SCHEMA)
