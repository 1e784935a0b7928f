import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from broadsheet.session import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app="broadsheet-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


def one(spark, col, schema="x string", rows=None):
    """Evaluate a Column over a one-column DataFrame and return the values."""
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]
