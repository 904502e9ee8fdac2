import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from msgsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=4,
                            **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate columns over literal rows: one(schema, rows, **columns) -> list of dicts."""
    def run(schema, rows, **cols):
        df = spark.createDataFrame(rows, schema)
        return [r.asDict(recursive=True) for r in df.select("*", *[c.alias(n) for n, c in cols.items()]).collect()]
    return run
