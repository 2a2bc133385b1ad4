import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trackspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def rows(spark):
    """Collect a frame as a sorted list of tuples of the named columns."""

    def collect(df, *cols):
        out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
        return sorted(out, key=lambda t: tuple((v is None, v) for v in t))

    return collect
