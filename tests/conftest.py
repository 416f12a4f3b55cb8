"""One local session for all tests."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value of either engine in one form."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(frame):
    """Rows of a pandas frame, columns by name, in one order."""
    frame = frame[sorted(frame.columns)]
    whole = frame.astype(object).where(frame.notna(), None)
    number = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 53 else v
    return sorted((tuple(plain(number(v)) for v in r) for r in whole.itertuples(index=False)), key=str)
