import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def drop(tmp_path):
    """Write a source file below a fresh folder; returns the folder."""

    def write(name: str, content: bytes | str):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(tmp_path / "in")

    write.root = str(tmp_path / "in")
    write.out = str(tmp_path / "out")
    return write


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
