import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def calls(spark):
    """``calls(name=text, ...)`` as a table ``archivo, raw``."""

    def make(**texts):
        return spark.createDataFrame(list(texts.items()), "archivo string, raw string")

    return make


@pytest.fixture
def folder(tmp_path):
    """Writes files of a transcript folder and returns its path."""

    def make(**texts):
        for name, content in texts.items():
            data = content if isinstance(content, bytes) else content.encode("utf-8")
            (tmp_path / name.replace("__", ".")).write_bytes(data)
        return str(tmp_path)

    return make
