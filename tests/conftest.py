import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def series(spark):
    """(station, values) to a table of hourly readings; a None value is a missing reading."""
    from datetime import datetime, timedelta

    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("station_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("temperature", T.DoubleType()),
            T.StructField("humidity", T.DoubleType()),
            T.StructField("pressure", T.DoubleType()),
        ]
    )

    def build(values, start=datetime(2025, 1, 1), step=1):
        rows = []
        for sid, vals in values.items():
            for i, v in enumerate(vals):
                at = start + timedelta(hours=i * step)
                rows.append((sid, at, None if v is None else float(v), 50.0, 1000.0))
        return spark.createDataFrame(rows, schema)

    return build
