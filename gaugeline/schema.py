"""Observation schema and the column contract checked before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [
        T.StructField("station_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("station_name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("wind_direction", T.DoubleType()),
    ]
)

FAULT_SPEC = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("variable", T.StringType()),
        T.StructField("fault", T.StringType()),
        T.StructField("station_id", T.LongType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("duration", T.LongType()),
        T.StructField("severity", T.StringType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise if a column is missing; uses the schema only, no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df
