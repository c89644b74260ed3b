"""Observation view over an event table.

The given tables hold no weather readings, so readings are derived from `events`
by arithmetic that any SQL engine repeats bit for bit: ten users form a station,
and the first event of a station's hour is its reading for that hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_readings(events: DataFrame) -> DataFrame:
    """One raw reading per event, before the hourly reduction."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        F.expr("user_id div 10").alias("station_id"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
        "value",
        k.alias("k"),
        (F.col("event_type") == "error").alias("is_error"),
    )


def reading_columns() -> dict[str, Column]:
    """Physical readings from the kept event's fields."""
    lost = F.col("is_error") & (F.col("k") % 10 == 0)
    return {
        "temperature": F.when(lost, None).otherwise(F.col("value") / F.lit(5.0) - F.lit(10.0)),
        "humidity": F.col("k") * F.lit(1.05),
        "pressure": F.lit(940.0) + (F.col("event_id") * 37) % 160,
        "wind_speed": (F.col("event_id") % 30) / F.lit(2.0),
    }


def station_columns() -> dict[str, Column]:
    sid = F.col("station_id")
    return {
        "station_name": F.concat(F.lit("ST"), sid.cast("string")),
        "latitude": F.lit(28.0) + (sid % 5) * F.lit(0.35),
        "longitude": F.lit(76.0) + F.expr("station_id div 5") * F.lit(0.4),
    }


OBS_COLUMNS = (
    "station_id",
    "ts",
    "station_name",
    "latitude",
    "longitude",
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings per station, unique on (station_id, ts).

    All aggregated fields are fixed-width, so the reduction is a hash aggregate
    with a partial step before the shuffle.
    """
    raw = event_readings(spark.read.parquet(f"{sf_dir}/events.parquet"))
    first = lambda c: F.min_by(c, "event_id").alias(c)
    kept = raw.groupBy("station_id", "ts").agg(
        first("value"), first("k"), first("is_error"), F.min("event_id").alias("_id")
    ).withColumnRenamed("_id", "event_id")
    return kept.withColumns({**reading_columns(), **station_columns()}).select(*OBS_COLUMNS)


def station_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stations, from one column of the events."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id")
    return users.select(F.expr("user_id div 10").alias("station_id")).distinct()
