"""Inputs of the named queries: readings, fault specs, votes and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import FAULT_DURATIONS, SEVERITIES
from gaugeline.functions.columns import flag, holds
from gaugeline.operators import correction, detectors, diagnosis, features, inject, profile
from gaugeline.operators.staging import stage
from gaugeline.sources.events import observations, station_ids

SPEC_FAULTS = ("spike", "drop", "frozen", "drift", "missing", "multivariate")
SPEC_ORIGIN = "2024-01-01 00:00:00"


def _pick(options, index: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))


def fault_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Six faults per station of the table, placed by arithmetic on the station id."""
    s = F.col("station_id")
    i = F.col("i")
    mixed = F.when((s + i) % 4 == 0, "humidity").when((s + i) % 4 == 1, "pressure").otherwise("temperature")
    hour = (i * 100 + 10 + (s * 37) % 80).cast("int")
    return (
        station_ids(spark, sf)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(SPEC_FAULTS) - 1))))
        .select(
            (s * 10 + i).alias("seq"),
            F.when(i == 5, "temperature").otherwise(mixed).alias("variable"),
            _pick(SPEC_FAULTS, i).alias("fault"),
            "station_id",
            F.timestamp_add("HOUR", hour, F.lit(SPEC_ORIGIN).cast("timestamp_ntz")).alias("start_ts"),
            _pick(FAULT_DURATIONS, (s * 3 + i) % 5).cast("bigint").alias("duration"),
            _pick(SEVERITIES, (s + i) % 3).alias("severity"),
        )
    )


# Fixed values: (variable, fault, hours after the first fault, duration) in the order of application.
OVERLAPS = (("temperature", "drift", 0, 6), ("humidity", "spike", 1, 3), ("temperature", "frozen", 2, 4), ("temperature", "drop", 3, 2))


def overlapping_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Four faults per station that share readings."""
    s = F.col("station_id")
    rows = [F.struct(F.lit(i).alias("i"), *[F.lit(x).alias(n) for n, x in zip(("variable", "fault", "after", "duration"), o)]) for i, o in enumerate(OVERLAPS)]
    hour = (F.lit(10) + (s * 37) % 80 + F.col("o.after")).cast("int")
    return station_ids(spark, sf).withColumn("o", F.explode(F.array(*rows))).select(
        (s * 10 + F.col("o.i")).alias("seq"),
        "o.variable",
        "o.fault",
        "station_id",
        F.timestamp_add("HOUR", hour, F.lit(SPEC_ORIGIN).cast("timestamp_ntz")).alias("start_ts"),
        F.col("o.duration").cast("bigint").alias("duration"),
        F.lit("moderate").alias("severity"),
    )


def row_spec(spark: SparkSession, sf: str, fault: str, amount: float, duration: int) -> DataFrame:
    """One row-position fault per station."""
    s = F.col("station_id")
    return station_ids(spark, sf).select(
        s.alias("seq"),
        "station_id",
        (F.lit(5) + s % 7).alias("start_row"),
        F.lit(duration).cast("bigint").alias("duration"),
        F.lit("temperature").alias("variable"),
        F.lit(fault).alias("fault"),
        F.lit(amount).alias("amount"),
        F.lit("severe").alias("severity"),
    )


def faulty(spark: SparkSession, sf: str, faults=SPEC_FAULTS) -> DataFrame:
    obs = observations(spark, sf)
    spec = stage(fault_spec(spark, sf).filter(F.col("fault").isin(*faults)), "spec")
    return inject.inject_faults(obs, spec)


def isolation_stand_in() -> Column:
    """Deterministic stand-in for the forest's vote, so that SQL can repeat it."""
    return flag(holds(F.abs("temperature_zscore_24h") > 2.5))


def ml_score_stand_in() -> Column:
    """Deterministic stand-in for the forest's score in [0, 1]."""
    return F.coalesce(F.least(F.abs("temperature_zscore_24h") / 5.0, F.lit(1.0)), F.lit(0.0))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled readings are written once, as the feature job reads them several times."""
    return features.temporal_features(stage(faulty(spark, sf), "faulty"))


def voted(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.detector_votes(featured(spark, sf), isolation_stand_in())


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    return voted(spark, sf).withColumn("predicted", flag(F.col("anomaly_score") >= 1))


def ensembled(spark: SparkSession, sf: str) -> DataFrame:
    base = features.baseline_24h(stage(faulty(spark, sf), "faulty")).withColumn("ml_anomaly_score", ml_score_stand_in())
    return detectors.ensemble(base)


def diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    """Features and votes are written once; thresholds and labels read them back."""
    return diagnosis.diagnose(stage(voted(spark, sf), "votes"))


def corrected(spark: SparkSession, sf: str) -> DataFrame:
    return correction.correct_by_rules(stage(diagnosed(spark, sf), "diagnosed"))


def with_method(df: DataFrame) -> DataFrame:
    return df.withColumn("correction_method", F.when(F.col("correction_applied") == 1, "rule_based").otherwise("none"))


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return stage(profile.station_dim(observations(spark, sf)), "stations")
