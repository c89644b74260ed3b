"""Tables behind a monitoring screen, from diagnosed and corrected readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.config import NORMAL, VOTES


def monitored(df: DataFrame) -> DataFrame:
    """Null labels read as normal; the anomaly flag follows the diagnosis, not the truth."""
    label = F.coalesce(F.col("diagnosed_fault"), F.lit(NORMAL))
    return df.withColumns(
        {
            "diagnosed_fault": label,
            "is_anomaly": F.when(F.upper(label) != NORMAL, 1).otherwise(0),
            "correction_applied": F.coalesce(F.col("correction_applied"), F.lit(0)),
        }
    )


def kpi(df: DataFrame) -> DataFrame:
    """One row per station and one for all stations."""
    percent = F.coalesce(F.col("anomalies") / F.nullif(F.col("records"), F.lit(0)) * 100, F.lit(0.0))
    status = F.when(F.col("anomalies") == 0, "Normal").when(percent < 5, "Monitoring").otherwise("Elevated")
    out = df.rollup("station_name").agg(
        F.grouping("station_name").alias("_total"),
        F.count(F.lit(1)).alias("records"),
        F.sum("is_anomaly").alias("anomalies"),
        F.sum("correction_applied").alias("corrections"),
    )
    return out.select(
        F.when(F.col("_total") == 1, "All Stations").otherwise(F.col("station_name")).alias("station_name"),
        "records",
        "anomalies",
        (F.col("records") - F.col("anomalies")).alias("normal"),
        "corrections",
        percent.alias("anomaly_rate"),
        status.alias("status"),
    )


def latest_alert(df: DataFrame) -> DataFrame:
    cols = ("ts", "station_id", "station_name", "diagnosed_fault", "diagnosis_confidence", "temperature", "temperature_corrected")
    return (
        df.filter(F.col("is_anomaly") == 1)
        .agg(F.max_by(F.struct(*cols), F.struct("ts", "station_id")).alias("_row"))
        .select("_row.*")
    )


def fault_counts(df: DataFrame) -> DataFrame:
    """Rows per label, and their share of the anomalies."""
    return df.groupBy(F.upper("diagnosed_fault").alias("diagnosed_fault")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("is_anomaly").alias("is_fault")
    )


def method_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("correction_applied") == 1)
        .groupBy(F.coalesce(F.col("correction_method"), F.lit("Unknown")).alias("correction_method"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def confidence_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in equal bins between the smallest and largest confidence of the anomalies."""
    rows = df.filter((F.col("is_anomaly") == 1) & F.col("diagnosis_confidence").isNotNull())
    low, high = rows.agg(F.min("diagnosis_confidence"), F.max("diagnosis_confidence")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0
    bin_no = F.least(F.floor((F.col("diagnosis_confidence") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return rows.groupBy(bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def signal_means(df: DataFrame, votes: Sequence[str] = VOTES) -> DataFrame:
    """Mean vote per detector, null counted as 0."""
    wide = df.agg(*[F.bround(F.avg(F.coalesce(F.col(v), F.lit(0))), 4).alias(v) for v in votes])
    return wide.unpivot([], list(votes), "detector", "mean_vote")


def station_comparison(df: DataFrame) -> DataFrame:
    out = df.groupBy("station_name").agg(
        F.count(F.lit(1)).alias("total_records"), F.sum("is_anomaly").alias("anomalies")
    )
    return out.withColumn("anomaly_rate", F.bround(F.col("anomalies") / F.col("total_records") * 100, 2))


def series_overlay(df: DataFrame) -> DataFrame:
    """Value, corrected value, flag and votes in (station, time) order."""
    return df.select(
        "station_id", "ts", "temperature", "temperature_corrected", "is_anomaly", "diagnosed_fault", *VOTES, "anomaly_score"
    ).orderBy("station_id", "ts")
