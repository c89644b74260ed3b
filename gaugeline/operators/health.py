"""Sensor health: running penalty ledger and rate-based status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, QCConfig
from gaugeline.functions.columns import health_status, penalty, rate_status
from gaugeline.operators.slices import with_running_sum


def health_ledger(df: DataFrame, fault: Column, start: int = 100, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Health after each reading: points start at 100, fall per fault, stop at 0.

    Penalties are never negative, so taking the running sum first and stopping at
    zero afterwards equals the step-by-step fold.
    """
    out = with_running_sum(df, penalty(fault), "_lost", cfg.slice_hours)
    out = out.withColumn("health_score", F.greatest(F.lit(0), F.lit(start) - F.col("_lost")).cast("bigint"))
    return out.withColumn("health_status", health_status(F.col("health_score"))).drop("_lost")


def station_health(df: DataFrame) -> DataFrame:
    """Records, anomalies, corrections and risk status per station."""
    out = df.groupBy("station_name").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("is_anomaly").alias("anomalies"),
        F.sum("correction_applied").alias("corrections"),
    )
    percent = F.col("anomalies") / F.col("records") * 100
    return out.withColumns({"anomaly_rate": F.bround(percent, 2), "health_status": rate_status(percent)})
