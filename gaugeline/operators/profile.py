"""Profiling, audits and small projections of observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, QCConfig
from gaugeline.functions.columns import calendar_columns, time_period
from gaugeline.operators.features import inter_arrival
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.operators.slices import epoch_seconds

READINGS = ("temperature", "humidity", "pressure", "wind_speed")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count of every column, one row per column, from one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot(["_n"], columns, "column_name", "n_null").withColumnRenamed("_n", "n_rows")


def describe(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    cfg: QCConfig = DEFAULT,
) -> DataFrame:
    """count, mean, std, min, quantiles and max per column, as rows."""
    columns, probs = list(columns), list(probs)
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    ).withColumn("_one", F.lit(1))
    quants = exact_quantiles(df.select(*columns), [], {c: probs for c in columns}, cfg.percentile_group_rows)
    both = moments.join(quants.withColumn("_one", F.lit(1)), "_one")  # two one-row tables
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                *[F.col(f"{c}.{f}").alias(f) for f in ("n", "mean", "std", "min")],
                *[F.get(f"q_{c}", F.lit(i)).alias(quantile_name(p)) for i, p in enumerate(probs)],
                F.col(f"{c}.max").alias("max"),
            )
            for c in columns
        ]
    )
    return both.select(F.inline(rows))


def quantile_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy("station_id", "ts").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def deduplicate(df: DataFrame, order: Column | str) -> DataFrame:
    """Keep, per (station, ts), the row that comes first by `order`; no sort needed."""
    rest = [c for c in df.columns if c not in ("station_id", "ts")]
    return (
        df.groupBy("station_id", "ts").agg(F.min_by(F.struct(*rest), order).alias("_row")).select("station_id", "ts", "_row.*")
    )


def cadence_histogram(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    gaps = inter_arrival(df, cfg).filter(F.col("gap_seconds").isNotNull())
    return gaps.groupBy("station_id", (F.col("gap_seconds") / 3600).alias("gap_hours")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def gap_counts(df: DataFrame, max_hours: int = 1, cfg: QCConfig = DEFAULT) -> DataFrame:
    return inter_arrival(df, cfg).groupBy("station_id").agg(
        F.count_if(F.col("gap_seconds") > max_hours * 3600).alias("n_gaps")
    )


def station_catalog(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(
        F.min_by("station_name", "ts").alias("station_name"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def station_dim(df: DataFrame) -> DataFrame:
    """One row per station: its first name and position."""
    first = lambda c: F.min_by(c, "ts").alias(c)
    return df.groupBy("station_id").agg(first("station_name"), first("latitude"), first("longitude"))


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns())


def time_period_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(time_period(F.hour("ts")).alias("time_period")).agg(F.count(F.lit(1)).alias("n_rows"))


def time_slice(df: DataFrame, station_id: int, start: str, end: str) -> DataFrame:
    """One station's readings in [start, end); both filters reach the scan of a stored table."""
    ts = F.col("ts")
    return df.filter(
        (F.col("station_id") == station_id)
        & (ts >= F.lit(start).cast("timestamp_ntz"))
        & (ts < F.lit(end).cast("timestamp_ntz"))
    )


def latest_per_station(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "station_id"]
    return df.groupBy("station_id").agg(F.max_by(F.struct(*rest), "ts").alias("_row")).select("station_id", "_row.*")


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """A top-k report; the order must be total for a stable result."""
    return df.orderBy(*order).limit(k)


def context_windows(df: DataFrame, events: DataFrame, hours: int = 3) -> DataFrame:
    """Readings within +-hours of each event of the same station.

    Range join on time buckets of the window's width: an event meets its own and
    the two adjacent buckets, so the join key is (station, bucket), never the
    station alone.
    """
    width = hours * 3600
    bucket = F.floor(epoch_seconds() / width)
    marks = events.select("station_id", F.col("ts").alias("event_ts")).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(epoch_seconds("event_ts") / width) - 1, F.floor(epoch_seconds("event_ts") / width) + 1))
    )
    readings = df.withColumn("_bucket", bucket)
    apart = F.abs(epoch_seconds("ts") - epoch_seconds("event_ts"))
    return readings.join(marks, ["station_id", "_bucket"]).filter(apart <= width).drop("_bucket")


def impute_median(df: DataFrame, columns: Sequence[str], cfg: QCConfig = DEFAULT) -> DataFrame:
    """Fill nulls of each column with its median over the whole table."""
    med = exact_quantiles(df.select(*columns), [], {c: [0.5] for c in columns}, cfg.percentile_group_rows).first()
    # one row of medians: literals keep the fill inside the scan stage
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[f"q_{c}"][0] if med[f"q_{c}"] else None)) for c in columns})


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant column is only centred."""
    stats = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        mean, sd = stats[c]
        out[f"{c}_scaled"] = (F.col(c) - F.lit(mean)) / F.lit(sd if sd else 1.0)
    return df.withColumns(out)
