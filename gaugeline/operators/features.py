"""Per-station time-series features over past readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, VARIABLES, QCConfig
from gaugeline.operators.slices import (
    HALO,
    SLICE,
    drop_halo,
    finish_runs,
    slice_window,
    with_lookback,
    without_slices,
)

LAST_24H = (
    "RANGE BETWEEN INTERVAL '23:59:59.999999' HOUR TO SECOND PRECEDING AND CURRENT ROW"
)


def _over_last_day(agg: str) -> Column:
    return F.expr(f"{agg} OVER (PARTITION BY station_id, _slice ORDER BY ts {LAST_24H})")


def _median_of(values: Column, min_count: int) -> Column:
    """Median of an array without nulls, null below min_count values."""
    ordered = F.sort_array(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n >= min_count, (low + high) / 2)


def _past(rows: int):
    return slice_window().rowsBetween(-rows, 0)


# --- feature blocks on a table that already has its look-back -------------------
# Each block is a dict of columns, so a job adds all lags in one step, all frames
# in the next, and Spark keeps one sort for all of them.


def lag_columns(variables, depth: int = 6) -> dict[str, Column]:
    """Previous value of each variable, and deeper lags of temperature."""
    w = slice_window()
    lags = {f"_prev_{v}": F.lag(v).over(w) for v in variables}
    lags.update({f"_lag{n}": F.lag("temperature", n).over(w) for n in range(1, depth + 1)})
    return lags


def time_baseline_columns(variable: str, min_rows: int) -> dict[str, Column]:
    """24-hour mean and spread of the readings shifted by one row, then framed by time."""
    prev = f"_prev_{variable}"
    enough = _over_last_day(f"count({prev})") >= min_rows
    return {
        f"{variable}_rolling_mean_24h": F.when(enough, _over_last_day(f"avg({prev})")),
        f"{variable}_rolling_std_24h": F.when(enough, _over_last_day(f"stddev_samp({prev})")),
    }


def row_baseline_columns(variable: str, min_rows: int, rows: int) -> dict[str, Column]:
    """The same baseline over the last `rows` shifted readings, whatever their age."""
    prev, frame = f"_prev_{variable}", _past(rows - 1)
    enough = F.count(prev).over(frame) >= min_rows
    return {
        f"{variable}_rolling_mean_24h": F.when(enough, F.avg(prev).over(frame)),
        f"{variable}_rolling_std_24h": F.when(enough, F.stddev_samp(prev).over(frame)),
    }


def deviation_columns(variable: str) -> dict[str, Column]:
    deviation = F.col(variable) - F.col(f"{variable}_rolling_mean_24h")
    return {
        f"{variable}_deviation_24h": deviation,
        f"{variable}_zscore_24h": deviation / F.nullif(F.col(f"{variable}_rolling_std_24h"), F.lit(0.0)),
    }


def change_columns() -> dict[str, Column]:
    """Steps and slopes of temperature from its lags."""
    t = F.col("temperature")
    l1, l2, l3, l4, l5, l6 = [F.col(f"_lag{n}") for n in range(1, 7)]
    zero_filled = F.coalesce(t - l1, F.lit(0.0))
    return {
        "temperature_change": t - l1,
        "absolute_temperature_change": F.abs(t - l1),
        "temperature_change_6h": t - l6,
        # least-squares slope over positions 0..5; null unless all six are present
        "temperature_trend_6h": (2.5 * t + 1.5 * l1 + 0.5 * l2 - 0.5 * l3 - 1.5 * l4 - 2.5 * l5) / 17.5,
        "trajectory_change": F.abs((t - l2) / 2 - (l3 - l5) / 2),
        "_step": zero_filled,
        # sign of the step, and of the step before it (its own sign on a first row)
        "_sign": F.signum(zero_filled),
        "_sign_before": F.when(l1.isNull() & l2.isNull(), None).otherwise(F.signum(F.coalesce(l1 - l2, F.lit(0.0)))),
    }


def frame_columns(std_min_rows: int) -> dict[str, Column]:
    """Spread, medians of past rows, directions, flips and sums over the last rows."""
    six, twelve = _past(5), _past(11)
    change = F.col("temperature_change")
    counted = F.count(change).over(six) >= 3
    prev = F.col("_prev_temperature")
    return {
        "temperature_std_6h": F.when(
            F.count("temperature").over(six) >= std_min_rows, F.stddev_samp("temperature").over(six)
        ),
        "previous_6h_median": _median_of(F.collect_list(prev).over(six), 3),
        "previous_12h_median": _median_of(F.collect_list(prev).over(twelve), 6),
        "rises_6h": F.when(counted, F.count(F.when(change > 0, 1)).over(six)),
        "falls_6h": F.when(counted, F.count(F.when(change < 0, 1)).over(six)),
        "sign_flips": F.sum("_flip").over(six),
        "cum_change_6h": F.sum("_step").over(six),
    }


def residual_columns() -> dict[str, Column]:
    return {
        "local_temperature_residual": F.abs(F.col("temperature") - F.col("previous_6h_median")),
        "local_residual_12h": F.abs(F.col("temperature") - F.col("previous_12h_median")),
    }


def _drop_private(df: DataFrame) -> DataFrame:
    keep = (SLICE, HALO)
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in keep])


def _merge(*blocks: dict[str, Column]) -> dict[str, Column]:
    return {name: col for block in blocks for name, col in block.items()}


# --- operators --------------------------------------------------------------------


def baseline_24h(df: DataFrame, variables=VARIABLES, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Past-only 24-hour mean, deviation and z-score of each variable."""
    out = with_lookback(df, rows=25, hours=24, carry=list(variables), slice_hours=cfg.slice_hours)
    out = (
        out.withColumns(lag_columns(variables, depth=0))
        .withColumns(_merge(*[time_baseline_columns(v, cfg.baseline_min_rows) for v in variables]))
        .withColumns(_merge(*[deviation_columns(v) for v in variables]))
    )
    return without_slices(_drop_private(drop_halo(out)))


def baseline_rows(df: DataFrame, variables=VARIABLES, rows: int = 24, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Past-only mean, deviation and z-score over the last `rows` readings."""
    out = with_lookback(df, rows=rows, carry=list(variables), slice_hours=cfg.slice_hours)
    out = (
        out.withColumns(lag_columns(variables, depth=0))
        .withColumns(_merge(*[row_baseline_columns(v, cfg.baseline_min_rows, rows) for v in variables]))
        .withColumns(_merge(*[deviation_columns(v) for v in variables]))
    )
    return without_slices(_drop_private(drop_halo(out)))


def shape_features(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Steps, 6-row spread and slope, past medians, directions and flips of temperature."""
    out = with_lookback(df, rows=12, carry=["temperature"], slice_hours=cfg.slice_hours)
    out = _shape(out.withColumns(lag_columns(["temperature"])), {}, cfg)
    return without_slices(_drop_private(drop_halo(out)))


def rolling_std(df: DataFrame, outputs: dict[str, int], rows: int = 6, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Sample deviation over the last rows, one column per minimum row count."""
    out = with_lookback(df, rows=rows, carry=["temperature"], slice_hours=cfg.slice_hours)
    frame = _past(rows - 1)
    spread, count = F.stddev_samp("temperature").over(frame), F.count("temperature").over(frame)
    out = out.withColumns({name: F.when(count >= need, spread) for name, need in outputs.items()})
    return without_slices(drop_halo(out))


def _shape(lagged: DataFrame, frames: dict[str, Column], cfg: QCConfig) -> DataFrame:
    flip = F.when(F.col("_sign_before") != F.col("_sign"), 1).otherwise(0)
    return (
        lagged.withColumns(change_columns())
        .withColumn("_flip", flip)
        .withColumns(_merge(frames, frame_columns(cfg.std_min_rows)))
        .withColumns(residual_columns())
    )


def temporal_features(df: DataFrame, variables=VARIABLES, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Baselines, shape features and run lengths: the input of detectors and diagnosis.

    All of them share one shuffle and one sort of the readings.
    """
    out = with_lookback(df, rows=25, hours=24, carry=list(variables), slice_hours=cfg.slice_hours)
    out = out.withColumns(lag_columns(variables))
    baselines = _merge(*[time_baseline_columns(v, cfg.baseline_min_rows) for v in variables])
    out = _shape(out, baselines, cfg).withColumns(_merge(*[deviation_columns(v) for v in variables]))
    return finish_runs(_drop_private(drop_halo(out)), "temperature")


def run_histogram(df: DataFrame) -> DataFrame:
    """Number of runs of each length, from a table with `repeat_length`.

    A run of n rows contributes n rows, so rows / n counts runs without locating them.
    """
    return df.groupBy("repeat_length").agg(
        F.expr("count(*) div repeat_length").alias("n_runs"), F.count(F.lit(1)).alias("n_rows")
    )


def longest_run(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(F.max("repeat_length").alias("max_run"))


def run_entry_jumps(df: DataFrame, min_run: int = 6) -> DataFrame:
    """Step sizes seen inside long runs; the non-zero ones are the entries."""
    return df.filter(F.col("repeat_length") >= min_run).select(
        "station_id", "ts", "repeat_length", F.col("absolute_temperature_change").alias("jump")
    )


def same_as_previous(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Share of readings equal to the one before, per station."""
    out = with_lookback(df, rows=1, carry=["temperature"], slice_hours=cfg.slice_hours)
    same = F.coalesce(F.col("temperature") == F.lag("temperature").over(slice_window()), F.lit(False))
    out = drop_halo(out.withColumn("_same", F.when(same, 1).otherwise(0)))
    return out.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("_same").alias("n_same"),
        F.avg("_same").alias("same_share"),
    )


def inter_arrival(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Hours since the station's previous reading."""
    keyed = df.select("station_id", "ts")
    out = with_lookback(keyed, rows=1, slice_hours=cfg.slice_hours)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    out = out.withColumn("gap_seconds", seconds - F.lag(seconds).over(slice_window()))
    return without_slices(drop_halo(out))
