"""Fault-shape diagnosis from features, votes and per-station robust thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, NORMAL, SUSPICIOUS, VOTES, QCConfig
from gaugeline.functions.columns import holds
from gaugeline.operators.quantiles import robust_thresholds
from gaugeline.operators.staging import join_dim, stage
from gaugeline.schema import require_columns

REQUIRED = (
    "station_id",
    "ts",
    "temperature",
    "temperature_change",
    "absolute_temperature_change",
    "local_temperature_residual",
    "temperature_std_6h",
    "repeat_length",
    "sign_flips",
    "cum_change_6h",
    *VOTES,
)


def shape_measures() -> dict[str, Column]:
    """What the thresholds are taken over, by name."""
    return {
        "change": F.col("absolute_temperature_change"),
        "residual": F.abs(F.col("local_temperature_residual")),
        "spread": F.col("temperature_std_6h"),
        "cumulative": F.abs(F.col("cum_change_6h")),
    }


def station_thresholds(features: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """thr_change, thr_residual, thr_spread, thr_cumulative and low_spread per station.

    The features are read several times, a few columns each: pass a stored stage.
    """
    narrow = features.select("station_id", *[c.alias(n) for n, c in shape_measures().items()])
    factors = {
        "change": cfg.spike_k,
        "residual": cfg.residual_k,
        "spread": cfg.noise_std_k,
        "cumulative": cfg.drift_change_k,
    }
    return robust_thresholds(
        narrow, ["station_id"], factors, cfg.percentile_group_rows, extra={"spread": cfg.frozen_std_quantile}
    )


def label_columns(cfg: QCConfig = DEFAULT) -> dict[str, Column]:
    """diagnosed_fault and diagnosis_confidence, from features joined to thresholds.

    Candidates exclude each other before the votes are asked: an unconfirmed
    spike candidate ends up normal, it does not turn into noise or drift.
    """
    m = shape_measures()
    change, residual, spread, cumulative = (m[k] for k in ("change", "residual", "spread", "cumulative"))
    flips = F.col("sign_flips")
    missing = F.col("temperature").isNull()
    spike = ~missing & (holds(change > F.col("thr_change")) | holds(residual > F.col("thr_residual")))
    frozen = ~missing & ~spike & holds(
        (F.col("repeat_length") >= cfg.frozen_min_repeat) & (spread <= F.col("low_spread"))
    )
    noise = ~missing & ~spike & ~frozen & holds((flips >= cfg.noise_flip_min) & (spread > F.col("thr_spread")))
    drift = ~missing & ~spike & ~frozen & ~noise & holds(
        (cumulative > F.col("thr_cumulative")) & (flips <= cfg.drift_flip_max)
    )
    fired = holds(F.greatest(*[F.coalesce(F.col(v), F.lit(0)) for v in VOTES]) > 0)

    label = (
        F.when(missing, "MISSING")
        .when(spike & fired, "SPIKE")
        .when(frozen & fired, "FROZEN")
        .when(noise, "NOISE")
        .when(drift & fired, "DRIFT")
        .when(fired, SUSPICIOUS)
        .otherwise(NORMAL)
    )

    def ratio(value: Column, limit: str) -> Column:
        """Share of twice the limit, capped at 1; a null ratio stays null."""
        capped = F.when(value.isNotNull(), F.least(value / F.col(limit), F.lit(2.0)))
        return F.when(holds(F.col(limit) > 0), capped / 2).otherwise(0.0)

    frozen_part = F.when(
        holds(F.col("low_spread") > 0),
        F.when(spread.isNotNull(), 1 - F.least(spread / F.col("low_spread"), F.lit(1.0))),
    ).otherwise(0.0)
    confidence = (
        F.when(missing, 1.0)
        .when(spike & fired, ratio(change, "thr_change"))
        .when(frozen & fired, frozen_part)
        .when(noise, ratio(spread, "thr_spread"))
        .when(drift & fired, ratio(cumulative, "thr_cumulative"))
        .when(fired, 0.4)
        .otherwise(0.0)
    )
    return {"diagnosed_fault": label, "diagnosis_confidence": F.bround(confidence, 2)}


THRESHOLDS = ("thr_change", "thr_residual", "thr_spread", "thr_cumulative", "low_spread")


def diagnose(features: DataFrame, thresholds: DataFrame | None = None, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Label every reading. `thresholds` may come from an earlier run (live use)."""
    require_columns(features, REQUIRED)
    if thresholds is None:
        thresholds = stage(station_thresholds(features, cfg), "thresholds")
    joined = join_dim(features, thresholds, ["station_id"], spread="ts", max_rows=cfg.broadcast_rows)
    return joined.withColumns(label_columns(cfg)).drop(*THRESHOLDS)
