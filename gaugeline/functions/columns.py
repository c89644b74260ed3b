"""Column expressions: calendar, rules, votes, scores, texts and geometry.

They are plain expressions, so the same functions serve tables and streams.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, DEFAULT_PENALTY, FAULT_FAMILIES, FAULT_PENALTIES, NORMAL, VARIABLES, VOTES, QCConfig

EARTH_RADIUS_KM = 6371.0


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def holds(condition: Column) -> Column:
    """The condition with unknown read as false, safe to negate."""
    return F.coalesce(condition, F.lit(False))


def finite_or_null(col: Column) -> Column:
    """NaN and infinities become null, so comparisons with them are never true."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(col) | (F.abs(col) == inf), None).otherwise(col)


# --- calendar -----------------------------------------------------------------


def calendar_columns(ts: str = "ts") -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "day_of_week": F.weekday(ts),
        "day_of_year": F.dayofyear(ts),
    }


def time_period(hour: Column) -> Column:
    return (
        F.when((hour >= 5) & (hour < 12), "Morning")
        .when((hour >= 12) & (hour < 17), "Afternoon")
        .when((hour >= 17) & (hour < 21), "Evening")
        .otherwise("Night")
    )


# --- row rules ----------------------------------------------------------------


def outside(col: str, limits: tuple[float, float]) -> Column:
    low, high = limits
    return (F.col(col) < low) | (F.col(col) > high)


def qc_flag_columns(cfg: QCConfig = DEFAULT) -> dict[str, Column]:
    """Plausibility flags; a missing reading is flagged."""
    limits = {
        "temperature": cfg.temperature_limits,
        "humidity": cfg.humidity_limits,
        "pressure": cfg.pressure_limits,
    }
    bad = {v: F.col(v).isNull() | outside(v, lim) for v, lim in limits.items()}
    flags = {f"{v}_rule_flag": flag(cond) for v, cond in bad.items()}
    flags["qc_flag"] = flag(bad["temperature"] | bad["humidity"] | bad["pressure"])
    return flags


def tight_range_flag(cfg: QCConfig = DEFAULT) -> Column:
    """Tight physical range; a missing reading is not flagged."""
    return flag(
        holds(outside("temperature", cfg.tight_temperature))
        | holds(outside("pressure", cfg.tight_pressure))
        | holds(outside("humidity", cfg.tight_humidity))
    )


def max_abs_z() -> Column:
    return F.greatest(*[F.abs(F.col(f"{v}_zscore_24h")) for v in VARIABLES])


def temporal_z_columns(cfg: QCConfig = DEFAULT) -> dict[str, Column]:
    m = max_abs_z()
    return {
        "temporal_anomaly": flag(m > cfg.z_limit),
        "temporal_z_score": F.coalesce(F.least(m, F.lit(cfg.z_cap)) / F.lit(cfg.z_cap), F.lit(0.0)),
    }


def statistical_vote(cfg: QCConfig = DEFAULT) -> Column:
    return flag(
        holds(F.abs("temperature_zscore_24h") > cfg.z_limit)
        | holds(F.abs("temperature_deviation_24h") > cfg.deviation_limit)
    )


def pattern_conditions(cfg: QCConfig = DEFAULT) -> dict[str, Column]:
    frozen = F.col("repeat_length") >= cfg.freeze_run
    if cfg.freeze_std is not None:
        frozen = frozen & (F.col("temperature_std_6h") <= cfg.freeze_std)
    return {
        "sudden_change": holds(F.col("absolute_temperature_change") > cfg.change_limit),
        "frozen_pattern": holds(frozen),
        "extreme_trend": holds(F.abs("temperature_trend_6h") > cfg.trend_limit),
    }


def temporal_vote(cfg: QCConfig = DEFAULT) -> Column:
    c = pattern_conditions(cfg)
    return flag(c["sudden_change"] | c["frozen_pattern"] | c["extreme_trend"])


def vote_total() -> Column:
    first, *rest = [F.col(v) for v in VOTES]
    for v in rest:
        first = first + v
    return first


# --- scores and texts ---------------------------------------------------------


def ensemble_columns(ml_score: str = "ml_anomaly_score", cfg: QCConfig = DEFAULT) -> dict[str, Column]:
    score = cfg.weight_temporal * F.col("temporal_z_score") + cfg.weight_ml * F.col(ml_score)
    return {"ensemble_score": score, "ensemble_prediction": flag(score >= cfg.ensemble_cut)}


def severity_band(score: Column) -> Column:
    return F.when(score < 0.30, "Normal").when(score < 0.60, "Low").when(score < 0.80, "Medium").otherwise("High")


# Sentences of the reason text.
REASON_TEXT = {
    "temperature": "Temperature deviates strongly from recent baseline",
    "pressure": "Pressure deviates strongly from recent baseline",
    "humidity": "Humidity deviates strongly from recent baseline",
    "ml": "ML model identifies unusual multivariate pattern",
    "none": "No significant anomaly detected",
}


def reason_text(ml_score: str = "ml_anomaly_score", cfg: QCConfig = DEFAULT) -> Column:
    parts = [F.when(F.abs(f"{v}_zscore_24h") > cfg.z_limit, REASON_TEXT[v]) for v in VARIABLES]
    parts.append(F.when(F.col(ml_score) > cfg.reason_ml_cut, REASON_TEXT["ml"]))
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(REASON_TEXT["none"]))


# Sentences of the live explanation.
VOTE_TEXT = {
    "rule_score": "Physical-range quality check flagged the reading",
    "statistical_score": "Statistical deviation from the 24h station baseline",
    "isolation_score": "Saved Isolation Forest flagged a multivariate anomaly",
    "temporal_score": "Temporal pattern (sudden change / freeze / extreme trend)",
}
EXPLAIN_TEXT = {
    "context": "Insufficient station history or feature context for confident diagnosis",
    "quiet": "No detector evidence of anomaly; reading consistent with recent station history",
    "mixed": "Detectors raised weak/mixed signals but primary diagnosis remains NORMAL; ",
    "suspicious": "Detector evidence without a confident specific fault type",
    "label": "Primary diagnosis: ",
}
INSUFFICIENT = "INSUFFICIENT CONTEXT"


def explanation_text(label: str = "diagnosed_fault") -> Column:
    parts = F.concat_ws("; ", *[F.when(F.col(v) == 1, text) for v, text in VOTE_TEXT.items()])
    tail = lambda sep: F.when(parts == "", "").otherwise(F.concat(F.lit(sep), parts))
    diagnosis = F.col(label)
    return (
        F.when(diagnosis == INSUFFICIENT, EXPLAIN_TEXT["context"])
        .when((diagnosis == NORMAL) & (parts == ""), EXPLAIN_TEXT["quiet"])
        .when(diagnosis == NORMAL, F.concat(F.lit(EXPLAIN_TEXT["mixed"]), parts))
        .when(diagnosis == "SUSPICIOUS", F.concat(F.lit(EXPLAIN_TEXT["suspicious"]), tail(": ")))
        .otherwise(F.concat(F.lit(EXPLAIN_TEXT["label"]), diagnosis, tail(". ")))
    )


def sigmoid(raw: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))


# --- health -------------------------------------------------------------------


def penalty(fault: Column) -> Column:
    """Points lost for a fault; 0 for null, the default for an unlisted one."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(FAULT_PENALTIES.items())])
    return F.when(fault.isNull(), 0).otherwise(F.coalesce(F.try_element_at(table, fault), F.lit(DEFAULT_PENALTY)))


def health_status(score: Column) -> Column:
    return F.when(score >= 80, "GREEN").when(score >= 50, "YELLOW").otherwise("RED")


def rate_status(percent: Column) -> Column:
    return F.when(percent < 2, "Healthy").when(percent < 5, "Watch").otherwise("At Risk")


def true_family(fault_type: Column) -> Column:
    lowered = F.lower(fault_type)
    out = None
    for family in FAULT_FAMILIES:
        hit = lowered.contains(family.lower())
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


# --- geometry -----------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
