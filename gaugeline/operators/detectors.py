"""Row flags, votes, scores and threshold tables on top of the features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, TRUTH_COLUMNS, QCConfig
from gaugeline.functions import columns as C
from gaugeline.schema import require_columns


def quality_control(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    require_columns(df, ["temperature", "humidity", "pressure"])
    return df.withColumns(C.qc_flag_columns(cfg))


def qc_totals(df: DataFrame) -> DataFrame:
    flags = ["temperature_rule_flag", "humidity_rule_flag", "pressure_rule_flag", "qc_flag"]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(f).alias(f) for f in flags])


def detector_votes(df: DataFrame, isolation: Column, cfg: QCConfig = DEFAULT) -> DataFrame:
    """The four 0/1 votes and their sum. `isolation` is the forest's flag column."""
    require_columns(df, ["temperature_zscore_24h", "temperature_std_6h", "repeat_length"])
    out = df.withColumns(
        {
            "rule_score": C.qc_flag_columns(cfg)["qc_flag"],
            "statistical_score": C.statistical_vote(cfg),
            "isolation_score": isolation,
            "temporal_score": C.temporal_vote(cfg),
        }
    )
    return out.withColumn("anomaly_score", C.vote_total())


def ensemble(df: DataFrame, ml_score: str = "ml_anomaly_score", cfg: QCConfig = DEFAULT) -> DataFrame:
    """Range flag, temporal z score, weighted score, severity band and reason text."""
    out = df.withColumn("statistical_anomaly", C.tight_range_flag(cfg)).withColumns(C.temporal_z_columns(cfg))
    out = out.withColumns(C.ensemble_columns(ml_score, cfg))
    return out.withColumns(
        {"severity": C.severity_band(F.col("ensemble_score")), "reason": C.reason_text(ml_score, cfg)}
    )


def check_feature_list(features: Sequence[str]) -> list[str]:
    """Refuse ground truth among model features."""
    leaked = [f for f in features if f in TRUTH_COLUMNS]
    if leaked:
        raise ValueError(f"Ground-truth columns may not be features: {leaked}")
    return list(features)


def rule_combinations(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Row counts for every combination of the temporal-pattern rules."""
    conds = C.pattern_conditions(cfg)
    return df.groupBy(*[cond.cast("int").alias(name) for name, cond in conds.items()]).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def combination_hits(df: DataFrame, combos: dict[str, tuple[str, Column]]) -> DataFrame:
    """Hits on one fault class and on normal rows per AND-combination, in one pass.

    `combos` maps a name to (fault type, condition).
    """
    normal = F.col("is_anomaly") == 0
    wide = df.agg(
        *[
            F.struct(
                F.lit(name).alias("combo"),
                F.count_if((F.col("fault_type") == fault) & cond).alias("fault_hits"),
                F.count_if(F.col("fault_type") == fault).alias("fault_rows"),
                F.count_if(normal & cond).alias("normal_hits"),
            ).alias(f"c{i}")
            for i, (name, (fault, cond)) in enumerate(combos.items())
        ]
    )
    return wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(combos))])))


def threshold_sweep(df: DataFrame, sweeps: dict[str, tuple[Column, Sequence[float], bool]]) -> DataFrame:
    """Rows at or beyond each threshold, for several measures at once, in one pass.

    `sweeps` maps a name to (measure, thresholds, inclusive).
    """
    cells = []
    for name, (measure, thresholds, inclusive) in sweeps.items():
        for t in thresholds:
            limit = F.lit(float(t))
            hit = measure >= limit if inclusive else measure > limit
            cells.append((name, float(t), F.count_if(hit)))
    total = F.count(F.lit(1))
    wide = df.agg(
        *[
            F.struct(
                F.lit(name).alias("measure"), F.lit(t).alias("threshold"), hits.alias("n_hits"), total.alias("n_rows")
            ).alias(f"c{i}")
            for i, (name, t, hits) in enumerate(cells)
        ]
    )
    rows = wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(cells))])))
    return rows.withColumn("percent", F.col("n_hits") / F.nullif(F.col("n_rows"), F.lit(0)) * 100)


def explanations(df: DataFrame, label: str = "diagnosed_fault") -> DataFrame:
    return df.withColumn("explanation", C.explanation_text(label))
