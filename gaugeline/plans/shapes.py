"""Output columns of the named queries, shared by the Spark side and the SQL side.

A leading "~" marks a computed floating-point column that both sides round to six
decimals, because engines add floats in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = "station_id ts"
_BASE = "~{v}_rolling_mean_24h ~{v}_rolling_std_24h ~{v}_deviation_24h"
_TRUTH = "original_temperature original_humidity original_pressure is_anomaly fault_type fault_severity"
_INJECTED = f"{KEYS} ~temperature ~humidity ~pressure {_TRUTH}"
_PRF = "~precision ~recall ~f1"
_QUANT = "column_name n ~mean ~std ~min ~p25 ~p50 ~p75 ~max"
_CONSENSUS = "neighbor_count normal_neighbors anomalous_neighbors ~neighbor_average"

SHAPES: dict[str, str] = {
    # sources and sinks
    "src_csv_clean": f"{KEYS} station_name temperature humidity pressure wind_speed",
    "obs_normalize": "ts station_id station_name latitude longitude temperature humidity pressure wind_speed",
    "obs_union": f"{KEYS} temperature humidity wind_speed",
    "stage_handoff": f"{KEYS} temperature humidity pressure qc_flag",
    "enrich_metadata": f"{KEYS} temperature station_name latitude longitude",
    "enrich_match_report": "n_rows n_matched",
    "handoff_mismatch": "n_rows n_mismatch",
    # profiling
    "null_profile": "n_rows column_name n_null",
    "describe_readings": _QUANT,
    "describe_abs_z": "column_name n ~mean ~std ~min ~p90 ~p95 ~p99 ~p99_5 ~p99_9 ~max",
    "dup_keys": f"{KEYS} n_rows",
    "cadence_hist": "station_id ~gap_hours n_rows",
    "gap_count": "station_id n_gaps",
    "station_catalog": "station_id station_name last_ts n_rows",
    "station_dim": "station_id station_name latitude longitude",
    "calendar_features": f"{KEYS} hour day month day_of_week day_of_year time_period",
    "time_period_counts": "time_period n_rows",
    "week_slice": f"{KEYS} temperature humidity pressure",
    "latest_per_station": f"{KEYS} station_name temperature humidity pressure wind_speed",
    "top_hot": f"{KEYS} temperature",
    "recent_readings": f"{KEYS} temperature humidity pressure",
    "anomaly_context": f"{KEYS} event_ts ~temperature is_anomaly fault_type",
    "impute_median": f"{KEYS} ~temperature ~humidity ~pressure",
    "standardize": f"{KEYS} ~temperature_scaled ~humidity_scaled ~pressure_scaled",
    # features
    "baseline_24h": f"{KEYS} " + " ".join(_BASE.format(v=v) for v in ("temperature", "pressure", "humidity")),
    "zscore_24h": f"{KEYS} ~temperature_zscore_24h ~pressure_zscore_24h ~humidity_zscore_24h",
    "baseline_24rows": f"{KEYS} {_BASE.format(v='temperature')} ~temperature_zscore_24h",
    "step_change": f"{KEYS} ~temperature_change ~absolute_temperature_change ~temperature_change_6h",
    "rolling_std_6": f"{KEYS} ~temperature_std_6h ~temperature_std_6h_live",
    "trend_6": f"{KEYS} ~temperature_trend_6h",
    "residual_6_12": f"{KEYS} ~previous_6h_median ~local_temperature_residual ~previous_12h_median ~local_residual_12h",
    "repeat_length": f"{KEYS} repeat_length",
    "max_run": "station_id max_run",
    "run_hist": "repeat_length n_runs n_rows",
    "run_entry_jump": "column_name n ~mean ~std ~min ~p50 ~p90 ~max",
    "direction_counts": f"{KEYS} rises_6h falls_6h",
    "trajectory_change": f"{KEYS} ~trajectory_change",
    "sign_flips": f"{KEYS} sign_flips",
    "cum_change_6": f"{KEYS} ~cum_change_6h",
    "same_as_prev": "station_id n_rows n_same ~same_share",
    # detectors
    "qc_flags": f"{KEYS} temperature_rule_flag humidity_rule_flag pressure_rule_flag qc_flag",
    "qc_totals": "n_rows temperature_rule_flag humidity_rule_flag pressure_rule_flag qc_flag",
    "stat_range_flag": f"{KEYS} statistical_anomaly",
    "temporal_z": f"{KEYS} temporal_anomaly ~temporal_z_score",
    "statistical_vote": f"{KEYS} statistical_score",
    "temporal_vote": f"{KEYS} temporal_score temporal_score_no_std temporal_score_tight_std",
    "ensemble_score": f"{KEYS} ~ensemble_score ensemble_prediction",
    "severity_bands": "severity n_rows",
    "reasons": f"{KEYS} reason",
    "vote_score": f"{KEYS} rule_score statistical_score isolation_score temporal_score anomaly_score",
    "rule_combos": "sudden_change frozen_pattern extreme_trend n_rows",
    "combo_hits": "combo fault_hits fault_rows normal_hits",
    "threshold_sweep": "measure threshold n_hits n_rows ~percent",
    "explanations": f"{KEYS} diagnosed_fault explanation",
    # spatial
    "station_pairs_500km": "a b ~km",
    "unknown_keys": KEYS,
    "neighbors_100km": "a b ~km",
    "knn_neighbors": "a b ~km rank",
    "latest_spatial_check": f"{KEYS} temperature n_neighbors ~neighbor_average ~spatial_difference",
    "neighbor_avg": f"{KEYS} station_value ~neighbor_average ~spatial_difference",
    "neighbor_consensus": f"{KEYS} {_CONSENSUS} neighbor_values_text",
    "evidence_class": f"{KEYS} evidence_score classification reasons_text",
    "spatial_correct": f"{KEYS} classification ~corrected_value",
    "loo_consistency": f"{KEYS} ~temperature ~neighbor_avg_temperature neighbor_count ~spatial_deviation spatial_classification",
    "station_pivot": "block ts " + " ".join(f"~c{k}" for k in range(100)),
    "spatial_boost": f"{KEYS} diagnosed_fault spatial_classification ~diagnosis_confidence",
    "spatial_merge": f"{KEYS} ~neighbor_avg_temperature neighbor_count spatial_classification",
    "regional_heat": "ts station_count ~average_temperature ~max_temperature ~min_temperature",
    "candidate_times": "ts station_count ~average_temperature ~min_temperature ~max_temperature",
    "spatial_batch": f"{KEYS} ~station_value {_CONSENSUS} classification evidence_score fault_type ~corrected_value health_score health_status",
    # diagnosis and correction
    "robust_threshold": "station_id ~thr_change ~thr_residual ~thr_spread ~thr_cumulative ~low_spread",
    "diagnose_faults": f"{KEYS} diagnosed_fault ~diagnosis_confidence",
    "interpolate_gaps": f"{KEYS} temperature ~temperature_filled",
    "correct_rule": f"{KEYS} diagnosed_fault ~temperature_original ~temperature_corrected correction_applied",
    "health_ledger": f"{KEYS} health_score health_status",
    "station_health": "station_name records anomalies corrections ~anomaly_rate health_status",
    # injection
    "inject_spike_abs": _INJECTED,
    "inject_spike": _INJECTED,
    "inject_drop": _INJECTED,
    "inject_frozen": _INJECTED,
    "inject_drift": _INJECTED,
    "inject_missing": _INJECTED,
    "inject_multivariate": _INJECTED,
    "inject_drift_rows": _INJECTED,
    "inject_noise": "station_id ts ~temperature ~original_temperature is_anomaly fault_type form",
    "inject_frozen_rows": _INJECTED,
    "inject_missing_rows": _INJECTED,
    "inject_overlap": _INJECTED,
    "invalid_specs": "station_id seq start_row duration problem",
    "schedule_overlaps": "seq station_id",
    "fault_schedule": "seq variable fault station_id start_ts duration severity",
    "fault_schedule_each": "seq variable fault station_id start_ts duration severity",
    "fault_islands": "station_id region_start region_end n_rows",
    "fault_summary": "fault_type fault_severity n_rows",
    "fault_crosstab": "station_id normal temperature_spike temperature_drop temperature_frozen temperature_drift temperature_missing multivariate_inconsistency",
    "injection_diff": f"{KEYS} fault_type fault_severity before_temperature ~after_temperature before_humidity ~after_humidity before_pressure ~after_pressure",
    # evaluation
    "confusion": "truth prediction n_rows",
    "class_report": f"label {_PRF} support",
    "roc_auc": "~auc n_pos n_neg",
    "roc_auc_by_detector": "detector ~auc",
    "prf_by_fault": f"fault_type n_rows tp fn fp {_PRF}",
    "prf_by_severity": f"fault_severity n_rows tp fn fp {_PRF}",
    "prf_by_station": f"station_name tp fp fn {_PRF}",
    "detector_metrics": f"detector predicted hits {_PRF}",
    "vote_sweep": f"threshold predicted hits {_PRF}",
    "detection_rate": "fault_type n_rows n_detected ~rate",
    "feature_by_fault": "fault_type n ~min ~mean ~median ~max",
    "detector_count": "fault_type n_rows ~mean_votes min_votes max_votes votes_0 votes_1 votes_2 votes_3 votes_4",
    "correction_error": "fault_type n n_corrected ~mae ~rmse",
    "match_rate": "fault_type n ~match_rate",
    "model_agreement": "n_rows ~accuracy ~precision ~recall ~old_truth_recall ~new_truth_recall",
    "diag_distribution": "diagnosed_fault n_rows n_corrected",
    "diag_crosstab": "fault_type normal suspicious missing spike frozen drift noise",
    # monitoring marts
    "kpi": "station_name records anomalies normal corrections ~anomaly_rate status",
    "latest_alert": "ts station_id station_name diagnosed_fault ~diagnosis_confidence ~temperature ~temperature_corrected",
    "fault_counts": "diagnosed_fault n_rows is_fault",
    "method_counts": "correction_method n_rows",
    "confidence_hist": "bin n_rows",
    "signal_means": "detector ~mean_vote",
    "station_compare": "station_name total_records anomalies ~anomaly_rate",
    "series_overlay": f"{KEYS} ~temperature ~temperature_corrected is_anomaly diagnosed_fault rule_score statistical_score isolation_score temporal_score anomaly_score",
    # streams, read to the end
    "stream_qc": f"{KEYS} temperature_rule_flag humidity_rule_flag pressure_rule_flag qc_flag statistical_anomaly",
    "stream_dedup": KEYS,
    "stream_sliding": "station_id window_start n_rows n_flagged ~mean_temperature",
    "stream_kpis": "station_id window_start n_rows n_flagged ~mean_temperature",
    "stream_causal_votes": f"{KEYS} ~temperature_zscore_24h running_length rule_score statistical_score temporal_score",
    "stream_late_votes": f"{KEYS} ~temperature_zscore_24h running_length rule_score statistical_score temporal_score",
    "stream_health": f"{KEYS} health_score health_status",
}


def shaped(df: DataFrame, name: str) -> DataFrame:
    """Select a query's columns, rounding the marked ones."""
    out = []
    for c in SHAPES[name].split():
        out.append(F.round(F.col(c[1:]), 6).alias(c[1:]) if c.startswith("~") else F.col(c))
    return df.select(*out)


def shaped_sql(name: str) -> str:
    """The same select list as SQL; adding zero turns -0.0 into 0.0."""
    out = []
    for c in SHAPES[name].split():
        out.append(f"round({c[1:]}, 6) + 0e0 AS {c[1:]}" if c.startswith("~") else c)
    return ", ".join(out)
