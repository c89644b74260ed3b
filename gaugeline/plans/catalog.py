"""The named queries: every operator applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, QCConfig
from gaugeline.functions import columns as C
from gaugeline.operators import (
    correction,
    detectors,
    diagnosis,
    evaluate,
    features,
    health,
    iforest,
    inject,
    marts,
    profile,
    spatial,
)
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.operators.slices import interpolate, with_run_length
from gaugeline.operators.staging import new_table_path, stage
from gaugeline.plans import demo
from gaugeline.plans.shapes import SHAPES, shaped
from gaugeline.sources import files
from gaugeline.sources.events import event_readings, observations, reading_columns, station_ids
from gaugeline.streaming import jobs, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its name, with its declared columns."""
    name = fn.__name__
    QUERIES[name] = (lambda spark, sf: shaped(fn(spark, sf), name)) if name in SHAPES else fn
    return fn


# --- sources and sinks ------------------------------------------------------------


@query
def src_csv_clean(spark, sf):
    columns = SHAPES["src_csv_clean"].split()
    path = new_table_path(spark, "csv")
    files.write_stage(observations(spark, sf), path, columns, fmt="csv")
    return files.read_observations_csv(spark, path, columns)


@query
def obs_normalize(spark, sf):
    obs = observations(spark, sf)
    raw = obs.select(
        "station_id",
        F.col("ts").alias("time"),
        F.col("temperature").alias("temp"),
        F.col("humidity").alias("rhum"),
        F.col("pressure").alias("pres"),
        F.col("wind_speed").alias("wspd"),
    )
    return files.normalize_provider(raw, demo.stations(spark, sf))


@query
def obs_union(spark, sf):
    obs = observations(spark, sf)
    even = obs.filter(F.col("station_id") % 2 == 0).select("station_id", "ts", "temperature", "humidity")
    odd = obs.filter(F.col("station_id") % 2 == 1).select("station_id", "ts", "temperature", "wind_speed")
    return files.union_feeds([even, odd])


@query
def stage_handoff(spark, sf):
    columns = SHAPES["stage_handoff"].split()
    path = new_table_path(spark, "handoff")
    files.write_stage(detectors.quality_control(observations(spark, sf)), path, columns, day_folders=True)
    return files.read_stage(spark, path)


def _enriched(spark, sf):
    obs = observations(spark, sf)
    meta = obs.filter(F.col("station_id") % 3 != 0).select("ts", "station_id", "station_name", "latitude", "longitude")
    return files.enrich_metadata(obs.select("station_id", "ts", "temperature"), meta)


@query
def enrich_metadata(spark, sf):
    return _enriched(spark, sf)


@query
def enrich_match_report(spark, sf):
    return files.match_report(_enriched(spark, sf))


@query
def handoff_mismatch(spark, sf):
    results = demo.faulty(spark, sf)
    severity = F.when(F.col("station_id") % 4 == 0, "mild").otherwise(F.col("fault_severity"))
    return files.handoff_mismatch(results, results.withColumn("fault_severity", severity))


# --- profiling --------------------------------------------------------------------


@query
def null_profile(spark, sf):
    return profile.null_profile(observations(spark, sf))


@query
def describe_readings(spark, sf):
    return profile.describe(observations(spark, sf), ["temperature", "humidity", "pressure", "wind_speed"])


@query
def describe_abs_z(spark, sf):
    measures = demo.featured(spark, sf).select(
        F.abs("temperature_zscore_24h").alias("abs_zscore"),
        F.col("absolute_temperature_change").alias("abs_change"),
        F.abs("temperature_deviation_24h").alias("abs_deviation"),
        F.abs("temperature_trend_6h").alias("abs_trend"),
        F.col("temperature_std_6h").alias("std_6h"),
    )
    measures = stage(measures, "measures")
    return profile.describe(measures, measures.columns, (0.9, 0.95, 0.99, 0.995, 0.999))


@query
def dup_keys(spark, sf):
    return profile.duplicate_keys(event_readings(spark.read.parquet(f"{sf}/events.parquet")))


@query
def cadence_hist(spark, sf):
    return profile.cadence_histogram(observations(spark, sf))


@query
def gap_count(spark, sf):
    return profile.gap_counts(observations(spark, sf))


@query
def station_catalog(spark, sf):
    return profile.station_catalog(observations(spark, sf))


@query
def station_dim(spark, sf):
    return profile.station_dim(observations(spark, sf))


@query
def calendar_features(spark, sf):
    return profile.calendar_features(observations(spark, sf)).withColumn("time_period", C.time_period(F.col("hour")))


@query
def time_period_counts(spark, sf):
    return profile.time_period_counts(observations(spark, sf))


@query
def week_slice(spark, sf):
    return profile.time_slice(observations(spark, sf), 1, "2024-01-08", "2024-01-15")


@query
def latest_per_station(spark, sf):
    return profile.latest_per_station(observations(spark, sf))


@query
def top_hot(spark, sf):
    order = [F.col("temperature").desc_nulls_last(), F.col("ts"), F.col("station_id")]
    return profile.top_rows(observations(spark, sf), order, 20)


@query
def recent_readings(spark, sf):
    return profile.top_rows(observations(spark, sf), [F.col("ts").desc(), F.col("station_id")], 10)


@query
def anomaly_context(spark, sf):
    df = demo.faulty(spark, sf)
    return profile.context_windows(df, df.filter(F.col("is_anomaly") == 1), hours=3)


@query
def impute_median(spark, sf):
    return profile.impute_median(observations(spark, sf), ["temperature", "humidity", "pressure"])


@query
def standardize(spark, sf):
    return profile.standardize(observations(spark, sf), ["temperature", "humidity", "pressure"])


# --- features ---------------------------------------------------------------------


@query
def baseline_24h(spark, sf):
    return features.baseline_24h(observations(spark, sf))


@query
def zscore_24h(spark, sf):
    return features.baseline_24h(observations(spark, sf))


@query
def baseline_24rows(spark, sf):
    return features.baseline_rows(observations(spark, sf), ["temperature"])


def _shape_query(name: str) -> Query:
    """Only the windows of the asked columns survive column pruning."""

    def run(spark, sf):
        return features.shape_features(observations(spark, sf))

    run.__name__ = name
    return query(run)


for _name in ("step_change", "trend_6", "residual_6_12", "direction_counts", "trajectory_change", "sign_flips", "cum_change_6"):
    _shape_query(_name)


@query
def rolling_std_6(spark, sf):
    return features.rolling_std(observations(spark, sf), {"temperature_std_6h": 6, "temperature_std_6h_live": 2})


def _runs(spark, sf):
    return with_run_length(stage(demo.faulty(spark, sf), "faulty"), "temperature")


@query
def repeat_length(spark, sf):
    return _runs(spark, sf)


@query
def max_run(spark, sf):
    return features.longest_run(_runs(spark, sf))


@query
def run_hist(spark, sf):
    return features.run_histogram(_runs(spark, sf))


@query
def run_entry_jump(spark, sf):
    jumps = features.run_entry_jumps(demo.featured(spark, sf), min_run=3)
    return profile.describe(stage(jumps, "jumps"), ["jump"], (0.5, 0.9))


@query
def same_as_prev(spark, sf):
    return features.same_as_previous(demo.faulty(spark, sf))


# --- detectors --------------------------------------------------------------------


@query
def qc_flags(spark, sf):
    return detectors.quality_control(observations(spark, sf))


@query
def qc_totals(spark, sf):
    return detectors.qc_totals(detectors.quality_control(observations(spark, sf)))


@query
def stat_range_flag(spark, sf):
    return demo.faulty(spark, sf).withColumn("statistical_anomaly", C.tight_range_flag())


@query
def temporal_z(spark, sf):
    return demo.ensembled(spark, sf)


@query
def statistical_vote(spark, sf):
    return features.baseline_24h(demo.faulty(spark, sf)).withColumn("statistical_score", C.statistical_vote())


@query
def temporal_vote(spark, sf):
    return demo.featured(spark, sf).withColumns(
        {
            "temporal_score": C.temporal_vote(),
            "temporal_score_no_std": C.temporal_vote(QCConfig(freeze_std=None)),
            "temporal_score_tight_std": C.temporal_vote(QCConfig(freeze_std=0.1)),
        }
    )


# What the two published forests read.
FOREST_FEATURES = ["temperature", "pressure", "humidity"]
FOREST_SHAPE_FEATURES = [
    "temperature",
    "temperature_change",
    "absolute_temperature_change",
    "temperature_std_6h",
    "temperature_trend_6h",
    "local_temperature_residual",
    "local_residual_12h",
    "repeat_length",
]


def _observed_rate(df):
    """Share of rows the earlier vote flags: the contamination of a retrained forest."""
    return df.agg(F.avg("isolation_score")).first()[0]


@query
def iforest_flags(spark, sf):
    scored, _ = iforest.isolation_ensemble(stage(demo.faulty(spark, sf), "faulty"), FOREST_FEATURES, 0.05)
    return scored.select("station_id", "ts", "isolation_raw", "isolation_anomaly", "ml_anomaly_score")


@query
def iforest_score_stats(spark, sf):
    df = stage(demo.voted(spark, sf), "votes")
    scored, _ = iforest.isolation_ensemble(df, FOREST_SHAPE_FEATURES, _observed_rate(df))
    return profile.describe(scored, ["isolation_raw", "ml_anomaly_score"], (0.01, 0.05, 0.5, 0.95, 0.99))


@query
def iforest_lowest(spark, sf):
    """The ten most isolated readings: a top-k report."""
    scored, _ = iforest.isolation_ensemble(stage(demo.faulty(spark, sf), "faulty"), FOREST_FEATURES, 0.05)
    order = [F.col("isolation_raw").desc(), F.col("station_id"), F.col("ts")]
    return profile.top_rows(scored, order, 10).select("station_id", "ts", "temperature", "isolation_raw")


@query
def iforest_reload_score(spark, sf):
    """A saved forest scores without a new fit; the raw score becomes a probability-like value."""
    df = stage(demo.faulty(spark, sf), "faulty")
    path = new_table_path(spark, "forest-model")
    iforest.fit_iforest(df, FOREST_FEATURES).save(spark, path)
    forest = iforest.IsolationForest.load(spark, path)
    scored = forest.flag(df)
    ml = C.sigmoid(F.col("isolation_raw") - F.lit(forest.offset))
    return scored.select("station_id", "ts", "isolation_raw", "isolation_score", F.round(ml, 4).alias("ml_anomaly_score"))


@query
def ensemble_score(spark, sf):
    return demo.ensembled(spark, sf)


@query
def ensemble_forest(spark, sf):
    """The full detection job with the real forest in place of the stand-in."""
    base = stage(features.baseline_24h(demo.faulty(spark, sf)), "baselines")
    scored, _ = iforest.isolation_ensemble(base, FOREST_FEATURES, 0.05)
    return detectors.ensemble(scored).select(
        "station_id", "ts", "isolation_anomaly", "ensemble_score", "ensemble_prediction", "severity", "reason"
    )


@query
def severity_bands(spark, sf):
    return demo.ensembled(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def reasons(spark, sf):
    return demo.ensembled(spark, sf)


@query
def vote_score(spark, sf):
    return demo.voted(spark, sf)


@query
def rule_combos(spark, sf):
    return detectors.rule_combinations(demo.featured(spark, sf).filter(F.col("is_anomaly") == 0))


@query
def combo_hits(spark, sf):
    std, change = F.col("temperature_std_6h"), F.col("absolute_temperature_change")
    residual, run = F.col("local_temperature_residual"), F.col("repeat_length")
    combos = {
        "std > 2": ("temperature_drift", std > 2),
        "std > 2 AND change > 4": ("temperature_drift", (std > 2) & (change > 4)),
        "std > 2 AND residual > 4": ("temperature_drift", (std > 2) & (residual > 4)),
        "change > 4 AND residual > 4": ("temperature_spike", (change > 4) & (residual > 4)),
        "repeat >= 6 AND std <= 1.0": ("temperature_frozen", (run >= 6) & (std <= 1.0)),
        "repeat >= 6 AND std <= 0.25": ("temperature_frozen", (run >= 6) & (std <= 0.25)),
    }
    return detectors.combination_hits(demo.featured(spark, sf), combos)


@query
def threshold_sweep(spark, sf):
    # Candidate thresholds per measure.
    sweeps = {
        "deviation": (F.abs("temperature_deviation_24h"), (5, 6, 7, 8, 9, 10), False),
        "zscore": (F.abs("temperature_zscore_24h"), (1.5, 2, 2.5, 3), False),
        "change": (F.col("absolute_temperature_change"), (3, 4, 5, 6, 8, 10), False),
        "run_length": (F.col("repeat_length"), (4, 5, 6, 7, 8, 10), True),
        "change_6h": (F.abs("temperature_change_6h"), (3, 4, 5, 6, 7, 8, 10), False),
        "trend": (F.abs("temperature_trend_6h"), (1, 1.5, 2, 2.5, 3), False),
    }
    return detectors.threshold_sweep(demo.featured(spark, sf).filter(F.col("is_anomaly") == 0), sweeps)


@query
def explanations(spark, sf):
    return detectors.explanations(demo.diagnosed(spark, sf))


# --- spatial ----------------------------------------------------------------------


@query
def station_pairs_500km(spark, sf):
    """Pairs within a radius, which `station_pairs` always asks for."""
    return spatial.station_pairs(demo.stations(spark, sf), max_km=500.0)


@query
def neighbors_100km(spark, sf):
    return spatial.neighbors(demo.stations(spark, sf))


@query
def knn_neighbors(spark, sf):
    return spatial.nearest_stations(demo.stations(spark, sf), k=3)


@query
def latest_spatial_check(spark, sf):
    return spatial.latest_spatial_check(observations(spark, sf))


@query
def neighbor_avg(spark, sf):
    out = spatial.neighbor_summary(observations(spark, sf), demo.stations(spark, sf))
    return out.withColumn("spatial_difference", F.abs(F.col("station_value") - F.col("neighbor_average")))


def _consensus(spark, sf, df, values=False):
    return spatial.neighbor_summary(df, demo.stations(spark, sf), flag_col="predicted", collect_values=values)


@query
def neighbor_consensus(spark, sf):
    out = _consensus(spark, sf, demo.predicted(spark, sf), values=True)
    text = F.transform("neighbor_values", lambda v: F.format_string("%.3f", v).try_cast("double").cast("string"))
    return out.withColumn("neighbor_values_text", F.array_join(text, ","))


def _evidence(spark, sf, df):
    summary = _consensus(spark, sf, df)
    both = summary.join(df.select("station_id", "ts", "isolation_score", "statistical_score", "last_valid"), ["station_id", "ts"])
    return spatial.classify_evidence(both, "isolation_score", "statistical_score")


@query
def evidence_class(spark, sf):
    df = stage(demo.predicted(spark, sf).withColumn("last_valid", F.lit(None).cast("double")), "predicted")
    return _evidence(spark, sf, df).withColumn("reasons_text", F.array_join("reasons", "|"))


@query
def spatial_correct(spark, sf):
    df = stage(demo.predicted(spark, sf), "predicted")
    return spatial.correct_by_neighbors(_evidence(spark, sf, spatial.last_valid_values(df)), "last_valid")


def _flagged_consistency(spark, sf):
    diag = stage(demo.diagnosed(spark, sf), "diagnosed")
    flagged = diag.filter(F.col("diagnosed_fault") != "NORMAL")
    return diag, spatial.leave_one_out(flagged, observations(spark, sf))


@query
def loo_consistency(spark, sf):
    return _flagged_consistency(spark, sf)[1]


@query
def station_pivot(spark, sf):
    return spatial.station_pivot(observations(spark, sf))


@query
def spatial_boost(spark, sf):
    return spatial.boost_confidence(_flagged_consistency(spark, sf)[1])


@query
def spatial_merge(spark, sf):
    diag, checked = _flagged_consistency(spark, sf)
    return spatial.merge_spatial(diag, checked)


@query
def regional_heat(spark, sf):
    return spatial.regional_heat(observations(spark, sf))


@query
def candidate_times(spark, sf):
    return spatial.candidate_times(observations(spark, sf), 10.0, 20.0)


@query
def spatial_batch(spark, sf):
    df = stage(demo.predicted(spark, sf), "predicted")
    listed = df.filter((F.col("isolation_score") == 1) | (F.col("statistical_score") == 1)).select(
        "station_id", "ts", F.col("isolation_score").alias("ml_anomaly"), F.col("statistical_score").alias("temporal_anomaly")
    )
    return spatial.spatial_batch(df, listed, demo.stations(spark, sf), flag_col="predicted")


@query
def unknown_keys(spark, sf):
    """Listed observations (every third of them half an hour off) that match no reading."""
    obs = observations(spark, sf)
    hot = obs.filter(F.col("temperature") > 5).select("station_id", "ts")
    off = F.when((F.col("station_id") + F.hour("ts")) % 3 == 0, F.expr("ts + INTERVAL 30 MINUTES")).otherwise(F.col("ts"))
    return spatial.unknown_observations(obs, hot.withColumn("ts", off))


# --- diagnosis and correction -----------------------------------------------------


@query
def robust_threshold(spark, sf):
    return diagnosis.station_thresholds(stage(demo.voted(spark, sf), "votes"))


@query
def diagnose_faults(spark, sf):
    return demo.diagnosed(spark, sf)


@query
def interpolate_gaps(spark, sf):
    return interpolate(observations(spark, sf), F.col("temperature"), "temperature_filled")


@query
def correct_rule(spark, sf):
    return demo.corrected(spark, sf)


def _model_job(spark, sf, trees=200):
    fixed = stage(demo.corrected(spark, sf), "corrected")
    model = correction.fit_corrector(fixed, trees=trees)
    return fixed, model


@query
def ml_corrector_fit(spark, sf):
    """What the fitted forest says on the rows it learned from."""
    fixed, model = _model_job(spark, sf)
    normal = correction.with_ml_features(fixed).filter(F.col("diagnosed_fault") == "NORMAL")
    rows = model.transform(normal.dropna(subset=[*correction.ML_FEATURES, "temperature"]))
    error = F.abs(F.col("_predicted") - F.col("temperature"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(error).alias("mae"))


@query
def correct_ml(spark, sf):
    fixed, model = _model_job(spark, sf)
    out = correction.apply_corrector(fixed, model)
    return out.select(
        "station_id",
        "ts",
        "diagnosed_fault",
        "temperature",
        "temperature_corrected",
        "temperature_corrected_rule_only",
        "temperature_corrected_ml",
        "correction_method",
        "correction_applied",
    )


@query
def diagnosis_job(spark, sf):
    """Diagnosis, rules, model and neighbour check in one run, as a compact result."""
    fixed, model = _model_job(spark, sf)
    final = stage(correction.apply_corrector(fixed, model), "final")
    checked = spatial.leave_one_out(final.filter(F.col("diagnosed_fault") != "NORMAL"), observations(spark, sf))
    merged = spatial.boost_confidence(spatial.merge_spatial(final, checked))
    return merged.groupBy("diagnosed_fault", "correction_method", "spatial_classification").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("diagnosis_confidence").alias("mean_confidence")
    )


@query
def rule_vs_ml(spark, sf):
    fixed, model = _model_job(spark, sf)
    return evaluate.rule_vs_model(correction.apply_corrector(fixed, model))


# --- health -----------------------------------------------------------------------


@query
def health_ledger(spark, sf):
    fault = F.when(F.col("is_anomaly") == 1, F.col("fault_type"))
    return health.health_ledger(demo.faulty(spark, sf), fault)


@query
def station_health(spark, sf):
    return health.station_health(marts.monitored(demo.corrected(spark, sf)))


# --- injection --------------------------------------------------------------------


@query
def inject_spike_abs(spark, sf):
    obs = observations(spark, sf)
    return inject.inject_at_rows(obs, demo.row_spec(spark, sf, "spike", 55.0, 1))


@query
def inject_drift_rows(spark, sf):
    obs = observations(spark, sf)
    return inject.inject_at_rows(obs, demo.row_spec(spark, sf, "drift", 1.0, 6))


@query
def inject_frozen_rows(spark, sf):
    obs = observations(spark, sf)
    return inject.inject_at_rows(obs, demo.row_spec(spark, sf, "frozen", 0.0, 6))


@query
def inject_missing_rows(spark, sf):
    obs = observations(spark, sf)
    return inject.inject_at_rows(obs, demo.row_spec(spark, sf, "missing", 0.0, 4))


def _inject_query(fault: str) -> Query:
    def run(spark, sf):
        return demo.faulty(spark, sf, (fault,))

    run.__name__ = f"inject_{fault}"
    return query(run)


for _name in ("spike", "drop", "frozen", "drift", "missing", "multivariate"):
    _inject_query(_name)


@query
def inject_overlap(spark, sf):
    """Four faults of each station on shared readings, applied in their order."""
    return inject.inject_faults(observations(spark, sf), demo.overlapping_spec(spark, sf))


@query
def inject_noise(spark, sf):
    """Both noise forms: sign pattern on the timed spans, normal noise on row spans."""
    obs = observations(spark, sf)
    spec = demo.fault_spec(spark, sf).filter(F.col("fault") == "drift").withColumn("fault", F.lit("noise"))
    timed = inject.inject_faults(obs, spec)
    rows = inject.inject_at_rows(obs, demo.row_spec(spark, sf, "noise", 2.0, 6))
    keep = ["station_id", "ts", "temperature", "original_temperature", "is_anomaly", "fault_type"]
    return timed.select(*keep, F.lit("timed").alias("form")).unionByName(
        rows.select(*keep, F.lit("rows").alias("form"))
    )


@query
def invalid_specs(spark, sf):
    obs = observations(spark, sf)
    s = F.col("station_id")
    spec = station_ids(spark, sf).select(
        s.alias("seq"),
        (s + F.when(s % 5 == 4, 1_000_000).otherwise(0)).alias("station_id"),
        F.when(s % 5 == 0, -1).when(s % 5 == 1, 100_000_000).otherwise(3).alias("start_row"),
        F.when(s % 5 == 2, 0).otherwise(6).alias("duration"),
    )
    return inject.invalid_row_specs(obs, spec)


@query
def fault_schedule(spark, sf):
    return inject.random_schedule(observations(spark, sf), n_faults=100)


@query
def fault_schedule_each(spark, sf):
    """One fault of each type and variable, clear of the faults that are already there."""
    df = stage(demo.faulty(spark, sf), "faulty")
    return inject.one_of_each_schedule(df, inject.fault_islands(df))


@query
def schedule_overlaps(spark, sf):
    spec = demo.fault_spec(spark, sf)
    extra = spec.filter(F.col("seq") % 3 == 0).select(
        (F.col("seq") + 1_000_000).alias("seq"),
        *[c for c in spec.columns if c not in ("seq", "start_ts", "duration")],
        F.timestamp_add("HOUR", F.lit(1), F.col("start_ts")).alias("start_ts"),
        F.lit(2).cast("bigint").alias("duration"),
    )
    return inject.overlapping_specs(spec.unionByName(extra))


@query
def fault_islands(spark, sf):
    return inject.fault_islands(demo.faulty(spark, sf))


@query
def fault_summary(spark, sf):
    return inject.fault_summary(demo.faulty(spark, sf))


@query
def fault_crosstab(spark, sf):
    return inject.fault_crosstab(demo.faulty(spark, sf), SHAPES["fault_crosstab"].split()[1:])


@query
def injection_diff(spark, sf):
    return inject.injection_diff(observations(spark, sf), demo.faulty(spark, sf))


# --- evaluation -------------------------------------------------------------------


@query
def confusion(spark, sf):
    return evaluate.confusion(demo.predicted(spark, sf), "predicted")


@query
def class_report(spark, sf):
    return evaluate.classification_report(demo.predicted(spark, sf), "predicted")


@query
def roc_auc(spark, sf):
    return evaluate.roc_auc(demo.ensembled(spark, sf), "ensemble_score")


@query
def roc_auc_by_detector(spark, sf):
    return evaluate.roc_auc_by_detector(demo.voted(spark, sf))


@query
def prf_by_fault(spark, sf):
    return evaluate.prf_by_class(stage(demo.predicted(spark, sf), "predicted"), "fault_type", None, "predicted")


@query
def prf_by_severity(spark, sf):
    df = stage(demo.predicted(spark, sf), "predicted")
    return evaluate.prf_by_class(df, "fault_severity", ["mild", "moderate", "severe"], "predicted")


@query
def prf_by_station(spark, sf):
    return evaluate.prf_by_group(demo.predicted(spark, sf), "station_name", "predicted")


@query
def detector_metrics(spark, sf):
    return evaluate.detector_metrics(demo.voted(spark, sf))


@query
def vote_sweep(spark, sf):
    return evaluate.vote_sweep(demo.voted(spark, sf))


@query
def detection_rate(spark, sf):
    return evaluate.detection_rate(demo.predicted(spark, sf), "predicted")


@query
def feature_by_fault(spark, sf):
    feature = "absolute_temperature_change"
    df = stage(demo.featured(spark, sf).select("fault_type", feature), "feature")
    middle = exact_quantiles(df, ["fault_type"], {feature: [0.5]}, DEFAULT.percentile_group_rows)
    stats = df.groupBy("fault_type").agg(
        F.count(feature).alias("n"), F.min(feature).alias("min"), F.avg(feature).alias("mean"), F.max(feature).alias("max")
    )
    return stats.join(middle.select("fault_type", F.get(f"q_{feature}", F.lit(0)).alias("median")), "fault_type")


@query
def detector_count(spark, sf):
    return evaluate.detector_count_profile(demo.voted(spark, sf))


@query
def correction_error(spark, sf):
    return evaluate.correction_error(demo.corrected(spark, sf))


@query
def match_rate(spark, sf):
    return evaluate.match_rate(demo.diagnosed(spark, sf))


@query
def model_agreement(spark, sf):
    return evaluate.model_agreement(demo.voted(spark, sf), "isolation_score", "statistical_score")


@query
def model_agreement_forest(spark, sf):
    """A forest on engineered features against one on the three readings."""
    df = stage(demo.voted(spark, sf), "votes")
    old = iforest.fit_and_flag(df, FOREST_FEATURES, _observed_rate(df), "old_flag")[0]
    new = iforest.fit_and_flag(old, FOREST_SHAPE_FEATURES, _observed_rate(df), "new_flag")[0]
    return evaluate.model_agreement(new, "old_flag", "new_flag")


@query
def diag_distribution(spark, sf):
    return evaluate.diagnosis_distribution(demo.corrected(spark, sf))


@query
def diag_crosstab(spark, sf):
    return evaluate.diagnosis_crosstab(demo.diagnosed(spark, sf))


# --- monitoring marts -------------------------------------------------------------


def _mart(spark, sf):
    return marts.monitored(demo.with_method(demo.corrected(spark, sf)))


@query
def kpi(spark, sf):
    return marts.kpi(_mart(spark, sf))


@query
def latest_alert(spark, sf):
    return marts.latest_alert(_mart(spark, sf))


@query
def fault_counts(spark, sf):
    return marts.fault_counts(_mart(spark, sf))


@query
def method_counts(spark, sf):
    return marts.method_counts(_mart(spark, sf))


@query
def confidence_hist(spark, sf):
    return marts.confidence_histogram(stage(_mart(spark, sf), "mart"))


@query
def signal_means(spark, sf):
    return marts.signal_means(demo.voted(spark, sf))


@query
def station_compare(spark, sf):
    return marts.station_comparison(_mart(spark, sf))


@query
def series_overlay(spark, sf):
    return marts.series_overlay(_mart(spark, sf))


# --- streams, read to the end -----------------------------------------------------


def _event_stream(spark, sf):
    """The stored events as a stream of raw readings."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = jobs.replay(spark, sf, schema, pattern="events.parquet")
    return event_readings(events).withColumns(reading_columns())


def _replayed(spark, df):
    path = new_table_path(spark, "history")
    jobs.write_in_time_order(df, path)
    return jobs.replay(spark, path, df.schema)


@query
def stream_qc(spark, sf):
    return jobs.run_to_end(jobs.qc_stream(_event_stream(spark, sf)))


@query
def stream_dedup(spark, sf):
    return jobs.run_to_end(jobs.dedup_stream(_event_stream(spark, sf)))


@query
def stream_kpis(spark, sf):
    stream = jobs.station_kpis(_replayed(spark, observations(spark, sf)))
    return jobs.run_latest(stream, ["station_id", "window"]).withColumn("window_start", F.col("window.start").cast("timestamp_ntz"))


@query
def stream_sliding(spark, sf):
    """Daily windows every twelve hours, those still open at the end too."""
    stream = jobs.station_kpis(_replayed(spark, observations(spark, sf)), "1 day", "12 hours")
    return jobs.run_latest(stream, ["station_id", "window"]).withColumn("window_start", F.col("window.start").cast("timestamp_ntz"))


@query
def stream_causal_votes(spark, sf):
    stream = jobs.causal_votes(_replayed(spark, observations(spark, sf)))
    return jobs.run_to_end(stream, stateful=True).withColumn("ts", F.col("event_time").cast("timestamp_ntz"))


@query
def stream_late_votes(spark, sf):
    """As stream_causal_votes, with readings that arrive up to an hour late, over several micro-batches."""
    obs = observations(spark, sf)
    arriving = obs.withColumn("arrived", F.expr("ts + make_dt_interval(0, pmod(xxhash64(station_id, ts), 2))"))
    path = new_table_path(spark, "arriving")
    files = jobs.write_in_time_order(arriving, path, "arrived", files=4)
    stream = jobs.causal_votes(jobs.replay(spark, path, arriving.schema, -(-files // 4)))
    return jobs.run_to_end(stream, stateful=True).withColumn("ts", F.col("event_time").cast("timestamp_ntz"))


@query
def stream_health(spark, sf):
    df = demo.faulty(spark, sf).withColumn("fault_type", F.when(F.col("is_anomaly") == 1, F.col("fault_type")))
    stream = jobs.health_stream(_replayed(spark, df))
    return jobs.run_to_end(stream, stateful=True).withColumn("ts", F.col("event_time").cast("timestamp_ntz"))


@query
def live_score(spark, sf):
    """Each station's newest reading scored live against the readings before it."""
    obs = stage(observations(spark, sf), "obs")
    newest = profile.latest_per_station(obs)
    history = obs.join(newest.select("station_id", "ts"), ["station_id", "ts"], "left_anti")
    return live.score_readings(newest, history, *_live_models(history))


def _live_models(history):
    """The forest and the corrector, learned from stored readings."""
    forest = iforest.fit_iforest(history, FOREST_FEATURES, trees=200)
    votes = detectors.detector_votes(features.temporal_features(history), demo.isolation_stand_in())
    fixed = stage(correction.correct_by_rules(diagnosis.diagnose(stage(votes, "votes"))), "fixed")
    return forest, correction.fit_corrector(fixed, trees=200)


@query
def stream_live_score(spark, sf):
    """Every reading scored as it arrives, in time order, against its station's last readings in state."""
    obs = stage(observations(spark, sf), "obs")
    models = _live_models(obs)
    return jobs.run_to_end(live.live_stream(_replayed(spark, obs), *models), stateful=True)
