"""Quantiles, staging, injection, evaluation, files and forest."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.config import QCConfig
from gaugeline.operators import correction, evaluate, iforest, inject, profile, quantiles, spatial, staging
from gaugeline.plans import demo
from gaugeline.sources import files
from gaugeline.sources.events import observations


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; values repeat and some are null."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7 + 1).alias("k"),
        F.when(F.col("id") % 11 != 0, F.round(F.rand(7) * F.rand(8) * 1000, 1)).alias("x"),
        F.randn(9).alias("y"),
    )
    return staging.stage(df, "skewed")


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantile_paths_agree(skewed, keys):
    probs = {"x": [0.0, 0.1, 0.5, 0.999, 1.0], "y": [0.5]}
    direct = quantiles.exact_quantiles(skewed, keys, probs)
    bracket = quantiles.exact_quantiles(skewed, keys, probs, max_group_rows=0)
    a = direct.toPandas().sort_values(keys).reset_index(drop=True) if keys else direct.toPandas()
    b = bracket.toPandas().sort_values(keys).reset_index(drop=True) if keys else bracket.toPandas()
    for c in ("q_x", "q_y"):
        np.testing.assert_allclose(np.stack(a[c]), np.stack(b[c]), rtol=0, atol=1e-9)


@pytest.mark.parametrize("limit", [0, 1, 40])
def test_selection_is_exact_whatever_the_values(spark, limit):
    """Few distinct values, huge ranges, long tails, groups of one row; the sketch's error never shows."""
    rng = np.random.default_rng(11)
    columns = {
        "a": rng.integers(0, 3, 3000).astype(float),
        "b": rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000),
        "c": np.where(rng.random(3000) < 0.9, 1.5, rng.random(3000)),
        "d": np.where(rng.random(3000) < 0.3, np.nan, rng.exponential(size=3000)),
    }
    pdf = pd.DataFrame(columns | {"k": np.where(np.arange(3000) == 0, 9, rng.integers(0, 2, 3000) * 5)})
    df = staging.stage(spark.createDataFrame(pdf).withColumn("d", F.nanvl("d", F.lit(None).cast("double"))).repartition(5), "values")
    ps = [0.0, 0.1, 0.5, 0.987, 1.0]
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], {c: ps for c in columns}, limit).collect()}
    for k, one in pdf.groupby("k"):
        for c in columns:
            want = one[c].dropna().quantile(ps)
            assert got[k][f"q_{c}"] == (pytest.approx(list(want)) if len(one[c].dropna()) else None)
    whole = quantiles.exact_quantiles(df, [], {"b": [0.5]}, limit).first()
    assert whole.q_b == pytest.approx([pdf.b.quantile(0.5)])


def test_quantile_of_empty_column_is_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, x double")
    for limit in (10, 0):
        got = {r.k: r.q_x for r in quantiles.exact_quantiles(df, ["k"], {"x": [0.5]}, limit).collect()}
        assert got[1] is None or got[1] == [None]
        assert got[2] == [3.0]


def test_zero_mad_uses_deviation(spark):
    df = spark.createDataFrame([(1, v) for v in (2.0, 2.0, 2.0, 2.0, 10.0)], "k int, x double")
    got = quantiles.robust_thresholds(df, ["k"], {"x": 5.0}).first()["thr_x"]
    assert got == pytest.approx(2 + 5 * np.std([2, 2, 2, 2, 10], ddof=1))


def test_join_dim_paths_agree(skewed, spark):
    dim = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = staging.join_dim(skewed, dim, ["k"], spread="y")
    salted = staging.join_dim(skewed, dim, ["k"], spread="y", max_rows=0)
    sums = lambda d: d.agg(F.count("*"), F.sum("v")).first()
    assert tuple(sums(small)) == tuple(sums(salted))


def test_scratch_dir_is_the_session_setting(spark):
    assert staging.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_scratch_dir_without_setting(spark, monkeypatch):
    monkeypatch.setattr(staging, "CHECKPOINT_CONF", "spark.gaugeline.unset")
    assert os.path.isdir(staging.scratch_dir(spark))
    assert staging.scratch_dir(spark) == staging.scratch_dir(spark)


def test_describe_matches_pandas(skewed):
    got = profile.describe(skewed, ["x"], (0.25, 0.5, 0.9)).first()
    x = skewed.toPandas()["x"]
    assert (got.n, got["min"], got["max"]) == (x.count(), x.min(), x.max())
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p90", 0.9)):
        assert got[name] == pytest.approx(x.quantile(p))


def test_median_fill_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (100.0, 5.0)], "x double, c double")
    assert [r.x for r in profile.impute_median(df, ["x"]).collect()] == [1.0, 3.0, 3.0, 100.0]
    assert {r.c_scaled for r in profile.standardize(df, ["c"]).collect()} == {0.0}


# --- injection --------------------------------------------------------------------


def spec(spark, *rows):
    cols = "seq long, variable string, fault string, station_id long, start_ts timestamp_ntz, duration long, severity string"
    return spark.createDataFrame([(*r[:4], pd.Timestamp(r[4]).to_pydatetime(), *r[5:]) for r in rows], cols)


def test_injected_values(spark, series):
    df = series({1: range(10, 34)})
    s = spec(
        spark,
        (1, "temperature", "spike", 1, "2025-01-01 02:00", 2, "severe"),
        (2, "temperature", "drift", 1, "2025-01-01 05:00", 3, "moderate"),
        (3, "temperature", "frozen", 1, "2025-01-01 10:00", 3, "mild"),
        (4, "temperature", "missing", 1, "2025-01-01 15:00", 1, "mild"),
        (5, "humidity", "drop", 1, "2025-01-01 18:00", 1, "moderate"),
    )
    out = inject.inject_faults(df, s).orderBy("ts").toPandas()
    t = out.temperature
    assert t[2] == 32 and t[3] == 33
    assert t[5:8].tolist() == [15.5, 17.0, 18.5]
    assert t[10:13].tolist() == [20, 20, 20]
    assert np.isnan(t[15]) and out.humidity[18] == 25.0
    assert out.original_temperature.tolist() == list(range(10, 34))
    assert out.is_anomaly.sum() == 10
    assert set(out.fault_type) == {"normal", "temperature_spike", "temperature_drift", "temperature_frozen", "temperature_missing", "humidity_drop"}


def test_row_faults_and_their_checks(spark, series):
    df = series({1: range(10), 2: range(10)})
    cols = "seq long, station_id long, start_row long, duration long, variable string, fault string, amount double, severity string"
    s = spark.createDataFrame(
        [(1, 1, 2, 1, "temperature", "spike", 55.0, "severe"), (2, 1, 5, 3, "temperature", "drift", 1.0, "mild"), (3, 2, 4, 3, "temperature", "frozen", 0.0, "mild")],
        cols,
    )
    out = inject.inject_at_rows(df, s, cfg=QCConfig(slice_hours=24)).orderBy("station_id", "ts").toPandas()
    assert out.temperature[:10].tolist() == [0, 1, 55, 3, 4, 5, 7, 9, 8, 9]
    assert out.temperature[10:].tolist() == [0, 1, 2, 3, 4, 4, 4, 7, 8, 9]
    bad = spark.createDataFrame([(1, 9, 0, 1), (2, 1, -1, 2), (3, 1, 8, 3), (4, 1, 0, 0), (5, 1, 8, 2)], "seq long, station_id long, start_row long, duration long")
    assert {r.seq for r in inject.invalid_row_specs(df, bad).collect()} == {1, 2, 3, 4}


def test_noise_is_the_same_under_any_partitioning(spark, sf):
    obs = observations(spark, sf)
    s = demo.fault_spec(spark, sf).withColumn("fault", F.lit("noise"))
    a = inject.inject_faults(obs, s).orderBy("station_id", "ts").toPandas()
    b = inject.inject_faults(obs.repartition(3), s).orderBy("station_id", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b)
    moved = a[(a.is_anomaly == 1) & a.fault_type.str.startswith("temp") & a.temperature.notna()]
    assert (abs(moved.temperature - moved.original_temperature) >= 0.4 * 5 - 1e-9).all()


def test_schedule_never_overlaps(spark, sf):
    got = inject.random_schedule(observations(spark, sf), 60)
    assert got.count() > 10
    assert inject.overlapping_specs(got).count() == 0


@pytest.mark.parametrize("one_per", [None, "turn"])
def test_first_free_is_the_greedy_choice(spark, one_per):
    """Rounds against going through the candidates one by one: ties of draws, repeated rows, a station with most of them."""
    rng = np.random.default_rng(1)
    t0 = pd.Timestamp("2024-01-01")
    rows = [(int(rng.choice([1, 1, 1, 2, 3])), t0 + pd.Timedelta(hours=int(rng.integers(0, 60))), float(rng.integers(0, 5)), int(rng.integers(0, 6)), int(rng.choice([1, 3, 9]))) for _ in range(150)]
    rows = {(r[0], r[1], r[2], r[3]): r for r in rows}.values()
    names = ["station_id", "start_ts", "draw", "turn", "duration"]
    want, turns = [], set()
    for s, at, d, t, n in sorted(rows, key=lambda r: (r[3], r[2], r[0], r[1])):
        end = at + pd.Timedelta(hours=n)
        if (one_per and t in turns) or any(k[0] == s and at < k[1] + pd.Timedelta(hours=k[4]) and end > k[1] for k in want):
            continue
        want.append((s, at, d, t, n))
        turns.add(t)
    df = spark.createDataFrame(pd.DataFrame([*rows, *list(rows)[:20]], columns=names))
    got = inject.first_free(df, one_per).toPandas()
    assert sorted(got[names].itertuples(index=False, name=None)) == sorted(want)
    assert inject.first_free(df.limit(0), one_per).count() == 0


def test_one_of_each_avoids_taken_regions(spark, sf):
    df = staging.stage(demo.faulty(spark, sf), "faulty")
    taken = inject.fault_islands(df)
    got = inject.one_of_each_schedule(df, taken, edge_rows=20).toPandas()
    assert len(got) == 10 and not got.duplicated(["variable", "fault"]).any()
    regions = taken.toPandas()
    for r in got.itertuples():
        end = r.start_ts + pd.Timedelta(hours=r.duration)
        near = regions[regions.station_id == r.station_id]
        assert not ((r.start_ts < near.region_end) & (end > near.region_start)).any()
    assert inject.overlapping_specs(spark.createDataFrame(got)).count() == 0


def test_islands_merge_over_slice_borders(spark, series):
    df = series({1: range(60)}).withColumn("is_anomaly", F.hour("ts").isin(22, 23, 0, 5).cast("int"))
    got = inject.fault_islands(df, cfg=QCConfig(slice_hours=24)).orderBy("region_start").toPandas()
    assert got.n_rows.tolist() == [1, 1, 3, 1, 3, 1]


# --- evaluation -------------------------------------------------------------------


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 1.0), (1, 2.0)], "is_anomaly int, s double")
    assert evaluate.roc_auc(df, "s").first().auc == 0.875
    assert evaluate.roc_auc(df.filter("is_anomaly = 1"), "s").first().auc is None


def test_auc_in_parts_agrees(skewed):
    df = skewed.select((F.col("k") == 0).cast("int").alias("is_anomaly"), (F.col("y") + (F.col("k") == 0).cast("int")).alias("s"))
    direct = evaluate.roc_auc(df, "s").first().auc
    cut = evaluate.roc_auc(df, "s", part_scores=100).first().auc
    assert direct == pytest.approx(cut, abs=1e-12)


# --- files ------------------------------------------------------------------------


def test_bad_csv_values_become_null(spark, tmp_path):
    path = os.path.join(tmp_path, "obs.csv")
    with open(path, "w") as f:
        f.write("timestamp,station_id,temperature,humidity\n2025-01-01 00:00:00,42182,abc,50\nnot a time,42182,1,2\n2025-01-01 01:00:00,42182.0,NaN,51\n,x,1,1\n")
    df = files.read_observations_csv(spark, path, ["timestamp", "station_id", "temperature", "humidity"])
    rows = df.orderBy("ts").collect()
    assert [(r.station_id, r.temperature, r.humidity) for r in rows] == [(42182, None, 50.0), (42182, None, 51.0)]


def test_day_folders_prune(spark, series):
    path = staging.new_table_path(spark, "days")
    files.write_stage(series({1: range(72)}), path, ["station_id", "ts", "temperature"], day_folders=True)
    df = files.read_stage(spark, path).filter(F.col("day") == "2025-01-02")
    assert df.count() == 24
    assert "PartitionFilters: [isnotnull(day" in df._jdf.queryExecution().executedPlan().toString()


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a", 2, 5.0), (1, "a", 1, 6.0), (2, "a", 1, 7.0)], "station_id long, ts string, n int, x double")
    got = profile.deduplicate(df, "n").orderBy("station_id").collect()
    assert [(r.station_id, r.x) for r in got] == [(1, 6.0), (2, 7.0)]


def test_time_filter_reaches_a_stored_table(spark, series):
    df = staging.stage(series({1: range(72)}), "pushed")
    plan = profile.time_slice(df, 1, "2025-01-02", "2025-01-03").select("temperature")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(station_id,1)" in plan
    assert "humidity" not in plan


# --- models -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    x[:10] += 12
    pdf = pd.DataFrame(x, columns=["temperature", "pressure", "humidity"])
    pdf.insert(0, "station_id", np.arange(2000) % 3)
    pdf.insert(1, "ts", pd.date_range("2025-01-01", periods=2000, freq="h"))
    return staging.stage(spark.createDataFrame(pdf), "cloud")


FEATURES = ["temperature", "pressure", "humidity"]


def test_forest_finds_outliers_and_ignores_partitioning(cloud):
    forest = iforest.fit_iforest(cloud, FEATURES, contamination=0.01, trees=50)
    again = iforest.fit_iforest(cloud.repartition(5), FEATURES, contamination=0.01, trees=50)
    pd.testing.assert_frame_equal(forest.nodes, again.nodes)
    out = forest.flag(cloud).toPandas()
    far = out.temperature > 8
    assert out[far].isolation_raw.min() > out[~far].isolation_raw.quantile(0.99)
    assert out.isolation_score.sum() == pytest.approx(20, abs=2)


@pytest.mark.parametrize("contamination", ["auto", 0.01])
def test_forest_flags_from_one_scoring(cloud, contamination):
    want = iforest.fit_iforest(cloud, FEATURES, contamination, trees=20)
    flagged, forest = iforest.fit_and_flag(cloud, FEATURES, contamination, "hit", trees=20)
    assert forest.offset == want.offset
    a, b = (x.orderBy("station_id", "ts").toPandas() for x in (want.flag(cloud, "hit"), flagged))
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_forest_survives_saving(cloud, spark):
    forest = iforest.fit_iforest(cloud, FEATURES, trees=20)
    path = staging.new_table_path(spark, "forest")
    forest.save(spark, path)
    loaded = iforest.IsolationForest.load(spark, path)
    a, b = forest.score(cloud).toPandas(), loaded.score(cloud).toPandas()
    np.testing.assert_allclose(a.isolation_raw, b.isolation_raw)


@pytest.mark.parametrize("psi", [10, 128, 600, 1000])
def test_forest_samples_follow_one_rule(cloud, psi):
    """From few rows of many to all rows: distinct rows for each tree, enough of them, whatever the partitioning."""
    n, trees = 2000, 12
    key = F.col("station_id"), F.col("ts"), F.col("tree"), F.col("_draw")
    got = iforest._hashed_samples(cloud, n, psi, trees, 42).select(*key).toPandas()
    again = iforest._hashed_samples(cloud.repartition(7), n, psi, trees, 42).select(*key).toPandas()
    by = ["tree", "station_id", "ts"]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), again.sort_values(by, ignore_index=True))
    assert not got.duplicated(by).any()
    sizes = got.groupby("tree").size()
    assert len(sizes) == trees and sizes.min() >= psi
    expected = min(n, 3 * psi)
    assert abs(sizes.mean() - expected) <= 0.1 * expected
    assert psi * 3 < n or (sizes == n).all()


def test_forest_with_sparse_samples(cloud):
    forest = iforest.fit_iforest(cloud, FEATURES, trees=8, sample_size=128)
    assert forest.nodes.tree.nunique() == 8
    out = forest.score(cloud).toPandas()
    assert out[out.temperature > 8].isolation_raw.mean() > out[out.temperature < 8].isolation_raw.mean() + 0.1


def test_corrector_refuses_truth(spark, series):
    with pytest.raises(ValueError, match="Ground-truth"):
        correction.fit_corrector(series({1: [1]}), ["original_temperature"])


def test_corrector_rows_by_hash(spark, series):
    df = series({s: range(200) for s in range(10)}).withColumn("diagnosed_fault", F.when(F.hour("ts") == 0, "SPIKE").otherwise("NORMAL"))
    features = ["humidity", "pressure", "hour"]
    every = correction.fit_rows(df, features).count()
    some = [{(r.station_id, r.ts) for r in correction.fit_rows(x, features, 400).collect()} for x in (df, df.repartition(7, "ts"))]
    assert some[0] == some[1] and 300 < len(some[0]) < 500 < every < 2000
    assert correction.fit_rows(df, features, 600).count() > len(some[0])
    assert correction.fit_rows(df.limit(0), features, 10).count() == 0


def test_corrections_only_where_flagged(spark, sf):
    fixed = staging.stage(demo.corrected(spark, sf), "fixed")
    moved = ~F.col("temperature_corrected").eqNullSafe(F.col("temperature"))
    assert fixed.filter(moved & (F.col("correction_applied") == 0)).count() == 0
    model = correction.fit_corrector(fixed, trees=5, depth=4)
    out = correction.apply_corrector(fixed, model)
    assert out.count() == fixed.count()
    by_model = out.filter(F.col("correction_method") == "ml_model")
    assert by_model.filter(~F.col("diagnosed_fault").isin("FROZEN", "DRIFT", "NOISE")).count() == 0
    assert by_model.filter(F.col("temperature_corrected") != F.col("temperature_corrected_ml")).count() == 0


def test_day_folders_have_as_many_files_as_their_rows_need(spark, series):
    path = staging.new_table_path(spark, "days")
    df = series({s: range(60) for s in range(20)}).repartition(16)
    files.write_stage(df, path, ["station_id", "ts", "temperature"], day_folders=True, rows_per_file=200)
    told = {str(r.day): (r.n_rows, r.n_files) for r in files.read_manifest(spark, path).collect()}
    assert told == {"2025-01-01": (480, 3), "2025-01-02": (480, 3), "2025-01-03": (240, 2)}
    for day, (n, most) in told.items():
        part = spark.read.parquet(f"{path}/day={day}")
        assert part.count() == n and 1 <= len(part.inputFiles()) <= most
    assert files.read_stage(spark, path).count() == 1200
    nothing = staging.new_table_path(spark, "days")
    files.write_stage(df.limit(0), nothing, ["station_id", "ts"], day_folders=True)
    assert files.read_manifest(spark, nothing).count() == 0


def test_pivot_places_negative_stations_and_refuses_none(spark, series):
    df = series({-5: [1.0], -100: [2.0], 7: [3.0], 205: [4.0]})
    got = {r.block: r for r in spatial.station_pivot(df).collect()}
    assert (got[-1].c95, got[-1].c0, got[0].c7, got[2].c5) == (1.0, 2.0, 3.0, 4.0)
    lost = df.limit(1).withColumn("station_id", F.lit(None).cast("long"))
    with pytest.raises(Exception, match="no station_id"):
        spatial.station_pivot(lost).collect()


def test_salted_join_never_broadcasts_the_copies(skewed, spark):
    """The planner takes a dimension's 64 copies for as small as its files; under Spark's own threshold it sent them all to the driver."""
    dim = staging.stage(spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")), "dim")
    out = staging.join_dim(skewed, dim, ["k"], spread="y", max_rows=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neighbour_plans_never_broadcast_pairs(spark):
    """Nor do the readings' pairs, which are lists in the tasks."""
    places = spark.createDataFrame([(i, 28.0 + i / 10, 76.0) for i in range(9)], "station_id long, latitude double, longitude double")
    df = spark.range(90).selectExpr("id % 9 AS station_id", "timestamp_ntz '2025-01-01' AS ts", "id / 2D AS temperature")
    out = spatial.neighbor_summary(df, places, cfg=QCConfig(broadcast_rows=0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "BroadcastHashJoin [b" not in plan


def test_corrector_grows_its_trees_in_blocks(spark, series, monkeypatch, tmp_path):
    """No fit holds more row weights than allowed; the blocks make one forest of all trees."""
    from pyspark.ml import PipelineModel

    grown = []
    fit = correction.RandomForestRegressor.fit
    monkeypatch.setattr(correction.RandomForestRegressor, "fit", lambda self, df: grown.append(self.getNumTrees()) or fit(self, df))
    df = series({s: [(h % 24) + s for h in range(300)] for s in range(4)}).withColumn("diagnosed_fault", F.lit("NORMAL"))
    df = staging.stage(df.withColumn("humidity", F.col("station_id") * 10.0), "normal")
    features = ["humidity", "hour"]
    whole = correction.fit_corrector(df, features, trees=10, depth=4)
    monkeypatch.setattr(correction, "TASK_WEIGHTS", 1)
    monkeypatch.setattr(correction, "BLOCK_TREES", 4)
    model = correction.fit_corrector(df, features, trees=10, depth=4)
    assert grown[0] == 10 and len(grown[1:]) == 3 and sum(grown[1:]) == 10 and max(grown[1:]) <= 4
    forest = model.stages[-1]
    assert forest.getNumTrees == len(forest.trees) == 10 and len({t.toDebugString for t in forest.trees}) > 4
    asked = correction.with_ml_features(df)
    row = model.transform(asked).select("features", "_predicted").first()
    assert row._predicted == pytest.approx(np.mean([t.predict(row.features) for t in forest.trees]))
    error = lambda m: m.transform(asked).agg(F.avg(F.abs(F.col("_predicted") - F.col("temperature")))).first()[0]
    assert error(model) == pytest.approx(error(whole), rel=0.25)
    model.write().overwrite().save(str(tmp_path / "model"))
    assert error(PipelineModel.load(str(tmp_path / "model"))) == pytest.approx(error(model))
