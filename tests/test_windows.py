"""Sliced windows must equal plain per-station pandas, whatever the slice length."""

import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.config import QCConfig
from gaugeline.operators import features, slices
from gaugeline.sources.events import observations

SMALL = QCConfig(slice_hours=24)


def ordered(df):
    return df.toPandas().sort_values(["station_id", "ts"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def obs(spark, sf):
    return observations(spark, sf)


@pytest.fixture(scope="module")
def base(obs):
    return ordered(obs)


def same(got, want, tol=1e-9):
    a, b = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(np.abs(a - b), initial=0.0) <= tol


def per_station(base, fn, column="temperature"):
    return np.concatenate([np.asarray(fn(g.set_index("ts")[column]), dtype=float) for _, g in base.groupby("station_id")])


@pytest.mark.parametrize("cfg", [QCConfig(), SMALL])
def test_features_equal_pandas(obs, base, cfg):
    got = ordered(features.temporal_features(obs, cfg=cfg))
    mean = per_station(base, lambda s: s.shift(1).rolling("24h", min_periods=3).mean())
    std = per_station(base, lambda s: s.shift(1).rolling("24h", min_periods=3).std())
    same(got.temperature_rolling_mean_24h, mean)
    same(got.temperature_rolling_std_24h, std)
    z = (base.temperature.to_numpy() - mean) / np.where(std == 0, np.nan, std)
    same(got.temperature_zscore_24h, z, 1e-7)
    same(got.temperature_change, per_station(base, lambda s: s.diff()))
    same(got.temperature_change_6h, per_station(base, lambda s: s.diff(6)))
    same(got.temperature_std_6h, per_station(base, lambda s: s.rolling(6, min_periods=6).std()))
    slope = lambda x: np.nan if np.isnan(x).any() else np.polyfit(np.arange(6), x, 1)[0]
    same(got.temperature_trend_6h, per_station(base, lambda s: s.rolling(6, min_periods=6).apply(slope, raw=True)))
    same(got.previous_6h_median, per_station(base, lambda s: s.shift(1).rolling(6, min_periods=3).median()))
    same(got.previous_12h_median, per_station(base, lambda s: s.shift(1).rolling(12, min_periods=6).median()))
    runs = lambda s: s.groupby((s != s.shift()).cumsum()).transform("size").where(s.notna(), 1)
    same(got.repeat_length, per_station(base, runs))
    flips = lambda s: (np.sign(s.diff().fillna(0)).diff().fillna(0) != 0).astype(int).rolling(6, min_periods=1).sum()
    same(got.sign_flips, per_station(base, flips))
    same(got.cum_change_6h, per_station(base, lambda s: s.diff().fillna(0).rolling(6, min_periods=1).sum()))
    up = lambda s: (s.diff() > 0).where(s.diff().notna()).astype(float).rolling(6, min_periods=3).sum()
    same(got.rises_6h, per_station(base, up))


def test_row_baseline(obs, base):
    got = ordered(features.baseline_rows(obs, ["temperature"], cfg=SMALL))
    same(got.temperature_rolling_mean_24h, per_station(base, lambda s: s.shift(1).rolling(24, min_periods=3).mean()))
    same(got.temperature_rolling_std_24h, per_station(base, lambda s: s.shift(1).rolling(24, min_periods=3).std()))


def test_look_back_crosses_long_gaps(series):
    """Rows weeks apart still see each other through row-based windows."""
    df = series({1: [1, 2, 4, 8, 16, 32, 64]}, step=24 * 9)
    got = ordered(features.shape_features(df, SMALL))
    assert got.temperature_change.tolist()[1:] == [1, 2, 4, 8, 16, 32]
    assert got.previous_6h_median.tolist()[3:] == [2.0, 3.0, 4.0, 6.0]


@pytest.mark.parametrize("hours", [24, 100])
def test_look_back_over_gaps_of_any_length(spark, series, hours):
    """Dense stretches, single readings and silent months, for several stations, one of them with a third of the rows."""
    rng = np.random.default_rng(4)
    rows = []
    for sid in range(9):
        at = datetime(2023, 1, 1) + timedelta(hours=int(rng.integers(0, 5000)))
        for _ in range(900 if sid == 0 else 200):
            at += timedelta(hours=int(rng.choice([1, 1, 1, 5, 30, 400, 3000], p=[0.3, 0.3, 0.2, 0.1, 0.06, 0.03, 0.01])))
            rows.append((sid, at, None if rng.random() < 0.1 else float(rng.normal()), 50.0, 1000.0))
    df = spark.createDataFrame(rows, series({1: [1]}).schema)
    base, cfg = ordered(df), QCConfig(slice_hours=hours)
    got = ordered(features.baseline_rows(df, ["temperature"], cfg=cfg))
    same(got.temperature_rolling_mean_24h, per_station(base, lambda s: s.shift(1).rolling(24, min_periods=3).mean()))
    got = ordered(features.temporal_features(df, cfg=cfg))
    same(got.temperature_rolling_mean_24h, per_station(base, lambda s: s.shift(1).rolling("24h", min_periods=3).mean()))
    same(got.previous_12h_median, per_station(base, lambda s: s.shift(1).rolling(12, min_periods=6).median()))
    same(got.temperature_std_6h, per_station(base, lambda s: s.rolling(6, min_periods=6).std()))
    same(got.cum_change_6h, per_station(base, lambda s: s.diff().fillna(0).rolling(6, min_periods=1).sum()))


def test_runs_cross_slices(series):
    values = [5, 5, None, None, 5] + [7] * 100 + [8]
    got = ordered(slices.with_run_length(series({1: values, 2: [3] * 60}), "temperature", slice_hours=24))
    assert got[got.station_id == 1].repeat_length.tolist() == [2, 2, 1, 1, 1] + [100] * 100 + [1]
    assert set(got[got.station_id == 2].repeat_length) == {60}
    run = ordered(slices.with_running_length(series({1: values}), "temperature", slice_hours=24))
    assert run.running_length.tolist() == [1, 2, 1, 1, 1] + list(range(1, 101)) + [1]


def test_interpolation(series):
    got = ordered(slices.interpolate(series({1: [None, 10, None, None, 16, None]}), F.col("temperature"), "x"))
    assert got.x.tolist() == [10, 10, 12, 14, 16, 16]
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.7 else float(v) for v in rng.normal(size=300)]
    got = ordered(slices.interpolate(series({1: values}), F.col("temperature"), "x", slice_hours=24))
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit_direction="both")
    same(got.x, want)


def test_carries(series):
    values = list(range(100))
    df = series({1: values, 2: values[:30]})
    got = ordered(slices.with_row_number(df, slice_hours=24))
    assert got.rn.tolist() == list(range(1, 101)) + list(range(1, 31))
    total = ordered(slices.with_running_sum(df, F.col("temperature"), "total", slice_hours=24))
    same(total.total, np.concatenate([np.cumsum(values), np.cumsum(values[:30])]))
    sparse = series({1: [None, 3] + [None] * 60 + [4, None]})
    known = ordered(slices.with_last_known(sparse, F.col("temperature"), "known", slice_hours=24))
    same(known.known, [np.nan, np.nan] + [3.0] * 61 + [4.0])


def test_look_back_shares_one_window_shuffle(obs):
    """Baselines and shapes sit on one sort: readings are not shuffled again per feature."""
    plan = features.baseline_24h(obs)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
    assert windows and all("_slice" in w for w in windows)


def test_slice_length_fits_load(series):
    assert slices.fit_slice_hours(series({1: range(48)}), target_rows=24) == 24
    assert slices.fit_slice_hours(series({1: range(48)}), target_rows=240) == 240


def test_hot_station_is_spread_over_tasks(spark, series):
    """Two thirds of the rows belong to one station; no task receives them all."""
    rng = np.random.default_rng(2)
    hot, cold = rng.normal(size=4000).tolist(), rng.normal(size=200).tolist()
    df = series({1: hot, **{s: cold for s in range(2, 12)}})
    cfg = QCConfig(slice_hours=72)
    out = features.temporal_features(df, cfg=cfg)
    got = ordered(out)
    base = ordered(df)
    same(got.temperature_rolling_std_24h, per_station(base, lambda s: s.shift(1).rolling("24h", min_periods=3).std()))
    sliced = slices.with_lookback(df, rows=25, hours=24, slice_hours=72).groupBy("station_id", "_slice").count()
    assert sliced.agg(F.max("count")).first()[0] <= 72 + 25
