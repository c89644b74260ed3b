"""Streams read to the end must equal their batch twins, over several micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.config import QCConfig
from gaugeline.functions import columns as C
from gaugeline.operators import detectors, features, health, slices, staging
from gaugeline.operators.correction import correct_by_rules, fit_corrector
from gaugeline.operators.diagnosis import diagnose
from gaugeline.operators.iforest import fit_iforest
from gaugeline.plans import demo
from gaugeline.sources.events import observations
from gaugeline.streaming import jobs, live


@pytest.fixture(scope="module")
def chunks(spark, sf):
    """History as one file per ten days, written in time order."""
    obs = staging.stage(observations(spark, sf), "obs")
    path = staging.new_table_path(spark, "chunks")
    for day in (1, 11, 21):
        start = F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz")
        part = obs.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 10 days")))
        part.coalesce(1).write.mode("append").parquet(path)
    return obs.filter(F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz")), path


def rows(df, *cols):
    out = df.select(*cols).toPandas().sort_values(list(cols[:2])).reset_index(drop=True)
    return out.round(6)


def test_qc_stream(spark, chunks):
    obs, path = chunks
    got = jobs.run_to_end(jobs.qc_stream(jobs.replay(spark, path, obs.schema, 1)))
    want = detectors.quality_control(obs).withColumn("statistical_anomaly", C.tight_range_flag())
    cols = ["station_id", "ts", "qc_flag", "statistical_anomaly"]
    assert rows(got, *cols).equals(rows(want, *cols))


def test_dedup_drops_repeats(spark, series):
    df = series({1: range(20)})
    path = staging.new_table_path(spark, "twice")
    df.unionByName(df.limit(5)).coalesce(1).write.parquet(path)
    got = jobs.run_to_end(jobs.dedup_stream(jobs.replay(spark, path, df.schema)))
    assert got.count() == 20


def test_causal_votes_over_batches(spark, chunks):
    obs, path = chunks
    got = jobs.run_to_end(jobs.causal_votes(jobs.replay(spark, path, obs.schema, 1)), stateful=True)
    got = got.withColumn("ts", F.col("event_time").cast("timestamp_ntz"))
    cfg = QCConfig(std_min_rows=2)
    want = features.shape_features(features.baseline_rows(obs, ["temperature"], cfg=cfg), cfg)
    want = slices.with_running_length(want, "temperature", "repeat_length")
    want = want.withColumns({"statistical_score": C.statistical_vote(), "temporal_score": C.temporal_vote()})
    want = want.withColumnRenamed("repeat_length", "running_length")
    cols = ["station_id", "ts", "running_length", "statistical_score", "temporal_score"]
    import pandas as pd

    pd.testing.assert_frame_equal(rows(got, *cols), rows(want, *cols), check_dtype=False)
    cols = ["station_id", "ts", "temperature_zscore_24h", "temperature_std_6h", "previous_12h_median"]
    pd.testing.assert_frame_equal(rows(got, *cols), rows(want, *cols), check_dtype=False, atol=1e-5)


@pytest.fixture(scope="module")
def late(spark, series):
    """A file with hours 0 to 9 but 8, one with 8, 10 and 11 (hour 8 is late, within 2 hours), one with 1 (too late) and 30."""
    df = staging.stage(series({1: [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, *[None] * 18, 22]}), "late")
    path = staging.new_table_path(spark, "late")
    hour = F.hour("ts") + 24 * (F.dayofmonth("ts") - 1)
    again = df.filter(hour == 1).withColumn("temperature", F.lit(-40.0))
    files = [df.filter((hour < 10) & (hour != 8)), df.filter(hour.isin(8, 10, 11)), again.unionByName(df.filter(hour == 30))]
    whole = staging.new_table_path(spark, "late-parts")
    for k, part in enumerate(files):
        part.coalesce(1).write.mode("append").parquet(f"{whole}/{k}")
        spark.read.schema(df.schema).parquet(f"{whole}/{k}").coalesce(1).write.mode("append").parquet(path)
    return df.filter((hour < 12) | (hour == 30)), path


def test_causal_votes_take_late_readings_in_order(spark, late):
    df, path = late
    got = jobs.run_to_end(jobs.causal_votes(jobs.replay(spark, path, df.schema, 1)), stateful=True)
    got = got.orderBy("event_time").collect()
    assert [r.temperature for r in got] == [*range(10, 22), 22]
    assert [r.temperature_change for r in got[1:]] == [1.0] * 12


def test_late_votes_equal_votes_in_order(spark, sf):
    from gaugeline.plans import catalog

    cols = ["station_id", "ts", "running_length", "statistical_score", "temporal_score"]
    got, want = (rows(catalog.QUERIES[q](spark, sf), *cols) for q in ("stream_late_votes", "stream_causal_votes"))
    assert len(got) == observations(spark, sf).count() and got.equals(want)


def test_causal_votes_of_nothing_and_restart(spark, late):
    df, path = late
    empty = staging.new_table_path(spark, "nothing")
    df.limit(0).write.parquet(empty)
    assert jobs.run_to_end(jobs.causal_votes(jobs.replay(spark, empty, df.schema)), stateful=True).count() == 0
    out, checkpoint = (staging.new_table_path(spark, x) for x in ("out", "checkpoint"))
    for _ in range(2):
        stream = jobs.causal_votes(jobs.replay(spark, path, df.schema, 1))
        assert jobs.run_to_end(stream, out, checkpoint, stateful=True).count() == 13


def test_health_stream(spark, chunks):
    obs, path = chunks
    fault = F.when(F.col("humidity") > 95, "humidity_spike")
    stream = jobs.replay(spark, path, obs.schema, 1).withColumn("fault_type", fault)
    got = jobs.run_to_end(jobs.health_stream(stream), stateful=True)
    got = got.withColumn("ts", F.col("event_time").cast("timestamp_ntz"))
    want = health.health_ledger(obs, fault)
    cols = ["station_id", "ts", "health_score", "health_status"]
    assert rows(got, *cols).equals(rows(want, *cols))


def test_health_takes_late_readings_in_order(spark, late):
    df, path = late
    fault = F.when(F.col("temperature").isin(13, 18), "humidity_spike")
    stream = jobs.replay(spark, path, df.schema, 1).withColumn("fault_type", fault)
    got = jobs.run_to_end(jobs.health_stream(stream), stateful=True).withColumn("ts", F.col("event_time").cast("timestamp_ntz"))
    cols = ["station_id", "ts", "health_score", "health_status"]
    assert rows(got, *cols).equals(rows(health.health_ledger(df, fault), *cols))


class Kept(dict):
    """State in memory."""

    exists = lambda self: "value" in self
    get = lambda self: self["value"]
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__

    def update(self, value):
        self["value"] = value

    def getMapState(self, *_):
        return Kept()

    getValueState = getMapState

    def registerTimer(self, at):
        self["timer"] = at


@pytest.mark.parametrize("name", ["CausalVotes", "HealthLedger"])
def test_long_histories_are_worked_on_in_parts(name, monkeypatch):
    import pandas as pd

    from gaugeline.streaming import state

    monkeypatch.setattr(state, "CHUNK_ROWS", 48, raising=False)
    n = 24 * 10
    df = pd.DataFrame({"event_time": pd.date_range("2024-01-01", periods=n, freq="h"), "penalty": [1, 0] * (n // 2)})
    df = df.assign(temperature=range(n), humidity=50.0, pressure=1000.0)

    class Time:
        getCurrentWatermarkInMs = staticmethod(lambda: int(df.event_time[n - 5].timestamp() * 1000))

    made = getattr(state, name)()
    made.init(handle := Kept())
    parts = list(made.handleInputRows((1,), (df.iloc[i::7] for i in range(7)), Time))
    parts += made.handleExpiredTimer((1,), Time, None)
    assert max(map(len, parts)) <= 48
    out = pd.concat(parts, ignore_index=True)
    assert list(out.event_time) == list(df.event_time[: n - 4]) and handle["timer"] == df.event_time[n - 4].timestamp() * 1000
    if name == "HealthLedger":
        assert list(out.health_score) == list((100 - df.penalty.cumsum()).clip(lower=0)[: n - 4])
    else:
        assert list(out.temperature_change[1:]) == [1.0] * (n - 5)


def test_windows_and_sessions(spark, chunks):
    obs, path = chunks
    got = jobs.run_to_end(jobs.station_kpis(jobs.replay(spark, path, obs.schema, 1), "1 day", "12 hours"))
    days = got.filter(F.hour("window.start") == 0).select("station_id", F.col("window.start").cast("timestamp_ntz").alias("ts"), "n_rows")
    want = obs.groupBy("station_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n_rows"))
    closed = days.select("ts").distinct()
    cols = ["station_id", "ts", "n_rows"]
    assert closed.count() > 20
    assert rows(days, *cols).equals(rows(want.join(closed, "ts"), *cols))
    sessions = jobs.run_to_end(jobs.station_sessions(jobs.replay(spark, path, obs.schema, 1)))
    assert sessions.agg(F.sum("n_rows")).first()[0] <= obs.count()
    assert sessions.count() > 2


def test_kpis_keep_open_windows(spark, chunks):
    obs, path = chunks
    got = jobs.run_latest(jobs.station_kpis(jobs.replay(spark, path, obs.schema, 1)), ["station_id", "window"])
    got = got.select("station_id", F.col("window.start").cast("timestamp_ntz").alias("ts"), "n_rows")
    want = obs.groupBy("station_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n_rows"))
    cols = ["station_id", "ts", "n_rows"]
    assert rows(got, *cols).equals(rows(want, *cols))


def test_kpis_of_a_history_in_many_files(spark, sf):
    obs = staging.stage(observations(spark, sf), "obs")
    path = staging.new_table_path(spark, "ordered")
    with_parts = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(with_parts, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        # hashed by key, as an aggregate leaves its rows
        jobs.write_in_time_order(obs.repartition(12, "station_id", "ts"), path)
    finally:
        spark.conf.unset(with_parts)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(spark.read.parquet(path).inputFiles()) > 8
    got = jobs.run_latest(jobs.station_kpis(jobs.replay(spark, path, obs.schema, 1)), ["station_id", "window"])
    got = got.select("station_id", F.col("window.start").cast("timestamp_ntz").alias("ts"), "n_rows")
    want = obs.groupBy("station_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n_rows"))
    cols = ["station_id", "ts", "n_rows"]
    assert rows(got, *cols).equals(rows(want, *cols))


def test_replayed_history_is_in_time_order(spark, sf, monkeypatch):
    from gaugeline.plans import catalog

    obs = staging.stage(observations(spark, sf), "obs")
    read = jobs.replay
    monkeypatch.setattr(jobs, "replay", lambda spark, path, schema: read(spark, path, schema, 1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = catalog.QUERIES["stream_kpis"](spark, sf)
        assert got.agg(F.sum("n_rows")).first()[0] == obs.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_kpis_of_nothing(spark, series):
    df = series({1: range(3)}).limit(0)
    path = staging.new_table_path(spark, "nothing")
    df.write.parquet(path)
    assert jobs.run_latest(jobs.station_kpis(jobs.replay(spark, path, df.schema)), ["station_id", "window"]).count() == 0


@pytest.fixture(scope="module")
def models(spark, sf):
    obs = observations(spark, sf)
    forest = fit_iforest(obs, ["temperature", "pressure", "humidity"], trees=30)
    voted = detectors.detector_votes(features.temporal_features(obs), demo.isolation_stand_in())
    fixed = staging.stage(correct_by_rules(diagnose(staging.stage(voted, "v"))), "f")
    return forest, fit_corrector(fixed, trees=5, depth=5)


def test_live_scoring(spark, sf, models):
    obs = staging.stage(observations(spark, sf), "obs")
    at = datetime(2024, 3, 1)
    # a wild reading, one in the past, one without pressure, one from an unknown station
    new = spark.createDataFrame(
        [(0, at, 95.0, 50.0, 1000.0), (1, datetime(2024, 1, 2), 0.0, 50.0, 1000.0), (2, at, 1.0, 50.0, None), (99, at, 1.0, 50.0, 1000.0)],
        "station_id long, ts timestamp_ntz, temperature double, humidity double, pressure double",
    )
    got = {r.station_id: r for r in live.score_readings(new, obs, *models).collect()}
    assert got[0].diagnosed_fault == "SPIKE" and got[0].anomaly_detected
    assert got[0].severity in {"Medium", "High"} and got[0].sensor_health_score == 85
    assert got[0].detector_scores.rule_score == 1 and got[0].stages.quality_check == "flagged"
    last = obs.filter("station_id = 1").agg(F.max("ts")).first()[0]
    if got[1].diagnosed_fault != C.INSUFFICIENT:
        assert got[1].ts == last + timedelta(hours=1)
    assert got[2].reason.startswith("a reading needs temperature, humidity and pressure")
    assert got[99].diagnosed_fault == C.INSUFFICIENT and got[99].severity == "Unknown"


def wavy(n, seed):
    """Readings with faults of every shape, and some equal and missing ones."""
    import random

    rng = random.Random(seed)
    out = [10 + 5 * ((i % 24) / 24) + rng.random() for i in range(n)]
    for i in range(60, n, 37):
        out[i] += 25
    for i in range(90, n, 61):
        out[i : i + 9] = [out[i]] * len(out[i : i + 9])
    for i in range(130, n, 97):
        out[i : i + 8] = [v + 4 * (-1) ** k * k for k, v in enumerate(out[i : i + 8])]
    for i in range(150, n, 83):
        out[i : i + 10] = [v + 2 * k for k, v in enumerate(out[i : i + 10])]
    for i in range(70, n, 89):
        out[i] = None
    out[n // 2 : n // 2 + 30] = [7.0] * 30
    out[n // 2 + 5] = 60.5
    return out[:n]


LIVE_EXACT = ["station_id", "ts", "anomaly_detected", "anomaly_score", "diagnosed_fault", "correction_method", "correction_applied", "severity", "explanation", "sensor_health_score"]
LIVE_NEAR = ["station_id", "ts", "temperature_original", "diagnosis_confidence", "temperature_corrected", "ml_anomaly_score"]


def scored_one_by_one(spark, df, models, keep=336):
    """The batch twin: each reading as a station of its own, with the readings before it."""
    from pyspark.sql import Window

    placed = staging.stage(df.withColumn("k", F.row_number().over(Window.partitionBy("station_id").orderBy("ts"))), "placed")
    before = placed.alias("n").join(placed.alias("o"), F.expr(f"n.station_id = o.station_id AND o.k BETWEEN n.k - {keep} AND n.k - 1"))
    names = [c for c in df.columns if c != "station_id"]
    history = before.select(F.expr("n.station_id * 100000 + n.k").alias("station_id"), *(f"o.{c}" for c in names))
    fresh = placed.select(F.expr("station_id * 100000 + k").alias("station_id"), *names)
    history = staging.stage(history.selectExpr("*", "'n' AS station_name", "cast(3.0 AS double) AS wind_speed"), "twin-history")
    got = live.score_readings(staging.stage(fresh, "twin-new"), history, *models)
    return got.withColumn("station_id", F.expr("station_id div 100000"))


def test_live_stream_equals_scoring_one_by_one(spark, series, models):
    import pandas as pd

    df = staging.stage(series({1: wavy(430, 1), 2: wavy(120, 2), 3: [5.0] * 60}), "live")
    path = staging.new_table_path(spark, "live-in")
    files = jobs.write_in_time_order(df.selectExpr("*", "'n' AS station_name", "cast(3.0 AS double) AS wind_speed"), path, files=5)
    stream = jobs.replay(spark, path, spark.read.parquet(path).schema, 2)
    got = jobs.run_to_end(live.live_stream(stream, *models), stateful=True)
    got, want = staging.stage(got, "live-out"), staging.stage(scored_one_by_one(spark, df, models), "twin-out")
    assert files == 5 and got.count() == want.count() == df.count()
    labels = {r[0] for r in got.select("diagnosed_fault").distinct().collect()}
    assert {"SPIKE", "FROZEN", "NORMAL", C.INSUFFICIENT} <= labels and len(labels) >= 5
    assert got.filter("correction_method = 'ml_model'").count() > 10
    scored = F.col("diagnosed_fault") != C.INSUFFICIENT
    assert got.filter(scored).count() == want.filter(scored).count()
    pd.testing.assert_frame_equal(rows(got.filter(scored), *LIVE_EXACT), rows(want.filter(scored), *LIVE_EXACT), check_dtype=False)
    pd.testing.assert_frame_equal(rows(got.filter(scored), *LIVE_NEAR), rows(want.filter(scored), *LIVE_NEAR), check_dtype=False, atol=1e-6)
    told = ["station_id", "ts", "diagnosed_fault", "severity", "anomaly_detected", "temperature_original"]
    pd.testing.assert_frame_equal(rows(got.filter(~scored), *told), rows(want.filter(~scored), *told), check_dtype=False)
    assert sorted(got.columns) == sorted(want.columns)


def test_live_stream_from_stored_history(spark, sf, models):
    """History enters once as state; late, repeated, incomplete and unknown readings; a restart goes on from the state."""
    obs = staging.stage(observations(spark, sf), "obs")
    arriving = staging.new_table_path(spark, "arriving")
    at = datetime(2024, 3, 1)
    cols = "station_id long, ts timestamp_ntz, temperature double, humidity double, pressure double"

    def arrive(rows):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(arriving)

    one, two = ([(s, at + timedelta(hours=h), v, 50.0, p) for s, h, v, p in part] for part in (
        [(0, 0, 12.0, 1000.0), (0, 1, 80.0, 1000.0), (0, 1, 12.0, 1000.0), (1, -9000, 0.0, 1000.0), (2, 0, 1.0, None), (99, 0, 1.0, 1000.0)],
        [(0, 2, 12.5, 1000.0), (99, 1, 2.0, 1000.0)],
    ))
    out, checkpoint = staging.new_table_path(spark, "live-results"), staging.new_table_path(spark, "live-checkpoint")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_PROVIDER)
    for part in (one, two):
        arrive(part)
        stream = jobs.replay(spark, arriving, spark.read.schema(cols).parquet(arriving).schema)
        live.start_live_scoring(stream, out, checkpoint, *models, history=obs, available_now=True).awaitTermination()
    got = spark.read.parquet(out).toPandas().sort_values(["station_id", "ts", "temperature_original"]).reset_index(drop=True)
    assert len(got) == 8
    zero = got[got.station_id == 0]
    assert list(zero.ts) == [at, at + timedelta(hours=1), at + timedelta(hours=2), at + timedelta(hours=2)]
    assert list(zero.temperature_original) == [12.0, 80.0, 12.0, 12.5] and zero.diagnosed_fault.iloc[1] == "SPIKE"
    assert set(zero.station_name) == {"ST0"}
    last = obs.filter("station_id = 1").agg(F.max("ts")).first()[0]
    assert got[got.station_id == 1].ts.iloc[0] in (last + timedelta(hours=1), at - timedelta(hours=9000))
    assert got[got.station_id == 2].reason.iloc[0].startswith("a reading needs")
    assert list(got[got.station_id == 99].reason) == [f"station 99: {n} earlier readings known, 48 needed" for n in (0, 1)]
    state = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    sizes = state.select(F.length("value.times").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 336 * 8
