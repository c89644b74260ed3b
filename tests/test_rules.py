"""Literal cases of the row rules, texts, scores and geometry."""

import pytest
from pyspark.sql import functions as F

from gaugeline.config import QCConfig
from gaugeline.functions import columns as C
from gaugeline.operators import detectors, diagnosis, health, spatial
from gaugeline.schema import require_columns


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    "reading, flags",
    [
        ((29.0, 50.0, 1012.0), (0, 0, 0, 0)),
        ((55.0, 101.0, 1100.0), (0, 1, 1, 1)),
        ((70.0, -5.0, 800.0), (1, 1, 1, 1)),
        ((-60.0, 70.0, 1000.0), (1, 0, 0, 1)),
        ((25.0, 50.0, 1013.0), (0, 0, 0, 0)),
        ((75.0, 110.0, 1100.0), (1, 1, 1, 1)),
        ((-60.0, -5.0, 850.0), (1, 1, 1, 1)),
        ((None, 50.0, 1013.0), (1, 0, 0, 1)),
    ],
)
def test_quality_control(spark, reading, flags):
    df = spark.createDataFrame([reading], "temperature double, humidity double, pressure double")
    row = detectors.quality_control(df).first()
    assert tuple(row[3:]) == flags


def test_missing_is_not_a_tight_range_hit(spark):
    df = spark.createDataFrame([(None, 50.0, 1000.0)], "temperature double, humidity double, pressure double")
    assert df.select(C.tight_range_flag()).first()[0] == 0


def test_bands(spark):
    scores = [(0.29, "Normal"), (0.30, "Low"), (0.59, "Low"), (0.60, "Medium"), (0.79, "Medium"), (0.80, "High")]
    df = spark.createDataFrame(scores, "s double, want string")
    assert df.filter(C.severity_band(F.col("s")) != F.col("want")).count() == 0
    hours = [(4, "Night"), (5, "Morning"), (11, "Morning"), (12, "Afternoon"), (16, "Afternoon"), (17, "Evening"), (20, "Evening"), (21, "Night")]
    df = spark.createDataFrame(hours, "h int, want string")
    assert df.filter(C.time_period(F.col("h")) != F.col("want")).count() == 0
    health_rows = [(100, "GREEN"), (80, "GREEN"), (79, "YELLOW"), (50, "YELLOW"), (49, "RED"), (0, "RED")]
    df = spark.createDataFrame(health_rows, "s int, want string")
    assert df.filter(C.health_status(F.col("s")) != F.col("want")).count() == 0


def test_non_finite_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(C.finite_or_null(F.col("x"))).collect()] == [None, None, 1.0]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns"):
        require_columns(spark.range(1), ["temperature"])
    with pytest.raises(ValueError, match="Ground-truth"):
        detectors.check_feature_list(["temperature", "is_anomaly"])


def test_ledger(series):
    df = series({1: range(7)}).withColumn("fault", F.lit("temperature_spike"))
    rows = health.health_ledger(df, F.col("fault"), cfg=QCConfig(slice_hours=24)).orderBy("ts").collect()
    assert [r.health_score for r in rows] == [85, 70, 55, 40, 25, 10, 0]


STATIONS = [
    (42182, 28.5833, 77.2000),
    (42181, 28.5667, 77.1167),
    (42176, 28.8333, 76.5833),
    (42139, 29.0167, 77.6333),
    (42131, 29.1667, 75.7333),
]


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame(STATIONS, "station_id long, latitude double, longitude double")


def test_haversine(spark):
    cols = [F.lit(x) for x in (28.6139, 77.2090, 28.5355, 77.3910)]
    assert round(spark.range(1).select(C.haversine_km(*cols)).first()[0], 4) == 19.7954


def test_neighbors(stations):
    got = {}
    for r in spatial.neighbors(stations).orderBy("a", "km").collect():
        got.setdefault(r.a, []).append((r.b, round(r.km, 2)))
    assert got[42182] == [(42181, 8.34), (42139, 64.07), (42176, 66.26)]
    assert got[42131] == [(42176, 90.60)]
    near = spatial.nearest_stations(stations, k=3, start_km=10).filter("a = 42131").orderBy("rank").collect()
    assert [r.b for r in near] == [42176, 42181, 42182]


def test_pairs_match_brute_force(spark):
    """Grid search finds the same pairs as comparing all, also over the date line and poles."""
    import math
    import random

    random.seed(3)
    pts = [(i, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(150)]
    pts += [(200, 10.0, 179.9), (201, 10.0, -179.9), (202, 89.9, 0.0), (203, 89.9, 180.0), (204, -89.5, 10.0), (205, -89.5, -170.0)]
    df = spark.createDataFrame(pts, "station_id long, latitude double, longitude double")

    def km(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for reach in (60.0, 700.0, 6000.0):
        want = {(p[0], q[0]) for p in pts for q in pts if p[0] != q[0] and km(p, q) <= reach}
        assert {(r.a, r.b) for r in spatial.station_pairs(df, reach).collect()} == want


def test_leave_one_out(series):
    from functools import reduce

    def at(values):
        return reduce(lambda a, b: a.unionByName(b), [series({i: [v]}) for i, v in enumerate(values)])

    cfg = QCConfig()
    for values, want in (([55, 28, 29, 30], "SENSOR_FAULT"), ([45, 44, 45, 46], "WEATHER_EVENT"), ([45, 44], "INSUFFICIENT_DATA")):
        table = at(values)
        row = spatial.leave_one_out(table.filter("station_id = 0"), table, cfg=cfg).first()
        assert row.spatial_classification == want


def test_evidence(spark):
    rows = [(1, 1, 30.0, 20.0, "Sensor Fault", 3), (0, 1, 30.0, 20.0, "Suspicious", 2), (0, 0, 25.0, 20.0, "Likely Weather Event", 0), (1, 1, 25.0, None, "Suspicious", 2)]
    df = spark.createDataFrame(rows, "ml int, temporal int, station_value double, neighbor_average double, want string, score int")
    got = spatial.classify_evidence(df, "ml", "temporal")
    assert got.filter((F.col("classification") != F.col("want")) | (F.col("evidence_score") != F.col("score"))).count() == 0
    fixed = spatial.correct_by_neighbors(got).select("corrected_value").collect()
    assert [r[0] for r in fixed] == [20.0, 30.0, 25.0, 25.0]


def test_unknown_observations(series):
    df = series({1: [1, 2]})
    other = series({2: [1]}).unionByName(series({1: [1]}))
    assert [r.station_id for r in spatial.unknown_observations(df, other).collect()] == [2]


def test_unconfirmed_spike_is_normal(spark):
    """A spike candidate that no detector supports does not turn into noise or drift."""
    base = dict(temperature=50.0, absolute_temperature_change=20.0, local_temperature_residual=20.0, temperature_std_6h=9.0,
                repeat_length=1, sign_flips=4, cum_change_6h=30.0, thr_change=5.0, thr_residual=5.0, thr_spread=1.0,
                thr_cumulative=5.0, low_spread=0.5, rule_score=0, statistical_score=0, isolation_score=0, temporal_score=0)
    rows = [base, {**base, "temporal_score": 1}, {**base, "absolute_temperature_change": 1.0, "local_temperature_residual": 1.0},
            {**base, "temperature": None}]
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in base.items())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = df.withColumns(diagnosis.label_columns()).select("diagnosed_fault", "diagnosis_confidence").collect()
    assert [tuple(r) for r in got] == [("NORMAL", 0.0), ("SPIKE", 1.0), ("NOISE", 1.0), ("MISSING", 1.0)]


# --- readings meet their neighbours ---------------------------------------------


def brute_summary(readings, stations, flagged):
    """By comparing all readings of a time: (ts, station) to what neighbor_summary gives."""
    import math

    def km(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    near = {p[0]: {q[0] for q in stations if q[0] != p[0] and 0 < km(p, q) <= 100.0} for p in stations}
    out = {}
    for key in {(ts, s) for s, ts, _, _ in readings if s in near}:
        own = [v for s, ts, v, _ in readings if (ts, s) == key and v is not None]
        met = [(v, f) for s, ts, v, f in readings if ts == key[0] and s in near[key[1]] and v is not None]
        values = sorted((v for v, _ in met), key=lambda v: (math.isnan(v), v))
        normal, odd = (sum(f == 0 for _, f in met), sum(f == 1 for _, f in met)) if flagged else (len(met), 0)
        out[key] = (max(own, key=lambda v: (math.isnan(v), v), default=None), len(met), normal, odd, sum(values) / len(values) if values else None, values)
    return out


@pytest.mark.parametrize("bounds", [{}, {"PLACE_PAIRS": 5, "SLOT_READINGS": 3, "SLOT_VALUES": 4, "STEP": 7}])
@pytest.mark.parametrize("flagged", [True, False])
def test_neighbor_summary_matches_brute_force(spark, monkeypatch, bounds, flagged):
    """Repeated, null and NaN readings, unknown stations, positions a turn apart; under bounds that make many places, slots and steps."""
    import random
    from datetime import datetime, timedelta

    for name, value in bounds.items():
        monkeypatch.setattr(spatial, name, value)
    rng = random.Random(5)
    stations = [(i, 28 + (i % 5) * 0.35, 76 + (i // 5) * 0.4 + 360 * (i % 3)) for i in range(30)] + [(90, -70.0, 10.0), (91, 10.0, 179.9), (92, 10.0, -179.9)]
    times = [None, *(datetime(2025, 1, 1) + timedelta(hours=h) for h in range(5))]
    known = [s[0] for s in stations]
    readings = [(rng.choice([*known, 777]), rng.choice(times), rng.choice([None, float("nan"), *(rng.uniform(-9, 9) for _ in range(20))]), rng.choice([0, 1, None])) for _ in range(250)]
    readings += [(91, times[1], 3.0, 0), (92, times[1], 5.0, 1)]
    df = spark.createDataFrame(readings, "station_id long, ts timestamp_ntz, temperature double, bad int")
    places = spark.createDataFrame(stations, "station_id long, latitude double, longitude double")
    got = spatial.neighbor_summary(df, places, flag_col="bad" if flagged else None, collect_values=True).collect()
    want = brute_summary(readings, stations, flagged)
    assert len(got) == len(want) and {(r.ts, r.station_id) for r in got} == set(want)
    for r in got:
        value, *counts, mean, values = want[r.ts, r.station_id]
        assert [r.neighbor_count, r.normal_neighbors, r.anomalous_neighbors] == counts
        assert (r.station_value, r.neighbor_average) == (pytest.approx(value, nan_ok=True), pytest.approx(mean, nan_ok=True))
        assert r.neighbor_values == pytest.approx(values, nan_ok=True)
    assert len(spatial.neighbor_summary(df, places, flag_col="bad").columns) == 7
    assert spatial.neighbor_summary(df.limit(0), places, collect_values=True).count() == 0


def test_positions_a_turn_apart_share_a_region(spark):
    """Else readings go to a region for each turn."""
    places = spark.createDataFrame([(i, 28.0, 76.0 + 360.0 * i + 0.1 * (i % 2)) for i in range(-3, 4)], "station_id long, latitude double, longitude double")
    routes = spatial.routed_edges(places).select("b", "region").distinct()
    assert spatial.routed_edges(places).count() == 49 and routes.count() == 7
