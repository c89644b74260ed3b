"""Faults that share readings, against a plain loop over the specs; specs that name nothing known."""

import datetime as dt

import pytest

from gaugeline.config import DRIFT_STEP, SEVERITY_MAGNITUDE
from gaugeline.operators import inject

SPEC = "seq long, variable string, fault string, station_id long, start_ts timestamp_ntz, duration long, severity string"


def hour(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)


def table(spark, n=12):
    rows = [(s, hour(i), 10.0 + i * s, None if i == 4 else 50.0 + i, 1000.0) for s in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, temperature double, humidity double, pressure double")


def by_loop(rows, specs):
    rows = {(r.station_id, r.ts): [r.temperature, r.humidity, "normal"] for r in rows}
    for _, variable, fault, station, start, duration, severity in sorted(specs):
        k = ("temperature", "humidity").index(variable)
        inside = sorted(key for key in rows if key[0] == station and start <= key[1] < start + dt.timedelta(hours=duration))
        held = rows[inside[0]][k] if inside else None
        for i, key in enumerate(inside, 1):
            amount = {"drift": i * DRIFT_STEP[severity], "spike": SEVERITY_MAGNITUDE[variable][severity], "drop": -SEVERITY_MAGNITUDE[variable][severity]}.get(fault)
            old = rows[key][k]
            new = held if fault == "frozen" else None if fault == "missing" or old is None else old + amount
            rows[key][k], rows[key][2] = new, f"{variable}_{fault}"
    return rows


def test_overlapping_specs_are_applied_in_order(spark):
    specs = [
        (1, "temperature", "drift", 1, hour(0), 6, "severe"),
        (2, "humidity", "spike", 1, hour(0), 2, "mild"),
        (3, "temperature", "frozen", 1, hour(2), 4, "mild"),
        (4, "temperature", "frozen", 1, hour(4), 5, "mild"),
        (5, "temperature", "drop", 1, hour(3), 2, "mild"),
        (6, "temperature", "frozen", 1, hour(5), 6, "mild"),
        (7, "temperature", "missing", 2, hour(1), 3, "mild"),
        (8, "temperature", "spike", 2, hour(2), 4, "moderate"),
        (9, "temperature", "frozen", 2, hour(3), 5, "mild"),
        (10, "humidity", "frozen", 2, hour(3), 4, "mild"),
    ]
    df = table(spark)
    got = {(r.station_id, r.ts): [r.temperature, r.humidity, r.fault_type] for r in inject.inject_faults(df, spark.createDataFrame(specs, SPEC)).collect()}
    want = by_loop(df.collect(), specs)
    assert got.keys() == want.keys()
    for key, (temperature, humidity, label) in want.items():
        assert got[key] == [pytest.approx(temperature), pytest.approx(humidity), label], key


@pytest.mark.parametrize("bad", [("temperature", "spyke", "mild"), ("temperature", "drop", "huge"), ("wetness", "spike", "mild")])
def test_unknown_specs_are_refused(spark, bad):
    spec = spark.createDataFrame([(1, bad[0], bad[1], 1, hour(0), 3, bad[2])], SPEC)
    with pytest.raises(Exception, match="fault spec not understood"):
        inject.inject_faults(table(spark), spec).collect()
