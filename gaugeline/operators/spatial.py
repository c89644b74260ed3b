"""Neighbour geometry and same-time comparisons between stations.

Station pairs come from an equi-join on grid cells, not from a cross join.
Readings reach their neighbours in one shuffle by (region, time): each reading is
copied only to the regions where it has neighbours, and is summed there, in Arrow
tables of bounded size, against the region's list of pairs. Pairs of readings are
never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.config import DEFAULT, QCConfig
from gaugeline.functions.columns import EARTH_RADIUS_KM, flag, haversine_km, health_status, penalty
from gaugeline.operators.slices import with_last_known, with_running_sum
from gaugeline.operators.staging import fits, join_dim, stage
from gaugeline.shipping import ship

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0
# Bounds of what one task holds: pairs of a place, readings and neighbour values of one of its slots, pairs of readings at once.
PLACE_PAIRS = 250_000
SLOT_READINGS = 50_000
SLOT_VALUES = 4_000_000
STEP = 1_000_000
POINT = ("station_id", "latitude", "longitude")


def station_pairs(stations: DataFrame, max_km: float, id_col: str = "station_id") -> DataFrame:
    """All ordered station pairs within max_km: (a, b, km), a <> b.

    One side sits in its grid cell; the other looks into every cell its search
    circle can touch. Longitude cells wrap round, and near the poles the circle
    covers them all, so no pair is missed.
    """
    reach = max_km / KM_PER_DEGREE * 1.0001  # degrees of latitude, with float slack
    size = max(reach, 0.01)
    columns = max(1, math.floor(360.0 / size))
    width = 360.0 / columns
    lat_cell = lambda lat: F.floor((lat + 90) / size).cast("int")

    home = stations.select(
        F.col(id_col).alias("b"),
        F.col("latitude").alias("lat_b"),
        F.col("longitude").alias("lon_b"),
    ).withColumns(
        {
            "_row": lat_cell(F.col("lat_b")),
            "_col": F.pmod(F.floor((F.col("lon_b") + 180) / width), F.lit(columns)).cast("int"),
        }
    )
    # half-width of the search circle in degrees of longitude
    ratio = F.lit(math.sin(min(math.radians(reach), math.pi / 2))) / F.cos(F.radians("lat_a"))
    polar = (F.abs("lat_a") + reach >= 90) | (ratio >= 1) | F.lit(reach >= 90)
    half = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.0001)
    first = F.floor((F.col("lon_a") + 180 - half) / width).cast("int")
    last = F.floor((F.col("lon_a") + 180 + half) / width).cast("int")
    search = (
        stations.select(
            F.col(id_col).alias("a"),
            F.col("latitude").alias("lat_a"),
            F.col("longitude").alias("lon_a"),
        )
        .withColumn("_row", F.explode(F.sequence(lat_cell(F.col("lat_a") - reach), lat_cell(F.col("lat_a") + reach))))
        .withColumn("_cols", F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(columns)).cast("int")))
        .withColumn("_col", F.explode(F.array_distinct("_cols")))
        .drop("_cols")
    )
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return (
        search.join(home.hint("merge"), ["_row", "_col"])  # the planner takes the copies of `search` for as small as its files
        .filter(F.col("a") != F.col("b"))
        .withColumn("km", km)
        .filter(F.col("km") <= max_km)
        .select("a", "b", "km")
    )


def neighbors(stations: DataFrame, max_km: float = DEFAULT.neighbor_km) -> DataFrame:
    """Radius neighbours; co-located stations are no neighbours."""
    return station_pairs(stations, max_km).filter(F.col("km") > 0)


def nearest_stations(stations: DataFrame, k: int = 3, start_km: float = 150.0) -> DataFrame:
    """The k nearest other stations, exactly, without all pairs.

    The radius doubles until every station has k others (or all of them) within
    it; stations that are done leave the search. At most eight rounds reach
    round the globe.
    """
    others = stations.count() - 1
    want = min(k, others)
    half_way = math.pi * EARTH_RADIUS_KM
    order = Window.partitionBy("a").orderBy(F.round("km", 6), "b")  # ties to a millimetre go to the lower id
    open_ids, done, radius = stations.select(F.col("station_id").alias("a")), None, start_km
    while True:
        pairs = station_pairs(stations, min(radius, half_way + 1)).join(open_ids, "a", "left_semi")
        ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = stage(ranked, "nearest")
        full = ranked.groupBy("a").count().filter(F.col("count") >= want).select("a")
        closed = ranked.join(full, "a", "left_semi")
        done = closed if done is None else done.unionByName(closed)
        open_ids = stage(open_ids.join(full, "a", "left_anti"), "nearest-open")
        if radius > half_way or fits(open_ids, 0):
            return done.select("a", "b", "km", "rank")
        radius *= 2


# --- readings meet their neighbours ---------------------------------------------


def _region(cfg: QCConfig) -> Column:
    """Coarse square a station lies in, several neighbour radii wide; longitudes a full turn apart are one place."""
    size = 4.0 * max(cfg.neighbor_km, 1.0) / KM_PER_DEGREE
    row, col = F.floor((F.col("latitude") + 90) / size), F.floor(F.pmod(F.col("longitude") + 180, F.lit(360.0)) / size)
    return (row * 100_000 + col).alias("region")


def routed_edges(stations: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """(a, b, region, is_self): b's readings count for a, and are met in a's region."""
    placed = stations.select(F.col("station_id").alias("a"), _region(cfg))
    own = placed.select("a", F.col("a").alias("b"), "region", F.lit(True).alias("is_self"))
    near = neighbors(stations, cfg.neighbor_km).join(placed, "a")
    return own.unionByName(near.select("a", "b", "region", F.lit(False).alias("is_self")))


def neighbor_summary(
    readings: DataFrame,
    stations: DataFrame,
    parameter: str = "temperature",
    flag_col: str | None = None,
    collect_values: bool = False,
    cfg: QCConfig = DEFAULT,
) -> DataFrame:
    """Per reading: its value and the values of the neighbours at the same time.

    Gives neighbor_count, normal_neighbors, anomalous_neighbors,
    neighbor_average and, on request, the sorted list of values. Without a flag
    column every neighbour counts as normal. Readings of one station and time are
    reduced to one cell; each cell is copied to the few regions in which it has
    neighbours and shuffled once. A region with very many pairs is dealt to parts by
    station, and its times to slots, so that no task holds more than the bounds above.
    """
    ship(readings.sparkSession)
    known = F.col("_v").isNotNull()
    of_flag = lambda x: F.count_if(known & (F.col("_f") == x))
    own = readings.select(
        F.col("station_id").alias("b"),
        "ts",
        F.col(parameter).alias("_v"),
        (F.col(flag_col) if flag_col else F.lit(0)).alias("_f"),
    )
    aggs = [F.max("_v").alias("_max"), F.count("_v").alias("_n"), F.sum(F.col("_v").cast("double")).alias("_sum")]
    aggs += [of_flag(0).alias("_normal"), of_flag(1).alias("_odd")] if flag_col else []
    aggs += [F.collect_list(F.col("_v").cast("double")).alias("_values")] if collect_values else []
    cells = stage(own.groupBy("b", "ts").agg(*aggs), "cells")
    edges = _in_places(stage(routed_edges(stations, cfg), "edges"))
    place = ["region", "_part"]
    routes = edges.select("b", *place).distinct()
    places = stage(_slots(cells, edges, routes, collect_values), "places")

    to = routes.join(places, place).groupBy("b").agg(F.collect_list(F.struct(*place, "_slots")).alias("_to"))
    to = stage(to, "routes")
    n_routes = to.agg(F.sum(F.size("_to"))).first()[0] or 0
    sent = join_dim(cells, to, ["b"], how="inner", spread="ts", max_rows=cfg.broadcast_rows, rows=n_routes)
    sent = sent.select(*cells.columns, F.inline("_to")).withColumn("_slot", F.pmod(F.xxhash64("ts"), F.col("_slots"))).drop("_slots")
    lists = edges.join(places, place).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slots") - 1)))

    kinds = {f.name: f.dataType for f in (*stations.schema, *readings.schema)}
    count = T.LongType()
    fields = [("ts", readings.schema["ts"].dataType), ("station_id", stations.schema["station_id"].dataType), ("station_value", kinds[parameter])]
    fields += [(n, count) for n in ("neighbor_count", "normal_neighbors", "anomalous_neighbors")] + [("neighbor_average", T.DoubleType())]
    fields += [("neighbor_values", T.ArrayType(T.DoubleType()))] if collect_values else []
    keys = [*place, "_slot"]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    met = sent.groupBy(*keys).cogroup(lists.drop("_slots").groupBy(*keys)).applyInArrow(meet, schema)
    return met.withColumn("neighbor_values", F.col("neighbor_values").cast(T.ArrayType(kinds[parameter]))) if collect_values else met


def _in_places(edges: DataFrame) -> DataFrame:
    """Each edge with its place: its region, and there the part of station a, of as many as the region's pairs need."""
    sizes = edges.filter(F.col("region").isNotNull()).groupBy("region").agg(F.ceil(F.count(F.lit(1)) / PLACE_PAIRS).alias("_parts"))
    return edges.join(sizes, "region").withColumn("_part", F.pmod(F.xxhash64("a"), F.col("_parts"))).drop("_parts")


def _slots(cells: DataFrame, edges: DataFrame, routes: DataFrame, collect_values: bool) -> DataFrame:
    """(region, _part, _slots): to how many slots a place's times are dealt.

    The list of pairs goes to each slot, so a slot takes more readings where that list is long.
    """
    place = ["region", "_part"]
    held = cells.groupBy("b").agg(F.count(F.lit(1)).alias("_rows"))
    rows = routes.join(held, "b").groupBy(*place).agg(F.sum("_rows").alias("_rows"))
    pairs = edges.groupBy(*place).agg(F.count(F.lit(1)).alias("_pairs"), F.count_if("is_self").alias("_own"))
    most = F.greatest(F.lit(SLOT_READINGS), 3 * F.col("_pairs"))
    if collect_values:
        each = F.col("_pairs") / F.greatest(F.col("_own"), F.lit(1))
        most = F.least(most, F.ceil(SLOT_VALUES / F.greatest(each, F.lit(1.0))))
    return rows.join(pairs, place).select(*place, F.ceil(F.col("_rows") / most).cast("bigint").alias("_slots"))


def meet(cells: pa.Table, edges: pa.Table) -> pa.Table:
    """The summary of each cell whose station is an `a` of the edges, over the cells of its neighbours at the same time."""
    ids = pc.unique(edges["b"])
    place = lambda column: pc.index_in(column, ids).combine_chunks().to_numpy(zero_copy_only=False)
    station = place(cells["b"].cast(ids.type)).astype(np.int64)
    time = cells["ts"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    order = np.lexsort((station, time))
    cells, station, time = cells.take(pa.array(order)), station[order], time[order]

    is_self = edges["is_self"].to_numpy()
    a, b = place(edges["a"].cast(ids.type)).astype(np.int64), place(edges["b"]).astype(np.int64)
    reports = np.zeros(len(ids), bool)
    reports[a[is_self]] = True
    a, b = a[~is_self], b[~is_self]
    sorted_ = np.lexsort((b, a))
    b, degree = b[sorted_], np.bincount(a, minlength=len(ids))
    start = np.cumsum(degree) - degree

    column = lambda name: np.append(cells[name].fill_null(0).to_numpy(), 0)  # the last one stands for a reading that is not there
    flagged, listed = "_normal" in cells.column_names, "_values" in cells.column_names
    sums = {name: column(name) for name in ("_n", "_sum", *(("_normal", "_odd") if flagged else ()))}
    if listed:
        lists = cells["_values"].combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        by_rank = np.argsort(flat, kind="stable")
        rank = np.empty(len(flat), np.int64)
        rank[by_rank] = np.arange(len(flat))
        first = np.cumsum(sums["_n"]) - sums["_n"]

    rows = np.flatnonzero(reports[station])
    found = {name: np.zeros(len(rows), x.dtype) for name, x in sums.items()}
    values = []
    for at, here, near, starts in _meetings(rows, time, station, degree, start, b):
        for name, x in sums.items():
            found[name][at] = np.add.reduceat(x[near], starts)
        if listed:
            n = sums["_n"][near]
            ends = np.cumsum(n)
            picked = np.repeat(first[near] - (ends - n), n) + np.arange(ends[-1])
            key = np.sort(np.repeat(here, n) * len(flat) + rank[picked])
            values.append(flat[by_rank[key % len(flat)]] if len(key) else key.astype(float))
    count = found["_n"].astype(np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        average = found["_sum"] / count
    out = {
        "ts": cells["ts"].take(pa.array(rows)),
        "station_id": ids.take(pa.array(station[rows])).cast(edges["a"].type),
        "station_value": cells["_max"].take(pa.array(rows)),
        "neighbor_count": pa.array(count),
        "normal_neighbors": pa.array(found["_normal"] if flagged else count),
        "anomalous_neighbors": pa.array(found["_odd"] if flagged else np.zeros(len(rows), np.int64)),
        "neighbor_average": pa.array(average, mask=count == 0),
    }
    if listed:
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        out["neighbor_values"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0)])))
    return pa.table(out)


def _meetings(rows, time, station, degree, start, b) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows with neighbours, some at a time: their places in `rows`; for each of their neighbours the number of the row
    among them and the neighbour's cell (the one past the last where it has none); where each row's neighbours begin."""
    size, width = len(time), len(degree)
    at = np.flatnonzero(degree[station[rows]] > 0)
    asked = rows[at]
    times = int(time[-1]) + 1 if size else 0
    span = max(1, min(times, 4 * STEP // max(width, 1)))
    for begin in range(0, times, span):
        low, high = np.searchsorted(time, [begin, begin + span])
        cell = np.full(span * width, size, np.int64)
        cell[(time[low:high] - begin) * width + station[low:high]] = np.arange(low, high)
        one, last = np.searchsorted(asked, [low, high])
        while one < last:
            upto = np.cumsum(degree[station[asked[one:last]]])
            end = one + max(1, int(np.searchsorted(upto, STEP, side="right")))
            mine = asked[one:end]
            many = degree[station[mine]]
            starts = np.cumsum(many) - many
            here = np.repeat(np.arange(len(mine)), many)
            others = b[np.arange(len(here)) + np.repeat(start[station[mine]] - starts, many)]
            yield at[one:end], here, cell[(time[mine] - begin)[here] * width + others], starts
            one = end


def evidence_columns(ml: str, temporal: str, threshold: float) -> dict[str, Column]:
    """Evidence count, class and reasons from model, history and neighbours."""
    # Class names and reason sentences.
    apart = F.coalesce(F.abs(F.col("station_value") - F.col("neighbor_average")) > threshold, F.lit(False))
    ml_hit, temporal_hit = F.col(ml) == 1, F.col(temporal) == 1
    score = flag(ml_hit) + flag(temporal_hit) + flag(apart)
    reasons = F.array_compact(
        F.array(
            F.when(ml_hit, "ML anomaly detected"),
            F.when(temporal_hit, "Temporal deviation detected"),
            F.when(apart, "Value differs significantly from nearby stations"),
        )
    )
    label = F.when(score >= 3, "Sensor Fault").when(score == 2, "Suspicious").otherwise("Likely Weather Event")
    return {"evidence_score": score, "classification": label, "reasons": reasons}


def classify_evidence(df: DataFrame, ml: str, temporal: str, cfg: QCConfig = DEFAULT) -> DataFrame:
    return df.withColumn(
        "spatial_difference", F.abs(F.col("station_value") - F.col("neighbor_average"))
    ).withColumns(evidence_columns(ml, temporal, cfg.spatial_threshold))


def correct_by_neighbors(df: DataFrame, last_valid: str | None = None) -> DataFrame:
    """Sensor faults take the neighbour average, else the last valid value, else stay."""
    options = [F.col("neighbor_average")] + ([F.col(last_valid)] if last_valid else []) + [F.col("station_value")]
    fixed = F.when(F.col("classification") == "Sensor Fault", F.coalesce(*options)).otherwise(F.col("station_value"))
    return df.withColumn("corrected_value", fixed)


def last_valid_values(df: DataFrame, parameter: str = "temperature", cfg: QCConfig = DEFAULT) -> DataFrame:
    return with_last_known(df, F.col(parameter), "last_valid", cfg.slice_hours)


def spatial_fault_type(parameter: str) -> Column:
    fault = F.col("classification") == "Sensor Fault"
    if parameter == "temperature":
        return F.when(fault & (F.col("station_value") < -20), "temperature_drop").when(fault, "temperature_spike")
    return F.when(fault, f"{parameter}_spike")


def spatial_batch(
    readings: DataFrame,
    observations: DataFrame,
    stations: DataFrame,
    parameter: str = "temperature",
    flag_col: str | None = None,
    start_health: int = 100,
    cfg: QCConfig = DEFAULT,
) -> DataFrame:
    """Consensus, class, correction, fault type and running health for listed observations.

    `observations` holds station_id, ts, ml_anomaly, temporal_anomaly. Only
    readings at listed times are compared; one plan serves the whole list.
    Listed keys without a reading are reported by `unknown_observations`.
    """
    at_times = readings.join(observations.select("ts").distinct(), "ts", "left_semi")
    summary = neighbor_summary(at_times, stations, parameter, flag_col, cfg=cfg)
    out = observations.select("station_id", "ts", "ml_anomaly", "temporal_anomaly").join(summary, ["station_id", "ts"])
    out = correct_by_neighbors(classify_evidence(out, "ml_anomaly", "temporal_anomaly", cfg))
    out = out.withColumn("fault_type", spatial_fault_type(parameter))
    out = with_running_sum(out, penalty(F.col("fault_type")), "_lost", cfg.slice_hours)
    out = out.withColumn("health_score", F.greatest(F.lit(0), F.lit(start_health) - F.col("_lost")).cast("bigint"))
    return out.withColumn("health_status", health_status(F.col("health_score"))).drop("_lost")


def unknown_observations(readings: DataFrame, observations: DataFrame) -> DataFrame:
    return observations.join(readings.select("station_id", "ts"), ["station_id", "ts"], "left_anti")


# --- all other stations at the same time ------------------------------------------


def leave_one_out(flagged: DataFrame, lookup: DataFrame, parameter: str = "temperature", cfg: QCConfig = DEFAULT) -> DataFrame:
    """Compare flagged readings with all other stations of the lookup table.

    Sum and count of the whole network per time, minus the station's own cell;
    duplicate cells are averaged first. Nothing is pivoted or paired.
    """
    cells = lookup.groupBy("ts", "station_id").agg(F.avg(parameter).alias("_cell"))
    per_time = stage(cells.groupBy("ts").agg(F.sum("_cell").alias("_sum"), F.count("_cell").alias("_n")), "per-time")
    out = flagged.join(cells, ["ts", "station_id"], "left")
    out = join_dim(out, per_time, ["ts"], spread="station_id", max_rows=cfg.broadcast_rows)
    count = F.coalesce(F.col("_n"), F.lit(0)) - F.when(F.col("_cell").isNotNull(), 1).otherwise(0)
    out = out.withColumn("neighbor_count", count)
    average = F.when(
        F.col("neighbor_count") > 0,
        (F.col("_sum") - F.coalesce(F.col("_cell"), F.lit(0.0))) / F.col("neighbor_count"),
    )
    out = out.withColumn("neighbor_avg_temperature", average).withColumn(
        "spatial_deviation", F.abs(F.col(parameter) - F.col("neighbor_avg_temperature"))
    )
    label = (
        F.when((F.col("neighbor_count") < 2) | F.col("spatial_deviation").isNull(), "INSUFFICIENT_DATA")
        .when(F.col("spatial_deviation") <= cfg.spatial_threshold, "WEATHER_EVENT")
        .otherwise("SENSOR_FAULT")
    )
    return out.withColumn("spatial_classification", label).drop("_cell", "_sum", "_n")


def boost_confidence(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Raise confidence where diagnosis and neighbours agree; nothing is filtered."""
    if "spatial_classification" not in df.columns:
        return df
    agree = F.coalesce(
        (F.col("diagnosed_fault") != "NORMAL") & (F.col("spatial_classification") == "SENSOR_FAULT"), F.lit(False)
    )
    raised = F.least(F.col("diagnosis_confidence") + cfg.confidence_boost, F.lit(1.0))
    boosted = F.when(F.col("diagnosis_confidence").isNotNull(), raised)
    return df.withColumn("diagnosis_confidence", F.when(agree, boosted).otherwise(F.col("diagnosis_confidence")))


SPATIAL_COLUMNS = ("neighbor_avg_temperature", "neighbor_count", "spatial_deviation", "spatial_classification")


def merge_spatial(df: DataFrame, spatial: DataFrame) -> DataFrame:
    return df.join(spatial.select("ts", "station_id", *SPATIAL_COLUMNS), ["ts", "station_id"], "left")


def station_pivot(df: DataFrame, parameter: str = "temperature", width: int = 100) -> DataFrame:
    """Time by station table of all stations, in blocks of `width` columns.

    Column c<k> of block b is station b * width + k, so the width does not grow with the stations; negative
    numbers have negative blocks. A reading without a station has no place and raises an error.
    """
    s = F.col("station_id")
    cell = F.when(s.isNull(), F.raise_error(F.lit("station_pivot: a reading has no station_id")).cast("string"))
    cell = cell.otherwise(F.concat(F.lit("c"), F.pmod(s, F.lit(width))))
    placed = df.select("ts", F.floor(s / width).alias("block"), cell.alias("_cell"), parameter)
    return placed.groupBy("block", "ts").pivot("_cell", [f"c{k}" for k in range(width)]).agg(F.avg(parameter))


def regional_heat(df: DataFrame, limit: float = 40.0, min_stations: int = 2) -> DataFrame:
    """Times at which several stations are hot together."""
    out = _per_time(df.filter(F.col("temperature") >= limit))
    return out.filter(F.col("station_count") >= min_stations).orderBy(
        F.col("station_count").desc(), F.col("average_temperature").desc(), "ts"
    )


def candidate_times(df: DataFrame, low: float = 20.0, high: float = 35.0, min_stations: int = 2) -> DataFrame:
    return _per_time(df).filter(
        (F.col("station_count") >= min_stations) & F.col("average_temperature").between(low, high)
    )


def _per_time(df: DataFrame) -> DataFrame:
    # first per (time, station), so that no time's rows meet in one task unreduced
    cells = df.groupBy("ts", "station_id").agg(
        F.sum("temperature").alias("_s"),
        F.count("temperature").alias("_c"),
        F.max("temperature").alias("_hi"),
        F.min("temperature").alias("_lo"),
    )
    return cells.groupBy("ts").agg(
        F.count(F.lit(1)).alias("station_count"),
        (F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0))).alias("average_temperature"),
        F.max("_hi").alias("max_temperature"),
        F.min("_lo").alias("min_temperature"),
    )


def latest_spatial_check(df: DataFrame, k: int = 3, start_degrees: float = 1.0) -> DataFrame:
    """Each station's newest reading against the k nearest readings of that time.

    Distances are planar, in degrees, as on a small map. Targets look into the
    grid cells of their own time within a radius that grows until k readings, or
    all there are, have been found.
    """
    rest = F.struct("ts", "latitude", "longitude", "temperature")
    latest = df.groupBy("station_id").agg(F.max_by(rest, "ts").alias("_l")).select("station_id", "_l.*")
    placed = df.dropna(subset=["latitude", "longitude", "temperature"])
    per_time = placed.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"))
    targets = stage(
        latest.dropna(subset=["latitude", "longitude", "temperature"])
        .join(per_time, "ts")
        .withColumn("_want", F.least(F.lit(k), F.col("_n") - 1))
        .filter(F.col("_want") > 0)
        .drop("_n"),
        "targets",
    )
    at_times = stage(
        placed.join(targets.select("ts").distinct(), "ts", "left_semi").select(
            "ts",
            F.col("station_id").alias("b"),
            F.col("temperature").alias("_t"),
            F.col("latitude").alias("lat_b"),
            F.col("longitude").alias("lon_b"),
        ),
        "at-times",
    )
    order = Window.partitionBy("station_id").orderBy("_d", "b")
    open_targets, done, radius = targets, None, start_degrees
    while True:
        cell = lambda c, r=radius: F.floor(c / r)
        around = lambda c, r=radius: F.explode(F.sequence(F.floor(c / r) - 1, F.floor(c / r) + 1))
        homes = at_times.withColumns({"_row": cell(F.col("lat_b")), "_col": cell(F.col("lon_b"))})
        search = open_targets.withColumn("_row", around(F.col("latitude"))).withColumn("_col", around(F.col("longitude")))
        apart = F.sqrt(F.pow(F.col("lat_b") - F.col("latitude"), 2) + F.pow(F.col("lon_b") - F.col("longitude"), 2))
        near = (
            search.join(homes, ["ts", "_row", "_col"])
            .filter(F.col("station_id") != F.col("b"))
            .withColumn("_d", apart)
            .filter(F.col("_d") <= radius)
            .withColumn("_rank", F.row_number().over(order))
            .filter(F.col("_rank") <= k)
        )
        found = near.groupBy("station_id", "ts", "temperature", "_want").agg(
            F.count(F.lit(1)).alias("n_neighbors"), F.avg("_t").alias("neighbor_average")
        )
        found = stage(found.filter(F.col("n_neighbors") >= F.col("_want")).drop("_want"), "found")
        done = found if done is None else done.unionByName(found)
        open_targets = stage(open_targets.join(found.select("station_id"), "station_id", "left_anti"), "open-targets")
        if fits(open_targets, 0) or radius > 512:
            break
        radius *= 4
    return done.withColumn("spatial_difference", F.col("temperature") - F.col("neighbor_average"))
