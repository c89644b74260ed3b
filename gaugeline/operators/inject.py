"""Labelled synthetic faults, written from a spec table in one pass.

A spec row is (seq, variable, fault, station_id, start_ts, duration, severity).
Specs meet readings by (station, time bucket), so a station with very many
readings or specs is still spread over tasks. Only the hit rows are windowed;
the other readings are never sorted.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import (
    DEFAULT,
    DRIFT_STEP,
    FAULT_DURATIONS,
    MULTIVARIATE_SHIFT,
    NOISE_SIGNS,
    SEVERITIES,
    SEVERITY_MAGNITUDE,
    QCConfig,
)
from gaugeline.operators.slices import epoch_seconds, slice_of, with_row_number
from gaugeline.operators.staging import fits, join_dim, stage

VARIABLES = ("temperature", "humidity", "pressure")
TIMED_FAULTS = ("spike", "drop", "frozen", "drift", "noise", "missing", "multivariate")
BUCKET_HOURS = 6


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def _by_variable(severity: Column) -> Column:
    out = None
    for v, table in SEVERITY_MAGNITUDE.items():
        cond, val = F.col("variable") == v, _lookup(table, severity)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def unit_hash(*cols: Column, seed: int = 42) -> Column:
    """Uniform number in (0, 1) from the row's keys, by MD5: the same under any partitioning and in any SQL engine."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def gauss_hash(*cols: Column, seed: int = 42) -> Column:
    """Standard normal number from the row's keys."""
    u, v = unit_hash(*cols, seed=seed), unit_hash(*cols, seed=seed + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def spec_hits(df: DataFrame, spec: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """One row for each reading and fault span that holds it, numbered along the span (`_i` from 1)."""
    width = BUCKET_HOURS * 3600
    spec = spec.withColumn("end_ts", F.timestamp_add("HOUR", F.col("duration").cast("int"), F.col("start_ts")))
    first, last = F.floor(epoch_seconds("start_ts") / width), F.floor((epoch_seconds("end_ts") - 1) / width)
    spans = spec.filter(F.col("duration") > 0).withColumn("_bucket", F.explode(F.sequence(first, last)))
    readings = df.select("station_id", "ts", *VARIABLES).withColumn("_bucket", F.floor(epoch_seconds() / width))
    # the exploded buckets are what is sent, so they are what is counted
    right = F.broadcast(spans) if fits(spans, cfg.broadcast_rows) else spans
    hits = readings.join(right, ["station_id", "_bucket"]).filter(
        (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts"))
    )
    return hits.withColumn("_i", F.row_number().over(Window.partitionBy("station_id", "seq").orderBy("ts")))


def _known(amount: Column) -> Column:
    """The amount, or an error where the spec names an unknown fault, variable or severity."""
    names = F.concat_ws("/", "variable", "fault", "severity")
    return F.coalesce(amount, F.raise_error(F.concat(F.lit("fault spec not understood: "), names)))


def _op(kind: Column, amount: Column, fault_type: Column) -> Column:
    """What one spec does to one reading: 'add' an amount, 'set' it, 'hold' the span's first value, or 'blank'."""
    return F.struct(
        "seq",
        "variable",
        kind.alias("kind"),
        amount.cast("double").alias("amount"),
        (F.col("_i") == 1).alias("opens"),
        fault_type.alias("fault_type"),
        F.col("severity").alias("fault_severity"),
    )


def _timed_op(seed: int) -> Column:
    fault, sev = F.col("fault"), F.col("severity")
    signs = F.array(*[F.lit(s) for s in NOISE_SIGNS])
    sign = F.get(signs, (F.pmod(F.col("_i") - 1, F.lit(len(NOISE_SIGNS)))).cast("int"))
    u = unit_hash(F.col("station_id"), F.col("seq"), F.col("_i"), seed=seed)
    amount = (
        F.when(~F.col("variable").isin(*VARIABLES), F.lit(None).cast("double"))
        .when(fault == "spike", _by_variable(sev))
        .when(fault == "drop", -_by_variable(sev))
        .when(fault == "drift", F.col("_i") * _lookup(DRIFT_STEP, sev))
        .when(fault == "noise", sign * _by_variable(sev) * (0.4 + 0.6 * u))
        .when(fault == "multivariate", _lookup(MULTIVARIATE_SHIFT, sev))
        .when(fault.isin("frozen", "missing"), 0.0)
    )
    kind = F.when(fault == "frozen", "hold").when(fault == "missing", "blank").otherwise("add")
    named = F.when(fault == "multivariate", "multivariate_inconsistency").otherwise(F.concat_ws("_", "variable", "fault"))
    return _op(kind, _known(amount), named)


def _fold(ops: Column, start: Column) -> Column:
    """(held, value) after ops in seq order: `value` itself, or to be added to what span `held` holds."""
    state = lambda held, value: F.struct(held.alias("held"), value.alias("value"))
    none, blank = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    step = lambda acc, op: (
        F.when(op["kind"] == "add", state(acc["held"], acc["value"] + op["amount"]))
        .when(op["kind"] == "set", state(none, op["amount"]))
        .when(op["kind"] == "hold", state(op["seq"].cast("bigint"), F.lit(0.0)))
        .otherwise(state(none, blank))
    )
    return F.aggregate(ops, state(none, start.cast("double")), step)


def _held_values(cells: DataFrame, chained: bool) -> DataFrame:
    """The value each frozen span holds: its variable at the span's first reading, after all earlier specs.

    Where frozen spans may start inside others (`chained`), references are shortened by
    doubling; they lead to ever smaller seq, so the rounds are the logarithm of the longest chain.
    """
    opening = cells.withColumn("op", F.explode(F.filter("ops", lambda o: (o["kind"] == "hold") & o["opens"])))
    start = F.coalesce(*[F.when(F.col("op.variable") == v, F.col(v)) for v in VARIABLES])
    earlier = F.filter("ops", lambda o: (o["variable"] == F.col("op.variable")) & (o["seq"] < F.col("op.seq")))
    starts = opening.select("station_id", F.col("op.seq").cast("bigint").alias("seq"), _fold(earlier, start).alias("at"))
    starts = starts.select("station_id", "seq", "at.held", "at.value")
    while chained:
        starts = stage(starts, "held-values")
        chained = starts.filter("held IS NOT NULL").limit(1).count() > 0
        if chained:
            base = starts.select("station_id", F.col("seq").alias("held"), F.col("held").alias("up"), F.col("value").alias("base"))
            value = F.when(F.col("held").isNull(), F.col("value")).otherwise(F.col("value") + F.col("base"))
            starts = starts.join(base, ["station_id", "held"], "left").select("station_id", "seq", F.col("up").alias("held"), value.alias("value"))
    return starts.select("station_id", F.col("seq").alias("held"), F.col("value").alias("_base"))


def _in_order(hits: DataFrame, op: Column, spec: DataFrame, cfg: QCConfig) -> DataFrame:
    """New values and labels of the hit readings, specs applied one after the other by seq.

    A spec changes its own variable only, on top of what earlier specs left there;
    the labels are those of the latest spec.
    """
    cells = hits.withColumn("_op", op).groupBy("station_id", "ts").agg(
        *[F.first(v).alias(v) for v in VARIABLES], F.array_sort(F.collect_list("_op")).alias("ops")
    )
    frozen = spec.filter("fault = 'frozen'").limit(1).count() > 0
    per_variable = lambda v: F.filter("ops", lambda o: o["variable"] == v)
    out = cells.withColumns({f"_{v}": _fold(per_variable(v), F.col(v)) for v in VARIABLES})
    if frozen:
        holds = _held_values(cells, True)
        known = fits(spec, cfg.broadcast_rows)
        for v in VARIABLES:
            mine = holds.withColumnRenamed("_base", f"_base_{v}")
            out = out.withColumn("held", F.col(f"_{v}.held"))
            out = join_dim(out, mine, ["station_id", "held"], spread="ts", max_rows=0, rows=0 if known else 1).drop("held")
        new = lambda v: F.when(F.col(f"_{v}.held").isNull(), F.col(f"_{v}.value")).otherwise(F.col(f"_base_{v}") + F.col(f"_{v}.value"))
    else:
        new = lambda v: F.col(f"_{v}.value")
    last = F.element_at("ops", -1)
    return out.select(
        "station_id",
        "ts",
        *[new(v).alias(f"new_{v}") for v in VARIABLES],
        last["fault_type"].alias("fault_type"),
        last["fault_severity"].alias("fault_severity"),
    )


def _write_faults(df: DataFrame, changed: DataFrame) -> DataFrame:
    """Put changed values and labels into the table; untouched rows get the defaults."""
    out = df.join(changed, ["station_id", "ts"], "left")
    hit = F.col("fault_type").isNotNull()
    return out.withColumns(
        {
            **{f"original_{v}": F.col(v) for v in VARIABLES},
            "is_anomaly": F.when(hit, 1).otherwise(0),
        }
    ).withColumns(
        {
            **{v: F.when(hit, F.col(f"new_{v}")).otherwise(F.col(v)) for v in VARIABLES},
            "fault_type": F.coalesce("fault_type", F.lit("normal")),
            "fault_severity": F.coalesce("fault_severity", F.lit("none")),
        }
    ).drop(*[f"new_{v}" for v in VARIABLES])


def inject_faults(df: DataFrame, spec: DataFrame, seed: int = 42, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Apply a spec of timed faults in seq order and add the ground-truth columns.

    Unknown faults, variables and severities raise an error.
    """
    return _write_faults(df, _in_order(spec_hits(df, spec, cfg), _timed_op(seed), spec, cfg))


def inject_at_rows(df: DataFrame, spec: DataFrame, seed: int = 42, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Faults placed by row position in the station's history.

    Spec: seq, station_id, start_row (from 0), duration (rows), variable, fault,
    amount, severity. spike sets `amount`, drift adds amount * i with i from 0,
    noise adds a normal number times amount, frozen repeats the first value,
    missing blanks.
    """
    numbered = with_row_number(df, "_rn", cfg.slice_hours).withColumn("_row", F.col("_rn") - 1)
    cells = spec.filter(F.col("duration") > 0).withColumn(
        "_row", F.explode(F.sequence(F.col("start_row"), F.col("start_row") + F.col("duration") - 1))
    )
    cells = F.broadcast(cells) if fits(cells, cfg.broadcast_rows) else cells
    hits = numbered.select("station_id", "ts", "_row", *VARIABLES).join(cells, ["station_id", "_row"])
    step = F.col("_row") - F.col("start_row")
    hits = hits.withColumn("_i", F.row_number().over(Window.partitionBy("station_id", "seq").orderBy("ts")))
    fault = F.col("fault")
    amount = (
        F.when(~F.col("variable").isin(*VARIABLES), F.lit(None).cast("double"))
        .when(fault == "spike", F.col("amount"))
        .when(fault == "drift", F.col("amount") * step)
        .when(fault == "noise", F.col("amount") * gauss_hash(F.col("station_id"), F.col("seq"), step, seed=seed))
        .when(fault.isin("frozen", "missing"), 0.0)
    )
    kind = F.when(fault == "spike", "set").when(fault == "frozen", "hold").when(fault == "missing", "blank").otherwise("add")
    op = _op(kind, _known(amount), F.concat_ws("_", "variable", "fault"))
    return _write_faults(df, _in_order(hits, op, spec, cfg))


def invalid_row_specs(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Row specs that cannot be placed, each with its reason."""
    sizes = df.groupBy("station_id").agg(F.count(F.lit(1)).alias("_n"))
    out = spec.join(sizes, "station_id", "left")
    problem = (
        F.when(F.col("_n").isNull(), "unknown station")
        .when(F.col("start_row") < 0, "start before first row")
        .when(F.col("duration") <= 0, "duration not positive")
        .when(F.col("start_row") + F.col("duration") > F.col("_n"), "span exceeds rows")
    )
    return out.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_n")


# --- schedules --------------------------------------------------------------------


def overlapping_specs(spec: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Specs that start before an earlier span of their station has ended (half-open).

    The latest end so far is a running maximum in (start, seq) order, kept per
    time slice and carried over slices; no pairs are formed.
    """
    spans = spec.withColumn(
        "end_ts", F.timestamp_add("HOUR", F.col("duration").cast("int"), F.col("start_ts"))
    ).withColumn("_slice", slice_of("start_ts", cfg.slice_hours))
    order = Window.partitionBy("station_id", "_slice").orderBy("start_ts", "seq")
    before = Window.partitionBy("station_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spans.groupBy("station_id", "_slice")
        .agg(F.max("end_ts").alias("_end"))
        .withColumn("_carried", F.max("_end").over(before))
        .drop("_end")
    )
    local = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = spans.withColumn("_local", local).join(carried, ["station_id", "_slice"], "left")
    latest = F.greatest("_local", "_carried")
    return out.filter(F.col("start_ts") < latest).drop("_local", "_carried", "_slice", "end_ts")


def _choose(options, *key: Column, seed: int) -> Column:
    """One of the options, by the hash of the row's key."""
    index = F.floor(unit_hash(*key, seed=seed) * len(options)).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), index)


def first_free(candidates: DataFrame, one_per: str | None = None) -> DataFrame:
    """The candidates that overlap none chosen before them, in the order (turn, draw, station_id, start_ts).

    With `one_per`, at most one for each of its values. Chosen in rounds: a candidate stands if no open one before it is in
    conflict with it, and what conflicts with those that stand drops out. The first open candidate always stands, so the
    rounds end, and the result is that of going through them one by one. With random draws a round settles a
    fixed share of the candidates, so the rounds grow with the logarithm of their number. Repeated rows are one candidate.
    """
    names = candidates.columns
    rank = F.struct("turn", "draw", "station_id", "start_ts").alias("rank")
    end = F.timestamp_add("HOUR", F.col("duration").cast("int"), F.col("start_ts"))
    open_ = stage(candidates.dropDuplicates(["turn", "draw", "station_id", "start_ts"]).select("*", rank), "open")
    width = BUCKET_HOURS * 3600
    buckets = F.sequence(F.floor(epoch_seconds("start_ts") / width), F.floor(epoch_seconds("end_ts") / width))
    spans = open_.select("station_id", "rank", "start_ts", end.alias("end_ts")).withColumn("bucket", F.explode(buckets))
    a, b = spans.alias("a"), spans.alias("b")
    meet = (F.col("a.station_id") == F.col("b.station_id")) & (F.col("a.bucket") == F.col("b.bucket"))
    overlap = (F.col("a.start_ts") < F.col("b.end_ts")) & (F.col("a.end_ts") > F.col("b.start_ts"))
    pairs = a.join(b, meet & overlap & (F.col("a.rank") < F.col("b.rank")))
    pairs = stage(pairs.select(F.col("a.rank").alias("first"), F.col("b.rank").alias("rank")).distinct(), "conflicts")
    chosen = None
    while True:
        live = pairs.join(open_.select(F.col("rank").alias("first")), "first", "left_semi")
        stands = open_.join(live.select("rank"), "rank", "left_anti")
        if one_per:
            # the first of all open ones of its turn, or an earlier one may yet stand
            leads = open_.groupBy(one_per).agg(F.min("rank").alias("rank")).select("rank")
            stands = stands.join(leads, "rank", "left_semi")
        stands = stage(stands.select(*names, "rank"), "chosen")
        if stands.isEmpty():
            break
        chosen = stands if chosen is None else chosen.unionByName(stands)
        gone = pairs.join(stands.select(F.col("rank").alias("first")), "first", "left_semi").select("rank")
        left = open_.join(stands.select("rank").unionByName(gone), "rank", "left_anti")
        if one_per:
            left = left.join(stands.select(one_per), one_per, "left_anti")
        open_ = stage(left.select(*names, "rank"), "open")
    return (open_ if chosen is None else chosen).select(*names)


def random_schedule(df: DataFrame, n_faults: int = 100, seed: int = 42, tries_per_fault: int = 10) -> DataFrame:
    """n_faults random faults on random readings, never overlapping within a station.

    Candidates are the readings with the lowest hashes, so the schedule does not
    depend on partitioning; there are n_faults * tries_per_fault of them in all.
    Overlaps are resolved in draw order.
    """
    key = [F.col("station_id"), F.col("ts").cast("string")]
    drawn = df.select("station_id", "ts", unit_hash(*key, seed=seed).alias("draw"))
    drawn = drawn.orderBy("draw", "station_id", "ts").limit(n_faults * tries_per_fault)
    fault = _choose(("spike", "drop", "frozen", "drift", "missing", "multivariate"), *key, seed=seed + 2)
    candidates = drawn.select(
        "station_id",
        F.col("ts").alias("start_ts"),
        "draw",
        F.lit(0).alias("turn"),
        fault.alias("fault"),
        # a multivariate fault shifts temperature and leaves the others
        F.when(fault == "multivariate", "temperature")
        .otherwise(_choose(VARIABLES, *key, seed=seed + 1))
        .alias("variable"),
        _choose(FAULT_DURATIONS, *key, seed=seed + 3).cast("bigint").alias("duration"),
        _choose(SEVERITIES, *key, seed=seed + 4).alias("severity"),
    )
    free = first_free(candidates)
    return _numbered(free.orderBy("draw", "station_id", "start_ts").limit(n_faults))


def one_of_each_schedule(
    df: DataFrame,
    taken: DataFrame,
    variables=("humidity", "pressure"),
    faults=("spike", "frozen", "drift", "noise", "missing"),
    seed: int = 42,
    tries: int = 200,
    edge_rows: int = 200,
    cfg: QCConfig = DEFAULT,
) -> DataFrame:
    """One fault of each type and variable, away from the ends of a history.

    `taken` holds regions (station_id, region_start, region_end) that stay free of
    new faults. Every combination draws `tries` candidate readings.
    """
    numbered = with_row_number(df.select("station_id", "ts"), "_rn", cfg.slice_hours)
    sizes = df.groupBy("station_id").agg(F.count(F.lit(1)).alias("_n"))
    inner = join_dim(numbered, sizes, ["station_id"], spread="ts", max_rows=cfg.broadcast_rows)
    inner = inner.filter((F.col("_rn") > edge_rows) & (F.col("_rn") <= F.col("_n") - edge_rows))
    combos = [(i, v, f) for i, (v, f) in enumerate((v, f) for v in variables for f in faults)]
    key = [F.col("station_id"), F.col("ts").cast("string"), F.col("turn")]
    each = inner.select("station_id", "ts", F.inline(F.array(*[
        F.struct(F.lit(i).alias("turn"), F.lit(v).alias("variable"), F.lit(f).alias("fault")) for i, v, f in combos
    ])))
    best = Window.partitionBy("turn").orderBy("draw", "station_id", "ts")
    # the rank limit keeps `tries` rows per combination and map task before the shuffle
    drawn = each.withColumn("draw", unit_hash(*key, seed=seed)).withColumn("_rank", F.row_number().over(best))
    candidates = drawn.filter(F.col("_rank") <= tries).select(
        "station_id",
        F.col("ts").alias("start_ts"),
        "draw",
        "turn",
        "fault",
        "variable",
        _choose(FAULT_DURATIONS, *key, seed=seed + 3).cast("bigint").alias("duration"),
        _choose(SEVERITIES, *key, seed=seed + 4).alias("severity"),
    )
    candidates = stage(candidates, "candidates")
    width = BUCKET_HOURS * 3600
    buckets = lambda s, e: F.explode(F.sequence(F.floor(epoch_seconds(s) / width), F.floor(epoch_seconds(e) / width)))
    ends = candidates.withColumn("_end", F.timestamp_add("HOUR", F.col("duration").cast("int"), F.col("start_ts")))
    blocked = (
        ends.withColumn("_b", buckets("start_ts", "_end"))
        .join(taken.withColumn("_b", buckets("region_start", "region_end")), ["station_id", "_b"])
        .filter((F.col("start_ts") < F.col("region_end")) & (F.col("_end") > F.col("region_start")))
        .select("station_id", "start_ts", "turn")
        .distinct()
    )
    open_ = candidates.join(blocked, ["station_id", "start_ts", "turn"], "left_anti").select(*candidates.columns)
    # a later combination must see the earlier ones
    return _numbered(first_free(open_, "turn"))


def _numbered(schedule: DataFrame) -> DataFrame:
    order = Window.orderBy("turn", "draw", "station_id", "start_ts")  # a short schedule
    return schedule.select(
        F.row_number().over(order).cast("bigint").alias("seq"),
        "variable",
        "fault",
        "station_id",
        "start_ts",
        "duration",
        "severity",
    )


# --- reports ----------------------------------------------------------------------


def fault_islands(df: DataFrame, gap_hours: int = 1, pad_hours: int = 1, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Merge anomalous times at most gap_hours apart into regions, padded on both sides.

    Each time slice yields its own islands; the few that touch across a slice
    border are merged on the island table.
    """
    bad = df.filter(F.col("is_anomaly") == 1).select("station_id", "ts").withColumn("_slice", slice_of("ts", cfg.slice_hours))
    w = Window.partitionBy("station_id", "_slice").orderBy("ts")
    fresh = epoch_seconds() - F.lag(epoch_seconds()).over(w) > gap_hours * 3600
    local = bad.withColumn("_new", F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = local.groupBy("station_id", "_slice", "_island").agg(
        F.min("ts").alias("_s"), F.max("ts").alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    # an island is new unless it is its slice's first and follows the slice before closely
    edges = parts.groupBy("station_id", "_slice").agg(F.max("_e").alias("_edge"), F.max("_island").alias("_count"))
    history = Window.partitionBy("station_id").orderBy("_slice")
    joins = F.coalesce(
        epoch_seconds("_first") - epoch_seconds(F.lag("_edge").over(history)) <= gap_hours * 3600, F.lit(False)
    )
    edges = edges.join(
        parts.filter(F.col("_island") == 1).select("station_id", "_slice", F.col("_s").alias("_first")),
        ["station_id", "_slice"],
    ).withColumn("_joins", joins.cast("int"))
    before = history.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("_count") - F.col("_joins")).over(before), F.lit(0))
    edges = edges.withColumn("_base", base).select("station_id", "_slice", "_joins", "_base")
    merged = parts.join(edges, ["station_id", "_slice"]).withColumn(
        "_id", F.col("_base") + F.col("_island") - F.col("_joins")
    )
    pad = lambda c, h: F.timestamp_add("HOUR", F.lit(h), c)
    out = merged.groupBy("station_id", "_id").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("n_rows")
    )
    return out.select(
        "station_id",
        pad(F.col("_s"), -pad_hours).alias("region_start"),
        pad(F.col("_e"), pad_hours).alias("region_end"),
        "n_rows",
    )


def fault_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("fault_type", "fault_severity").agg(F.count(F.lit(1)).alias("n_rows"))


def fault_crosstab(df: DataFrame, fault_types) -> DataFrame:
    """Rows per station and fault type; the listed types become columns."""
    return df.groupBy("station_id").pivot("fault_type", list(fault_types)).agg(F.count(F.lit(1))).na.fill(0)


def injection_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Readings that an injection changed or labelled, with old and new values."""
    old = before.select("station_id", "ts", *[F.col(v).alias(f"before_{v}") for v in VARIABLES])
    new = after.filter(F.col("is_anomaly") == 1).select(
        "station_id", "ts", "fault_type", "fault_severity", *[F.col(v).alias(f"after_{v}") for v in VARIABLES]
    )
    return new.join(old, ["station_id", "ts"])
