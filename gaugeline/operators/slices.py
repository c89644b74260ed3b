"""Window work on station histories without one task per station.

A station may hold a large share of all rows, so no window here is partitioned
by station alone over the readings. Each history is cut into time slices; a
slice gets copies ("halo") of the earlier readings its windows look back on (those
of the slice before it, or of blocks of slices where that one has too few),
and sums that run over the whole history are finished from one summary row per
slice. The number of slices per station depends on the time span only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT
from gaugeline.operators.staging import stage

SLICE = "_slice"
HALO = "_halo"
KEY = "station_id"


def epoch_seconds(ts: str | Column = "ts") -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(col.cast("timestamp"))


def slice_of(ts: str = "ts", slice_hours: int = DEFAULT.slice_hours) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(slice_hours * 3600)).cast("bigint")


def with_slices(df: DataFrame, slice_hours: int = DEFAULT.slice_hours) -> DataFrame:
    return df.withColumn(SLICE, slice_of("ts", slice_hours))


def fit_slice_hours(df: DataFrame, target_rows: int = 500_000, floor_hours: int = 24) -> int:
    """Slice length for which the busiest station-day yields about target_rows per slice."""
    daily = df.groupBy(KEY, F.date_trunc("day", "ts").alias("day")).count()
    busiest = daily.agg(F.max("count")).first()[0] or 1
    return int(max(floor_hours, min(24 * 365, 24 * (target_rows // busiest))))


def slice_window(descending: bool = False) -> WindowSpec:
    order = F.col("ts").desc() if descending else F.col("ts")
    return Window.partitionBy(KEY, SLICE).orderBy(order)


def with_lookback(
    df: DataFrame,
    rows: int,
    hours: int = 0,
    carry: Sequence[str] | None = None,
    slice_hours: int = DEFAULT.slice_hours,
) -> DataFrame:
    """Add `_slice` and halo copies so that slice windows see their past.

    Every slice receives the readings of the `hours` before it and, however old
    they are, the last `rows` readings before it. Halo copies have `_halo` true
    and hold the `carry` columns only; drop them with `drop_halo`.
    """
    if hours > slice_hours:
        raise ValueError("the look-back may not be longer than a slice")
    carry = [c for c in (carry or df.columns) if c not in (KEY, "ts")]
    width = slice_hours * 3600
    sliced = with_slices(df, slice_hours)

    if hours:
        near_end = epoch_seconds() >= (F.col(SLICE) + 1) * width - hours * 3600
        here = F.struct(F.col(SLICE).alias("s"), F.lit(False).alias("h"))
        ahead = F.struct((F.col(SLICE) + 1).alias("s"), F.lit(True).alias("h"))
        own = (
            sliced.withColumn("_to", F.explode(F.when(near_end, F.array(here, ahead)).otherwise(F.array(here))))
            .withColumn(SLICE, F.col("_to.s"))
            .withColumn(HALO, F.col("_to.h"))
            .drop("_to")
        )
    else:
        own = sliced.withColumn(HALO, F.lit(False))

    tails = stage(_tails(sliced.select(KEY, SLICE, "ts", *carry), [KEY, SLICE], rows), "tails")
    older = tails.filter(F.size("_tail") == rows).select(KEY, (F.col(SLICE) + 1).alias(SLICE), F.inline("_tail"))
    deeper = _beyond_short_slices(tails, carry, rows)
    if deeper is not None:
        older = older.unionByName(deeper)
    older = older.filter(epoch_seconds() < F.col(SLICE) * width - hours * 3600).withColumn(HALO, F.lit(True))
    return own.unionByName(older, allowMissingColumns=True)


def _tails(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The last `rows` readings of each group as one array `_tail`; the rank limit is applied before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    kept = df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= rows)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_tail"))


def _beyond_short_slices(tails: DataFrame, carry: Sequence[str], rows: int) -> DataFrame | None:
    """The last `rows` readings before each slice that follows a slice with fewer readings (or none), or nothing if no slice does.

    The slices before one are a union of aligned blocks of 1, 2, 4, ... slices, one for each bit of its number. The last
    readings of all blocks are taken from the tails at once, each slice meets its few blocks and keeps the last of theirs.
    So no group holds a station's history, whatever the gaps in it.
    """
    short = F.when(F.size("_tail") < rows, 1).otherwise(0)
    span = tails.groupBy(KEY).agg(
        F.min(SLICE).alias("_first"),
        (F.max(SLICE) - F.min(SLICE) + 1 - F.count(F.lit(1))).alias("_gaps"),
        (F.sum(short) - F.max_by(short, SLICE)).alias("_short"),
    )
    # stations without gaps whose slices but the last are full need nothing more
    gappy = span.filter("_gaps > 0 OR _short > 0").select(KEY, "_first")
    if gappy.isEmpty():
        return None
    tails = stage(tails.join(gappy, KEY), "tails-with-gaps")
    fed = tails.filter(F.size("_tail") == rows).select(KEY, (F.col(SLICE) + 1).alias(SLICE))
    asking = tails.filter(F.col(SLICE) > F.col("_first")).select(KEY, SLICE).join(fed, [KEY, SLICE], "left_anti")
    base, last = tails.agg(F.min(SLICE), F.max(SLICE)).first()
    levels = F.sequence(F.lit(0), F.lit((last - base).bit_length()))
    place = F.col(SLICE) - F.lit(base)
    block = lambda c: F.expr(f"shiftright({c}, _level)")
    wanted = asking.select(KEY, SLICE, place.alias("_place"), F.explode(levels).alias("_level"))
    wanted = wanted.filter(block("_place") % 2 == 1).select(KEY, SLICE, "_level", (block("_place") - 1).alias("_block"))
    each = tails.select(KEY, place.alias("_place"), F.inline("_tail"))
    each = each.withColumn("_level", F.explode(levels)).withColumn("_block", block("_place")).filter("_block % 2 = 0").drop("_place")
    blocks = _tails(each, [KEY, "_level", "_block"], rows)
    met = wanted.join(blocks, [KEY, "_level", "_block"]).select(KEY, SLICE, F.inline("_tail"))
    return _tails(met, [KEY, SLICE], rows).select(KEY, SLICE, F.inline("_tail")).select(KEY, SLICE, "ts", *carry)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO)


def without_slices(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, HALO)


def with_carry(
    df: DataFrame,
    summaries: Sequence[Column],
    carries: dict[str, Callable[[WindowSpec, WindowSpec], Column]],
    prepare: Callable[[DataFrame], DataFrame] = lambda per_slice: per_slice,
) -> DataFrame:
    """Join values carried over from the other slices of the same station.

    `summaries` are aggregates per (station, slice). `carries` maps a column name
    to a function of two windows over the slice summaries: those before the
    current slice and (newest first) those after it. `prepare` may add columns to
    the summaries first.
    """
    before, after = history_windows()
    per_slice = prepare(df.groupBy(KEY, SLICE).agg(*summaries))
    carried = per_slice.select(KEY, SLICE, *[fn(before, after).alias(name) for name, fn in carries.items()])
    return df.join(carried, [KEY, SLICE], "left")


def history_windows() -> tuple[WindowSpec, WindowSpec]:
    """Over slice summaries: the slices before, and (newest first) the slices after."""
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(KEY).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return before, after


def with_row_number(df: DataFrame, name: str = "rn", slice_hours: int = DEFAULT.slice_hours) -> DataFrame:
    """1-based position of every reading in its station's history."""
    local = with_slices(df, slice_hours).withColumn("_pos", F.row_number().over(slice_window()))
    placed = with_carry(
        local,
        [F.count(F.lit(1)).alias("_n")],
        {"_skip": lambda before, after: F.coalesce(F.sum("_n").over(before), F.lit(0))},
    )
    return placed.withColumn(name, (F.col("_pos") + F.col("_skip")).cast("bigint")).drop("_pos", "_skip", SLICE)


def with_running_sum(
    df: DataFrame, value: Column, name: str, slice_hours: int = DEFAULT.slice_hours
) -> DataFrame:
    """Sum of `value` over a station's readings up to and including the current one."""
    local = with_slices(df, slice_hours).withColumn("_v", value)
    local = local.withColumn("_sum", F.sum("_v").over(slice_window().rowsBetween(Window.unboundedPreceding, 0)))
    placed = with_carry(
        local,
        [F.sum("_v").alias("_total")],
        {"_base": lambda before, after: F.coalesce(F.sum("_total").over(before), F.lit(0))},
    )
    return placed.withColumn(name, F.col("_base") + F.coalesce("_sum", F.lit(0))).drop("_v", "_sum", "_base", SLICE)


def with_last_known(
    df: DataFrame, value: Column, name: str, slice_hours: int = DEFAULT.slice_hours
) -> DataFrame:
    """Newest non-null `value` strictly before the current reading."""
    local = with_slices(df, slice_hours).withColumn("_v", value)
    past = slice_window().rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumn("_known", F.last("_v", ignorenulls=True).over(past))
    placed = with_carry(
        local,
        [F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("ts"))).alias("_newest")],
        {"_old": lambda before, after: F.last("_newest", ignorenulls=True).over(before)},
    )
    return placed.withColumn(name, F.coalesce("_known", "_old")).drop("_v", "_known", "_old", SLICE)


def _local_runs(sliced: DataFrame, value: str) -> DataFrame:
    """Number the runs of equal values inside each slice from 1; a null is a run of its own."""
    w = slice_window()
    same = F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))
    starts = sliced.withColumn("_start", F.when(same, 0).otherwise(1))
    return starts.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def _run_ends(numbered: DataFrame, value: str) -> DataFrame:
    """One row per slice: its first and last run, and whether the first continues the slice before."""
    ends = (
        numbered.groupBy(KEY, SLICE, "_run")
        .agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v"))
        .groupBy(KEY, SLICE)
        .agg(
            F.max("_run").alias("_last"),
            F.max(F.when(F.col("_run") == 1, F.col("_n"))).alias("_head"),
            F.max_by("_n", "_run").alias("_tail"),
            F.min_by("_v", "_run").alias("_first_v"),
            F.max_by("_v", "_run").alias("_last_v"),
        )
    )
    follows = F.coalesce(F.col("_first_v") == F.lag("_last_v").over(Window.partitionBy(KEY).orderBy(SLICE)), F.lit(False))
    return ends.withColumn("_joins", follows.cast("int"))


def with_run_length(
    df: DataFrame, value: str, name: str = "repeat_length", slice_hours: int = DEFAULT.slice_hours
) -> DataFrame:
    """Length of the run of equal consecutive values a reading belongs to."""
    return finish_runs(with_slices(df, slice_hours), value, name)


def finish_runs(sliced: DataFrame, value: str, name: str = "repeat_length") -> DataFrame:
    """Run lengths of a table that is already sliced (and free of halo copies).

    Runs are counted inside the slices. Their open ends are added up on the slice
    summaries, so a run may cross any number of slices.
    """
    numbered = _local_runs(sliced, value)
    history = Window.partitionBy(KEY).orderBy(SLICE)
    # A slice opens a chain with its first run, unless that continues the one before, and with its last.
    opened = 1 - F.col("_joins") + F.when(F.col("_last") > 1, 1).otherwise(0)
    ends = _run_ends(numbered, value).withColumn("_chain", F.sum(opened).over(history.rowsBetween(Window.unboundedPreceding, 0)))
    several = F.col("_last") > 1
    head = F.struct(F.lit(1).alias("_part"), F.col("_head").alias("_len"), (F.col("_chain") - several.cast("int")).alias("_link"))
    tail = F.struct(F.lit(2).alias("_part"), F.col("_tail").alias("_len"), F.col("_chain").alias("_link"))
    totals = (
        ends.select(KEY, SLICE, "_last", F.inline(F.when(several, F.array(head, tail)).otherwise(F.array(head))))
        .withColumn("_total", F.sum("_len").over(Window.partitionBy(KEY, "_link")))
        .groupBy(KEY, SLICE)
        .agg(
            F.max("_last").alias("_last"),
            F.max(F.when(F.col("_part") == 1, F.col("_total"))).alias("_head_total"),
            F.max(F.when(F.col("_part") == 2, F.col("_total"))).alias("_tail_total"),
        )
    )
    local = F.count(F.lit(1)).over(Window.partitionBy(KEY, SLICE, "_run"))
    length = (
        F.when(F.col("_run") == 1, F.col("_head_total"))
        .when(F.col("_run") == F.col("_last"), F.col("_tail_total"))
        .otherwise(F.col("_local"))
    )
    return (
        numbered.withColumn("_local", local)
        .join(totals, [KEY, SLICE], "left")
        .withColumn(name, length.cast("bigint"))
        .drop("_local", "_head_total", "_tail_total", "_last", "_run", SLICE)
    )


def with_running_length(
    df: DataFrame, value: str, name: str = "running_length", slice_hours: int = DEFAULT.slice_hours
) -> DataFrame:
    """Length of the run so far, which unlike the full run length never looks ahead."""
    numbered = _local_runs(with_slices(df, slice_hours), value)
    numbered = numbered.withColumn("_at", F.row_number().over(Window.partitionBy(KEY, SLICE, "_run").orderBy("ts")))
    history = Window.partitionBy(KEY).orderBy(SLICE)
    # A chain starts in every slice whose last run starts in it; later slices only prolong it.
    starts = F.when((F.col("_last") > 1) | (F.col("_joins") == 0), 1).otherwise(0)
    ends = _run_ends(numbered, value).withColumn("_chain", F.sum(starts).over(history.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(KEY, "_chain").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_open", F.sum("_tail").over(chain))
    ends = ends.withColumn("_before", F.when(F.col("_joins") == 1, F.lag("_open").over(history)).otherwise(0))
    out = numbered.join(ends.select(KEY, SLICE, "_before"), [KEY, SLICE], "left")
    carried = F.when(F.col("_run") == 1, F.col("_before")).otherwise(0)
    return out.withColumn(name, (F.col("_at") + carried).cast("bigint")).drop("_run", "_at", "_before", SLICE)


def interpolate(
    df: DataFrame, value: Column, name: str, slice_hours: int = DEFAULT.slice_hours
) -> DataFrame:
    """Fill nulls linearly by row position; edges copy the nearest value."""
    w, back = slice_window(), slice_window(descending=True)
    local = with_slices(df, slice_hours).withColumn("_v", value)
    local = local.withColumn("_pos", F.row_number().over(w))
    local = local.withColumn("_known", F.when(F.col("_v").isNotNull(), F.struct("_pos", "_v")))
    local = local.withColumn(
        "_left", F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_right", F.last("_known", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))

    def on_history(known: str) -> Column:
        """The summary's known point with its position in the whole history."""
        at = F.col(f"{known}._pos") + F.col("_skip")
        return F.when(F.col(known).isNotNull(), F.struct(at.alias("_pos"), F.col(f"{known}._v").alias("_v")))

    def positions(per_slice: DataFrame) -> DataFrame:
        before, _ = history_windows()
        counted = per_slice.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        return counted.withColumn("_newest", on_history("_newest")).withColumn("_oldest", on_history("_oldest"))

    placed = with_carry(
        local,
        [
            F.count(F.lit(1)).alias("_n"),
            F.max("_known").alias("_newest"),
            F.min("_known").alias("_oldest"),
        ],
        {
            "_skip": lambda before, after: F.col("_skip"),
            "_l0": lambda before, after: F.last("_newest", ignorenulls=True).over(before),
            "_r0": lambda before, after: F.last("_oldest", ignorenulls=True).over(after),
        },
        prepare=positions,
    )
    placed = (
        placed.withColumn("_l", F.coalesce(on_history("_left"), F.col("_l0")))
        .withColumn("_r", F.coalesce(on_history("_right"), F.col("_r0")))
        .withColumn("_at", F.col("_pos") + F.col("_skip"))
    )
    between = F.col("_l._v") + (F.col("_r._v") - F.col("_l._v")) * (
        (F.col("_at") - F.col("_l._pos")) / (F.col("_r._pos") - F.col("_l._pos"))
    )
    filled = F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(F.coalesce(between, F.col("_l._v"), F.col("_r._v")))
    return placed.withColumn(name, filled).drop(
        "_v", "_pos", "_skip", "_at", "_known", "_left", "_right", "_l0", "_r0", "_l", "_r", SLICE
    )
