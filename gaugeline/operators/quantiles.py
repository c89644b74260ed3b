"""Exact quantiles per group that do not need a whole group in one place.

Linear interpolation between order statistics at p * (n - 1), as pandas does. An order statistic is found by
selection: a bracket of values that holds its rank is cut at points of a mergeable sketch, the rows of each piece are counted exactly,
and the piece that holds the rank is the next bracket, until it has few enough rows to rank (or one value).
The sketch only proposes where to cut, so the result is exact whatever its error. Groups that are small enough
from the start need no cut: Spark's `percentile` ranks them in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT
from gaugeline.operators.staging import join_dim, stage

PIECES = 64
SKETCH_ACCURACY = 2_000


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and the number of groups."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    largest, groups = counts.agg(F.max("count"), F.count(F.lit(1))).first()
    return largest or 0, groups


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    probs: dict[str, Sequence[float]],
    max_group_rows: int = DEFAULT.percentile_group_rows,
    largest: int | None = None,
) -> DataFrame:
    """One row per key with `q_<column>`: the array of asked quantiles of each column.

    `largest` passes the size of the largest group if the caller knows it.
    """
    keys = list(keys)
    largest = group_sizes(df, keys)[0] if largest is None else largest
    if largest <= max_group_rows:
        aggs = [
            F.percentile(c, F.array(*[F.lit(float(p)) for p in ps])).alias(f"q_{c}") for c, ps in probs.items()
        ]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return _selected(df, keys, probs, max_group_rows)


def _selected(df: DataFrame, keys: list[str], probs: dict[str, Sequence[float]], limit: int) -> DataFrame:
    """exact_quantiles for groups of any size; no task ranks more than `limit` rows of a group."""
    group = keys or ["_all"]
    base = (df if keys else df.withColumn("_all", F.lit(0))).select(*group, *probs)
    values = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in probs]
    long = base.select(*group, F.inline(F.array(*values))).filter(F.col("_x").isNotNull())
    one, each = [*group, "_column"], [*group, "_column", "_k"]

    spans = long.groupBy(*one).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    asked = F.create_map(*[x for c, ps in probs.items() for x in (F.lit(c), F.array(*[F.lit(float(p)) for p in ps]))])
    asked = spans.select("*", F.posexplode(asked[F.col("_column")]).alias("_i", "_p"))
    asked = stage(asked.withColumn("_target", F.col("_p") * (F.col("_n") - 1)), "quantile-ranks")
    # the ranks to find, each with the bracket that holds it and the number of values below that
    ranks = asked.withColumn("_k", F.explode(F.array(F.floor("_target"), F.ceil("_target"))))
    open_ = ranks.select(*each, "_low", "_high", F.lit(0).cast("bigint").alias("_below"), "_n").distinct()
    small = (F.col("_n") <= limit) | (F.col("_low") == F.col("_high"))
    closed = []
    while True:
        open_ = stage(open_, "brackets")
        closed.append(open_.filter(small))
        open_ = open_.filter(~small)
        if open_.isEmpty():
            break
        open_ = _narrowed(long, open_, one, each)

    brackets = reduce(DataFrame.unionAll, closed)
    counts = _inside(long, brackets, one).groupBy(*each, "_below", "_x").agg(F.count(F.lit(1)).alias("_n"))
    found = _holding(counts, each, "_x").select(*each, "_x")
    at = lambda side: found.withColumnsRenamed({"_k": f"_{side}", "_x": f"_at_{side}"})
    placed = asked.withColumns({"_floor": F.floor("_target"), "_ceil": F.ceil("_target")})
    placed = placed.join(at("floor"), [*one, "_floor"]).join(at("ceil"), [*one, "_ceil"])
    above = F.col("_target") - F.col("_floor")
    value = F.when(above == 0, F.col("_at_floor")).otherwise((1 - above) * F.col("_at_floor") + above * F.col("_at_ceil"))
    pair = F.struct("_i", value.alias("_value"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col("_column") == c, pair))), lambda s: s["_value"])
    arrays = placed.groupBy(*group).agg(*[listed(c).alias(f"q_{c}") for c in probs])
    out = base.select(*group).distinct().join(arrays, group, "left")
    # a column without values has no quantiles
    out = out.withColumns({f"q_{c}": F.when(F.size(f"q_{c}") > 0, F.col(f"q_{c}")) for c in probs})
    return out if keys else out.drop("_all")


def _inside(long: DataFrame, brackets: DataFrame, one: list[str]) -> DataFrame:
    """The values within each bracket, with its other columns."""
    rest = [c for c in brackets.columns if c not in (*one, "_n")]
    per_group = brackets.groupBy(*one).agg(F.collect_list(F.struct(*rest)).alias("_brackets"))
    met = join_dim(long, per_group, one, how="inner", spread="_x")
    fits_in = lambda b: (F.col("_x") >= b["_low"]) & (F.col("_x") <= b["_high"])
    return met.withColumn("_b", F.explode(F.filter("_brackets", fits_in))).select(*one, "_x", "_b.*")


def _holding(counts: DataFrame, each: list[str], order: str) -> DataFrame:
    """Of the counted pieces of each bracket, the one that holds its rank, with the number of values below it."""
    upto = Window.partitionBy(*each).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_end", F.col("_below") + F.sum("_n").over(upto))
    return placed.filter((F.col("_end") - F.col("_n") <= F.col("_k")) & (F.col("_k") < F.col("_end"))).withColumn("_below", F.col("_end") - F.col("_n"))


def _narrowed(long: DataFrame, brackets: DataFrame, one: list[str], each: list[str]) -> DataFrame:
    """Each bracket cut into pieces by value; what remains is the piece that holds the rank.

    The highest value and the middle are always among the cuts, so a bracket of two values or more gets smaller.
    """
    shares = [(k + 1) / PIECES for k in range(PIECES - 1)]
    sketch = _inside(long, brackets, one).groupBy(*each, "_low", "_high", "_below").agg(F.percentile_approx("_x", shares, SKETCH_ACCURACY).alias("_cuts"))
    middle = F.col("_low") / 2 + F.col("_high") / 2
    cuts = F.array_sort(F.array_distinct(F.concat("_cuts", F.array(middle, F.col("_high")))))
    cut = stage(sketch.withColumn("_cuts", cuts), "cuts")
    piece = F.size(F.filter("_cuts", lambda c: c <= F.col("_x")))
    counts = _inside(long, cut, one).groupBy(*each, "_below", piece.alias("_piece")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")
    )
    return _holding(counts, each, "_piece").select(*each, "_low", "_high", "_below", "_n")


def quantile_column(name: str, index: int = 0) -> Column:
    return F.get(f"q_{name}", F.lit(index))


def robust_thresholds(
    df: DataFrame,
    keys: Sequence[str],
    factors: dict[str, float],
    max_group_rows: int = DEFAULT.percentile_group_rows,
    zero_when_empty: bool = False,
    extra: dict[str, float] | None = None,
) -> DataFrame:
    """median + k * MAD per group; sample deviation stands in for a zero MAD.

    Adds `thr_<column>`, and `low_<column>` for the quantiles asked in `extra`. A
    group without values gives null, or 0 on request. df is read several times:
    pass a stored stage.
    """
    keys, columns, extra = list(keys), list(factors), extra or {}
    largest, groups = group_sizes(df, keys)
    probs = {c: [0.5, *([extra[c]] if c in extra else [])] for c in columns}
    med = exact_quantiles(df, keys, probs, max_group_rows, largest)
    med = med.select(
        *keys,
        *[quantile_column(c).alias(f"med_{c}") for c in columns],
        *[quantile_column(c, 1).alias(f"low_{c}") for c in extra],
    )
    spread = df.groupBy(*keys).agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in columns])
    center = stage(med.join(spread, keys), "medians")
    away = join_dim(df.select(*keys, *columns), center, keys, spread=columns[0], rows=groups)
    away = away.select(*keys, *[F.abs(F.col(c) - F.col(f"med_{c}")).alias(c) for c in columns])
    mad = exact_quantiles(away, keys, {c: [0.5] for c in columns}, max_group_rows, largest)
    mad = mad.select(*keys, *[quantile_column(c).alias(f"mad_{c}") for c in columns])
    out = center.join(mad, keys, "left")
    for c, k in factors.items():
        scale = F.when(F.col(f"mad_{c}") > 0, F.col(f"mad_{c}")).otherwise(F.col(f"sd_{c}"))
        thr = F.col(f"med_{c}") + F.lit(float(k)) * scale
        out = out.withColumn(f"thr_{c}", F.coalesce(thr, F.lit(0.0)) if zero_when_empty else thr)
    return out.select(*keys, *[f"thr_{c}" for c in columns], *[f"low_{c}" for c in extra])
