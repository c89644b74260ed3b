"""Mixing sources to target weights by Poisson replication.

A source with n of N documents and target weight w gets the mean repetition rate N w / n.
Each document draws its count from a Poisson distribution of that mean by inverting the
distribution function at a uniform number hashed from (seed, id); it is repeated that often
and all copies are put in an order hashed from (seed, id, copy). Nothing depends on how the
rows are partitioned. Rates above SPLIT are drawn as sums of equal parts, each with its own
hash, so the function never underflows.

Defined results: a null source is a source of its own; sources without a target weight have
weight 0; without target weights a source weighs its count to the power `power`. Rows that
repeat an id draw the same count. A null id draws as the empty string. An empty table gives an
empty one. Extra columns pass through; n_copies, copy_no and shuffle_key replace columns so named.

The rates are one row per source, joined by the checked broadcast of join_dim; with too many sources
for that the join is salted, so a source with a third of all rows is spread. The order is a range
sort on the hash, which is uniform whatever the sources are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import fresh
from gaugeline.operators.staging import join_dim, stage

SPLIT = 256.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts joined by '|'."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """array<double>: P(X <= k) for k = 0 ... 10 standard deviations and 30 beyond the mean."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int"))
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(steps, first, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """(source, n, weight, rate): weights as given, or the counts to `power`; both scaled to sum to 1."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        raw = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")), F.lit(0.0))
    counts = counts.withColumn("raw", raw)
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("raw").alias("all_raw"))
    # one row of totals: its size is fixed
    both = counts.join(F.broadcast(total))
    weight = F.col("raw") / F.col("all_raw")
    return both.select("source", "n", weight.alias("weight"), (F.col("all_n") * weight / F.col("n")).alias("rate"))


def order_key(id_col: str, copy_no: Column, seed: str = "mix") -> Column:
    """Where a copy stands in the global order: a hash of the id and the copy's number."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), copy_no.cast("string")))


def restore_order(copies: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "mix") -> DataFrame:
    """A mixed table that has lost copy_no, shuffle_key and its order (readers pack files by size): all three again.

    A document's copies are alike, so which of them gets which number does not matter. Rows of one id and text are counted on
    together, so copies of repeated rows get numbers of their own.
    """
    key = fresh(copies, "_text_hash")
    alike = Window.partitionBy(id_col, key).orderBy(key)
    numbered = copies.withColumn(key, F.xxhash64(text)).withColumn("copy_no", F.row_number().over(alike) - 1).drop(key)
    return numbered.withColumn("shuffle_key", order_key(id_col, F.col("copy_no"), seed)).orderBy("shuffle_key", "copy_no")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, seed: str = "mix") -> DataFrame:
    """docs repeated to the target weights, in one global hashed order, with n_copies, copy_no (from 0) and shuffle_key."""
    names = [c for c in docs.columns if c not in ("n_copies", "copy_no", "shuffle_key")]
    docs = docs.select(*names)
    key, parts, cdf = fresh(docs, "_mix_source"), fresh(docs, "_mix_parts"), fresh(docs, "_mix_cdf")
    table = stage(rates(docs, source, weights, power), "mix-rates")
    n_parts = F.greatest(F.ceil(F.col("rate") / SPLIT), F.lit(1)).cast("int")
    name = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))
    dim = table.select(name(F.col("source")).alias(key), n_parts.alias(parts), poisson_cdf(F.col("rate") / n_parts).alias(cdf))
    rows = join_dim(docs.withColumn(key, name(F.col(source))), dim, [key], how="inner", spread=id_col)
    draw = lambda part: F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(seed), F.col(id_col), part)))
    count = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, part: acc + draw(part))
    counted = rows.withColumn("n_copies", count).filter("n_copies > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", order_key(id_col, F.col("copy_no"), seed))
    return keyed.select(*names, "n_copies", "copy_no", "shuffle_key").orderBy("shuffle_key", "copy_no")
