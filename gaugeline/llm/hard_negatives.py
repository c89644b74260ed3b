"""Hard-negative mining by length buckets and coordinate pruning (the LEMP scheme), exact.

Rows are ordered by vector length and cut into buckets (an Arrow batch of that order is one). A bucket
holds its unit vectors' coordinates as sorted lists. For an anchor q and a score threshold t, a bucket
whose longest vector has length l can only hold scores of at least t at a cosine of c = t / (|q| l) or
more; above 1 the bucket is skipped. Otherwise each of the anchor's focus coordinates (its largest) bounds
the same coordinate of every feasible unit vector to q_f c -+ sqrt((1 - c^2)(1 - q_f^2)); the ranges of the
sorted lists are intersected, the shortest first, and only what is left is verified by its inner product.
Where the shortest range holds most of the bucket, the whole bucket is verified: same rows, one product.

Two passes over the buckets for a block of anchors. The first finds each anchor's best rows of its label, the
threshold rising to the last of the best so far. The second finds, for each of those positives, the
best rows of other labels within the asked share of its score; the threshold is the least that any of them still
needs. Each task returns the best of its own buckets, and a ranking window merges them.

Vectors are arrays of whole numbers. Products are made in doubles where they are exact there (lengths whose
product is under 2**53), in 64-bit integers otherwise.

Defined results: rows with a null id, label or vector, or a null component, take no part, nor do vectors of length
2**31 or more, whose scores do not fit 64 bits; vectors of different sizes are never compared; each row stands for itself,
repeated ids too (a row is never its own positive, its twin may be); ties go to the smaller id; an anchor without positives or a
positive without fitting negatives gives no rows; an empty table gives an empty one; extra columns are not read.
The driver holds one block of anchors (BLOCK rows or about so) and their positives at a time, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import ship
from gaugeline.operators.staging import new_table_path, stage

BUCKET_ROWS = 8192
BLOCK = 2048
FOCUS = 4
EXACT = float(1 << 53)


def by_length(df: DataFrame, anchor: Column, id_col: str, label: str, vector: str, bucket_rows: int) -> DataFrame:
    """(row, id, label, v, len, anchor) of the rows that take part, longest first, written in ranges of length."""
    whole = F.col(vector).cast("array<bigint>")
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        whole.alias("v"),
        F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("len"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    # a null component makes the length null
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("len") < float(1 << 31)))
    parts = max(1, -(-df.count() // bucket_rows))
    return stage(rows.repartitionByRange(parts, F.desc("len"), "row").sortWithinPartitions(F.desc("len"), "row"), "by-length")


class Bucket:
    """Rows of one size of vector, with sorted lists of the coordinates that are asked for."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.row, self.id, self.label, self.len = get("row"), get("id"), get("label"), get("len")
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        self.whole = flat.reshape(len(self.row), dim)
        self.wide = self.whole.astype(np.float64)
        self.unit = self.wide / np.maximum(self.len, 1e-300)[:, None]
        self.longest = float(self.len.max())
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def of(batch: pa.RecordBatch) -> Iterator[tuple[int, Bucket]]:
        sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            yield int(dim), Bucket(batch.filter(pa.array(sizes == dim)), int(dim))

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, a: Anchor, threshold: float) -> np.ndarray | None:
        """Rows that can reach the threshold (more than do); None for all of them."""
        if threshold <= 0 or not a.len:
            return None
        c = threshold / (a.len * self.longest) if self.longest else np.inf
        if c > 1 + 1e-9:
            return np.zeros(0, np.int64)
        c = min(c, 1.0)
        ranges = []
        for f, q in a.focus:
            order, values = self.sorted_list(f)
            spread = np.sqrt((1 - c * c) * max(0.0, 1 - q * q)) + 1e-9
            low = -2.0 if q <= -c else q * c - spread
            high = 2.0 if q >= c else q * c + spread
            ranges.append((int(np.searchsorted(values, low, "left")), int(np.searchsorted(values, high, "right")), f, low, high, order))
        first, last, f, _, _, order = min(ranges, key=lambda r: r[1] - r[0])
        if last - first > 0.6 * len(order):
            return None
        found = order[first:last]
        for _, _, g, low, high, _ in ranges:
            if g != f:
                x = self.unit[found, g]
                found = found[(x >= low) & (x <= high)]
        return found

    def scores(self, a: Anchor, rows: np.ndarray | None) -> np.ndarray:
        exact = a.len * self.longest < EXACT
        table, q = (self.wide, a.wide) if exact else (self.whole, a.whole)
        got = table @ q if rows is None else table[rows] @ q
        return got.astype(np.int64)


class Anchor:
    def __init__(self, k: int, row: int, label: int, length: float, vector: list[int]):
        self.k, self.row, self.label, self.len = k, row, label, length
        self.whole = np.array(vector, np.int64)
        self.wide = self.whole.astype(np.float64)
        unit = self.wide / length if length else self.wide
        self.focus = [(int(f), float(unit[f])) for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]]


class Best:
    """The first `size` of the scores within [low, high] seen so far: higher first, then smaller id."""

    def __init__(self, size: int, low: int | None = None, high: int | None = None):
        self.size, self.low, self.high = size, low, high
        self.kept: list[tuple[int, int, int]] = []

    @property
    def floor(self) -> float:
        """A score below it cannot enter."""
        last = -self.kept[-1][0] if len(self.kept) == self.size else -np.inf
        return last if self.low is None else max(last, self.low)

    def offer(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores in descending order, ids ascending within equal ones."""
        first = 0 if self.high is None else int(np.searchsorted(-score, -self.high, "left"))
        last = first + self.size
        new = [(-s, i, r) for s, i, r in zip(score[first:last].tolist(), ids[first:last].tolist(), rows[first:last].tolist()) if self.low is None or s >= self.low]
        if new:
            self.kept = sorted(self.kept + new)[: self.size]


FOUND = "a int, j int, score bigint, id bigint, row bigint"


def _search(data: DataFrame, anchors: list[tuple], wanted: dict[int, list[tuple[int, int]]] | None, size: int) -> DataFrame:
    """For each anchor, the best rows of its own label (wanted None), or of other labels for each asked range of scores."""
    spark = data.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast((anchors, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asked = known.value
        all_anchors = [Anchor(*r) for r in rows]
        best = {a.k: [Best(size)] if asked is None else [Best(size, *r) for r in asked.get(a.k, [])] for a in all_anchors}
        for batch in batches:
            for dim, b in Bucket.of(batch):
                labels = {int(x): b.label == x for x in np.unique(b.label)}
                none = np.zeros(len(b.label), bool)
                for a in all_anchors:
                    lists = best[a.k]
                    if len(a.whole) != dim or not lists:
                        continue
                    threshold = min(x.floor for x in lists)
                    rows = b.candidates(a, threshold)
                    own = labels.get(a.label, none)
                    fit = own if asked is None else ~own
                    if rows is None and asked is None:
                        rows = np.flatnonzero(fit)
                    if rows is not None:
                        rows = rows[fit[rows]]
                        if not len(rows):
                            continue
                    score = b.scores(a, rows)
                    good = score >= threshold
                    if rows is None:
                        good &= fit
                    if asked is not None:
                        good &= score <= max(x.high for x in lists)
                    where = np.flatnonzero(good)
                    at = where if rows is None else rows[where]
                    other = b.row[at] != a.row
                    at, s = at[other], score[where][other]
                    if not len(at):
                        continue
                    order = np.lexsort((b.row[at], b.id[at], -s))
                    at, s = at[order], s[order]
                    for x in lists:
                        x.offer(s, b.id[at], b.row[at])
        got = [(k, j, -s, i, r) for k, lists in best.items() for j, x in enumerate(lists) for s, i, r in x.kept]
        columns = list(zip(*got)) or [()] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["a", "j", "score", "id", "row"])

    return data.select("row", "id", "label", "v", "len").mapInArrow(run, FOUND)


def _first(found: DataFrame, size: int) -> DataFrame:
    """The first rows of each (a, j) over all tasks, with their rank."""
    order = Window.partitionBy("a", "j").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def mine(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    bucket_rows: int = BUCKET_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where `anchor` holds. A negative's score is between `low` and `high` hundredths of the positive's.
    """
    spark = df.sparkSession
    data = by_length(df, anchor, id_col, label, vector, bucket_rows)
    anchors = data.filter("anchor")
    blocks = max(1, -(-anchors.count() // block))
    path = new_table_path(spark, "hard-negatives")
    for k in range(blocks):
        part = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).orderBy("row").select("row", "id", "label", "len", "v").collect()
        rows = [(i, r.row, r.label, r.len, r.v) for i, r in enumerate(part)]
        near = _first(_search(data, rows, None, positives), positives).orderBy("a", "rank").collect()
        wanted: dict[int, list[tuple[int, int]]] = {}
        for r in near:
            wanted.setdefault(r.a, []).append((-(-low * r.score // 100), high * r.score // 100))
        ids = spark.createDataFrame([(r.a, r.rank - 1, part[r.a].id, r.id, r.score) for r in near], "a int, j int, anchor_id long, positive_id long, positive_score long")
        found = _first(_search(data, rows, wanted, negatives), negatives)
        # at most `positives` rows for each anchor of the block
        found.join(F.broadcast(ids), ["a", "j"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.parquet(f"{path}/block={k}")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*(f"{path}/block={k}" for k in range(blocks)))
