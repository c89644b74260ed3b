"""Isolation forest: trees are grown in parallel from small hashed samples.

Every tree sees at most `sample_size` rows, so a tree is one bounded group.
Samples are chosen by hashes of the row key, so the forest does not depend on
partitioning or task order. The fitted forest is a small table of nodes.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.config import DEFAULT, QCConfig
from gaugeline.operators.detectors import check_feature_list
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.operators.staging import stage
from gaugeline.shipping import ship

KEYS = ("station_id", "ts")
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left_node int, right_node int, path double"


def _unsuccessful_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Grow one tree; leaves carry their depth plus the mean depth of their rows."""
    nodes: list[list] = []
    todo = [(np.arange(len(sample)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = here
        data = sample[rows]
        low, high = data.min(axis=0), data.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([here, -1, 0.0, -1, -1, depth + _unsuccessful_path(len(rows))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = data[:, feature] <= cut
        nodes.append([here, feature, cut, -1, -1, 0.0])
        todo.append((rows[~goes_left], depth + 1, here, 1))
        todo.append((rows[goes_left], depth + 1, here, 0))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class IsolationForest:
    """Nodes of all trees (trees * (2 * sample_size - 1) rows at most) and the cut."""

    nodes: pd.DataFrame
    features: tuple[str, ...]
    medians: tuple[float, ...]
    sample_size: int
    offset: float = 0.5

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.parquet(f"{path}/nodes")
        meta = [(list(self.features), list(self.medians), self.sample_size, self.offset)]
        schema = "features array<string>, medians array<double>, sample_size int, cut double"
        spark.createDataFrame(meta, schema).coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        meta = spark.read.parquet(f"{path}/meta").first()
        return IsolationForest(nodes, tuple(meta[0]), tuple(meta[1]), meta[2], meta[3])

    def score(self, df: DataFrame, name: str = "isolation_raw") -> DataFrame:
        """Add the anomaly score in (0, 1); larger is more isolated.

        Nulls take the medians of the training rows. The node arrays are broadcast
        once; rows are scored in Arrow batches, all rows of a batch per tree.
        """
        ship(df.sparkSession)
        arrays = df.sparkSession.sparkContext.broadcast(self.packed())
        norm = _unsuccessful_path(self.sample_size)

        def score_batches(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                yield pd.Series(isolation_scores(arrays.value, np.column_stack([c.to_numpy(dtype=float) for c in cols]), norm))

        udf = F.pandas_udf(score_batches, T.DoubleType())
        filled = [F.coalesce(F.col(f), F.lit(m)).cast("double") for f, m in zip(self.features, self.medians)]
        return df.withColumn(name, udf(*filled))

    def packed(self) -> list[tuple]:
        """The trees as arrays, for `isolation_scores`."""
        return _packed(self.nodes)

    def voter(self, spark: SparkSession) -> ForestVoter:
        """For stateful processors: their code must stay small, so the trees go to the executors as a file."""
        columns = {c: self.nodes[c].to_numpy() for c in ("tree", "node", "feature", "threshold", "left_node", "right_node", "path")}
        folder = Path(tempfile.mkdtemp(prefix="gaugeline-forest-"))
        name = f"forest-{uuid.uuid4().hex}.npz"
        np.savez_compressed(folder / name, **columns)
        spark.sparkContext.addFile(str(folder / name))
        return ForestVoter(name, self.features, self.medians, _unsuccessful_path(self.sample_size), self.offset)

    def flag(self, df: DataFrame, name: str = "isolation_score") -> DataFrame:
        """Score and flag rows beyond the cut."""
        return self.score(df).withColumn(name, F.when(F.col("isolation_raw") > self.offset, 1).otherwise(0))


def isolation_scores(trees: list[tuple], x: np.ndarray, norm: float) -> np.ndarray:
    """Scores of the rows of x, all rows per tree and level."""
    total, pick = np.zeros(len(x)), np.arange(len(x))
    for feature, cut, left, right, path, depth in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            f = feature[at]
            down = np.where(x[pick, np.maximum(f, 0)] <= cut[at], left[at], right[at])
            at = np.where(f >= 0, down, at)
        total += path[at]
    return np.power(2.0, -(total / len(trees)) / norm)


@dataclass(frozen=True)
class ForestVoter:
    """What a task needs to vote on single readings given by feature name; the trees are read at the first one."""

    file: str
    features: tuple[str, ...]
    medians: tuple[float, ...]
    norm: float
    offset: float

    def fires(self, reading: dict[str, float]) -> bool:
        if self.file not in _LOADED:
            with np.load(SparkFiles.get(self.file)) as columns:
                _LOADED[self.file] = _packed(pd.DataFrame(dict(columns)))
        x = [m if np.isnan(v := reading[f]) else v for f, m in zip(self.features, self.medians)]
        return bool(isolation_scores(_LOADED[self.file], np.array([x]), self.norm)[0] > self.offset)


_LOADED: dict[str, list[tuple]] = {}


def _packed(nodes: pd.DataFrame) -> list[tuple]:
    out = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
        left, right = t["left_node"].to_numpy(np.int64), t["right_node"].to_numpy(np.int64)
        depth, level = 0, [0]
        while level:
            level = [c for n in level for c in (left[n], right[n]) if c >= 0]
            depth += bool(level)
        out.append(
            (
                t["feature"].to_numpy(np.int64),
                t["threshold"].to_numpy(float),
                left,
                right,
                t["path"].to_numpy(float),
                depth,
            )
        )
    return out


def fit_iforest(
    df: DataFrame,
    features: Sequence[str],
    contamination: float | str = "auto",
    trees: int = 200,
    sample_size: int = 256,
    seed: int = 42,
    cfg: QCConfig = DEFAULT,
) -> IsolationForest:
    """Fit on the rows of df. A numeric contamination sets the cut at that share of rows."""
    features = check_feature_list(features)
    n = df.count()
    medians = exact_quantiles(df.select(*features), [], {c: [0.5] for c in features}, cfg.percentile_group_rows, n).first()
    filled = tuple(float(medians[f"q_{c}"][0]) if medians[f"q_{c}"] else 0.0 for c in features)
    rows = df.select(*KEYS, *[F.coalesce(F.col(c), F.lit(m)).cast("double").alias(c) for c, m in zip(features, filled)])
    psi = min(sample_size, n)
    sampled = _hashed_samples(rows, n, psi, trees, seed)
    limit = max(1, math.ceil(math.log2(max(psi, 2))))

    def grow_tree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = group.sort_values("_draw", kind="stable").head(psi)
        grown = _grow(ordered[list(features)].to_numpy(float), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left_node", "right_node", "path"])
        out.insert(0, "tree", tree)
        return out

    ship(df.sparkSession)
    # A fixed number of tasks: the samples are small, growing the trees is the work.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    nodes = sampled.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow_tree, NODE_SCHEMA)
    forest = IsolationForest(nodes.orderBy("tree", "node").toPandas(), tuple(features), filled, psi)
    if contamination == "auto":
        return forest
    scored = stage(forest.score(rows).select("isolation_raw"), "forest-scores")
    return replace(forest, offset=_cut(scored, contamination, cfg))


def _cut(scored: DataFrame, contamination: float, cfg: QCConfig) -> float:
    """The score that the given share of rows lies above; rows without any keep the default."""
    cut = exact_quantiles(scored.select("isolation_raw"), [], {"isolation_raw": [1.0 - float(contamination)]}, cfg.percentile_group_rows).first()[0]
    return cut[0] if cut else IsolationForest.offset


def fit_and_flag(
    df: DataFrame, features: Sequence[str], contamination: float | str, name: str = "isolation_score", cfg: QCConfig = DEFAULT, **fit
) -> tuple[DataFrame, IsolationForest]:
    """Fit on the rows of df and flag them: each row walks the trees once, and the cut comes from those stored scores."""
    forest = fit_iforest(df, features, "auto", cfg=cfg, **fit)
    scored = stage(forest.score(df), "forest")
    if contamination != "auto":
        forest = replace(forest, offset=_cut(scored, contamination, cfg))
    return scored.withColumn(name, F.when(F.col("isolation_raw") > forest.offset, 1).otherwise(0)), forest


def _hashed_samples(rows: DataFrame, n: int, psi: int, trees: int, seed: int) -> DataFrame:
    """About 3 * psi candidate rows per tree; each tree later keeps its psi lowest draws.

    One rule at every size: hashes of the key say in how many trees a row stands and in which, so a
    row is copied for those trees alone. It enters each tree with the same chance, and all
    trees when there are no more than 3 * psi rows. The trees of a row are a start and steps of
    a length coprime to their number, hence distinct.
    """
    draw = lambda *salt: F.xxhash64(*KEYS, *(F.lit(x) if isinstance(x, int) else x for x in salt))
    below = lambda k, *salt: F.pmod(draw(*salt), F.lit(k))
    space = 2**52
    mean = trees * min(1.0, 3.0 * psi / max(n, 1))
    copies = F.floor(F.lit(mean) + below(space, seed, 1) / float(space)).cast("int")
    strides = [k for k in range(1, max(2, trees)) if math.gcd(k, trees) == 1]
    stride = F.element_at(F.array(*map(F.lit, strides)), (below(len(strides), seed, 3) + 1).cast("int"))
    placed = rows.withColumns({"_copies": copies, "_first": below(trees, seed, 2), "_stride": stride}).filter("_copies > 0")
    turn = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))
    placed = placed.withColumn("_turn", turn).withColumn("tree", F.pmod(F.col("_first") + F.col("_turn") * F.col("_stride"), F.lit(trees)).cast("int"))
    return placed.withColumn("_draw", below(space, F.col("tree"), seed) / float(space)).drop("_copies", "_first", "_stride", "_turn")


def isolation_ensemble(
    df: DataFrame, features: Sequence[str], contamination: float = 0.05, cfg: QCConfig = DEFAULT, **fit
) -> tuple[DataFrame, IsolationForest]:
    """Fit and score the same rows; add the flag and the score scaled to [0, 1]."""
    scored, forest = fit_and_flag(df, features, contamination, "isolation_anomaly", cfg, **fit)
    low, high = scored.agg(F.min("isolation_raw"), F.max("isolation_raw")).first()
    scaled = (F.col("isolation_raw") - F.lit(low)) / F.lit(high - low + 1e-9)
    return scored.withColumn("ml_anomaly_score", scaled), forest
