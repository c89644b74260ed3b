"""Reconstruction of faulty temperatures: rules, and a regression forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT, NORMAL, QCConfig
from gaugeline.operators.detectors import check_feature_list
from gaugeline.operators.inject import unit_hash
from gaugeline.operators.profile import impute_median
from gaugeline.operators.slices import interpolate

ACTIONABLE = ("MISSING", "SPIKE", "FROZEN", "NOISE", "DRIFT")
ML_LABELS = ("FROZEN", "DRIFT", "NOISE")
# Row weights that a task holds at once while trees grow (its rows times the trees of a block), unless a block has no more trees than these.
TASK_WEIGHTS = 10_000_000
BLOCK_TREES = 10
# What the regression forest reads.
ML_FEATURES = (
    "hour",
    "day_of_year",
    "humidity",
    "pressure",
    "previous_6h_median",
    "previous_12h_median",
    "wind_speed",
)


def correct_by_rules(df: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """temperature_original, temperature_corrected and correction_applied.

    Missing readings are interpolated; spikes take the past median; frozen
    readings are interpolated over a series whose missing and spiked readings are
    already repaired; noise and drift take past medians. A correction whose
    baseline is null gives null and counts as applied.
    """
    filled = interpolate(df, F.col("temperature"), "_filled", cfg.slice_hours)
    filled = filled.withColumn("_repaired", repaired_value(F.col("_filled")))
    blanked = F.when(F.col("diagnosed_fault") != "FROZEN", F.col("_repaired"))
    bridged = interpolate(filled, blanked, "_bridged", cfg.slice_hours)
    return bridged.withColumns(rule_columns(F.col("_repaired"), F.col("_bridged"), cfg)).drop("_filled", "_repaired", "_bridged")


def repaired_value(filled: Column) -> Column:
    """Missing readings take `filled`, spikes the past median."""
    label = F.col("diagnosed_fault")
    return (
        F.when(label == "MISSING", filled)
        .when(label == "SPIKE", F.coalesce("previous_6h_median", "previous_12h_median"))
        .otherwise(F.col("temperature"))
    )


def rule_columns(repaired: Column, bridged: Column, cfg: QCConfig = DEFAULT) -> dict[str, Column]:
    """The corrected value of a diagnosed reading, given its repaired value and the one that bridges a frozen stretch."""
    label = F.col("diagnosed_fault")
    fix = (
        F.when(label == "FROZEN", bridged)
        .when(label == "NOISE", F.col("previous_6h_median"))
        .when(label == "DRIFT", F.col("previous_12h_median"))
        .otherwise(repaired)
    )
    sure = F.coalesce(F.col("diagnosis_confidence") >= cfg.min_confidence, F.lit(False))
    apply = label.isin(*ACTIONABLE) & (sure | (label == "MISSING"))
    return {
        "temperature_original": F.col("temperature"),
        "temperature_corrected": F.when(apply, fix).otherwise(F.col("temperature")),
        "correction_applied": F.when(apply, 1).otherwise(0),
    }


def with_ml_features(df: DataFrame) -> DataFrame:
    wanted = {"hour": F.hour("ts"), "day_of_year": F.dayofyear("ts")}
    return df.withColumns({n: c for n, c in wanted.items() if n not in df.columns})


def fit_rows(df: DataFrame, features: Sequence[str] = ML_FEATURES, max_rows: int = 20_000_000, seed: int = 42) -> DataFrame:
    """What the corrector learns from: complete rows diagnosed as normal.

    Of more than `max_rows` it takes about so many, those with the lowest hashes of (station_id, ts): each station and time of
    day stays in by its share, and the choice does not depend on partitioning.
    """
    rows = with_ml_features(df).filter(F.col("diagnosed_fault") == NORMAL).dropna(subset=[*features, "temperature"])
    share = max_rows / max(rows.count(), 1)
    return rows if share >= 1 else rows.filter(unit_hash(F.col("station_id"), F.col("ts"), seed=seed) < share)


def fit_corrector(
    df: DataFrame,
    features: Sequence[str] = ML_FEATURES,
    trees: int = 200,
    depth: int = 10,
    seed: int = 42,
    max_fit_rows: int = 20_000_000,
) -> PipelineModel:
    """Regression forest for temperature, learned from at most about `max_fit_rows` rows diagnosed as normal.

    A fit keeps a weight for each row and tree, so the trees grow in blocks: all at once while a task's rows and trees make at most
    TASK_WEIGHTS, else as many as do, or BLOCK_TREES. Each block draws its own weights.
    """
    features = check_feature_list(features)
    train = fit_rows(df, features, max_fit_rows, seed).select(*features, "temperature")
    tasks = train.sparkSession.sparkContext.defaultParallelism
    at_once = max(BLOCK_TREES, TASK_WEIGHTS // max(1, -(-train.count() // tasks)))
    blocks = -(-trees // at_once)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    # few input files would leave most cores idle in every pass
    train = assembler.transform(train.repartition(tasks)).select("features", "temperature")
    if blocks > 1:
        train = train.persist(StorageLevel.DISK_ONLY)
    forests = []
    for k in range(blocks):
        forest = RandomForestRegressor(
            featuresCol="features",
            labelCol="temperature",
            predictionCol="_predicted",
            numTrees=trees * (k + 1) // blocks - trees * k // blocks,
            maxDepth=depth,
            featureSubsetStrategy="all",
            # each task holds statistics of so many nodes; with all nodes of a deep level they outgrow an executor
            maxMemoryInMB=128,
            # cached node ids take as much room again as the weights
            cacheNodeIds=False,
            seed=seed + 1_000_003 * k,
        )
        forests.append(forest.fit(train))
    if blocks > 1:
        train.unpersist()
    return PipelineModel([assembler, _one_forest(train.sparkSession, forests)])


def _one_forest(spark: SparkSession, forests: Sequence[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """The trees of all forests in one."""
    if len(forests) == 1:
        return forests[0]
    grown = [tree for forest in forests for tree in forest._java_obj.trees()]
    gateway, ml = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(ml.DecisionTreeRegressionModel, len(grown))
    for i, tree in enumerate(grown):
        trees[i] = tree
    one = RandomForestRegressionModel(ml.RandomForestRegressionModel(forests[0].uid, trees, forests[0].numFeatures))
    forests[0]._copyValues(one)._set(numTrees=len(grown))._transfer_params_to_java()
    return one


def apply_corrector(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str] = ML_FEATURES,
    labels: Sequence[str] = ML_LABELS,
    cfg: QCConfig = DEFAULT,
) -> DataFrame:
    """Let the model replace the rule value for shapes it reconstructs better."""
    features = check_feature_list(features)
    base = with_ml_features(df)
    target = F.coalesce(ml_target(labels, cfg), F.lit(False))
    own = [F.col(f).alias(f"_own_{f}") for f in features]
    asked = impute_median(base.select("*", *own), features, cfg).filter(target)
    predicted = model.transform(asked).select(*(F.col(f"_own_{c}" if c in features else c).alias(c) for c in base.columns), "_predicted")
    # rows that are not asked pass by: no join brings the predictions back
    rest = base.filter(~target).withColumn("_predicted", F.lit(None).cast("double"))
    out = predicted.unionByName(rest)
    return out.withColumns(method_columns(F.col("_predicted"))).drop("_predicted")


def ml_target(labels: Sequence[str] = ML_LABELS, cfg: QCConfig = DEFAULT) -> Column:
    """Whether a reading's shape is one that the model reconstructs, diagnosed with enough confidence."""
    return F.col("diagnosed_fault").isin(*labels) & (F.col("diagnosis_confidence") >= cfg.min_confidence)


def method_columns(predicted: Column) -> dict[str, Column]:
    """The model's value, if there is one, over the rule's."""
    hit = predicted.isNotNull()
    method = F.when(hit, "ml_model").when(F.col("correction_applied") == 1, "rule_based").otherwise("none")
    return {
        "temperature_corrected_rule_only": F.col("temperature_corrected"),
        "temperature_corrected_ml": predicted,
        # a row without a correction keeps the method "none" even if the model had a value
        "correction_method": F.when(F.col("correction_applied") == 0, "none").otherwise(method),
        "temperature_corrected": F.when(hit, predicted).otherwise(F.col("temperature_corrected")),
    }
