"""Scores against ground truth. Only these functions read the label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import NORMAL, VOTES
from gaugeline.functions.columns import true_family
from gaugeline.operators.staging import stage
from gaugeline.schema import require_columns

TRUTH = "is_anomaly"


def confusion(df: DataFrame, pred: str, truth: str = TRUTH) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def prf_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 with zero for an empty denominator."""
    return {
        "precision": _safe(tp, tp + fp),
        "recall": _safe(tp, tp + fn),
        "f1": _safe(2 * tp, 2 * tp + fp + fn),
    }


def classification_report(df: DataFrame, pred: str, truth: str = TRUTH) -> DataFrame:
    """Per class, accuracy, macro and weighted averages, from the four cell counts."""
    hit = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    cells = df.agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero, one = prf_columns(tn, fn, fp), prf_columns(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    n = n0 + n1
    accuracy = _safe(tp + tn, n)
    fields = ("precision", "recall", "f1")

    def row(label: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), *[values[f].alias(f) for f in fields], support.alias("support"))

    macro = {f: (zero[f] + one[f]) / 2 for f in fields}
    weighted = {f: _safe(zero[f] * n0 + one[f] * n1, n) for f in fields}
    rows = F.array(
        row("0", zero, n0),
        row("1", one, n1),
        row("accuracy", {f: accuracy for f in fields}, n),
        row("macro avg", macro, n),
        row("weighted avg", weighted, n),
    )
    return cells.select(F.inline(rows))


def prf_by_class(df: DataFrame, by: str, classes: Sequence[str] | None, pred: str, truth: str = TRUTH) -> DataFrame:
    """P/R/F1 per fault class over that class's rows together with all true normals."""
    fp_all = df.filter(F.col(truth) == 0).agg(F.count_if(F.col(pred) == 1)).first()[0]
    rows = df.filter(F.col(truth) == 1)
    if classes:
        rows = rows.filter(F.col(by).isin(*classes))
    per = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(pred) == 1).alias("tp"),
        F.count_if(F.col(pred) == 0).alias("fn"),
    )
    return per.withColumn("fp", F.lit(fp_all)).withColumns(prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def prf_by_group(df: DataFrame, by: str, pred: str, truth: str = TRUTH) -> DataFrame:
    """P/R/F1 within each group that has at least one true fault."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    per = df.groupBy(by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )
    per = per.filter(F.col("tp") + F.col("fn") > 0)
    return per.withColumns(prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def roc_auc(df: DataFrame, score: str, truth: str = TRUTH, part_scores: int = 500_000) -> DataFrame:
    """Area under the ROC curve with ties counted half; null when one class is absent.

    Rows are first reduced to distinct scores, which are dealt in order to parts of about `part_scores`; a score's rank is the
    part's offset, from one total per part, and its place within the part. No task sees more than one part.
    """
    kept = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
    counts = kept.groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count_if(F.col(truth) == 0).alias("_neg")
    )
    counts = stage(counts, "scores")
    parts = counts.count() // part_scores + 1
    # written once, so that both branches below see the same parts
    dealt = stage(counts.repartitionByRange(parts, "_s").withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum("_neg").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_base") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    linked = dealt.join(F.broadcast(totals), "_part")  # one row per part
    wins = linked.withColumn("_wins", F.col("_pos") * (below + F.col("_neg") / 2))
    sums = wins.agg(F.sum("_wins").alias("_u"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return sums.select(auc.alias("auc"), "n_pos", "n_neg")


def roc_auc_by_detector(df: DataFrame, detectors: Sequence[str] = VOTES, truth: str = TRUTH) -> DataFrame:
    """AUC of each 0/1 vote: with two score values it follows from four counts."""
    t = F.col(truth)
    long = _votes_long(df, detectors, [truth])
    per = long.groupBy("detector").agg(
        F.count_if((t == 1) & (F.col("vote") == 1)).alias("_tp"),
        F.count_if((t == 0) & (F.col("vote") == 1)).alias("_fp"),
        F.count_if((t == 1) & F.col("vote").isNotNull()).alias("n_pos"),
        F.count_if((t == 0) & F.col("vote").isNotNull()).alias("n_neg"),
    )
    tpr, fpr = F.col("_tp") / F.col("n_pos"), F.col("_fp") / F.col("n_neg")
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (1 + tpr - fpr) / 2)
    return per.select("detector", auc.alias("auc"))


def _votes_long(df: DataFrame, detectors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *detectors).unpivot(list(keep), list(detectors), "detector", "vote")


def detector_metrics(df: DataFrame, detectors: Sequence[str] = VOTES, truth: str = TRUTH) -> DataFrame:
    t, p = F.col(truth) == 1, F.col("vote") == 1
    per = _votes_long(df, detectors, [truth]).groupBy("detector").agg(
        F.count_if(p).alias("predicted"), F.count_if(t & p).alias("hits"), F.count_if(t & ~p).alias("fn")
    )
    return per.withColumns(
        prf_columns(F.col("hits"), F.col("predicted") - F.col("hits"), F.col("fn"))
    ).drop("fn")


def vote_sweep(df: DataFrame, thresholds: Sequence[int] = (1, 2, 3), truth: str = TRUTH) -> DataFrame:
    """Metrics of `anomaly_score >= t` for each t, from one pass."""
    t = F.col(truth) == 1
    cells = []
    for k in thresholds:
        p = F.col("anomaly_score") >= k
        cells.append(
            F.struct(
                F.lit(k).alias("threshold"),
                F.count_if(p).alias("predicted"),
                F.count_if(t & p).alias("hits"),
                F.count_if(t & ~p).alias("fn"),
            )
        )
    wide = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    rows = wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(cells))])))
    return rows.withColumns(prf_columns(F.col("hits"), F.col("predicted") - F.col("hits"), F.col("fn"))).drop("fn")


def detection_rate(df: DataFrame, pred: str) -> DataFrame:
    """Rows, detections and rate per fault type; for normal rows it is the false-positive rate."""
    return df.groupBy("fault_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(pred).alias("n_detected"),
        (F.sum(pred) / F.count(F.lit(1))).alias("rate"),
    )


def detector_count_profile(df: DataFrame) -> DataFrame:
    """How many detectors fire on true faults, by fault type."""
    return df.filter(F.col(TRUTH) == 1).groupBy("fault_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("anomaly_score").alias("mean_votes"),
        F.min("anomaly_score").alias("min_votes"),
        F.max("anomaly_score").alias("max_votes"),
        *[F.count_if(F.col("anomaly_score") == k).alias(f"votes_{k}") for k in range(5)],
    )


def correction_error(df: DataFrame) -> DataFrame:
    """MAE and RMSE of corrections on true faults, by fault type and overall."""
    require_columns(df, ["fault_type", TRUTH, "original_temperature"])
    error = F.col("temperature_corrected") - F.col("original_temperature")
    faults = df.filter(F.col(TRUTH) == 1).select("fault_type", "correction_applied", error.alias("_e"))
    return (
        faults.rollup("fault_type")
        .agg(
            F.grouping("fault_type").alias("_total"),
            F.count(F.lit(1)).alias("n"),
            F.sum("correction_applied").alias("n_corrected"),
            F.avg(F.abs("_e")).alias("mae"),
            F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        )
        .withColumn("fault_type", F.when(F.col("_total") == 1, "OVERALL").otherwise(F.col("fault_type")))
        .drop("_total")
    )


def match_rate(df: DataFrame) -> DataFrame:
    """Share of true faults diagnosed as their own family."""
    same = F.coalesce(F.col("diagnosed_fault") == true_family(F.col("fault_type")), F.lit(False))
    return df.filter(F.col(TRUTH) == 1).groupBy("fault_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(same.cast("int")).alias("match_rate")
    )


def rule_vs_model(df: DataFrame) -> DataFrame:
    """Mean absolute error of rule-only and model values on true faults the model treated."""
    truth = F.col("original_temperature")
    rows = df.filter((F.col(TRUTH) == 1) & F.col("temperature_corrected_ml").isNotNull())
    return rows.groupBy("fault_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("temperature_corrected_rule_only") - truth)).alias("mae_rule"),
        F.avg(F.abs(F.col("temperature_corrected_ml") - truth)).alias("mae_model"),
    )


def model_agreement(df: DataFrame, old: str, new: str, truth: str = TRUTH) -> DataFrame:
    """A retrained flag against the old one, and the recall of both against the truth."""
    o, n, t = F.col(old) == 1, F.col(new) == 1, F.col(truth) == 1
    c = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(o == n).alias("_same"),
        F.count_if(o & n).alias("_both"),
        F.count_if(o).alias("_old"),
        F.count_if(n).alias("_new"),
        F.count_if(t).alias("_true"),
        F.count_if(t & o).alias("_t_old"),
        F.count_if(t & n).alias("_t_new"),
    )
    return c.select(
        "n_rows",
        _safe(F.col("_same"), F.col("n_rows")).alias("accuracy"),
        _safe(F.col("_both"), F.col("_new")).alias("precision"),
        _safe(F.col("_both"), F.col("_old")).alias("recall"),
        _safe(F.col("_t_old"), F.col("_true")).alias("old_truth_recall"),
        _safe(F.col("_t_new"), F.col("_true")).alias("new_truth_recall"),
    )


def diagnosis_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("diagnosed_fault").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("correction_applied").alias("n_corrected")
    )


def diagnosis_crosstab(df: DataFrame) -> DataFrame:
    """Fault type by diagnosis, as columns."""
    labels = [NORMAL, "SUSPICIOUS", "MISSING", "SPIKE", "FROZEN", "DRIFT", "NOISE"]
    return df.groupBy("fault_type").agg(
        *[F.count_if(F.col("diagnosed_fault") == x).alias(x.lower()) for x in labels]
    )
