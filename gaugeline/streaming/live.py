"""Live scoring: new readings against saved models and each station's recent history."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline.config import DEFAULT, LABEL_PENALTY_KEY, NORMAL, QCConfig
from gaugeline.functions import columns as C
from gaugeline.operators import correction, diagnosis, features
from gaugeline.operators.iforest import IsolationForest
from gaugeline.operators.slices import with_running_length
from gaugeline.operators.staging import stage
from gaugeline.shipping import ship
from gaugeline.streaming.ring import CONTEXT_SCHEMA, LiveContext
from gaugeline.streaming.state import KEPT_ROWS

# Fixed value: readings a station needs before it is scored.
MIN_HISTORY_ROWS = 48
LIVE_COLUMNS = ("station_id", "ts", "station_name", "temperature", "humidity", "pressure", "wind_speed")


def recent_history(history: DataFrame, rows: int = KEPT_ROWS) -> DataFrame:
    """The last readings of each station; the rank limit is applied before the shuffle."""
    newest = Window.partitionBy("station_id").orderBy(F.col("ts").desc())
    return history.select(*LIVE_COLUMNS).withColumn("_rank", F.row_number().over(newest)).filter(
        F.col("_rank") <= rows
    ).drop("_rank")


def place_after_history(new: DataFrame, last: DataFrame) -> DataFrame:
    """A reading at or before its station's last one moves to one hour after it."""
    out = new.join(last, "station_id", "left")
    late = F.col("ts").isNull() | (F.col("ts") <= F.col("last_ts"))
    moved = F.when(late & F.col("last_ts").isNotNull(), F.timestamp_add("HOUR", F.lit(1), F.col("last_ts")))
    return out.withColumn("asked_ts", F.col("ts")).withColumn("ts", F.coalesce(moved, F.col("ts")))


def score_readings(
    new: DataFrame,
    history: DataFrame,
    forest: IsolationForest,
    corrector: PipelineModel,
    cfg: QCConfig = DEFAULT,
) -> DataFrame:
    """Votes, diagnosis, correction, severity, explanation and health of new readings.

    `new` holds one reading per station (station_id, ts, temperature, humidity,
    pressure). Thresholds come from the station's own window of at most 336
    readings and the new one. Readings without enough context are labelled
    INSUFFICIENT CONTEXT instead of failing.
    """
    context = stage(recent_history(history).join(new.select("station_id").distinct(), "station_id", "left_semi"), "context")
    last = context.groupBy("station_id").agg(
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("history_rows"),
        F.max_by("station_name", "ts").alias("station_name"),
        F.coalesce(F.max_by("wind_speed", "ts"), F.lit(0.0)).alias("wind_speed"),
    )
    asked = new.select("station_id", "ts", "temperature", "humidity", "pressure")
    placed = stage(place_after_history(asked, last), "placed")
    placed = placed.withColumn("problem", _refusal())
    ready = placed.filter(F.col("problem").isNull())

    window = context.join(ready.select("station_id").distinct(), "station_id", "left_semi").withColumn("is_new", F.lit(0))
    working = window.unionByName(ready.select(*LIVE_COLUMNS, F.lit(1).alias("is_new")))
    working = stage(working, "working")
    live_cfg = replace(cfg, std_min_rows=2)
    feats = features.shape_features(features.baseline_rows(working, ["temperature"], cfg=live_cfg), live_cfg)
    feats = with_running_length(feats, "temperature", "repeat_length", cfg.slice_hours)
    scored = forest.flag(feats).withColumns(
        {
            "rule_score": C.qc_flag_columns(cfg)["qc_flag"],
            "statistical_score": C.statistical_vote(cfg),
            "temporal_score": C.temporal_vote(cfg),
        }
    )
    scored = stage(scored.withColumn("anomaly_score", C.vote_total()), "live-votes")
    fixed = stage(correction.correct_by_rules(diagnosis.diagnose(scored, cfg=cfg), cfg), "live-corrected")
    final = correction.apply_corrector(fixed, corrector, cfg=cfg).filter(F.col("is_new") == 1)

    results = [col.alias(name) for name, col in _result_columns(forest.offset).items()]
    known = final.select("station_id", "ts", "station_name", *results, _no_baseline().alias("problem"))
    ok = known.filter(F.col("problem").isNull()).withColumn("reason", F.col("explanation"))
    failed = known.filter(F.col("problem").isNotNull()).select("station_id", "ts", "temperature_original", "problem")
    rejected = placed.filter(F.col("problem").isNotNull()).select(
        "station_id", F.coalesce("asked_ts", "ts").alias("ts"), F.col("temperature").alias("temperature_original"), "problem"
    )
    return ok.drop("problem").unionByName(_insufficient(failed.unionByName(rejected)), allowMissingColumns=True)


def _refusal() -> Column:
    """Why a reading is not scored at all, or null."""
    absent = F.col("temperature").isNull() | F.col("humidity").isNull() | F.col("pressure").isNull()
    rows = F.coalesce(F.col("history_rows"), F.lit(0))
    short = F.format_string(f"station %d: %d earlier readings known, {MIN_HISTORY_ROWS} needed", F.col("station_id"), rows)
    return F.when(absent, "a reading needs temperature, humidity and pressure").when(rows < MIN_HISTORY_ROWS, short)


def _no_baseline() -> Column:
    missing = F.col("previous_6h_median").isNull() | F.col("temperature_zscore_24h").isNull()
    return F.when(missing, "no temporal baseline for this reading")


def _result_columns(cut: float) -> dict[str, Column]:
    label = F.col("diagnosed_fault")
    ml = C.sigmoid(F.col("isolation_raw") - F.lit(cut))
    found = label != NORMAL
    lost = F.create_map(*[F.lit(x) for pair in LABEL_PENALTY_KEY.items() for x in pair])
    score = F.lit(100) - C.penalty(F.when(found, F.try_element_at(lost, label)))
    return {
        "temperature_original": F.col("temperature_original"),
        "humidity": F.col("humidity"),
        "pressure": F.col("pressure"),
        "anomaly_detected": found,
        "anomaly_score": F.col("anomaly_score"),
        "diagnosed_fault": label,
        "diagnosis_confidence": F.col("diagnosis_confidence"),
        "temperature_corrected": F.col("temperature_corrected"),
        "correction_method": F.col("correction_method"),
        "correction_applied": F.col("correction_applied"),
        "severity": F.when(found, C.severity_band(F.greatest(ml, F.col("anomaly_score") / 4.0))).otherwise("Normal"),
        "explanation": C.explanation_text(),
        "ml_anomaly_score": F.round(ml, 4),
        "detector_scores": F.struct("rule_score", "statistical_score", "isolation_score", "temporal_score"),
        "sensor_health_score": score,
        "sensor_health_status": C.health_status(score),
        "stages": F.struct(
            F.when(F.col("rule_score") == 1, "flagged").otherwise("passed").alias("quality_check"),
            F.when(F.col("anomaly_score") >= 1, "anomaly").otherwise("normal").alias("anomaly_detection"),
            label.alias("diagnosis"),
            F.when(F.col("correction_applied") == 1, F.col("correction_method")).otherwise("none").alias("correction"),
            C.health_status(score).alias("sensor_health"),
        ),
    }


def _insufficient_columns(problem: Column) -> dict[str, Column]:
    skipped = F.lit("skipped")
    return {
        "anomaly_detected": F.lit(False),
        "diagnosed_fault": F.lit(C.INSUFFICIENT),
        "correction_method": F.lit("none"),
        "correction_applied": F.lit(0),
        "severity": F.lit("Unknown"),
        "explanation": problem,
        "stages": F.struct(
            skipped.alias("quality_check"),
            skipped.alias("anomaly_detection"),
            F.lit(C.INSUFFICIENT).alias("diagnosis"),
            skipped.alias("correction"),
            skipped.alias("sensor_health"),
        ),
        "reason": problem,
    }


def _insufficient(df: DataFrame) -> DataFrame:
    told = [c.alias(n) for n, c in _insufficient_columns(F.col("problem")).items()]
    return df.select("station_id", "ts", "temperature_original", *told)


def live_stream(
    stream: DataFrame,
    forest: IsolationForest,
    corrector: PipelineModel,
    history: DataFrame | None = None,
    cfg: QCConfig = DEFAULT,
) -> DataFrame:
    """Score every arriving reading against its station's last 336 readings, kept in state.

    The columns are those of `score_readings`, which gives the same rows for the same context. `history` (LIVE_COLUMNS) is read
    once, at the start of the first micro-batch; from then on nothing stored is read again. Several readings of a
    station in one micro-batch each have those before them as context. The null column `previous_12h_median` of
    a reading that the model corrects takes the median over the reading's own context.
    """
    ship(stream.sparkSession)
    known = set(stream.columns)
    name, wind = (F.col(c) if c in known else F.lit(None).cast(t) for c, t in (("station_name", "string"), ("wind_speed", "double")))
    readings = [F.col(v).cast("double").alias(v) for v in ("temperature", "humidity", "pressure")]
    arriving = stream.select("station_id", "ts", name.alias("station_name"), *readings, wind.cast("double").alias("wind_speed"))
    start = None if history is None else recent_history(history).groupBy("station_id")
    context = arriving.groupBy("station_id").transformWithStateInPandas(
        statefulProcessor=LiveContext(KEPT_ROWS, MIN_HISTORY_ROWS, forest.voter(stream.sparkSession), cfg),
        outputStructType=CONTEXT_SCHEMA,
        outputMode="Append",
        timeMode="None",
        initialState=start,
    )
    votes = forest.flag(context).withColumns(
        {"rule_score": C.qc_flag_columns(cfg)["qc_flag"], "statistical_score": C.statistical_vote(cfg), "temporal_score": C.temporal_vote(cfg)}
    )
    labelled = votes.withColumn("anomaly_score", C.vote_total()).withColumns(diagnosis.label_columns(cfg))
    fixed = labelled.withColumns(correction.rule_columns(correction.repaired_value(F.col("temperature")), F.col("bridged"), cfg))
    # the model is asked for every row, as a branch and a join would run the state twice; most answers are not used
    own = {f: F.col(f) for f in correction.ML_FEATURES if f in fixed.columns}
    asked = correction.with_ml_features(fixed.withColumns({f"_own_{f}": c for f, c in own.items()}))
    filled = {f: F.coalesce(F.col(f), F.col("median_12h") if f == "previous_12h_median" else F.lit(None), F.lit(0.0)) for f in own}
    predicted = corrector.transform(asked.withColumns(filled))
    predicted = predicted.withColumns({f: F.col(f"_own_{f}") for f in own})
    wanted = F.when(correction.ml_target(cfg=cfg), F.col("_predicted"))
    done = predicted.withColumn("_predicted", wanted).withColumns(correction.method_columns(F.col("_predicted")))
    done = done.withColumn("_refused", _refusal()).withColumn("_problem", F.coalesce(F.col("_refused"), _no_baseline()))

    told = _insufficient_columns(F.col("_problem"))
    results = _result_columns(forest.offset) | {"station_name": F.col("station_name")}
    results["reason"] = results["explanation"]
    fine = F.col("_problem").isNull()
    columns = {n: F.when(fine, c).otherwise(told[n]) if n in told else F.when(fine, c) for n, c in results.items()}
    columns["temperature_original"] = F.col("temperature")
    columns["ts"] = F.when(F.col("_refused").isNotNull(), F.coalesce("asked_ts", "ts")).otherwise(F.col("ts"))
    order = ["ts", "station_name", *(n for n in results if n != "station_name")]
    return done.select("station_id", *(columns[n].alias(n) for n in order))


def start_live_scoring(
    stream: DataFrame,
    result_path: str,
    checkpoint: str,
    forest: IsolationForest,
    corrector: PipelineModel,
    history: DataFrame | None = None,
    cfg: QCConfig = DEFAULT,
    available_now: bool = False,
) -> StreamingQuery:
    """Score arriving readings into Parquet files, exactly once; the session needs a RocksDB state store (`jobs.STATE_PROVIDER`)."""
    scored = live_stream(stream, forest, corrector, history, cfg)
    writer = scored.writeStream.format("parquet").option("path", result_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
