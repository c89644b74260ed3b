"""Structured Streaming jobs over replayed or arriving readings."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeline.config import DEFAULT, QCConfig
from gaugeline.functions import columns as C
from gaugeline.operators.staging import new_table_path, stage
from gaugeline.shipping import ship
from gaugeline.streaming.state import CAUSAL_SCHEMA, LEDGER_SCHEMA, CausalVotes, HealthLedger

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_trigger: int = 64,
    fmt: str = "parquet",
    pattern: str | None = None,
) -> DataFrame:
    """Read a folder's history as a stream, a bounded number of files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(folder)


def write_in_time_order(df: DataFrame, path: str, ts: str = "ts", files: int | None = None) -> int:
    """Write a history so that `replay` reads it in time order, whatever the number of files; returns that number.

    Each file holds a time range of its own, sorted. A stream reads files by their modification
    time, which follows the end of the writing tasks; so it is set by part number, a second apart.
    """
    ranged = df.repartitionByRange(files, F.col(ts)) if files else df.repartitionByRange(F.col(ts))
    ranged.sortWithinPartitions(ts).write.parquet(path)
    jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(jsc.hadoopConfiguration())
    numbered = lambda f: tuple(map(int, re.match(r"part-(\d+)-.*?-c(\d+)", f.getPath().getName()).groups()))
    listed = lambda: sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=numbered)
    parts = listed()
    newest = max((f.getModificationTime() for f in parts), default=0)
    for back, part in enumerate(reversed(parts)):
        fs.setTimes(part.getPath(), newest - 1000 * back, -1)
    times = [f.getModificationTime() for f in listed()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise RuntimeError(f"{path} keeps no modification times that are set, so a stream cannot read it in time order")
    return len(parts)


def with_event_time(stream: DataFrame, ts: str = "ts", lateness: str | None = None) -> DataFrame:
    """Add the event time used for watermarks; readings later than `lateness` may be dropped."""
    out = stream.withColumn("event_time", F.col(ts).cast("timestamp"))
    return out.withWatermark("event_time", lateness) if lateness else out


def qc_stream(stream: DataFrame, cfg: QCConfig = DEFAULT) -> DataFrame:
    """Plausibility flags and the tight range flag; no state."""
    return stream.withColumns({**C.qc_flag_columns(cfg), "statistical_anomaly": C.tight_range_flag(cfg)})


def dedup_stream(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """First reading per (station, ts) within the watermark; state expires with it."""
    return with_event_time(stream, lateness=lateness).dropDuplicatesWithinWatermark(["station_id", "ts"])


def station_kpis(stream: DataFrame, window: str = "1 day", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """Rows, flagged rows and mean temperature per station and event-time window."""
    timed = with_event_time(qc_stream(stream), lateness=lateness)
    span = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return timed.groupBy("station_id", span.alias("window")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("qc_flag").alias("n_flagged"),
        F.avg("temperature").alias("mean_temperature"),
    )


def station_sessions(stream: DataFrame, gap: str = "3 hours", lateness: str = "6 hours") -> DataFrame:
    """Stretches of readings without a gap of the given length."""
    timed = with_event_time(stream, lateness=lateness)
    return timed.groupBy("station_id", F.session_window("event_time", gap).alias("window")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def causal_votes(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Past-only features and votes from up to 336 kept readings per station, in event-time order.

    A reading is voted on once the watermark has passed it; one behind the watermark is dropped.
    """
    ship(stream.sparkSession)
    timed = with_event_time(stream, lateness=lateness)
    return timed.groupBy("station_id").transformWithStateInPandas(
        statefulProcessor=CausalVotes(), outputStructType=CAUSAL_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def health_stream(stream: DataFrame, fault: str = "fault_type", lateness: str = "2 hours") -> DataFrame:
    """Health after each reading in event-time order, kept across micro-batches."""
    ship(stream.sparkSession)
    timed = with_event_time(stream.withColumn("penalty", C.penalty(F.col(fault))), lateness=lateness)
    ledger = timed.select("station_id", "event_time", "penalty").groupBy("station_id").transformWithStateInPandas(
        statefulProcessor=HealthLedger(), outputStructType=LEDGER_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    return _with_status(ledger)


def _with_status(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("health_status", C.health_status(F.col("health_score")))


def waiting_results(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """Results of the readings that causal_votes or health_stream holds back for the watermark.

    The state stays as it is, so a restarted stream still writes them.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    known = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties").distinct()
    for operator, properties in known.collect():
        names = [v["stateName"] for v in json.loads(properties or "{}").get("stateVariables", [])]
        for kept, (processor, schema, finish) in IN_TIME_ORDER.items():
            if "waiting" in names and kept in names:
                return finish(_waiting(spark, checkpoint, operator, kept, processor, schema))
    return None


def _waiting(spark: SparkSession, checkpoint: str, operator: int, kept: str, processor: type, schema: str) -> DataFrame:
    source = lambda name: (
        spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(checkpoint)
    )
    days = source("waiting").select("key.station_id", "user_map_key.day", "user_map_value.*")
    before = source(kept).select("key.station_id", "value.*").join(days.select("station_id").distinct(), "station_id", "left_semi")

    def finish(key, days, before):
        held = [tuple(r)[2:] for r in days.sort_values("day").itertuples(index=False)]
        return processor.finish(int(key[0]), held, tuple(before.iloc[0])[1:] if len(before) else None)

    return days.groupBy("station_id").cogroup(before.groupBy("station_id")).applyInPandas(finish, schema)


#: By the name of what a processor keeps: the processor, its rows, and the columns added to them.
IN_TIME_ORDER = {
    "history": (CausalVotes, CAUSAL_SCHEMA, lambda rows: rows),
    "score": (HealthLedger, LEDGER_SCHEMA, _with_status),
}


def run_to_end(stream: DataFrame, path: str | None = None, checkpoint: str | None = None, stateful: bool = False) -> DataFrame:
    """Process all that is available into Parquet, then read the result as a table.

    The file sink and the checkpoint make a restart exactly-once. Readings that still wait for the
    watermark at the end are in the table but not in the files.
    """
    spark = stream.sparkSession
    path = path or new_table_path(spark, "stream-out")
    checkpoint = checkpoint or new_table_path(spark, "stream-checkpoint")
    if stateful:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    query: StreamingQuery = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    done = spark.read.schema(stream.schema).parquet(path)
    waiting = waiting_results(spark, checkpoint) if stateful else None
    if waiting is None:
        return done
    if waiting.columns != stream.columns:
        raise ValueError("run_to_end takes causal_votes and health_stream as they are; change the table that it returns")
    return done.unionByName(stage(waiting, "waiting"))


def run_latest(stream: DataFrame, keys: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all that is available in update mode: the newest row of each key, open windows included.

    Each micro-batch writes its changed rows to a folder of its own number, which a retried batch
    replaces. An empty input gives an empty table.
    """
    spark = stream.sparkSession
    path = path or new_table_path(spark, "stream-updates")
    checkpoint = checkpoint or new_table_path(spark, "stream-checkpoint")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    done = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    newest = done.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_newest"))
    return newest.select(*keys, *(F.col("_newest")[c].alias(c) for c in rest)).select(*stream.columns)
