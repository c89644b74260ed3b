"""Station files: tolerant reading, provider fields, unions and stage hand-off."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.columns import finite_or_null
from gaugeline.operators.staging import join_dim, stage
from gaugeline.schema import OBSERVATION, require_columns

# Field names of the weather provider and their canonical names.
PROVIDER_FIELDS = {
    "time": "ts",
    "temp": "temperature",
    "rhum": "humidity",
    "pres": "pressure",
    "wspd": "wind_speed",
    "wdir": "wind_direction",
}
READINGS = ("temperature", "humidity", "pressure", "wind_speed", "wind_direction")
TIME_NAMES = ("ts", "timestamp")


def coerce_observations(df: DataFrame) -> DataFrame:
    """Cast text columns to the observation types; what does not parse becomes null.

    Rows without a key are dropped. NaN and infinities become null too.
    """
    if "ts" not in df.columns and "timestamp" in df.columns:
        df = df.withColumnRenamed("timestamp", "ts")
    require_columns(df, ["ts", "station_id"])
    casts = {}
    for field in OBSERVATION.fields:
        if field.name not in df.columns:
            continue
        if isinstance(field.dataType, T.TimestampNTZType):
            casts[field.name] = F.col(field.name).try_cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            casts[field.name] = finite_or_null(F.col(field.name).try_cast("double"))
        elif isinstance(field.dataType, T.LongType):
            # "42182" and "42182.0" name the same station
            casts[field.name] = F.coalesce(
                F.col(field.name).try_cast("bigint"), F.col(field.name).try_cast("double").try_cast("bigint")
            )
    return df.withColumns(casts).dropna(subset=["ts", "station_id"])


def read_observations_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Read a CSV whose header holds `columns`, all as text, then coerce.

    The schema is given, so the files are read once and not sampled.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return coerce_observations(spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").csv(path))


def normalize_provider(raw: DataFrame, stations: DataFrame) -> DataFrame:
    """Provider fields to canonical names, with the station's attributes, in a fixed order."""
    named = raw.withColumnsRenamed(PROVIDER_FIELDS)
    placed = join_dim(named, stations, ["station_id"], spread="ts")
    return placed.select(
        "ts", "station_id", "station_name", "latitude", "longitude", *[c for c in READINGS if c in named.columns]
    )


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """Concatenate station feeds by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def write_stage(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    fmt: str = "parquet",
    day_folders: bool = False,
    rows_per_file: int = 5_000_000,
) -> None:
    """Write the agreed columns of a stage.

    The files may be foldered by day, so that time filters prune folders. Folders by
    station would give one writer a third of the rows when one station has them. A day gets as many files as
    its counted rows need and no more, whatever the number of tasks; `read_manifest` tells rows and files of each day. df is read
    twice: pass a stored stage.
    """
    require_columns(df, columns)
    out = df.select(*columns)
    if not day_folders:
        _format(out.write, fmt).save(path)
        return
    dated = out.withColumn("day", F.to_date("ts"))
    per_day = stage(dated.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows")), "days")
    per_day = per_day.withColumn("n_files", F.ceil(F.col("n_rows") / rows_per_file))
    # rows without a time have a folder of their own
    key = F.coalesce("day", F.lit("0001-01-01").cast("date"))
    files = per_day.select(key.alias("_day"), "n_files")
    placed = join_dim(dated.withColumn("_day", key), files, ["_day"], spread="ts")
    placed = placed.withColumn("_file", F.pmod(F.xxhash64(*columns), F.col("n_files"))).repartition("_day", "_file")
    _format(placed.drop("_day", "_file", "n_files").write.partitionBy("day"), fmt).save(path)
    per_day.coalesce(1).write.parquet(f"{path}/{MANIFEST}")


# readers of the folder skip names with an underscore
MANIFEST = "_manifest"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(day, n_rows, n_files) of a stage in day folders; a day may have fewer files than told."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def _format(writer: DataFrameWriter, fmt: str) -> DataFrameWriter:
    return (writer.option("header", True) if fmt == "csv" else writer).format(fmt)


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def enrich_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on (ts, station_id) to metadata with one row per key; names get a default."""
    keys = ["ts", "station_id"]
    rest = [c for c in metadata.columns if c not in keys]
    one = metadata.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_m")).select(*keys, "_m.*")
    default = F.concat(F.lit("Station "), F.col("station_id").cast("string"))
    return df.join(one, keys, "left").withColumn("station_name", F.coalesce("station_name", default))


def match_report(enriched: DataFrame, probe: str = "latitude") -> DataFrame:
    return enriched.agg(F.count(F.lit(1)).alias("n_rows"), F.count(probe).alias("n_matched"))


def handoff_mismatch(results: DataFrame, handoff: DataFrame, column: str = "fault_severity") -> DataFrame:
    """Rows both sides hold, and how many of them disagree on a column (null equals null)."""
    other = handoff.select("station_id", "ts", F.col(column).alias("_truth"))
    both = results.select("station_id", "ts", column).join(other, ["station_id", "ts"])
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col(column).eqNullSafe(F.col("_truth"))).alias("n_mismatch")
    )
