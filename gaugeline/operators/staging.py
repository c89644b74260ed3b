"""Hand-off tables, checked broadcasts and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import DEFAULT

CHECKPOINT_CONF = "spark.checkpoint.dir"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gaugeline-")


def scratch_dir(spark: SparkSession) -> str:
    """Folder for hand-off tables: the shared one the cluster names.

    Only a local session without that setting gets a folder of its own.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        path = _local_folder()
    return path.rstrip("/")


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage as Parquet and go on from the files.

    Used where several later branches read one expensive result. The files
    survive executor loss and give the planner true sizes.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when df has at most max_rows rows; stops counting beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_dim(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread: str | None = None,
    max_rows: int = DEFAULT.broadcast_rows,
    salts: int = 64,
    rows: int | None = None,
) -> DataFrame:
    """Join a large table to a table with one (or few) rows per key.

    The small side is broadcast when its counted size allows it; `rows` passes a
    count the caller already has. Otherwise both
    sides are salted, so a key holding a large share of df is spread over
    `salts` tasks. `spread` names a column of df that varies within a key.
    """
    keys = list(keys)
    if rows <= max_rows if rows is not None else fits(dim, max_rows):
        return df.join(F.broadcast(dim), keys, how)
    salt_source = spread or next(c for c in df.columns if c not in keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_source), F.lit(salts)))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "_salt", F.col("_salt").cast("bigint")
    )
    # the planner takes the copies for as small as the files of dim, and may broadcast them all
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
