"""Small helpers of the operators in this package."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from gaugeline.shipping import ship as ship  # the operators of this package take it from here


def fresh(df: DataFrame | Iterable[str], name: str) -> str:
    """`name`, or a longer one that df has no column of, whatever the case of letters."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
