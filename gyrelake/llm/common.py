"""What the text operators share: reading tables, cutting lineage, checking columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gyrelake.sources.tables import written

__all__ = ["free_name", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with underscores before it while `df` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base
