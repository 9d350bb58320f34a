"""Readers of the parquet tables; each call reads only what the query selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: str = "loaded_at", *columns: str) -> DataFrame:
    """One row per key, the one delivered last.

    Repeats are combined on the map side (max_by), so a key delivered often costs no more than one
    row per input partition. Ties on `order` take the greatest struct of the kept columns; a null
    `order` loses to any other. Rows with a null key are dropped: they cannot be told apart.
    """
    keep = [c for c in (columns or df.columns) if c != key]
    packed = F.max(F.struct(F.col(order).alias("__o"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]))
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("__r"))
    return out.select(key, *[F.col(f"__r.__{i}").alias(c) for i, c in enumerate(keep)])
