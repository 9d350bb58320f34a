"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.operators.instants import to_utc, zone_ids
from sheafwork.sources.tables import latest, table


def stamped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts that say when: quote_date of headers and stamp cells (each cell once), with zone and day order of their quote."""
    headers = table(spark, sf_dir, "quote_headers").select("doc_id", "quote_date", "issuer_zone", "day_first")
    own = headers.select(F.lit("header").alias("src"), F.col("doc_id").alias("row_id"), F.col("quote_date").alias("text"), "issuer_zone", "day_first")
    cells = table(spark, sf_dir, "grid_cells").select("cell_id", "doc_id", "cell_role", "text", "loaded_at")
    last = latest(cells, "cell_id").where("cell_role = 'stamp' and text is not null")  # after the last delivery is chosen, which may have changed them
    once = last.join(headers.drop("quote_date"), "doc_id", "left")
    return own.where("text is not null").unionByName(once.select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), "text", "issuer_zone", "day_first"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that holds an existing date or time whose instant can be told."""
    found = to_utc(stamped_texts(spark, sf_dir), zone_ids(spark), table(spark, sf_dir, "zone_labels"))
    return found.where("utc_us is not null").select("src", "row_id", "utc_us")


def p2_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts came out as an instant and how many did not, by source."""
    found = to_utc(stamped_texts(spark, sf_dir), zone_ids(spark), table(spark, sf_dir, "zone_labels"))
    return found.groupBy("src").agg(F.count("*").alias("texts"), F.count("utc_us").alias("instants"))


QUERIES = {"p2_found": p2_found, "p2_notations": p2_notations}
