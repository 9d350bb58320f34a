"""Queries of sources, sinks, images, readers and streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.functions import labels as L, raster
from sheafwork.plans.cells import PAGE, cells
from sheafwork.plans.layout import rules
from sheafwork.plans.registry import Plans
from sheafwork.sources import readers, xlsx
from sheafwork.streaming import quotes as stream

plans = Plans()
QUERIES, ORACLE, query = plans.queries, plans.oracle, plans.query


def book_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as the workbook sink takes them, one cell a slot."""
    placed = cells(spark, sf, *PAGE, "row_idx", "col_idx", "row_span", "col_span", "ord", "text").where("text is not null").groupBy(*PAGE, "row_idx", "col_idx").agg(F.min_by(F.struct("text", "row_span", "col_span"), F.struct("ord", "cell_id")).alias("c"))
    title = L.sheet_title(F.concat(F.lit("Page "), "page_number"))
    return placed.select("doc_id", "page_number", title.alias("title"), F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), "c.text", "c.row_span", "c.col_span")


@query("xlsx_roundtrip", "SELECT doc_id, page_number, row_idx AS row, col_idx AS col, text FROM grid_cells WHERE false")
def xlsx_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that change on the way into workbooks and back: none."""
    before = book_cells(spark, sf)
    after = xlsx.from_workbooks(xlsx.to_workbooks(before))
    keys = ["doc_id", "title", "row", "col", "text", "row_span", "col_span"]
    lost = before.select(keys).exceptAll(after.select(keys)).unionByName(after.select(keys).exceptAll(before.select(keys)))
    return lost.select("doc_id", F.lit(1).alias("page_number"), "row", "col", "text")


@query("xlsx_books", "WITH c AS (SELECT DISTINCT doc_id FROM grid_cells WHERE text IS NOT NULL) SELECT doc_id FROM c")
def xlsx_books(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that become a workbook."""
    return xlsx.to_workbooks(book_cells(spark, sf)).where("length(content) > 0").select("doc_id")


_FOUND = "doc_id bigint, page_number int, orientation string, position double, low double, high double, stroke double"


def _draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Draw the rules of each page at 72 dpi and find them again."""
    for batch in batches:
        out = []
        for doc, number, *lines in batch.itertuples(index=False):
            image = np.full((900, 900), 255, np.uint8)
            for o, at, low, high in zip(*lines):
                a, c, d = int(at), max(0, int(low)), min(899, int(high))
                if o == "h":
                    image[a : a + 1, c:d] = 0
                else:
                    image[c:d, a : a + 1] = 0
            out += [(doc, number, *f) for f in raster.find_rulings(raster.binary(image), 72)]
        yield pd.DataFrame(out, columns=["doc_id", "page_number", "orientation", "position", "low", "high", "stroke"])


@query("raster_rulings")
def raster_rulings(spark: SparkSession, sf: str) -> DataFrame:
    """Rules found on page images, drawn from long made rules."""
    long = rules(spark, sf).select(*PAGE, F.struct("orientation", "position", "low", (F.col("high") + 60).alias("high")).alias("r"))
    pages = long.groupBy(*PAGE).agg(F.collect_list("r").alias("r"))
    return pages.select(*PAGE, *[F.col(f"r.{c}").alias(c) for c in ("orientation", "position", "low", "high")]).mapInPandas(_draw, _FOUND)


@query("reader_echo", "SELECT count(*) AS cells, count(*) AS agree FROM (SELECT DISTINCT cell_id FROM grid_cells WHERE text IS NOT NULL)")
def reader_echo(spark: SparkSession, sf: str) -> DataFrame:
    """Cells a faithful reader agrees with."""
    every = cells(spark, sf, "text").where("text is not null").select("cell_id", "text")
    both = every.join(readers.read_cells(every, "echo"), "cell_id")
    return both.agg(F.count("*").alias("cells"), F.count_if(F.col("text") == F.col("reading")).alias("agree"))


@query("stream_tumbling")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day and type as a stream; the last day stays open."""
    return stream.run(stream.tumbling(stream.landing(spark, sf, "events", "ts"), "ts", "event_type"), "tumbling")


@query("stream_session")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users as a stream."""
    return stream.run(stream.sessions(stream.landing(spark, sf, "events", "ts"), "ts", "user_id"), "sessions")
