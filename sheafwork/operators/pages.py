"""Contents of pages before and after the grid: images, drawings, recognised words, sheet titles, stored grids, replies and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.functions.labels import SYNONYMS, fold_ocr
from sheafwork.operators import geometry as G
from sheafwork.operators.quotes import usable

STRAIGHT, LEAST_RULING = 0.6, 3.0  #: points that an axis-parallel stroke may lean, and its least length
SIZE_OF_HEIGHT = 0.78  #: font size of a recognised word by the height of its box
RESOLVED = 0.95  #: confidence of a corrected cell


def image_coverage(pages: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, coverage: part of each page under images clipped to it, at most 1; a page without images or area has 0."""
    inside = [F.greatest("x0", F.lit(0.0)), F.greatest("top", F.lit(0.0)), F.least("x1", F.col("width")), F.least("bottom", F.col("height"))]
    covered = images.join(pages, keys).groupBy(*keys).agg(F.sum(G.area(*inside)).alias("covered"))
    whole = F.col("width") * F.col("height")
    part = F.when(whole > 0, F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)) / whole)).otherwise(0.0)  # least alone would pass over a null
    return pages.join(covered, keys, "left").select(*keys, part.alias("coverage"))


def strokes_to_rulings(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """Axis-parallel strokes (ord, x0, y0, x1, y1, stroke, color) as rulings: position is the middle across, short or slanted ones are dropped."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    flat, upright = (dy <= STRAIGHT) & (dx >= LEAST_RULING), (dx <= STRAIGHT) & (dy >= LEAST_RULING)
    o = F.when(flat, "h").when(upright, "v")
    pick = lambda h, v: F.when(flat, h).otherwise(v)
    low, high = pick(F.least("x0", "x1"), F.least("y0", "y1")), pick(F.greatest("x0", "x1"), F.greatest("y0", "y1"))
    at = pick((F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2)
    return strokes.select(*keys, "ord", o.alias("orientation"), at.alias("position"), low.alias("low"), high.alias("high"), "stroke", "color").where("orientation is not null")


def rect_strokes(rects: DataFrame, keys: list[str]) -> DataFrame:
    """The four sides of stroked rectangles (ord, x0, top, x1, bottom, stroke, color) as strokes: upper, lower, left, right."""
    c = F.col
    side = lambda a, b, d, e: F.struct(a.alias("x0"), b.alias("y0"), d.alias("x1"), e.alias("y1"))
    four = F.array(side(c("x0"), c("top"), c("x1"), c("top")), side(c("x0"), c("bottom"), c("x1"), c("bottom")), side(c("x0"), c("top"), c("x0"), c("bottom")), side(c("x1"), c("top"), c("x1"), c("bottom")))
    return rects.select(*keys, (c("ord") * 4).alias("o"), "stroke", "color", F.posexplode(four).alias("i", "s")).select(*keys, (c("o") + c("i")).alias("ord"), "s.*", "stroke", "color")


def px_to_pt(pixels: Column, dpi: Column) -> Column:
    return pixels * 72.0 / dpi


def pt_to_px(points: Column, dpi: Column) -> Column:
    return points * dpi / 72.0


def recognised_words(detections: DataFrame, dpi: str = "dpi") -> DataFrame:
    """Detections in pixels (text, x0, top, x1, bottom, confidence, dpi and any keys) as words in points; the size comes from the height of the box."""
    box = {c: px_to_pt(F.col(c), F.col(dpi)) for c in ("x0", "top", "x1", "bottom")}
    words = detections.withColumns(box).withColumn("text", fold_ocr(F.col("text")))
    return words.withColumns({"font_name": F.lit("Calibri"), "font_size": F.round((F.col("bottom") - F.col("top")) * SIZE_OF_HEIGHT, 1), "source": F.lit("ocr")}).drop(dpi)


def width_to_points(width: Column) -> Column:
    """A spreadsheet column width (characters of 7 pixels at 96 to the inch) in points."""
    return width * 7.0 * (72.0 / 96.0)


def sheet_titles(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number) with `title`: the page's number, or Sheet1 for the only page of a document."""
    many = F.count("*").over(Window.partitionBy("doc_id")) > 1
    return pages.withColumn("title", F.when(many, F.concat(F.lit("Page "), "page_number")).otherwise(F.lit("Sheet1")))


def corrected(cells: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the corrections of decided disputes (keys, resolution, value) written in: text replaced, number format General, source vlm, confidence RESOLVED; the typed value is derived anew."""
    fixes = decisions.where("resolution = 'corrected'").select(*keys, F.col("value").alias("__v"), F.lit(True).alias("__f"))
    done = F.coalesce("__f", F.lit(False))
    new = {"text": F.col("__v"), "number_format": F.lit("General"), "source": F.lit("vlm"), "confidence": F.lit(RESOLVED)}
    return cells.join(fixes, keys, "left").withColumns({c: F.when(done, v).otherwise(F.col(c)) for c, v in new.items()}).drop("__v", "__f")


def grids_to_json(cells: DataFrame) -> DataFrame:
    """doc_id, grid: each document's sheets as one JSON text, pages and cells in order; null texts stay null."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "row_idx", "col_idx", "row_span", "col_span", "text")))
    return cells.groupBy("doc_id").agg(F.to_json(F.struct(ordered.alias("cells")), {"ignoreNullFields": "false"}).alias("grid"))


def grids_from_json(grids: DataFrame) -> DataFrame:
    """The cells of stored documents; a text that is no grid gives no cell."""
    parsed = F.from_json("grid", "cells array<struct<page_number:int,row_idx:int,col_idx:int,row_span:int,col_span:int,text:string>>")
    return grids.select("doc_id", F.inline(parsed["cells"]))


def located_by_reply(replies: DataFrame) -> DataFrame:
    """Replies of a model (keys, reply, n_rows, n_cols) as table locations: header_row, first_data_row, mapping.

    Indices beyond the sheet, words and booleans count as missing; a reply without a first data row or with an
    unusable mapping is dropped.
    """
    block = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    parsed = F.from_json(block, "header_row string, first_data_row string, columns map<string,string>")
    index = lambda v, n: F.when(v.try_cast("int").between(F.lit(0), F.col(n) - 1), v.try_cast("int"))
    keep = [c for c in replies.columns if c not in ("reply", "n_rows", "n_cols")]
    known = F.map_filter(F.transform_values(F.map_filter(F.col("p.columns"), lambda k, _: k.isin(*SYNONYMS)), lambda _, v: index(v, "n_cols")), lambda _, v: v.isNotNull())
    read = replies.withColumn("p", parsed).select(*keep, index(F.col("p.header_row"), "n_rows").alias("header_row"), index(F.col("p.first_data_row"), "n_rows").alias("first_data_row"), known.alias("mapping"))
    return read.where(F.col("first_data_row").isNotNull() & usable(F.col("mapping")))


def verdicts(replies: DataFrame) -> DataFrame:
    """Readings of a page's reply (keys, reply), from its lists of disagreements and missing cells: keys, kind, row, col, text, confidence; malformed entries are dropped."""
    block = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    entry = "array<struct<row:string,col:string,text:string,confidence:string>>"
    parsed = F.from_json(block, f"disagreements {entry}, missing {entry}")
    keep = [c for c in replies.columns if c != "reply"]
    named = lambda f, kind: F.transform(F.coalesce(F.col(f"p.{f}"), F.array().cast(entry)), lambda x: F.struct(F.lit(kind).alias("kind"), x["row"].try_cast("int").alias("row"), x["col"].try_cast("int").alias("col"), F.coalesce(x["text"], F.lit("")).alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x["confidence"].try_cast("double"), F.lit(0.0)))).alias("confidence")))
    rows = replies.withColumn("p", parsed).select(*keep, F.inline(F.concat(named("disagreements", "disagreement"), named("missing", "missing"))))
    return rows.where("row is not null and col is not null")


def similarity_summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, mean_ssim, passed, failures (page numbers) of page similarities (doc_id, page_number, ssim)."""
    low = F.col("ssim") < threshold
    return scores.groupBy("doc_id").agg(F.round(F.avg("ssim"), 9).alias("mean_ssim"), F.min(~low).alias("passed"), F.sort_array(F.collect_list(F.when(low, F.col("page_number")))).alias("failures"))
