"""Queries of page contents, stored grids, replies and verdicts, over inputs made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.operators import pages as P
from sheafwork.plans.cells import PAGE, _C, _DECIDE, _READ, _VALUE, _decided, cells, readings
from sheafwork.plans.registry import Plans
from sheafwork.sources.tables import table

plans = Plans()
QUERIES, ORACLE, query = plans.queries, plans.oracle, plans.query


@query("image_coverage", f"""WITH {_C}, i AS (SELECT doc_id, page_number, bbox.x0 - 100 AS x0, bbox.top AS top, bbox.x1 + 40 AS x1, bbox.bottom + 30 AS bottom FROM c WHERE bbox IS NOT NULL AND cell_role IN ('stamp', 'remark')),
    p AS (SELECT DISTINCT doc_id, page_number, CASE doc_id % 4 WHEN 0 THEN 0.0 ELSE 300.0 END AS width, 200.0 AS height FROM c), s AS (SELECT doc_id, page_number, sum(greatest(0.0, least(x1, width) - greatest(x0, 0.0)) * greatest(0.0, least(bottom, height) - greatest(top, 0.0))) AS a FROM i JOIN p USING (doc_id, page_number) GROUP BY ALL)
    SELECT doc_id, page_number, CASE WHEN width * height > 0 THEN round(least(1.0, coalesce(a, 0.0) / (width * height)), 9) ELSE 0.0 END AS coverage FROM p LEFT JOIN s USING (doc_id, page_number)""")
def image_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Part of each page under images made of its stamps and remarks; every fourth page has no area."""
    every = cells(spark, sf, *PAGE, "bbox", "cell_role")
    b = lambda k: F.col(f"bbox.{k}")
    images = every.where("bbox is not null and cell_role in ('stamp', 'remark')").select(*PAGE, (b("x0") - 100).alias("x0"), b("top").alias("top"), (b("x1") + 40).alias("x1"), (b("bottom") + 30).alias("bottom"))
    pages = every.select(*PAGE).distinct().withColumns({"width": F.when(F.col("doc_id") % 4 == 0, 0.0).otherwise(300.0), "height": F.lit(200.0)})
    return P.image_coverage(pages, images, PAGE).withColumn("coverage", F.round("coverage", 9))


_STROKES = " UNION ALL ".join(f"SELECT doc_id, page_number, word_id * 4 + {i} AS ord, {a} AS x0, {b} AS y0, {c} AS x1, {d} AS y1 FROM words" for i, (a, b, c, d) in enumerate((("x1", "top", "x0", "top + word_id % 3 * 0.4"), ("x0", "bottom", "x1", "bottom"), ("x0", "top", "x0 + word_id % 2", "bottom"), ("x1", "bottom", "x1", "top + word_id % 9"))))


@query("drawing_rulings", f"""WITH s AS ({_STROKES}), f AS (SELECT *, abs(y1 - y0) <= 0.6 AND abs(x1 - x0) >= 3 AS h, abs(x1 - x0) <= 0.6 AND abs(y1 - y0) >= 3 AS v FROM s)
    SELECT ord, CASE WHEN h THEN 'h' ELSE 'v' END AS orientation, CASE WHEN h THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS position, CASE WHEN h THEN least(x0, x1) ELSE least(y0, y1) END AS low, CASE WHEN h THEN greatest(x0, x1) ELSE greatest(y0, y1) END AS high FROM f WHERE h OR v""")
def drawing_rulings(spark: SparkSession, sf: str) -> DataFrame:
    """Rulings among strokes around every word, some of them slanted or short."""
    i, c = F.col("word_id"), F.col
    side = lambda k, a, b, d, e: F.struct((i * 4 + k).alias("ord"), a.alias("x0"), b.alias("y0"), d.alias("x1"), e.alias("y1"))
    four = F.array(side(0, c("x1"), c("top"), c("x0"), c("top") + i % 3 * 0.4), side(1, c("x0"), c("bottom"), c("x1"), c("bottom")), side(2, c("x0"), c("top"), c("x0") + i % 2, c("bottom")), side(3, c("x1"), c("bottom"), c("x1"), c("top") + i % 9))
    strokes = table(spark, sf, "words").select(*PAGE, F.inline(four)).withColumns({"stroke": F.lit(0.5), "color": F.lit("000000")})
    return P.strokes_to_rulings(strokes, PAGE).select("ord", "orientation", "position", "low", "high")


@query("rect_edges", """WITH r AS (SELECT word_id, x0, top, CASE WHEN word_id % 4 = 0 THEN x0 + 1 ELSE x1 END AS x1, bottom FROM words)
    SELECT word_id * 4 AS ord, 'h' AS orientation, top AS position, x0 AS low, x1 AS high FROM r WHERE x1 - x0 >= 3 UNION ALL SELECT word_id * 4 + 1, 'h', bottom, x0, x1 FROM r WHERE x1 - x0 >= 3
    UNION ALL SELECT word_id * 4 + 2, 'v', x0, top, bottom FROM r WHERE bottom - top >= 3 UNION ALL SELECT word_id * 4 + 3, 'v', x1, top, bottom FROM r WHERE bottom - top >= 3""")
def rect_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Sides of a rectangle around every word as rulings; sides under three points are none."""
    x1 = F.when(F.col("word_id") % 4 == 0, F.col("x0") + 1).otherwise(F.col("x1"))
    rects = table(spark, sf, "words").select(*PAGE, F.col("word_id").alias("ord"), "x0", "top", x1.alias("x1"), "bottom", F.lit(0.5).alias("stroke"), F.lit("000000").alias("color"))
    return P.strokes_to_rulings(P.rect_strokes(rects, PAGE), PAGE).select("ord", "orientation", "position", "low", "high")


@query("ocr_words", "SELECT word_id, x0 * 300 / 72 * 72.0 / 150 AS x0, round((bottom * 300 / 72 * 72.0 / 150 - top * 300 / 72 * 72.0 / 150) * 0.78, 1) AS font_size, 'ocr' AS source FROM words")
def ocr_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words as if found at 300 dots to the inch and read at 150: geometry and size in points."""
    px = lambda c: P.pt_to_px(F.col(c), F.lit(300)).alias(c)
    found = table(spark, sf, "words").select("word_id", "text", *[px(c) for c in ("x0", "top", "x1", "bottom")], "confidence", F.lit(150).alias("dpi"))
    return P.recognised_words(found).select("word_id", "x0", "font_size", "source")


@query("width_points", "SELECT word_id, round((x1 - x0) / 10 * 7 * 72 / 96, 6) AS points FROM words")
def width_points(spark: SparkSession, sf: str) -> DataFrame:
    """Column widths in points."""
    return table(spark, sf, "words").select("word_id", F.round(P.width_to_points((F.col("x1") - F.col("x0")) / 10), 6).alias("points"))


@query("page_titles", f"WITH {_C}, p AS (SELECT DISTINCT doc_id // 2 AS doc_id, page_number + doc_id % 2 AS page_number FROM c WHERE doc_id % 3 <> 0) SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'Page ' || page_number ELSE 'Sheet1' END AS title FROM p")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of pages; documents of one or two pages are made of pairs of documents."""
    pages = cells(spark, sf, *PAGE).where("doc_id % 3 <> 0").select(F.floor(F.col("doc_id") / 2).alias("doc_id"), (F.col("page_number") + F.col("doc_id") % 2).alias("page_number")).distinct()
    return P.sheet_titles(pages)


@query("apply_correction", f"""WITH {_READ}, d AS (SELECT cell_id, resolution, {_VALUE} AS value FROM (SELECT *, {_DECIDE} AS resolution FROM rd))
    SELECT c.cell_id, CASE WHEN resolution = 'corrected' THEN value ELSE text END AS text, CASE WHEN resolution = 'corrected' THEN 'General' ELSE number_format END AS number_format, CASE WHEN resolution = 'corrected' THEN 'vlm' ELSE source END AS source, CASE WHEN resolution = 'corrected' THEN 0.95 ELSE confidence END AS confidence FROM c LEFT JOIN d USING (cell_id)""")
def apply_correction(spark: SparkSession, sf: str) -> DataFrame:
    """Cells after the corrections that four readings agree on."""
    return P.corrected(cells(spark, sf, "text", "number_format", "source", "confidence"), _decided(readings(spark, sf)).select("cell_id", "resolution", "value"), ["cell_id"])


@query("grid_json", f"WITH {_C} SELECT doc_id, page_number, row_idx, col_idx, row_span, col_span, text FROM c")
def grid_json(spark: SparkSession, sf: str) -> DataFrame:
    """Cells stored as one JSON text a document and read again."""
    return P.grids_from_json(P.grids_to_json(cells(spark, sf, *PAGE, "row_idx", "col_idx", "row_span", "col_span", "text")))


@query("reply_location", """SELECT loc_id, CASE WHEN loc_id % 7 <> 0 THEN CAST(header_row AS INTEGER) END AS header_row, CAST(first_data_row AS INTEGER) AS first_data_row, CAST(loc_id % 9 AS INTEGER) AS price_column
    FROM table_locations WHERE loc_id % 5 <> 0 AND first_data_row < 40 AND loc_id % 9 < 8""")
def reply_location(spark: SparkSession, sf: str) -> DataFrame:
    """Table locations out of made replies for sheets of 40 rows and 8 columns; some are words or point outside."""
    i = F.col("loc_id")
    head = F.when(i % 7 == 0, F.lit("true")).otherwise(F.col("header_row").cast("string"))
    first = F.when(i % 5 == 0, F.lit('"none"')).otherwise(F.col("first_data_row").cast("string"))
    reply = F.concat(F.lit('Sure: {"header_row": '), head, F.lit(', "first_data_row": '), first, F.lit(', "columns": {"ref": 0, "other": 1, "qty": "x", "unit_price": '), (i % 9).cast("string"), F.lit("}}"))
    made = table(spark, sf, "table_locations").select("loc_id", reply.alias("reply"), F.lit(40).alias("n_rows"), F.lit(8).alias("n_cols"))
    return P.located_by_reply(made).select("loc_id", "header_row", "first_data_row", F.try_element_at("mapping", F.lit("unit_price")).alias("price_column"))


@query("page_verdict", f"""WITH {_C} SELECT cell_id, 'disagreement' AS kind, row_idx AS row, col_idx AS col, 'a' || ord AS text, least(1.0, greatest(0.0, confidence + 0.2)) AS confidence FROM c WHERE cell_id % 3 <> 0
    UNION ALL SELECT cell_id, 'missing', row_idx, col_idx + 1, '', 0.0 FROM c""")
def page_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of made page replies; every third has a malformed disagreement."""
    row = F.when(F.col("cell_id") % 3 == 0, F.lit("null")).otherwise(F.col("row_idx").cast("string"))
    reply = F.concat(F.lit('{"disagreements": [{"row": '), row, F.lit(', "col": '), "col_idx", F.lit(', "text": "a'), "ord", F.lit('", "confidence": '), (F.col("confidence") + 0.2).cast("string"), F.lit('}], "missing": [{"row": '), "row_idx", F.lit(', "col": '), F.col("col_idx") + 1, F.lit("}]}"))
    return P.verdicts(cells(spark, sf, "row_idx", "col_idx", "ord", "confidence").select("cell_id", reply.alias("reply")))


@query("ssim_summary", f"""WITH {_C}, s AS (SELECT doc_id // 4 AS doc_id, doc_id % 4 AS page_number, min(confidence) - (doc_id % 3) * 0.2 AS ssim FROM c GROUP BY ALL, c.doc_id)
    SELECT doc_id, round(avg(ssim), 9) AS mean_ssim, bool_and(ssim >= 0.5) AS passed, coalesce(string_agg(CASE WHEN ssim < 0.5 THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS failures FROM s GROUP BY doc_id""".replace("GROUP BY ALL, c.doc_id", "GROUP BY c.doc_id"))
def ssim_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose pages all resemble what they were read from; scores are made from confidences."""
    scores = cells(spark, sf, "doc_id", "confidence").groupBy("doc_id").agg((F.min("confidence") - F.col("doc_id") % 3 * 0.2).alias("ssim"))
    rows = P.similarity_summary(scores.select(F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") % 4).alias("page_number"), "ssim"))
    return rows.withColumn("failures", F.array_join("failures", ","))
