"""Cells on a sheet: spans, borders, fills, alignment, images, geometry of the workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.operators.geometry import area, band_index, binned_overlaps, shared_area

EDGE_TOL, EDGE_COVER, FILL_COVER, ALIGN_TOL, MIN_IMAGE, BACKGROUND = 2.5, 0.70, 0.80, 3.0, 2.0, 0.85


def covered_slots(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col of every slot a cell covers with its spans, the anchor included, with `anchor_row`, `anchor_col`; the first cell (by ord) wins a slot."""
    slots = cells.select(*keys, "ord", F.col("row_idx").alias("anchor_row"), F.col("col_idx").alias("anchor_col"), F.explode(F.sequence(F.col("row_idx"), F.col("row_idx") + F.col("row_span") - 1)).alias("row"), "col_span")
    slots = slots.select("*", F.explode(F.sequence(F.col("anchor_col"), F.col("anchor_col") + F.col("col_span") - 1)).alias("col"))
    return slots.groupBy(*keys, "row", "col").agg(F.min_by(F.struct("anchor_row", "anchor_col"), F.struct("ord", "anchor_row", "anchor_col")).alias("a")).select(*keys, "row", "col", "a.*")


def shrink_spans(cells: DataFrame, keys: list[str], id_: str = "cell_id") -> DataFrame:
    """Add `new_col_span`, `new_row_span`: spans cut before the first other anchor; rows are tested with the shrunk columns."""
    anchors = cells.select(*keys, F.col("row_idx").alias("r"), F.col("col_idx").alias("c")).distinct()
    off = cells.where("col_span > 1").select(*keys, id_, F.col("row_idx").alias("r"), F.posexplode(F.sequence(F.col("col_idx") + 1, F.col("col_idx") + F.col("col_span") - 1)).alias("o", "c"))
    cut = off.join(anchors, [*keys, "r", "c"], "left_semi").groupBy(id_).agg((F.min("o") + 1).alias("stop"))
    cols = cells.join(cut, id_, "left").withColumn("new_col_span", F.greatest(F.lit(1), F.coalesce("stop", "col_span"))).drop("stop")
    down = cols.where("row_span > 1").select(*keys, id_, "col_idx", "new_col_span", F.posexplode(F.sequence(F.col("row_idx") + 1, F.col("row_idx") + F.col("row_span") - 1)).alias("o", "r"))
    down = down.select(*keys, id_, "o", "r", F.explode(F.sequence(F.col("col_idx"), F.col("col_idx") + F.col("new_col_span") - 1)).alias("c"))
    stop = down.join(anchors, [*keys, "r", "c"], "left_semi").groupBy(id_).agg((F.min("o") + 1).alias("stop"))
    return cols.join(stop, id_, "left").withColumn("new_row_span", F.greatest(F.lit(1), F.coalesce("stop", "row_span"))).drop("stop")


def best_edges(cells: DataFrame, rulings: DataFrame, keys: list[str], color: bool = False) -> DataFrame:
    """cell_id, edge, stroke (and color, if asked for): the heaviest ruling that covers EDGE_COVER of each edge within EDGE_TOL, the first on ties.

    Edges and rulings meet in bins of the position, so the work is in neighbours, not in pairs of a page. Both grow with
    the input and are judged too small by the size of their compressed files, so neither is broadcast.
    """
    b = lambda c: F.col(f"bbox.{c}")
    edges = F.array(
        F.struct(F.lit("top").alias("edge"), F.lit("h").alias("orientation"), b("top").alias("at"), b("x0").alias("from"), b("x1").alias("to")), F.struct(F.lit("bottom").alias("edge"), F.lit("h").alias("orientation"), b("bottom").alias("at"), b("x0").alias("from"), b("x1").alias("to")),
        F.struct(F.lit("left").alias("edge"), F.lit("v").alias("orientation"), b("x0").alias("at"), b("top").alias("from"), b("bottom").alias("to")), F.struct(F.lit("right").alias("edge"), F.lit("v").alias("orientation"), b("x1").alias("at"), b("top").alias("from"), b("bottom").alias("to")),
    )
    width = 10.0
    e = cells.where("bbox is not null").select(*keys, "cell_id", F.inline(edges)).where(F.col("to") > F.col("from"))
    e = e.withColumn("bin", F.explode(F.sequence(F.floor((F.col("at") - EDGE_TOL) / width), F.floor((F.col("at") + EDGE_TOL) / width))))
    r = rulings.withColumn("bin", F.floor(F.col("position") / width))
    pairs = e.join(r.hint("merge"), [*keys, "orientation", "bin"]).where(F.abs(F.col("position") - F.col("at")) <= EDGE_TOL)
    cover = (F.least("to", "high") - F.greatest("from", "low")) / (F.col("to") - F.col("from"))
    good = pairs.where(cover >= EDGE_COVER)
    more = ["color"] if color else []
    return good.groupBy("cell_id", "edge").agg(F.max(F.struct("stroke", (-F.col("ord")).alias("n"), *more)).alias("m")).select("cell_id", "edge", F.round("m.stroke", 4).alias("stroke"), *[f"m.{c}" for c in more])


def best_fills(cells: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """cell_id, fill: the smallest rectangle, not near white, that covers FILL_COVER of the cell, the first on ties.

    Cells and rectangles meet in bands of the height of a page, never as all pairs of a page.
    """
    c = cells.where("bbox is not null").select(*keys, "cell_id", F.col("bbox.x0").alias("a0"), F.col("bbox.top").alias("a1"), F.col("bbox.x1").alias("a2"), F.col("bbox.bottom").alias("a3"))
    one, two = [F.col(f"a{i}") for i in range(4)], [F.col(f"r{i}") for i in range(4)]
    near = binned_overlaps(c, rects, keys, "a1", "a3", "r1", "r3", 50.0)
    pairs = near.where((area(*one) > 0) & (shared_area(one, two) >= area(*one) * FILL_COVER))
    return pairs.groupBy("cell_id").agg(F.min_by("fill", F.struct(F.round(area(*two), 6), "rect_ord")).alias("fill"))


def alignment(left: Column, right: Column, top: Column, bottom: Column) -> list[Column]:
    """h_align, v_align from the slack on each side."""
    h = F.when(F.abs(left - right) <= ALIGN_TOL, "center").when(left < right, "left").otherwise("right")
    v = F.when(F.abs(top - bottom) <= ALIGN_TOL, "center").when(top < bottom, "top").otherwise("bottom")
    return [h.alias("h_align"), v.alias("v_align")]


def anchor(images: DataFrame, cols: Column, rows: Column) -> DataFrame:
    """Images of visible size in the cell of their upper left corner: row, col, size in pixels, offsets."""
    seen = images.where((F.col("x1") - F.col("x0") >= MIN_IMAGE) & (F.col("bottom") - F.col("top") >= MIN_IMAGE)).withColumns({"__c": cols, "__r": rows}).where("size(__c) > 1 and size(__r) > 1")
    px = lambda v: F.greatest(F.lit(1), F.rint(v * 96 / 72).cast("int"))
    placed = seen.withColumns({"col": band_index(F.col("x0"), F.col("__c")), "row": band_index(F.col("top"), F.col("__r"))})
    return placed.select(
        "image_id", "row", "col", px(F.col("x1") - F.col("x0")).alias("width_px"), px(F.col("bottom") - F.col("top")).alias("height_px"),
        F.round(F.greatest(F.lit(0.0), F.col("x0") - F.get("__c", F.col("col"))), 4).alias("offset_x"), F.round(F.greatest(F.lit(0.0), F.col("top") - F.get("__r", F.col("row"))), 4).alias("offset_y"),
    )


def column_width(points: Column) -> Column:
    """Points as spreadsheet column width, rounded, within the limits of a workbook."""
    return F.least(F.greatest(F.round(points * 96 / 72 / 7, 2), F.lit(0.5)), F.lit(255.0))


def row_height(points: Column) -> Column:
    return F.least(F.greatest(F.round(points, 2), F.lit(1.0)), F.lit(409.0))


def assemble(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that fall into one slot as one cell: texts in line and run order, box united, widest span, the rest from the first run."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "run", "text")))
    first = F.min_by(F.struct("font_size", "confidence"), F.struct("line", "run"))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), " ")
    return runs.groupBy(*keys, "row", "col").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("col_span").alias("col_span"), first.alias("f")).select(*keys, "row", "col", "text", "x0", "x1", "col_span", "f.*")


def blank_slots(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Slots of a sheet's grid that no cell covers: a sequence per axis, anti-joined with the covered slots."""
    size = cells.groupBy(*keys).agg(F.max(F.col("row_idx") + F.col("row_span")).alias("n"), F.max(F.col("col_idx") + F.col("col_span")).alias("m"))
    grid = size.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"), "m").select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("col"))
    return grid.join(covered_slots(cells, keys).select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti")


def chunked(cells: DataFrame, keys: list[str], size: int = 300) -> DataFrame:
    """Add `chunk`: cells in groups of `size` by ord, for calls of a reader."""
    return cells.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "cell_id")) - 1) / size))
