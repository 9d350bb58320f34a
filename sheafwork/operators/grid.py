"""From the words, rulings, rectangles and images of pages to sheets of cells.

Facts of a page (boundaries, bands, rulings across a band) are small sorted arrays on the rows that need them; lines,
runs and cells are rows. Everything is keyed by document and page. What several steps read (lines, contents, boundaries, cells) is written
once to the shared folder.

Inputs, each with doc_id and page_number: `pages` (width, height), `words` (word_id, ord, text, box, font_name, font_size,
bold, italic, color, source, confidence), `rulings` (ord, orientation, position, low, high, stroke, color), `rects` (ord,
x0, top, x1, bottom, fill), `images` (ord, x0, top, x1, bottom). Pages without words and images give no cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.functions.labels import border_style, near_white
from sheafwork.functions.values import let, strip
from sheafwork.operators import cells as C, geometry as G, layout as Y
from sheafwork.operators.layout import PAGE
from sheafwork.session import written

TOUCH, LEAST_BAND, RULE_SHARE = 2.0, 3.0, 0.04
_POINTS = "array<double>"
_SPANS = "array<struct<at:double,low:double,high:double>>"
_BANDS = "array<struct<top:double,bottom:double,top_ruled:boolean,bottom_ruled:boolean>>"


@dataclass
class Pages:
    """The contents of pages."""

    pages: DataFrame
    words: DataFrame
    rulings: DataFrame
    rects: DataFrame
    images: DataFrame


def _sorted(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.groupBy(*PAGE).agg(F.sort_array(F.collect_list(value)).alias(name))


def _or_none(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(kind)).alias(name)


def text_lines(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Non-blank words with their line, and the lines with their boxes."""
    placed = written(Y.group_lines(words.where(strip(F.col("text")) != "")), "lines")
    return placed, placed.groupBy(*PAGE, "line").agg(*G.union_box())


def significant(rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """Rulings of at least RULE_SHARE of the page along them."""
    extent = F.when(F.col("orientation") == "v", F.col("height")).otherwise(F.col("width"))
    return rulings.join(pages, PAGE).where(F.col("high") - F.col("low") >= extent * RULE_SHARE).drop("width", "height")


def contents(p: Pages, lines: DataFrame) -> DataFrame:
    """Pages with words or images and the box of all that must appear (left, upper, right, lower), within the page."""
    box = lambda *c: [x.cast("double").alias(n) for x, n in zip(c, ("x0", "top", "x1", "bottom"))]
    v = F.col("orientation") == "v"
    at = lambda a, b: F.when(v, F.col(a)).otherwise(F.col(b))
    drawn = p.rulings.join(p.pages, PAGE).where(F.col("high") - F.col("low") >= F.least("width", "height") * RULE_SHARE)
    shown = lines.select(*PAGE, *G.box(), F.lit(1).alias("full")).unionByName(p.images.select(*PAGE, *G.box(), F.lit(1).alias("full")))
    every = shown.unionByName(drawn.select(*PAGE, *box(at("position", "low"), at("low", "position"), at("position", "high"), at("high", "position")), F.lit(0).alias("full")))
    union = every.groupBy(*PAGE).agg(*G.union_box(), F.max("full").alias("full")).where("full = 1").join(p.pages, PAGE)
    zero = F.lit(0.0)
    return union.select(*PAGE, F.greatest("x0", zero).alias("left"), F.greatest("top", zero).alias("upper"), F.least("x1", "width").alias("right"), F.least("bottom", "height").alias("lower"))


def grid_verticals(strong: DataFrame, content: DataFrame) -> DataFrame:
    """Vertical rulings of pages where at least one lies inside the content: PAGE, verticals (sorted spans). A frame around the page is no table."""
    v = strong.where("orientation = 'v'").join(content, PAGE)
    inside = (F.col("position") > F.col("left") + LEAST_BAND) & (F.col("position") < F.col("right") - LEAST_BAND)
    spans = F.sort_array(F.collect_list(F.struct(F.col("position").alias("at"), "low", "high")))
    return v.groupBy(*PAGE).agg(spans.alias("verticals"), F.max(inside).alias("inner")).where("inner").drop("inner")


def word_gaps(placed: DataFrame) -> DataFrame:
    """Words with the end of the word before on their line and whether that gap stands out there.

    A single gap stands out beyond WIDE_GAP, one of several also beyond GAP_FACTOR times the lower quartile of all gaps of the line.
    """
    along, line = Window.partitionBy(*PAGE, "line").orderBy("x0", "top", "ord"), Window.partitionBy(*PAGE, "line")
    gaps = placed.withColumns({"before": F.lag("x1").over(along), "i": F.row_number().over(along)}).withColumn("gap", F.col("x0") - F.col("before"))
    sizes = F.sort_array(F.collect_list("gap").over(line))
    usual = F.element_at(sizes, (F.floor((F.size(sizes) - 1) / 4) + 1).cast("int"))
    limit = F.when(F.size(sizes) == 1, F.lit(Y.WIDE_GAP)).otherwise(F.greatest(F.lit(Y.WIDE_GAP), Y.GAP_FACTOR * usual))
    return gaps.withColumn("outlier", F.coalesce(F.col("gap") > limit, F.lit(False)))


def corridor_positions(placed: DataFrame, content: DataFrame) -> DataFrame:
    """PAGE, position: the free corridors strictly inside the content."""
    found = Y.corridors(placed, edges=content.select(*PAGE, "left", "right")).join(content, PAGE)
    inside = (F.col("separator") > F.col("left") + LEAST_BAND) & (F.col("separator") < F.col("right") - LEAST_BAND)
    return found.where(inside).select(*PAGE, F.col("separator").alias("position"))


def column_bounds(strong: DataFrame, gaps: DataFrame, corridors: DataFrame, content: DataFrame) -> DataFrame:
    """PAGE, cols: boundaries of the columns from the left to the right edge of the content.

    Vertical rulings inside the content decide; pages without one take the corridors and the gaps that stand
    out on at least three lines.
    """
    inside = (F.col("position") > F.col("left") + LEAST_BAND) & (F.col("position") < F.col("right") - LEAST_BAND)
    inner = lambda df: df.join(content, PAGE).where(inside).select(*PAGE, "position")
    ruled = inner(G.cluster_positions(strong.where("orientation = 'v'"), PAGE, "position", TOUCH))
    middle = gaps.where("outlier").select(*PAGE, ((F.col("before") + F.col("x0")) / 2).alias("position"))
    shared = inner(G.cluster_positions(middle, PAGE, "position", 2 * Y.CORRIDOR).where("members >= 3"))
    open_ = G.cluster_positions(corridors.unionByName(shared), PAGE, "position", Y.CORRIDOR).select(*PAGE, "position")
    ends = content.select(*PAGE, F.explode(F.array("left", "right")).alias("position"))
    every = ends.unionByName(ruled).unionByName(open_.join(ruled, PAGE, "left_anti"))
    bounds = _sorted(G.cluster_positions(every, PAGE, "position", TOUCH), "position", "b")
    return bounds.select(*PAGE, G.prune(F.col("b"), LEAST_BAND).alias("cols"))


def ruled_edges(strong: DataFrame, rects: DataFrame, content: DataFrame) -> DataFrame:
    """PAGE, position: horizontal rulings and the upper and lower edges of visible fills, near ones as one, within the content."""
    fills = rects.where(F.col("fill").isNotNull() & (F.col("fill") != "") & ~near_white(F.col("fill"))).select(*PAGE, F.explode(F.array("top", "bottom")).alias("position"))
    every = strong.where("orientation = 'h'").select(*PAGE, "position").unionByName(fills)
    near = G.cluster_positions(every, PAGE, "position", TOUCH).join(content, PAGE)
    return near.where((F.col("position") >= F.col("upper") - TOUCH) & (F.col("position") <= F.col("lower") + TOUCH)).select(*PAGE, "position")


def real_bands(edges: DataFrame, verticals: DataFrame, lines: DataFrame) -> DataFrame:
    """PAGE, top, bottom: gaps between neighbouring edges that are rows: a vertical ruling spans them, or they hold exactly one line."""
    along = Window.partitionBy(*PAGE).orderBy("position")
    gaps = edges.select(*PAGE, F.col("position").alias("top"), F.lead("position").over(along).alias("bottom")).where(F.col("bottom") - F.col("top") >= LEAST_BAND)
    centres = _sorted(lines.select(*PAGE, ((F.col("top") + F.col("bottom")) / 2).alias("y")), "y", "centres")
    known = gaps.join(verticals, PAGE, "left").join(centres, PAGE, "left")
    spanned = F.exists(F.coalesce("verticals", F.array().cast(_SPANS)), lambda v: (v["low"] <= F.col("top") + TOUCH) & (v["high"] >= F.col("bottom") - TOUCH))
    held = F.size(F.filter(F.coalesce("centres", F.array().cast(_POINTS)), lambda y: (y >= F.col("top")) & (y < F.col("bottom"))))
    return known.where(spanned | (held == 1)).select(*PAGE, "top", "bottom")


def _band(top: Column, bottom: Column, top_ruled: Column, bottom_ruled: Column) -> Column:
    return F.struct(top.alias("top"), bottom.alias("bottom"), top_ruled.alias("top_ruled"), bottom_ruled.alias("bottom_ruled"))


def backfilled(bands: Column, boxes: Column) -> Column:
    """Bands and, in the order of `boxes` (top, bottom), one of its own for every box whose centre lies in no band so far."""
    no = F.lit(False)

    def step(acc: Column, b: Column) -> Column:
        y = (b["top"] + b["bottom"]) / 2
        held = F.exists(acc, lambda a: (a["top"] <= y) & (y < a["bottom"]))
        return F.when(held, acc).otherwise(F.concat(acc, F.array(_band(b["top"], b["bottom"], no, no))))

    return F.aggregate(boxes, bands, step)


def merged_bands(bands: Column) -> Column:
    """Bands in order, those that overlap by more than a touch as one; the flags tell whose edge a ruling is."""

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.slice(acc, 1, F.size(acc) - 1)
        joined = _band(last["top"], F.greatest(last["bottom"], b["bottom"]), last["top_ruled"], F.when(b["bottom"] >= last["bottom"], b["bottom_ruled"]).otherwise(last["bottom_ruled"]))
        return F.when((F.size(acc) > 0) & (b["top"] < last["bottom"] - TOUCH), F.concat(rest, F.array(joined))).otherwise(F.concat(acc, F.array(b)))

    by = lambda a, b: F.when(a["top"] < b["top"], -1).when(a["top"] > b["top"], 1).when(a["bottom"] < b["bottom"], -1).when(a["bottom"] > b["bottom"], 1).otherwise(0)
    return F.aggregate(F.array_sort(bands, by), F.array().cast(_BANDS), step)


def between(bands: Column) -> Column:
    """The boundary between each band and the next: the lower one's ruled edge, else the upper one's, else the middle of the gap."""

    def edge(b: Column, i: Column) -> Column:
        n = F.get(bands, i + 1)
        return F.when(n["top_ruled"], n["top"]).when(b["bottom_ruled"], b["bottom"]).otherwise((b["bottom"] + n["top"]) / 2)

    return F.transform(F.slice(bands, F.lit(1), F.greatest(F.size(bands) - 1, F.lit(0))), edge)


def page_bands(p: Pages, real: DataFrame, lines: DataFrame, content: DataFrame) -> DataFrame:
    """PAGE, upper, lower, bands: ruled bands, lines and images outside them, merged in order."""
    ruled = real.groupBy(*PAGE).agg(F.sort_array(F.collect_list(_band(F.col("top"), F.col("bottom"), F.lit(True), F.lit(True)))).alias("ruled"))
    boxes = lambda df, name, order: df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(order, "top", "bottom"))).alias(name))
    kind = "array<struct<o:{},top:double,bottom:double>>"
    known = content.join(ruled, PAGE, "left").join(boxes(lines, "texts", F.struct(F.col("top").alias("t"), "line").alias("o")), PAGE, "left").join(boxes(p.images, "pictures", F.col("ord").cast("int").alias("o")), PAGE, "left")
    known = known.select(*PAGE, "upper", "lower", _or_none("ruled", _BANDS), _or_none("texts", kind.format("struct<t:double,line:int>")), _or_none("pictures", kind.format("int")))
    beside = lambda i: F.exists("texts", lambda t: (t["top"] < i["bottom"]) & (t["bottom"] > i["top"]))
    known = known.withColumn("with_text", backfilled(F.col("ruled"), F.col("texts")))
    known = known.withColumn("with_all", backfilled(F.col("with_text"), F.filter("pictures", lambda i: ~beside(i))))
    return known.select(*PAGE, "upper", "lower", merged_bands(F.col("with_all")).alias("bands"))


def row_bounds(bands: DataFrame) -> DataFrame:
    """PAGE, rows: boundaries of the rows from the upper to the lower edge of the content."""
    b = F.col("bands")
    whole = F.concat(F.array(F.least("upper", F.get(b, F.lit(0))["top"])), between(b), F.array(F.greatest("lower", F.element_at(b, -1)["bottom"])))
    every = F.when(F.size(b) > 0, whole).otherwise(F.array("upper", "lower"))
    return bands.select(*PAGE, let(every, lambda e: G.prune(e, LEAST_BAND)).alias("rows"))


def crossing(spans: Column, at: Column) -> Column:
    """Different positions of the rulings that reach across a coordinate, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda v: (v["low"] <= at + TOUCH) & (v["high"] >= at - TOUCH)), lambda v: v["at"])))


def line_runs(gaps: DataFrame, lines: DataFrame, bounds: DataFrame, corridors: DataFrame) -> DataFrame:
    """Runs of words that fall into one cell: PAGE, line, run, row, n_rows, band_top, band_bottom, across (rulings), box, text and the style of the leading word.

    Where at least two vertical rulings cross the line's rows, they alone divide it; else corridors and its
    own outlier gaps do.
    """
    hits = G.overlap_bands(F.col("top"), F.col("bottom"), F.col("rows"))
    laid = lines.join(bounds, PAGE).withColumn("hits", hits).withColumn("row", F.get("hits", F.lit(0))).withColumn("n_rows", F.size("hits"))
    laid = laid.withColumns({"band_top": F.get("rows", F.col("row")), "band_bottom": F.get("rows", F.least(F.col("row") + F.col("n_rows"), F.size("rows") - 1))})
    laid = laid.withColumn("across", crossing(F.col("verticals"), (F.col("band_top") + F.col("band_bottom")) / 2))
    laid = laid.join(_sorted(corridors, "position", "corridors"), PAGE, "left").select(*PAGE, "line", "row", "n_rows", "band_top", "band_bottom", "across", _or_none("corridors", _POINTS))
    ruled = F.size("across") >= 2
    parted = F.exists(F.when(ruled, F.col("across")).otherwise(F.col("corridors")), lambda s: (F.col("before") < s) & (s < F.col("x0")))
    cut = F.coalesce(parted, F.lit(False)) | (~ruled & F.col("outlier"))
    along = Window.partitionBy(*PAGE, "line").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = gaps.join(laid, [*PAGE, "line"]).withColumn("run", F.sum(cut.cast("int")).over(along))
    style = F.struct("font_name", "font_size", "bold", "italic", "color", "source")
    lead = F.max_by(style, F.struct(F.length("text"), F.round(F.col("x1") - F.col("x0"), 6), -F.col("i")))
    text = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda w: w["text"]), " "))
    keep = ("row", "n_rows", "band_top", "band_bottom", "across")
    runs = words.groupBy(*PAGE, "line", "run").agg(text.alias("text"), *G.union_box(), F.min("confidence").alias("confidence"), lead.alias("lead"), *[F.first(c).alias(c) for c in keep])
    return runs.where("text <> ''")


def _enclosed(low: Column, high: Column, rules: Column, bounds: Column) -> Column:
    """struct(first, last) of the bands between the rulings nearest outside an interval; null where there are none or they are no boundaries."""

    def ends(rs: Column) -> Column:
        before, after = F.array_max(F.filter(rs, lambda r: r <= low + TOUCH)), F.array_min(F.filter(rs, lambda r: r >= high - TOUCH))
        return F.struct(let(before, lambda v: G.nearest_boundary(v, bounds)).alias("a"), let(after, lambda v: G.nearest_boundary(v, bounds)).alias("b"))

    found = lambda e: F.when(e["b"] > e["a"], F.struct(e["a"].alias("first"), F.least(e["b"] - 1, F.size(bounds) - 2).alias("last")))
    return let(rules, lambda rs: F.when(F.size(rs) >= 2, let(ends(rs), found)))


def spanned(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Runs with their cell: row, col, row_span, col_span; borders around a run outrank what it overlaps."""
    placed = runs.join(bounds.select(*PAGE, "cols", "rows", "horizontals"), PAGE)
    placed = placed.withColumns({"ruled": _enclosed(F.col("x0"), F.col("x1"), F.col("across"), F.col("cols")), "hit": G.overlap_bands(F.col("x0"), F.col("x1"), F.col("cols"))})
    placed = placed.withColumns({"col": F.coalesce("ruled.first", F.get("hit", F.lit(0))), "last_col": F.coalesce("ruled.last", F.element_at("hit", -1))})
    middle = (F.get("cols", F.col("col")) + F.get("cols", F.col("last_col") + 1)) / 2
    down = _enclosed(F.col("top"), F.col("bottom"), crossing(F.col("horizontals"), middle), F.col("rows"))
    placed = placed.withColumn("down", F.when(F.col("ruled").isNotNull(), down))
    return placed.select(
        *PAGE, "line", "run", "text", *G.box(), "confidence", "lead", F.coalesce("down.first", "row").alias("row_idx"), F.col("col").alias("col_idx"),
        F.coalesce(F.col("down.last") - F.col("down.first") + 1, F.col("n_rows")).alias("row_span"), (F.col("last_col") - F.col("col") + 1).alias("col_span"),
    )


def assembled(placed: DataFrame) -> DataFrame:
    """Cells of the runs that share a slot: texts in reading order, boxes united, the widest span; the rest from the first run. Spans end before other cells."""
    order = F.struct("line", "run")
    text = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "run", "text"))), lambda r: r["text"]), " "))
    first = F.min_by(F.struct("row_span", "confidence", "lead", order.alias("o")), order)
    cells = placed.groupBy(*PAGE, "row_idx", "col_idx").agg(text.alias("text"), *G.union_box(), F.max("col_span").alias("col_span"), first.alias("f"))
    cells = cells.select(
        *PAGE, "row_idx", "col_idx", "text", *G.box(), "col_span", "f.row_span", "f.confidence", "f.lead.source", F.coalesce(F.nullif("f.lead.font_name", F.lit("")), F.lit("Calibri")).alias("font_name"),
        F.when(F.col("f.lead.font_size") > 0, F.col("f.lead.font_size")).otherwise(11.0).alias("font_size"), "f.lead.bold", "f.lead.italic", F.col("f.lead.color").alias("font_color"),
    )
    named = written(cells.withColumn("cell_id", F.concat_ws("/", *PAGE, "row_idx", "col_idx")), "slots")  # the spans read it four times
    shrunk = C.shrink_spans(named, PAGE)
    return shrunk.drop("col_span", "row_span").withColumnsRenamed({"new_col_span": "col_span", "new_row_span": "row_span"})


def bounds_of(p: Pages) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Boundaries (PAGE, cols, rows, verticals, horizontals), words with gaps, lines and corridors of all pages that hold anything."""
    placed, lines = text_lines(p.words)
    lines = written(lines, "boxes")
    content = written(contents(p, lines), "contents")
    strong = written(significant(p.rulings, p.pages), "strong")
    gaps, corridors, verticals = word_gaps(placed), written(corridor_positions(placed, content), "corridors"), grid_verticals(strong, content)
    cols = column_bounds(strong, gaps, corridors, content)
    rows = row_bounds(page_bands(p, real_bands(ruled_edges(strong, p.rects, content), verticals, lines), lines, content))
    flat = strong.where("orientation = 'h'").groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(F.col("position").alias("at"), "low", "high"))).alias("horizontals"))
    bounds = cols.join(rows, PAGE).join(verticals, PAGE, "left").join(flat, PAGE, "left")
    return written(bounds.select(*PAGE, "cols", "rows", _or_none("verticals", _SPANS), _or_none("horizontals", _SPANS)), "bounds"), gaps, lines, corridors


def sheet_cells(p: Pages) -> tuple[DataFrame, DataFrame]:
    """The cells of every page, and the boundaries of its columns and rows (PAGE, cols, rows)."""
    bounds, gaps, lines, corridors = bounds_of(p)
    runs = line_runs(gaps, lines, bounds, corridors)
    return written(assembled(spanned(written(runs, "runs"), bounds)), "cells"), bounds.select(*PAGE, "cols", "rows")


def cell_rects(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells with `bbox`, their rectangle between the boundaries (spans end at the grid), and the box of their text as `inner`; degenerate ones have a null bbox."""
    last_col, last_row = F.least(F.col("col_idx") + F.col("col_span"), F.size("cols") - 1), F.least(F.col("row_idx") + F.col("row_span"), F.size("rows") - 1)
    rect = F.struct(F.get("cols", F.col("col_idx")).alias("x0"), F.get("rows", F.col("row_idx")).alias("top"), F.get("cols", last_col).alias("x1"), F.get("rows", last_row).alias("bottom"))
    inner = F.when(F.col("x0").isNotNull(), F.struct(*[F.col(c) for c in ("x0", "top", "x1", "bottom")]))
    return cells.join(bounds, PAGE).withColumns({"bbox": F.when((F.col("col_idx") < last_col) & (F.col("row_idx") < last_row), rect), "inner": inner}).drop("cols", "rows", "x0", "top", "x1", "bottom")


def styled(cells: DataFrame, bounds: DataFrame, p: Pages) -> DataFrame:
    """Cells with borders (struct of left, right, top, bottom: style, color), fill and alignment, and the blank ones that are bordered or filled.

    A cell without a rectangle keeps no decoration.
    """
    every = cells.withColumn("made", F.lit(False))
    shape = bounds.select(*PAGE, (F.size("rows") - 1).alias("n"), (F.size("cols") - 1).alias("m"))
    grid = shape.where("n > 0 and m > 0").select(*PAGE, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"), "m").select(*PAGE, "row", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("col"))
    taken = C.covered_slots(cells.withColumn("ord", F.lit(0)), PAGE).select(*PAGE, "row", "col")
    blank = grid.join(taken, [*PAGE, "row", "col"], "left_anti").select(*PAGE, F.col("row").alias("row_idx"), F.col("col").alias("col_idx"), F.lit("").alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(True).alias("made"))
    blank = blank.withColumn("cell_id", F.concat_ws("/", *PAGE, "row_idx", "col_idx"))
    rect = written(cell_rects(every.unionByName(blank, allowMissingColumns=True), bounds), "rects")
    edges = C.best_edges(rect, p.rulings, PAGE, color=True).withColumn("b", F.struct(border_style(F.col("stroke")).alias("style"), "color"))
    borders = edges.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("edge", "b"))).alias("e")).select("cell_id", F.struct(*[F.try_element_at("e", F.lit(s)).alias(s) for s in ("left", "right", "top", "bottom")]).alias("borders"))
    seen = p.rects.where(F.col("fill").isNotNull() & (F.col("fill") != "") & ~near_white(F.col("fill")))
    fills = C.best_fills(rect, seen.select(*PAGE, F.col("ord").alias("rect_ord"), F.col("x0").alias("r0"), F.col("top").alias("r1"), F.col("x1").alias("r2"), F.col("bottom").alias("r3"), "fill"), PAGE)
    both = rect.join(borders, "cell_id", "left").join(fills, "cell_id", "left").where(~F.col("made") | F.col("borders").isNotNull() | F.col("fill").isNotNull())
    slack = [F.col("inner.x0") - F.col("bbox.x0"), F.col("bbox.x1") - F.col("inner.x1"), F.col("inner.top") - F.col("bbox.top"), F.col("bbox.bottom") - F.col("inner.bottom")]
    h, v = C.alignment(*slack)
    told = F.col("inner").isNotNull() & F.col("bbox").isNotNull()
    return both.withColumns({"h_align": F.when(told, h).otherwise("left"), "v_align": F.when(told, v).otherwise("bottom")})
