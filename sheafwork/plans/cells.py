"""Queries of cells, consensus, review and scoring over grid_cells (each cell once)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.functions import labels as L
from sheafwork.operators import cells as C, review as R
from sheafwork.plans import sqltext as S
from sheafwork.plans.registry import Plans
from sheafwork.sources.tables import latest, table

plans = Plans()
QUERIES, ORACLE, query = plans.queries, plans.oracle, plans.query
PAGE = ["doc_id", "page_number"]
_C = f"c AS ({S.CELLS})"


def cells(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Each cell once, with the named columns; the choice is made before the deliveries are compared, so that only those are read and shuffled."""
    return latest(table(spark, sf, "grid_cells").select("cell_id", *columns, "loaded_at"), "cell_id", "loaded_at", *columns)


SLOT = (*PAGE, "ord", "row_idx", "col_idx", "row_span", "col_span")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with wider spans, so that they collide."""
    return cells(spark, sf, *SLOT).withColumns({"col_span": F.col("col_span") + (F.col("cell_id") % 3).cast("int"), "row_span": F.col("row_span") + (F.col("cell_id") % 2).cast("int")})


_W = f"{_C}, w AS (SELECT cell_id, doc_id, page_number, ord, row_idx, col_idx, CAST(row_span + cell_id % 2 AS INTEGER) AS row_span, CAST(col_span + cell_id % 3 AS INTEGER) AS col_span FROM c)"


@query("cell_covering", f"""WITH {_W}, s AS (SELECT doc_id, page_number, ord, row_idx, col_idx, unnest(range(row_idx, row_idx + row_span)) AS row, col_span FROM w), t AS (SELECT *, unnest(range(col_idx, col_idx + col_span)) AS col FROM s)
    SELECT doc_id, page_number, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, arg_min(row_idx, k) AS anchor_row, arg_min(col_idx, k) AS anchor_col FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, row, col ORDER BY ord, row_idx, col_idx) AS k FROM t) GROUP BY doc_id, page_number, row, col""")
def cell_covering(spark: SparkSession, sf: str) -> DataFrame:
    """Which cell covers each slot."""
    return C.covered_slots(wide(spark, sf), PAGE)


@query("span_collide", f"""WITH {_W}, a AS (SELECT DISTINCT doc_id, page_number, row_idx AS r, col_idx AS c FROM w),
    x AS (SELECT cell_id, min(o) AS stop FROM (SELECT *, unnest(range(1, col_span)) AS o FROM w WHERE col_span > 1) q JOIN a ON a.doc_id = q.doc_id AND a.page_number = q.page_number AND a.r = q.row_idx AND a.c = q.col_idx + o GROUP BY cell_id),
    y AS (SELECT w.*, greatest(1, coalesce(stop, col_span)) AS ncs FROM w LEFT JOIN x USING (cell_id)),
    z AS (SELECT cell_id, min(o) AS stop FROM (SELECT *, unnest(range(1, row_span)) AS o FROM y WHERE row_span > 1) q JOIN a ON a.doc_id = q.doc_id AND a.page_number = q.page_number AND a.r = q.row_idx + o AND a.c >= q.col_idx AND a.c < q.col_idx + ncs GROUP BY cell_id)
    SELECT cell_id, CAST(ncs AS INTEGER) AS new_col_span, CAST(greatest(1, coalesce(stop, row_span)) AS INTEGER) AS new_row_span FROM y LEFT JOIN z USING (cell_id)""")
def span_collide(spark: SparkSession, sf: str) -> DataFrame:
    """Spans cut before other cells."""
    return C.shrink_spans(wide(spark, sf), PAGE).select("cell_id", "new_col_span", "new_row_span")


def _letters(i: str) -> str:
    return f"CASE WHEN {i} < 26 THEN chr(CAST(65 + {i} AS INTEGER)) ELSE chr(CAST(64 + ({i}) // 26 AS INTEGER)) || chr(CAST(65 + ({i}) % 26 AS INTEGER)) END"


@query("xlsx_merges", f"""WITH {_W.replace('ord, row_idx, col_idx, CAST(row_span', 'ord, row_idx, CAST(col_idx + cell_id % 5 * 20 AS INTEGER) AS col_idx, CAST(row_span')} SELECT cell_id, {_letters('col_idx')} || (row_idx + 1) || ':' || {_letters('col_idx + col_span - 1')} || (row_idx + row_span) AS merged FROM w WHERE col_span > 1 OR row_span > 1""")
def xlsx_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Merged ranges in A1 notation; columns are also moved far to the right, so that letters of two places occur."""
    ref = F.concat(L.column_label(F.col("col_idx")), F.col("row_idx") + 1, F.lit(":"), L.column_label(F.col("col_idx") + F.col("col_span") - 1), F.col("row_idx") + F.col("row_span"))
    far = wide(spark, sf).withColumn("col_idx", F.col("col_idx") + (F.col("cell_id") % 5 * 20).cast("int"))
    return far.where("col_span > 1 or row_span > 1").select("cell_id", ref.alias("merged"))


@query("xlsx_geometry", f"""WITH {_C} SELECT cell_id, least(greatest(round((bbox.x1 - bbox.x0) * 96 / 72 / 7, 2), 0.5), 255.0) AS width, least(greatest(round(bbox.bottom - bbox.top, 2), 1.0), 409.0) AS height FROM c WHERE bbox IS NOT NULL""")
def xlsx_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Column widths and row heights of a workbook."""
    b = lambda k: F.col(f"bbox.{k}")
    return cells(spark, sf, "bbox").where("bbox is not null").select("cell_id", C.column_width(b("x1") - b("x0")).alias("width"), C.row_height(b("bottom") - b("top")).alias("height"))


_RULES = "SELECT doc_id, page_number, ord, CASE WHEN cell_id % 2 = 0 THEN 'h' ELSE 'v' END AS orientation, CASE WHEN cell_id % 2 = 0 THEN bbox.top + cell_id % 4 ELSE bbox.x1 - cell_id % 5 END AS position, CASE WHEN cell_id % 2 = 0 THEN bbox.x0 - cell_id % 7 ELSE bbox.top + cell_id % 6 END AS low, CASE WHEN cell_id % 2 = 0 THEN bbox.x1 - cell_id % 50 ELSE bbox.bottom END AS high, (cell_id % 6) / 2.0 AS stroke FROM c WHERE bbox IS NOT NULL"


@query("edge_best", f"""WITH {_C}, r AS ({_RULES}), e AS (SELECT cell_id, doc_id, page_number, unnest(['top', 'bottom', 'left', 'right']) AS edge, unnest(['h', 'h', 'v', 'v']) AS o, unnest([bbox.top, bbox.bottom, bbox.x0, bbox.x1]) AS p, unnest([bbox.x0, bbox.x0, bbox.top, bbox.top]) AS a, unnest([bbox.x1, bbox.x1, bbox.bottom, bbox.bottom]) AS b FROM c WHERE bbox IS NOT NULL)
    SELECT cell_id, edge, round(max(stroke), 4) AS stroke FROM e JOIN r ON e.doc_id = r.doc_id AND e.page_number = r.page_number AND e.o = r.orientation AND abs(r.position - p) <= 2.5 WHERE b > a AND (least(b, high) - greatest(a, low)) / (b - a) >= 0.70 GROUP BY cell_id, edge""")
def edge_best(spark: SparkSession, sf: str) -> DataFrame:
    """The ruling along each edge of a cell; rulings are made from the cells."""
    i, h = F.col("cell_id"), F.col("cell_id") % 2 == 0
    b = lambda k: F.col(f"bbox.{k}")
    every = cells(spark, sf, *PAGE, "ord", "bbox")
    rulings = every.where("bbox is not null").select(*PAGE, "ord", F.when(h, "h").otherwise("v").alias("orientation"), F.when(h, b("top") + i % 4).otherwise(b("x1") - i % 5).alias("position"), F.when(h, b("x0") - i % 7).otherwise(b("top") + i % 6).alias("low"), F.when(h, b("x1") - i % 50).otherwise(b("bottom")).alias("high"), ((i % 6) / 2).alias("stroke"))
    return C.best_edges(every, rulings, PAGE)


@query("fill_best", f"""WITH {_C}, r AS (SELECT doc_id, page_number, cell_id AS rect_ord, bbox.x0 - 5 AS x0, bbox.top - cell_id % 3 AS top, bbox.x1 + cell_id % 90 AS x1, bbox.bottom + cell_id % 30 AS bottom, printf('%06X', (cell_id * 7919) % 16777216) AS fill FROM c WHERE bbox IS NOT NULL),
    p AS (SELECT c.cell_id, r.*, (r.x1 - r.x0) * (r.bottom - r.top) AS size FROM c JOIN r ON c.doc_id = r.doc_id AND c.page_number = r.page_number WHERE bbox IS NOT NULL AND (bbox.x1 - bbox.x0) * (bbox.bottom - bbox.top) > 0
      AND greatest(0, least(bbox.x1, r.x1) - greatest(bbox.x0, r.x0)) * greatest(0, least(bbox.bottom, r.bottom) - greatest(bbox.top, r.top)) >= 0.8 * ((bbox.x1 - bbox.x0) * (bbox.bottom - bbox.top)))
    SELECT cell_id, fill FROM (SELECT cell_id, fill, row_number() OVER (PARTITION BY cell_id ORDER BY round(size, 6), rect_ord) AS k FROM p) WHERE k = 1""")
def fill_best(spark: SparkSession, sf: str) -> DataFrame:
    """The filled rectangle behind each cell; rectangles are made from the cells."""
    i = F.col("cell_id")
    b = lambda k: F.col(f"bbox.{k}")
    every = cells(spark, sf, *PAGE, "bbox")
    rects = every.where("bbox is not null").select(*PAGE, i.alias("rect_ord"), (b("x0") - 5).alias("r0"), (b("top") - i % 3).alias("r1"), (b("x1") + i % 90).alias("r2"), (b("bottom") + i % 30).alias("r3"), F.format_string("%06X", (i * 7919) % 16777216).alias("fill"))
    return C.best_fills(every, rects, PAGE)


@query("align_infer", f"""WITH {_C}, s AS (SELECT cell_id, (cell_id % 11) * 1.0 AS l, (cell_id % 7) * 1.5 AS r, (cell_id % 5) * 2.0 AS t, (cell_id % 9) * 1.0 AS b FROM c)
    SELECT cell_id, CASE WHEN abs(l - r) <= 3 THEN 'center' WHEN l < r THEN 'left' ELSE 'right' END AS h_align, CASE WHEN abs(t - b) <= 3 THEN 'center' WHEN t < b THEN 'top' ELSE 'bottom' END AS v_align FROM s""")
def align_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment from the slack around a text; slack is made from the id."""
    i = F.col("cell_id")
    return cells(spark, sf).select("cell_id", *C.alignment((i % 11) * 1.0, (i % 7) * 1.5, (i % 5) * 2.0, (i % 9) * 1.0))


@query("img_anchor", f"""WITH {_C}, k AS (SELECT doc_id, page_number, list_sort(list(DISTINCT bbox.x0)) AS cs, list_sort(list(DISTINCT bbox.top)) AS rs FROM c WHERE bbox IS NOT NULL GROUP BY ALL),
    i AS (SELECT cell_id AS image_id, doc_id, page_number, bbox.x0 + 7 AS x0, bbox.top + 3 AS top, bbox.x0 + 7 + cell_id % 40 AS x1, bbox.top + 3 + cell_id % 30 AS bottom FROM c WHERE bbox IS NOT NULL),
    p AS (SELECT *, len(list_filter(cs, lambda v: v <= x0)) - 1 AS a, len(list_filter(rs, lambda v: v <= top)) - 1 AS b FROM i JOIN k USING (doc_id, page_number) WHERE x1 - x0 >= 2 AND bottom - top >= 2 AND len(cs) > 1 AND len(rs) > 1),
    q AS (SELECT *, CASE WHEN a < 0 OR a > len(cs) - 2 THEN len(cs) - 2 ELSE a END AS c0, CASE WHEN b < 0 OR b > len(rs) - 2 THEN len(rs) - 2 ELSE b END AS r0 FROM p)
    SELECT image_id, CAST(r0 AS INTEGER) AS row, CAST(c0 AS INTEGER) AS col, greatest(1, CAST(round_even((x1 - x0) * 96 / 72, 0) AS INTEGER)) AS width_px, greatest(1, CAST(round_even((bottom - top) * 96 / 72, 0) AS INTEGER)) AS height_px, round(greatest(0.0, x0 - cs[c0 + 1]), 4) AS offset_x, round(greatest(0.0, top - rs[r0 + 1]), 4) AS offset_y FROM q""")
def img_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Images made at every cell, anchored to the grid of its page."""
    i = F.col("cell_id")
    full = cells(spark, sf, *PAGE, "bbox").where("bbox is not null")
    grid = full.groupBy(*PAGE).agg(F.sort_array(F.collect_set("bbox.x0")).alias("cs"), F.sort_array(F.collect_set("bbox.top")).alias("rs"))
    images = full.select(i.alias("image_id"), *PAGE, (F.col("bbox.x0") + 7).alias("x0"), (F.col("bbox.top") + 3).alias("top"), (F.col("bbox.x0") + 7 + i % 40).alias("x1"), (F.col("bbox.top") + 3 + i % 30).alias("bottom"))
    return C.anchor(images.join(grid, PAGE), F.col("cs"), F.col("rs"))


@query("img_background", f"WITH {_C} SELECT cell_id FROM c WHERE bbox IS NOT NULL AND (bbox.x1 - bbox.x0) * (cell_id % 700) / (250.0 * 500.0) >= 0.85")
def img_background(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes (height made from the id) that fill 85 % of a page of 250 x 500 points."""
    return cells(spark, sf, "bbox").where(f"bbox is not null and (bbox.x1 - bbox.x0) * (cell_id % 700) / (250.0D * 500.0D) >= {C.BACKGROUND}").select("cell_id")


@query("blank_cells", f"""WITH {_C}, s AS (SELECT doc_id, page_number, max(row_idx + row_span) AS n, max(col_idx + col_span) AS m FROM c GROUP BY ALL), g AS (SELECT doc_id, page_number, row, unnest(range(m)) AS col FROM (SELECT *, unnest(range(n)) AS row FROM s)),
    v AS (SELECT DISTINCT doc_id, page_number, row, unnest(range(col_idx, col_idx + col_span)) AS col FROM (SELECT *, unnest(range(row_idx, row_idx + row_span)) AS row FROM c))
    SELECT doc_id, page_number, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM g ANTI JOIN v USING (doc_id, page_number, row, col)""")
def blank_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of a sheet without a cell."""
    return C.blank_slots(cells(spark, sf, *SLOT), PAGE)


@query("cell_assemble", """WITH w AS (SELECT doc_id, page_number, ord // 8 AS row, ord % 3 AS col, top, ord, text, x0, x1, font_size, confidence FROM words)
    SELECT doc_id, page_number, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, string_agg(text, ' ' ORDER BY top, ord) AS text, min(x0) AS x0, max(x1) AS x1, CAST(max(1 + ord % 4) AS INTEGER) AS col_span, arg_min(font_size, top * 10000 + ord) AS font_size, arg_min(confidence, top * 10000 + ord) AS confidence FROM w WHERE text IS NOT NULL GROUP BY doc_id, page_number, row, col""")
def cell_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that share a slot as one cell (slots made from the order of words)."""
    runs = table(spark, sf, "words").where("text is not null").select(*PAGE, F.floor(F.col("ord") / 8).cast("int").alias("row"), (F.col("ord") % 3).alias("col"), F.col("top").alias("line"), F.col("ord").alias("run"), "text", "x0", "x1", (F.col("ord") % 4 + 1).alias("col_span"), "font_size", "confidence")
    return C.assemble(runs, PAGE)


@query("chunk_300", f"WITH {_C} SELECT doc_id, chunk, count(*) AS cells FROM (SELECT doc_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY ord, cell_id) - 1) // 10 AS BIGINT) AS chunk FROM c WHERE trim(coalesce(text, '')) <> '') GROUP BY doc_id, chunk")
def chunk_300(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a document in groups of ten for a reader."""
    return C.chunked(cells(spark, sf, "doc_id", "ord", "text").where("trim(coalesce(text, '')) <> ''"), ["doc_id"], 10).groupBy("doc_id", "chunk").agg(F.count("*").alias("cells"))


@query("cell_queries", f"WITH {_C} SELECT cell_id, row_idx, col_idx, text, round(bbox.x0, 1) AS x0, round(bbox.top, 1) AS top FROM c WHERE trim(coalesce(text, '')) <> '' AND bbox IS NOT NULL")
def cell_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Cells a reader is asked about."""
    return cells(spark, sf, "row_idx", "col_idx", "text", "bbox").where("trim(coalesce(text, '')) <> '' and bbox is not null").select("cell_id", "row_idx", "col_idx", "text", F.round("bbox.x0", 1).alias("x0"), F.round("bbox.top", 1).alias("top"))


_BAD = "CASE WHEN t = '' THEN text || '?' WHEN t BETWEEN '0' AND '9' THEN h || CAST((CAST(t AS INTEGER) + 1) % 10 AS VARCHAR) || r ELSE h || CASE WHEN t = 'x' THEN 'y' WHEN t = 'X' THEN 'Y' WHEN t BETWEEN 'A' AND 'Z' THEN 'X' ELSE 'x' END || r END"
_READ = f"""{_C}, k AS (SELECT cell_id, doc_id, text, regexp_extract(text, '([0-9A-Za-z])[^0-9A-Za-z]*$', 1) AS t, regexp_extract(text, '(?s)^(.*)[0-9A-Za-z][^0-9A-Za-z]*$', 1) AS h, regexp_extract(text, '(?s)[0-9A-Za-z]([^0-9A-Za-z]*)$', 1) AS r FROM c WHERE trim(coalesce(text, '')) <> ''),
    rd AS (SELECT cell_id, doc_id, CASE WHEN cell_id % 2 = 0 THEN text ELSE bad END AS original, CASE WHEN cell_id % 5 < 3 THEN text ELSE bad END AS page, CASE cell_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN text ELSE bad END AS crop_a, CASE cell_id % 7 WHEN 0 THEN bad WHEN 1 THEN NULL ELSE ' ' || text END AS crop_b FROM (SELECT cell_id, doc_id, text, {_BAD} AS bad FROM k))"""
_N = lambda x: S.squeeze(x)
_DECIDE = f"""CASE WHEN coalesce(crop_a, '') <> '' AND coalesce(crop_b, '') <> '' AND {_N('crop_a')} = {_N('crop_b')} THEN CASE WHEN {_N('crop_a')} = {_N('original')} THEN 'agreed' ELSE 'corrected' END
    WHEN (coalesce(crop_a, '') <> '' AND {_N('crop_a')} = {_N('original')}) OR (coalesce(crop_b, '') <> '' AND {_N('crop_b')} = {_N('original')}) THEN 'agreed'
    WHEN (coalesce(crop_a, '') <> '' AND {_N('crop_a')} = {_N('page')}) OR (coalesce(crop_b, '') <> '' AND {_N('crop_b')} = {_N('page')}) THEN 'corrected' ELSE 'open' END"""
_VALUE = f"""CASE WHEN resolution = 'corrected' THEN CASE WHEN coalesce(crop_a, '') <> '' AND coalesce(crop_b, '') <> '' AND {_N('crop_a')} = {_N('crop_b')} THEN crop_a ELSE page END END"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Four readings of every non-blank cell, made from its text and a corruption of it."""
    i, text = F.col("cell_id"), F.col("text")
    base = cells(spark, sf, "doc_id", "text").where("trim(coalesce(text, '')) <> ''").select("cell_id", "doc_id", "text", R.corrupt(text).alias("bad"))
    bad = F.col("bad")
    a = F.when(i % 4 == 1, "").when(i % 4 == 2, text).when(i % 4 == 3, bad)
    b = F.when(i % 7 == 0, bad).when(i % 7 > 1, F.concat(F.lit(" "), text))
    return base.select("cell_id", "doc_id", F.when(i % 2 == 0, text).otherwise(bad).alias("original"), F.when(i % 5 < 3, text).otherwise(bad).alias("page"), a.alias("crop_a"), b.alias("crop_b"))


def _decided(df: DataFrame) -> DataFrame:
    return df.withColumn("d", R.decide(F.col("original"), F.col("page"), F.col("crop_a"), F.col("crop_b"))).select("cell_id", "doc_id", "d.resolution", "d.value")


@query("decide", f"WITH {_READ} SELECT cell_id, doc_id, resolution, {_VALUE} AS value FROM (SELECT *, {_DECIDE} AS resolution FROM rd)")
def decide(spark: SparkSession, sf: str) -> DataFrame:
    """What four readings of a cell settle."""
    return _decided(readings(spark, sf))


@query("dispute_counts", f"WITH {_READ} SELECT doc_id, count(*) AS checked, count(*) FILTER (resolution <> 'agreed') AS flagged, count(*) FILTER (resolution = 'corrected') AS corrected, count(*) FILTER (resolution = 'open') AS open_disputes FROM (SELECT *, {_DECIDE} AS resolution FROM rd) GROUP BY doc_id")
def dispute_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Disputes of each document by outcome."""
    d = _decided(readings(spark, sf))
    is_ = lambda r: F.count_if(F.col("resolution") == r)
    return d.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if(F.col("resolution") != "agreed").alias("flagged"), is_("corrected").alias("corrected"), is_("open").alias("open_disputes"))


@query("review_status", f"WITH {_READ} SELECT doc_id, count(*) FILTER (resolution = 'open') AS open_disputes, CASE WHEN count(*) FILTER (resolution = 'open') > 0 THEN 'NEEDS_REVIEW' ELSE 'DONE' END AS status FROM (SELECT *, {_DECIDE} AS resolution FROM rd) GROUP BY doc_id")
def review_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a document still needs a look."""
    return R.status(_decided(readings(spark, sf)), "doc_id")


@query("reconcile", f"WITH {_READ} SELECT cell_id, coalesce(o, '') AS original, page, CASE WHEN o IS NULL THEN 'open' ELSE resolution END AS resolution, CASE WHEN o IS NOT NULL THEN {_VALUE} END AS value FROM (SELECT *, {_DECIDE} AS resolution, CASE WHEN cell_id % 11 <> 0 THEN original END AS o FROM rd)")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Readings joined with the cells they dispute; every eleventh cell is missing."""
    r = readings(spark, sf)
    known = r.where("cell_id % 11 <> 0").select("cell_id", F.col("original").alias("text"))
    return R.reconcile(r.drop("original", "doc_id"), known, ["cell_id"])


@query("readings_union", f"WITH {_READ} SELECT cell_id, 'disagreement' AS kind, page AS text FROM rd WHERE page <> original UNION ALL SELECT cell_id, 'missing', page FROM rd WHERE cell_id % 11 = 0")
def readings_union(spark: SparkSession, sf: str) -> DataFrame:
    """Disagreements and missing cells in one list."""
    r = readings(spark, sf)
    return r.where("page <> original").select("cell_id", F.lit("disagreement").alias("kind"), F.col("page").alias("text")).unionByName(r.where("cell_id % 11 = 0").select("cell_id", F.lit("missing").alias("kind"), F.col("page").alias("text")))


@query("review_upsert", f"""WITH {_C}, k AS (SELECT doc_id, page_number, row_idx, col_idx, arg_min(text, ord) AS text, arg_min(source, ord) AS source, arg_min(confidence, ord) AS confidence FROM c GROUP BY doc_id, page_number, row_idx, col_idx),
    r AS (SELECT DISTINCT doc_id, CASE WHEN cell_id % 33 = 0 THEN 99 ELSE page_number END AS page_number, row_idx, CASE WHEN cell_id % 22 = 0 THEN 77 ELSE col_idx END AS col_idx, 'fixed ' || (row_idx + 1) AS value FROM c WHERE cell_id % 11 = 0),
    g AS (SELECT r.* FROM r SEMI JOIN (SELECT DISTINCT doc_id, page_number FROM c) p USING (doc_id, page_number))
    SELECT doc_id, page_number, row_idx, col_idx, coalesce(g.value, k.text) AS text, CASE WHEN g.value IS NOT NULL THEN 'human' ELSE source END AS source, CASE WHEN g.value IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, CASE WHEN g.value IS NOT NULL THEN k.text END AS previous FROM k FULL JOIN g USING (doc_id, page_number, row_idx, col_idx)""")
def review_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Cells after corrections, some of absent cells and absent pages."""
    i, keys = F.col("cell_id"), [*PAGE, "row_idx", "col_idx"]
    every = cells(spark, sf, *PAGE, "row_idx", "col_idx", "ord", "text", "source", "confidence")
    placed = every.groupBy(*keys).agg(F.min_by(F.struct("text", "source", "confidence"), "ord").alias("c")).select(*keys, "c.*")
    fixes = every.where("cell_id % 11 = 0").select("doc_id", F.when(i % 33 == 0, 99).otherwise(F.col("page_number")).alias("page_number"), "row_idx", F.when(i % 22 == 0, 77).otherwise(F.col("col_idx")).alias("col_idx"), F.concat(F.lit("fixed "), F.col("row_idx") + 1).alias("value")).distinct()
    return R.apply_corrections(placed, fixes, every.select(*PAGE).distinct(), keys, PAGE)


@query("corruption_plan", f"""WITH {_C}, o AS (SELECT trim(text) AS text, count(*) AS n, min(cell_id) AS ord FROM c WHERE trim(text) <> '' GROUP BY 1),
    k AS (SELECT text, ord, regexp_extract(text, '([0-9A-Za-z])[^0-9A-Za-z]*$', 1) AS t, regexp_extract(text, '(?s)^(.*)[0-9A-Za-z][^0-9A-Za-z]*$', 1) AS h, regexp_extract(text, '(?s)[0-9A-Za-z]([^0-9A-Za-z]*)$', 1) AS r FROM o WHERE n = 1)
    SELECT text AS original, bad AS corrupted FROM (SELECT text, ord, {_BAD} AS bad FROM k) WHERE bad NOT IN (SELECT text FROM o) ORDER BY ord, text LIMIT 20""")
def corruption_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty texts to corrupt for the gate of injected errors (a stated number of cases)."""
    return R.corruption_plan(cells(spark, sf, "text").select("text", F.col("cell_id").alias("ord")), 20)


@query("accuracy_rollup", f"""WITH {_READ}, a AS (SELECT cell_id, cell_id % 4 AS g, original AS want FROM rd WHERE cell_id % 13 <> 0), b AS (SELECT cell_id, cell_id % 4 AS g, page AS got FROM rd WHERE cell_id % 17 <> 0),
    j AS (SELECT coalesce(a.g, b.g) AS g, want, got FROM a FULL JOIN b USING (cell_id))
    SELECT CASE WHEN grouping(g) = 1 THEN 'TOTAL' ELSE CAST(g AS VARCHAR) END AS fixture, count(want) AS expected, count(*) FILTER (want = got) AS matched, count(*) FILTER (want IS NULL) AS extra, round(CASE WHEN count(want) + count(*) FILTER (want IS NULL) > 0 THEN count(*) FILTER (want = got) / (count(want) + count(*) FILTER (want IS NULL)) ELSE 1.0 END, 6) AS accuracy FROM j GROUP BY ROLLUP (g)""")
def accuracy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Score of one reading against another by group, with a total; spurious cells count against it."""
    r = readings(spark, sf).withColumn("fixture", F.col("cell_id") % 4)
    want = r.where("cell_id % 13 <> 0").select("cell_id", "fixture", F.col("original").alias("text"))
    got = r.where("cell_id % 17 <> 0").select("cell_id", "fixture", F.col("page").alias("text"))
    return R.accuracy(want, got, ["cell_id"], "fixture")


@query("json_reading", f"""WITH {_C} SELECT cell_id, row_idx AS row, col_idx AS col, 'v' || ord AS text, least(1.0, greatest(0.0, confidence * 2 - 0.5)) AS confidence FROM c WHERE cell_id % 4 <> 0""")
def json_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Readings parsed out of model replies (made from the cells); every fourth reply has no usable row."""
    i = F.col("cell_id")
    row = F.when(i % 4 == 0, F.lit('"none"')).otherwise(F.col("row_idx").cast("string"))
    reply = F.concat(F.lit('Here: {"cells": [{"row": '), row, F.lit(', "col": '), "col_idx", F.lit(', "text": "v'), "ord", F.lit('", "confidence": '), (F.col("confidence") * 2 - 0.5).cast("string"), F.lit("}]} done"))
    return R.readings_of(cells(spark, sf, "row_idx", "col_idx", "ord", "confidence").select("cell_id", reply.alias("reply"))).select("cell_id", "row", "col", "text", "confidence")


@query("idx_coerce", f"WITH {_C} SELECT cell_id, CASE WHEN cell_id % 5 <> 0 AND cell_id % 40 - 5 BETWEEN 0 AND 9 THEN CAST(cell_id % 40 - 5 AS INTEGER) END AS idx FROM c")
def idx_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """Indices from texts; words and numbers out of range are null."""
    value = F.when(F.col("cell_id") % 5 == 0, "true").otherwise((F.col("cell_id") % 40 - 5).cast("string")).try_cast("int")
    return cells(spark, sf).select("cell_id", F.when(value.between(0, 9), value).alias("idx"))


@query("jobs_top100", "SELECT doc_id, received_at FROM quote_headers ORDER BY received_at DESC, doc_id LIMIT 100")
def jobs_top100(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred newest quotes (a top-k view)."""
    return R.newest(table(spark, sf, "quote_headers").select("doc_id", "received_at"), "received_at", "doc_id")


@query("job_detail", f"WITH {_C} SELECT doc_id, count(DISTINCT page_number) AS pages, count(*) FILTER (trim(coalesce(text, '')) <> '') AS cells, string_agg(DISTINCT cell_role, ',' ORDER BY cell_role) AS roles FROM c GROUP BY doc_id")
def job_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, filled cells and roles of each document."""
    full = F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "")
    return cells(spark, sf, *PAGE, "text", "cell_role").groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"), full.alias("cells"), F.array_join(F.sort_array(F.collect_set("cell_role")), ",").alias("roles"))


@query("notes_explode", "SELECT doc_id, note FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS note FROM documents WHERE text IS NOT NULL) WHERE note <> ''")
def notes_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Newline-joined texts as one row a line, empty lines dropped."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("note"))


@query("batch_status", """WITH b AS (SELECT source, count(*) AS files, count(text) AS read, string_agg(CASE WHEN text IS NULL THEN doc_id || ': no text' END, chr(10) ORDER BY doc_id) AS failures FROM documents GROUP BY source) SELECT source, files, read, coalesce(failures, '') AS failures, 'DONE' AS status FROM b""")
def batch_status(spark: SparkSession, sf: str) -> DataFrame:
    """Files read and failures by source; a batch is done even if files failed."""
    failed = F.when(F.col("text").isNull(), F.struct("doc_id", F.concat(F.col("doc_id"), F.lit(": no text")).alias("m")))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(failed)), lambda x: x["m"]), "\n")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count("text").alias("read"), notes.alias("failures"), F.lit("DONE").alias("status"))
