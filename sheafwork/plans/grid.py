"""Queries that lead from pages to sheets. Pages are made from the cells of grid_cells: a word in each cell, and on every second page borders around the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.functions.values import strip
from sheafwork.operators import geometry, grid as G
from sheafwork.plans import sqltext as S
from sheafwork.plans.cells import PAGE, _C, cells
from sheafwork.plans.layout import _BINS, pruned
from sheafwork.plans.registry import Plans
from sheafwork.session import written

plans = Plans()
QUERIES, ORACLE, query = plans.queries, plans.oracle, plans.query
WIDTH, HEIGHT = 700.0, 842.0


def made(spark: SparkSession, sf: str) -> G.Pages:
    """Pages of 700 x 842 points. A word ends before its cell does, so that there are gaps; headings are shaded on every third page, an image stands above the text of every fifth."""
    i, b = F.col("cell_id"), lambda k: F.col(f"bbox.{k}")
    full = cells(spark, sf, *PAGE, "ord", "text", "cell_role", "style", "bbox", "source", "confidence").where("bbox is not null")
    full = written(full, "page_cells")
    words = full.where(strip(F.col("text")) != "").select(
        i.alias("word_id"), *PAGE, "ord", "text", b("x0").alias("x0"), b("top").alias("top"), F.greatest(b("x0") + 5, b("x1") - 8 - i % 5 * 6).alias("x1"), b("bottom").alias("bottom"),
        F.lit("Helvetica").alias("font_name"), F.col("style.font_size").alias("font_size"), F.col("style.bold").alias("bold"), F.lit(False).alias("italic"), F.lit("000000").alias("color"), "source", "confidence",
    )
    table_ = full.where("cell_role in ('heading', 'body', 'total')")
    edge = lambda o, at, low, high: F.struct(F.lit(o).alias("orientation"), at.alias("position"), low.alias("low"), high.alias("high"))
    x0, x1, y0, y1 = b("x0") - 2, b("x1") + 2, b("top") - 4, b("top") + 16
    lines = table_.where("doc_id % 2 = 0").select(*PAGE, "ord", F.inline(F.array(edge("h", y0, x0, x1), edge("h", y1, x0, x1), edge("v", x0, y0, y1), edge("v", x1, y0, y1))))
    rulings = written(geometry.merge_rulings(lines.withColumns({"stroke": F.lit(0.75), "color": F.lit("262626")}), PAGE), "rulings")
    rects = table_.where("cell_role = 'heading' and doc_id % 3 = 0").select(*PAGE, "ord", x0.alias("x0"), y0.alias("top"), x1.alias("x1"), y1.alias("bottom"), F.lit("D9E1F2").alias("fill"))
    pages = full.select(*PAGE).distinct()
    images = pages.where("doc_id % 5 = 0").select(*PAGE, F.lit(0).alias("ord"), F.lit(60.0).alias("x0"), F.lit(5.0).alias("top"), F.lit(156.0).alias("x1"), F.lit(45.0).alias("bottom"))
    return G.Pages(pages.select(*PAGE, F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")), words, rulings, rects, images)


def _islands(source: str, tol: float, having: str = "") -> str:
    """Positions of a relation (doc_id, page_number, position), near ones as their mean."""
    new = f"SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY doc_id, page_number ORDER BY position) <= {tol} THEN 0 ELSE 1 END AS n FROM ({source})"
    return f"SELECT doc_id, page_number, round(avg(position), 9) AS position FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM ({new})) GROUP BY doc_id, page_number, island {having}"


_X = "(SELECT cell_id, doc_id, page_number, ord, cell_role, bbox.x0 - 2 AS a0, bbox.x1 + 2 AS a1, bbox.top - 4 AS b0, bbox.top + 16 AS b1 FROM c WHERE bbox IS NOT NULL AND cell_role IN ('heading', 'body', 'total'))"
_EDGES = " UNION ALL ".join(f"SELECT doc_id, page_number, ord, '{o}' AS orientation, {at} AS position, {low} AS low, {high} AS high FROM {_X} WHERE doc_id % 2 = 0" for o, at, low, high in (("h", "b0", "a0", "a1"), ("h", "b1", "a0", "a1"), ("v", "a0", "b0", "b1"), ("v", "a1", "b0", "b1")))
_INSIDE = "position > lft + 3 AND position < rgt - 3"
_MADE = f"""{_C}, l AS (SELECT cell_id AS word_id, doc_id, page_number, ord, dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY bbox.top) - 1 AS line, text, bbox.x0 AS x0, bbox.top AS top, greatest(bbox.x0 + 5, bbox.x1 - 8 - cell_id % 5 * 6) AS x1, bbox.bottom AS bottom, style.font_size AS font_size, confidence FROM c WHERE bbox IS NOT NULL AND {S.strip('text')} <> ''),
    ln AS (SELECT doc_id, page_number, line, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM l GROUP BY ALL),
    im AS (SELECT DISTINCT doc_id, page_number, 60.0 AS x0, 5.0 AS top, 156.0 AS x1, 45.0 AS bottom FROM c WHERE bbox IS NOT NULL AND doc_id % 5 = 0),
    fl AS (SELECT doc_id, page_number, a0 AS x0, b0 AS top, a1 AS x1, b1 AS bottom FROM {_X} WHERE cell_role = 'heading' AND doc_id % 3 = 0),
    r0 AS (SELECT *, CAST(round_even(position, 0) AS BIGINT) AS bucket FROM ({_EDGES})),
    r1 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number, orientation, bucket ORDER BY low, ord ROWS UNBOUNDED PRECEDING) AS island, avg(position) OVER (PARTITION BY doc_id, page_number, orientation, bucket) AS mean
      FROM (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY doc_id, page_number, orientation, bucket ORDER BY low, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0 THEN 0 ELSE 1 END AS n FROM r0)),
    rl AS (SELECT doc_id, page_number, orientation, round(max(mean), 4) AS position, min(low) AS low, max(high) AS high FROM r1 GROUP BY doc_id, page_number, orientation, bucket, island),
    strong AS (SELECT * FROM rl WHERE high - low >= CASE orientation WHEN 'v' THEN {HEIGHT} ELSE {WIDTH} END * 0.04),
    ct AS (SELECT doc_id, page_number, greatest(min(x0), 0.0) AS lft, least(max(x1), {WIDTH}) AS rgt, greatest(min(top), 0.0) AS upr, least(max(bottom), {HEIGHT}) AS lwr FROM (
      SELECT doc_id, page_number, x0, top, x1, bottom, 1 AS full_ FROM ln UNION ALL SELECT doc_id, page_number, x0, top, x1, bottom, 1 FROM im
      UNION ALL SELECT doc_id, page_number, CASE orientation WHEN 'v' THEN position ELSE low END, CASE orientation WHEN 'v' THEN low ELSE position END, CASE orientation WHEN 'v' THEN position ELSE high END, CASE orientation WHEN 'v' THEN high ELSE position END, 0 FROM rl WHERE high - low >= {WIDTH} * 0.04) GROUP BY ALL HAVING max(full_) = 1),
    gv AS (SELECT s.* FROM strong s JOIN (SELECT DISTINCT doc_id, page_number FROM strong JOIN ct USING (doc_id, page_number) WHERE orientation = 'v' AND {_INSIDE}) USING (doc_id, page_number) WHERE orientation = 'v')"""
_CORRIDORS = _BINS.replace("ct AS (SELECT doc_id, page_number, min(x0) AS lft, max(x1) AS rgt FROM l GROUP BY ALL),\n    ", "").replace("r0 AS", "q0 AS").replace("FROM r0", "FROM q0").replace("r1 AS", "q1 AS").replace("FROM r1", "FROM q1")
_GAPS = "g AS (SELECT *, round(x0 - lag(x1) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, ord), 6) AS gap, lag(x1) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, ord) AS before FROM l)"
_COLUMNS = f"""{_GAPS}, {_CORRIDORS}, ok AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page_number ORDER BY bin) AS grp FROM bins WHERE straddling >= 3 AND free >= straddling * 0.85),
    cr AS (SELECT doc_id, page_number, (s + e) / 2 AS position FROM (SELECT doc_id, page_number, lft + min(bin) * 0.5 AS s, lft + (max(bin) + 1) * 0.5 AS e, lft, rgt FROM ok JOIN ct USING (doc_id, page_number) GROUP BY doc_id, page_number, grp, lft, rgt)
      WHERE e - s >= 5.0 AND s > lft + 0.5 AND e < rgt - 0.5 AND (s + e) / 2 > lft + 3 AND (s + e) / 2 < rgt - 3),
    o1 AS (SELECT *, x0 - before AS wide, list_sort(list(x0 - before) OVER (PARTITION BY doc_id, page_number, line)) AS s FROM g WHERE before IS NOT NULL),
    o2 AS (SELECT *, wide > CASE WHEN len(s) = 1 THEN 18.0 ELSE greatest(18.0, 3.0 * s[(len(s) - 1) // 4 + 1]) END AS outlier FROM o1),
    oc AS ({_islands("SELECT doc_id, page_number, (before + x0) / 2 AS position FROM o2 WHERE outlier", 10.0, "HAVING count(*) >= 3")}),
    vr AS (SELECT v.* FROM ({_islands("SELECT doc_id, page_number, position FROM strong WHERE orientation = 'v'", 2.0)}) v JOIN ct USING (doc_id, page_number) WHERE {_INSIDE}),
    op AS ({_islands(f"SELECT doc_id, page_number, position FROM cr UNION ALL SELECT doc_id, page_number, position FROM oc JOIN ct USING (doc_id, page_number) WHERE {_INSIDE}", 5.0)}),
    ev AS (SELECT doc_id, page_number, lft AS position FROM ct UNION ALL SELECT doc_id, page_number, rgt FROM ct UNION ALL SELECT * FROM vr UNION ALL SELECT * FROM op ANTI JOIN vr USING (doc_id, page_number)),
    cb0 AS (SELECT doc_id, page_number, list(position ORDER BY position) AS b FROM ({_islands("SELECT * FROM ev", 2.0)}) GROUP BY ALL), cb AS (SELECT doc_id, page_number, {pruned('b')} AS cols FROM cb0)"""
_ROWS = f"""re AS (SELECT e.* FROM ({_islands("SELECT doc_id, page_number, position FROM strong WHERE orientation = 'h' UNION ALL SELECT doc_id, page_number, unnest([top, bottom]) FROM fl", 2.0)}) e JOIN ct USING (doc_id, page_number) WHERE position >= upr - 2 AND position <= lwr + 2),
    ga AS (SELECT doc_id, page_number, position AS top, lead(position) OVER (PARTITION BY doc_id, page_number ORDER BY position) AS bottom FROM re),
    rb AS (SELECT * FROM ga WHERE bottom - top >= 3 AND (EXISTS (SELECT 1 FROM gv WHERE gv.doc_id = ga.doc_id AND gv.page_number = ga.page_number AND gv.low <= ga.top + 2 AND gv.high >= ga.bottom - 2)
      OR (SELECT count(*) FROM ln WHERE ln.doc_id = ga.doc_id AND ln.page_number = ga.page_number AND (ln.top + ln.bottom) / 2 >= ga.top AND (ln.top + ln.bottom) / 2 < ga.bottom) = 1)),
    lb AS (SELECT doc_id, page_number, top, bottom FROM ln WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.doc_id = ln.doc_id AND rb.page_number = ln.page_number AND rb.top <= (ln.top + ln.bottom) / 2 AND (ln.top + ln.bottom) / 2 < rb.bottom)
      UNION ALL SELECT doc_id, page_number, top, bottom FROM im WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.doc_id = im.doc_id AND ln.page_number = im.page_number AND ln.top < im.bottom AND ln.bottom > im.top)
        AND NOT EXISTS (SELECT 1 FROM rb WHERE rb.doc_id = im.doc_id AND rb.page_number = im.page_number AND rb.top <= 25 AND 25 < rb.bottom)),
    ab AS (SELECT doc_id, page_number, top, bottom, true AS ruled FROM rb UNION ALL SELECT *, false FROM lb),
    mb0 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN top < max(bottom) OVER (PARTITION BY doc_id, page_number ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2 THEN 0 ELSE 1 END AS n FROM ab)),
    mb AS (SELECT doc_id, page_number, island, min(top) AS top, max(bottom) AS bottom, arg_min(ruled, (top, bottom)) AS tr, arg_max(ruled, (bottom, top)) AS br FROM mb0 GROUP BY ALL),
    bt AS (SELECT *, lead(top) OVER w AS ntop, lead(tr) OVER w AS ntr FROM mb WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY island)),
    rw0 AS (SELECT doc_id, page_number, list_concat(list_concat([least(any_value(upr), min(top))], list(CASE WHEN ntr THEN ntop WHEN br THEN bottom ELSE (bottom + ntop) / 2 END ORDER BY island) FILTER (ntop IS NOT NULL)), [greatest(any_value(lwr), arg_max(bottom, island))]) AS b FROM bt JOIN ct USING (doc_id, page_number) GROUP BY doc_id, page_number),
    rw AS (SELECT doc_id, page_number, {pruned('b')} AS rows_ FROM rw0)"""


def _bounds(name: str, relation: str) -> str:
    return f"SELECT doc_id, page_number, CAST(generate_subscripts({name}, 1) - 1 AS INTEGER) AS pos, round(unnest({name}), 6) AS bound FROM {relation}"


@query("col_bounds", f"WITH {_MADE}, {_COLUMNS} {_bounds('cols', 'cb')}")
def col_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Column boundaries of every page, from its rulings, else from corridors and outlier gaps."""
    return G.bounds_of(made(spark, sf))[0].select(*PAGE, F.posexplode("cols").alias("pos", "bound")).withColumn("bound", F.round("bound", 6))


@query("row_bounds", f"WITH {_MADE}, {_ROWS} {_bounds('rows_', 'rw')}")
def row_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Row boundaries of every page, from ruled bands, lines and images."""
    return G.bounds_of(made(spark, sf))[0].select(*PAGE, F.posexplode("rows").alias("pos", "bound")).withColumn("bound", F.round("bound", 6))


def _bands(spark: SparkSession, sf: str) -> tuple[G.Pages, DataFrame, DataFrame, DataFrame, DataFrame]:
    p = made(spark, sf)
    _, lines = G.text_lines(p.words)
    content, strong = G.contents(p, lines), G.significant(p.rulings, p.pages)
    edges = G.ruled_edges(strong, p.rects, content)
    return p, lines, content, edges, G.real_bands(edges, G.grid_verticals(strong, content), lines)


@query("rule_edges", f"WITH {_MADE}, {_ROWS} SELECT doc_id, page_number, round(position, 6) AS position FROM re")
def rule_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Row edges drawn on a page: horizontal rulings and edges of fills, near ones as one."""
    return _bands(spark, sf)[3].select(*PAGE, F.round("position", 6).alias("position"))


@query("band_real", f"WITH {_MADE}, {_ROWS} SELECT doc_id, page_number, round(top, 6) AS top, round(bottom, 6) AS bottom FROM rb")
def band_real(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between drawn edges that are rows of a table."""
    return _bands(spark, sf)[4].select(*PAGE, F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query("band_backfill", f"WITH {_MADE}, {_ROWS} SELECT doc_id, page_number, round(top, 6) AS top, round(bottom, 6) AS bottom, tr AS top_ruled, br AS bottom_ruled FROM mb")
def band_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Row bands of a page: ruled ones, and lines and images outside them, with what drew their edges."""
    p, lines, content, _, real = _bands(spark, sf)
    bands = G.page_bands(p, real, lines, content).select(*PAGE, F.inline("bands"))
    return bands.select(*PAGE, F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), "top_ruled", "bottom_ruled")


_PLACED = f"""lr AS (SELECT ln.*, rows_, [i FOR i IN range(0, len(rows_) - 1) IF least(bottom, rows_[i + 2]) - greatest(top, rows_[i + 1]) >= greatest(0.75, 0.3 * least(bottom - top, rows_[i + 2] - rows_[i + 1]))] AS h FROM ln JOIN rw USING (doc_id, page_number)),
    lr2 AS (SELECT *, (rows_[h[1] + 1] + rows_[least(h[1] + len(h), len(rows_) - 1) + 1]) / 2 AS mid FROM lr),
    lx AS (SELECT doc_id, page_number, line, h[1] AS row, len(h) AS n_rows, mid, coalesce((SELECT list_sort(list(DISTINCT gv.position)) FROM gv WHERE gv.doc_id = lr2.doc_id AND gv.page_number = lr2.page_number AND gv.low <= mid + 2 AND gv.high >= mid - 2), []) AS across FROM lr2),
    wc AS (SELECT g.*, row, n_rows, across, coalesce(CASE WHEN len(across) >= 2 THEN len(list_filter(across, lambda s: before < s AND s < x0)) > 0 ELSE EXISTS (SELECT 1 FROM cr WHERE cr.doc_id = g.doc_id AND cr.page_number = g.page_number AND before < cr.position AND cr.position < x0) OR coalesce((SELECT outlier FROM o2 WHERE o2.word_id = g.word_id), false) END, false) AS cut FROM g JOIN lx USING (doc_id, page_number, line)),
    wr AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS run FROM wc),
    rn AS (SELECT doc_id, page_number, line, run, {S.strip("string_agg(text, ' ' ORDER BY x0, ord)")} AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, any_value(row) AS row, any_value(n_rows) AS n_rows, any_value(across) AS across FROM wr GROUP BY doc_id, page_number, line, run),
    rc AS (SELECT rn.*, cols, list_max(list_filter(across, lambda r: r <= x0 + 2)) AS bl, list_min(list_filter(across, lambda r: r >= x1 - 2)) AS br, [i FOR i IN range(0, len(cols) - 1) IF least(x1, cols[i + 2]) - greatest(x0, cols[i + 1]) >= greatest(0.75, 0.3 * least(x1 - x0, cols[i + 2] - cols[i + 1]))] AS hit FROM rn JOIN cb USING (doc_id, page_number)),
    ri AS (SELECT *, list_last([i FOR i IN range(0, len(cols)) IF abs(cols[i + 1] - bl) = list_min(list_transform(cols, lambda v: abs(v - bl))) AND abs(cols[i + 1] - bl) <= 3]) AS i0, list_last([i FOR i IN range(0, len(cols)) IF abs(cols[i + 1] - br) = list_min(list_transform(cols, lambda v: abs(v - br))) AND abs(cols[i + 1] - br) <= 3]) AS i1 FROM rc)"""


@query("span_cols", f"""WITH {_MADE}, {_COLUMNS}, {_ROWS}, {_PLACED}
    SELECT doc_id, page_number, line, CAST(run AS BIGINT) AS run, text, CAST(CASE WHEN len(across) >= 2 AND i1 > i0 THEN i0 ELSE hit[1] END AS INTEGER) AS col, CAST(CASE WHEN len(across) >= 2 AND i1 > i0 THEN least(i1 - 1, len(cols) - 2) - i0 + 1 ELSE hit[-1] - hit[1] + 1 END AS INTEGER) AS col_span FROM ri WHERE text <> ''""")
def span_cols(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of words that fall into one cell, with their columns."""
    p = made(spark, sf)
    bounds, gaps, lines, corridors = G.bounds_of(p)
    placed = G.spanned(G.line_runs(gaps, lines, bounds, corridors), bounds)
    return placed.select(*PAGE, F.col("line").cast("bigint").alias("line"), F.col("run").cast("bigint").alias("run"), "text", F.col("col_idx").cast("int").alias("col"), F.col("col_span").cast("int").alias("col_span"))


@query("sheet_grid")
def sheet_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of every page: the whole way from words and rulings to a sheet."""
    return G.sheet_cells(made(spark, sf))[0].select(*PAGE, "row_idx", "col_idx", "row_span", "col_span", "text", "font_name", "font_size", "bold")


@query("sheet_styles")
def sheet_styles(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of every page with borders, fill and alignment, decorated blanks included."""
    p = made(spark, sf)
    return G.styled(*G.sheet_cells(p), p).select(*PAGE, "row_idx", "col_idx", "text", "borders", "fill", "h_align", "v_align", "made")
