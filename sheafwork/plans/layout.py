"""Queries of page geometry. Lines are words of one top edge here, so that SQL can state them; words_lines is the fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sheafwork.operators import geometry as G, layout as Y
from sheafwork.plans.registry import Plans
from sheafwork.sources.tables import latest, table

plans = Plans()
QUERIES, ORACLE, query = plans.queries, plans.oracle, plans.query


def words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words with the rank of their top edge as line; every third word is moved right so that gaps differ."""
    shift = F.when(F.col("word_id") % 3 == 0, (F.col("word_id") % 7) * 6.0).otherwise(0.0)
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "page_number").orderBy("top")) - 1
    return words(spark, sf).withColumns({"line": rank, "x0": F.round(F.col("x0") + shift, 3), "x1": F.round(F.col("x1") + F.when(F.col("word_id") % 5 == 0, 0.0).otherwise(shift), 3)}).where("x1 > x0")


_L = """l0 AS (SELECT w.*, dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY top) - 1 AS line,
    round(x0 + CASE WHEN word_id % 3 = 0 THEN (word_id % 7) * 6.0 ELSE 0 END, 3) AS a, round(x1 + CASE WHEN word_id % 5 = 0 THEN 0 WHEN word_id % 3 = 0 THEN (word_id % 7) * 6.0 ELSE 0 END, 3) AS b FROM words w),
    l AS (SELECT word_id, doc_id, page_number, ord, line, text, a AS x0, top, b AS x1, bottom, font_name, font_size, bold, italic, color, confidence FROM l0 WHERE b > a),
    g AS (SELECT *, round(x0 - lag(x1) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, ord), 6) AS gap FROM l)"""
_COARSE = "k AS (SELECT doc_id, page_number, line, round(greatest(4.0, coalesce(median(font_size) FILTER (font_size > 0), 10.0) * 0.28 * 1.6), 6) AS coarse FROM l GROUP BY ALL)"
_OUT = """o0 AS (SELECT *, list_sort(list(gap) OVER (PARTITION BY doc_id, page_number, line)) AS s FROM g WHERE gap > 0),
    o AS (SELECT doc_id, page_number, line, gap, round(x0 - gap / 2, 6) AS position FROM o0 WHERE gap > CASE WHEN len(s) = 1 THEN 18.0 ELSE greatest(18.0, 3.0 * s[(len(s) - 1) // 4 + 1]) END)"""


@query("words_lines")
def words_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Visual line of every word, by the growing band of the line."""
    return Y.group_lines(words(spark, sf)).select("word_id", "line")


@query("gap_runs", f"WITH {_L}, {_COARSE} SELECT word_id, CAST(sum(CASE WHEN gap > coarse THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g JOIN k USING (doc_id, page_number, line)")
def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run of every word on its line, split at coarse gaps."""
    rows = lines(spark, sf)
    return Y.split_runs(rows.join(Y.coarse_gaps(rows), [*Y.PAGE, "line"]), F.col("coarse")).select("word_id", "run")


@query("coarse_gap", f"WITH {_L}, {_COARSE} SELECT * FROM k")
def coarse_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse column gap of every line."""
    return Y.coarse_gaps(lines(spark, sf))


@query("gap_outliers", f"WITH {_L}, {_OUT} SELECT * FROM o")
def gap_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps that stand out on their line."""
    return Y.outlier_gaps(lines(spark, sf))


_BINS = f"""{_COARSE}, r0 AS (SELECT g.*, sum(CASE WHEN gap > coarse THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number, line ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS run FROM g JOIN k USING (doc_id, page_number, line)),
    ct AS (SELECT doc_id, page_number, min(x0) AS lft, max(x1) AS rgt FROM l GROUP BY ALL),
    r1 AS (SELECT doc_id, page_number, line, run, CAST(floor((min(x0) - any_value(lft)) / 0.5) AS BIGINT) AS s, CAST(floor((max(x1) - any_value(lft)) / 0.5) AS BIGINT) AS e FROM r0 JOIN ct USING (doc_id, page_number) GROUP BY doc_id, page_number, line, run),
    r AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, min(s) OVER w AS lo, max(e) OVER w AS hi FROM r1 WINDOW w AS (PARTITION BY doc_id, page_number, line)) WHERE n >= 2),
    sp AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number) AS voters FROM (SELECT DISTINCT doc_id, page_number, line, lo, hi FROM r)),
    tk AS (SELECT DISTINCT doc_id, page_number, line, unnest(range(s, e + 1)) AS bin FROM r),
    ins AS (SELECT doc_id, page_number, line, unnest(range(lo + 1, hi)) AS bin FROM sp WHERE voters >= 2),
    bins AS (SELECT i.doc_id, i.page_number, i.bin, count(*) AS straddling, count(*) FILTER (t.bin IS NULL) AS free FROM ins i LEFT JOIN tk t USING (doc_id, page_number, line, bin) GROUP BY ALL)"""


@query("corridor_hist", f"WITH {_L}, {_BINS} SELECT * FROM bins")
def corridor_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Half-point bins that lines with several runs straddle, and how many of them leave it free."""
    return Y.corridor_spans(lines(spark, sf)).select(*Y.PAGE, F.explode(F.sequence("first", "last")).alias("bin"), "straddling", "free")


def tall(spark: SparkSession, sf: str, pages: int) -> DataFrame:
    """The lines of several pages, one below another, as one page, so that enough lines bear witness to a column."""
    return lines(spark, sf).withColumns({"line": F.col("line") * pages + F.col("doc_id") % pages, "doc_id": F.floor(F.col("doc_id") / pages)})


def _tall(pages: int) -> str:
    return _L.replace("FROM l0 WHERE b > a", f"FROM (SELECT * REPLACE (line * {pages} + doc_id % {pages} AS line, doc_id // {pages} AS doc_id) FROM l0) WHERE b > a")


@query("corridor_seps", f"""WITH {_tall(3)}, {_BINS}, ok AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page_number ORDER BY bin) AS grp FROM bins WHERE straddling >= 3 AND free >= straddling * 0.85),
    c AS (SELECT doc_id, page_number, lft + min(bin) * 0.5 AS s, lft + (max(bin) + 1) * 0.5 AS e, lft, rgt FROM ok JOIN ct USING (doc_id, page_number) GROUP BY doc_id, page_number, grp, lft, rgt)
    SELECT doc_id, page_number, (s + e) / 2 AS separator FROM c WHERE e - s >= 5.0 AND s > lft + 0.5 AND e < rgt - 0.5""")
def corridor_seps(spark: SparkSession, sf: str) -> DataFrame:
    """Separators in the middle of free corridors of pages made of three."""
    return Y.corridors(tall(spark, sf, 3))


@query("outlier_bounds", f"""WITH {_tall(12)}, {_OUT}, i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY position, line, gap ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY doc_id, page_number ORDER BY position, line, gap) <= 10 THEN 0 ELSE 1 END AS n FROM o))
    SELECT doc_id, page_number, round(avg(position), 9) AS position, count(*) AS members FROM i GROUP BY doc_id, page_number, island HAVING count(*) >= 3""")
def outlier_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Column boundaries where outlier gaps of three or more lines of a page made of twelve meet."""
    return Y.outlier_columns(tall(spark, sf, 12))


@query("cluster_1d", """
    WITH i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY x0, word_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page_number ORDER BY x0, word_id) <= 2 THEN 0 ELSE 1 END AS n FROM words))
    SELECT doc_id, page_number, round(avg(x0), 9) AS position, count(*) AS members FROM i GROUP BY doc_id, page_number, island""")
def cluster_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Left edges of a page, near ones as one position."""
    return G.cluster_positions(words(spark, sf), Y.PAGE, "x0")


@query("content_bbox", "SELECT doc_id, page_number, greatest(min(x0), 60.0) AS x0, greatest(min(top), 0.0) AS top, least(max(x1), 540.0) AS x1, least(max(bottom), 842.0) AS bottom FROM words GROUP BY doc_id, page_number")
def content_bbox(spark: SparkSession, sf: str) -> DataFrame:
    """Box of all words of a page, clipped to the page."""
    boxes = words(spark, sf).groupBy(*Y.PAGE).agg(*G.union_box())
    return boxes.select(*Y.PAGE, F.greatest("x0", F.lit(60.0)).alias("x0"), F.greatest("top", F.lit(0.0)).alias("top"), F.least("x1", F.lit(540.0)).alias("x1"), F.least("bottom", F.lit(842.0)).alias("bottom"))


@query("bbox_ops", """
    WITH p AS (SELECT a.word_id, a.x0, a.top, a.x1, a.bottom, b.x0 - 20 AS u0, b.top AS v0, b.x1 + 5 AS u1, b.bottom AS v1 FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND b.ord = a.ord + 1)
    SELECT word_id, round(x1 - x0, 4) AS width, round(bottom - top, 4) AS height, round((x0 + x1) / 2, 4) AS cx, round((x1 - x0) * (bottom - top), 4) AS area,
      round(CASE WHEN (x1 - x0) * (bottom - top) > 0 THEN greatest(0.0, least(x1, u1) - greatest(x0, u0)) * greatest(0.0, least(bottom, v1) - greatest(top, v0)) / ((x1 - x0) * (bottom - top)) ELSE 0 END, 4) AS overlap,
      (x0 + x1) / 2 BETWEEN u0 AND u1 AND (top + bottom) / 2 BETWEEN v0 AND v1 AS holds_centre, least(x0, u0) AS merged_x0, greatest(x1, u1) AS merged_x1 FROM p""")
def bbox_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Box algebra of every word and a box around its successor."""
    a = words(spark, sf).select("word_id", *Y.PAGE, "ord", "x0", "top", "x1", "bottom")
    b = a.select(*Y.PAGE, (F.col("ord") - 1).alias("ord"), (F.col("x0") - 20).alias("u0"), F.col("top").alias("v0"), (F.col("x1") + 5).alias("u1"), F.col("bottom").alias("v1"))
    one, two = G.box(), [F.col(c) for c in ("u0", "v0", "u1", "v1")]
    r = lambda c: F.round(c, 4)
    holds = ((F.col("x0") + F.col("x1")) / 2).between(F.col("u0"), F.col("u1")) & ((F.col("top") + F.col("bottom")) / 2).between(F.col("v0"), F.col("v1"))
    return a.join(b, [*Y.PAGE, "ord"]).select(
        "word_id", r(F.col("x1") - F.col("x0")).alias("width"), r(F.col("bottom") - F.col("top")).alias("height"), r((F.col("x0") + F.col("x1")) / 2).alias("cx"), r(G.area(*one)).alias("area"),
        r(G.overlap_ratio(one, two)).alias("overlap"), holds.alias("holds_centre"), F.least("x0", "u0").alias("merged_x0"), F.greatest("x1", "u1").alias("merged_x1"),
    )


@query("mean_confidence", "SELECT doc_id, page_number, coalesce(round(avg(confidence), 4), 0.0) AS confidence, min(confidence) AS least FROM words WHERE confidence >= 0.30 GROUP BY doc_id, page_number")
def mean_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and least confidence of the words kept on a page."""
    return words(spark, sf).where("confidence >= 0.30").groupBy(*Y.PAGE).agg(F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("confidence"), F.min("confidence").alias("least"))


@query("dominant_word", f"WITH {_L} SELECT doc_id, page_number, line, arg_max(text, k) AS text, arg_max(font_size, k) AS font_size, arg_max(color, k) AS color, min(confidence) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, line ORDER BY length(text), round(x1 - x0, 6), -ord) AS k FROM l) GROUP BY doc_id, page_number, line")
def dominant_word(spark: SparkSession, sf: str) -> DataFrame:
    """The word that styles each line, and the line's least confidence."""
    return Y.dominant_words(lines(spark, sf)).select(*Y.PAGE, "line", "text", "font_size", "color", "confidence")


@query("weighted_median", """
    WITH w AS (SELECT doc_id, font_size AS v, sum(x1 - x0) AS w FROM words GROUP BY doc_id, font_size),
    c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY v) AS upto, sum(w) OVER (PARTITION BY doc_id) AS total FROM w)
    SELECT doc_id, coalesce(min(v) FILTER (total > 0 AND upto >= total / 2 - 1e-9), 0.0) AS median FROM c GROUP BY doc_id""")
def weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    """Font size weighed by the width of its words: the first value that reaches half the weight."""
    sizes = words(spark, sf).groupBy("doc_id", F.col("font_size").alias("v")).agg(F.sum(F.col("x1") - F.col("x0")).alias("w"))
    doc = Window.partitionBy("doc_id")
    cum = sizes.withColumns({"upto": F.sum("w").over(doc.orderBy("v")), "total": F.sum("w").over(doc)})
    return cum.groupBy("doc_id").agg(F.coalesce(F.min(F.when((F.col("total") > 0) & (F.col("upto") >= F.col("total") / 2 - 1e-9), F.col("v"))), F.lit(0.0)).alias("median"))


_RULES = "SELECT doc_id, page_number, ord, CASE WHEN ord % 4 = 0 THEN 'v' ELSE 'h' END AS orientation, CASE WHEN ord % 4 = 0 THEN x0 ELSE bottom + (ord % 3) * 0.4 END AS position, CASE WHEN ord % 4 = 0 THEN top ELSE x0 END AS low, CASE WHEN ord % 4 = 0 THEN bottom + 30 ELSE x1 + (ord % 2) * 3.5 END AS high, (ord % 5) * 0.6 AS stroke FROM words"


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Ruling lines made from the edges of words: under each word, every fourth one to its left."""
    v = F.col("ord") % 4 == 0
    return words(spark, sf).select(
        *Y.PAGE, "ord", F.when(v, "v").otherwise("h").alias("orientation"), F.when(v, F.col("x0")).otherwise(F.col("bottom") + (F.col("ord") % 3) * 0.4).alias("position"),
        F.when(v, F.col("top")).otherwise(F.col("x0")).alias("low"), F.when(v, F.col("bottom") + 30).otherwise(F.col("x1") + (F.col("ord") % 2) * 3.5).alias("high"), ((F.col("ord") % 5) * 0.6).alias("stroke"),
    )


@query("rule_merge", f"""
    WITH r AS (SELECT *, CAST(round_even(position, 0) AS BIGINT) AS bucket, printf('%06X', ord * 4099 % 16777216) AS color FROM ({_RULES})),
    i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number, orientation, bucket ORDER BY low, ord ROWS UNBOUNDED PRECEDING) AS island, avg(position) OVER (PARTITION BY doc_id, page_number, orientation, bucket) AS mean
      FROM (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY doc_id, page_number, orientation, bucket ORDER BY low, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0 THEN 0 ELSE 1 END AS n FROM r))
    SELECT doc_id, page_number, arg_min(ord, (low, ord)) AS ord, orientation, round(max(mean), 4) AS position, min(low) AS low, max(high) AS high, max(stroke) AS stroke, arg_min(color, (low, ord)) AS color FROM i GROUP BY doc_id, page_number, orientation, bucket, island""")
def rule_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Collinear touching segments as one ruling; position is the mean of the whole bucket, colour that of the first segment."""
    return G.merge_rulings(rules(spark, sf).withColumn("color", F.format_string("%06X", F.col("ord") * 4099 % 16777216)), Y.PAGE)


@query("rule_filter", f"SELECT orientation, count(*) AS rulings FROM ({_RULES}) WHERE high - low >= 0.04 * 842 GROUP BY orientation")
def rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rulings of at least 4 % of the page height."""
    return rules(spark, sf).where(F.col("high") - F.col("low") >= 0.04 * 842).groupBy("orientation").agg(F.count("*").alias("rulings"))


@query("stab_rulings", f"""
    WITH b AS (SELECT doc_id, page_number, top, max(bottom) AS bottom FROM words GROUP BY doc_id, page_number, top), v AS (SELECT * FROM ({_RULES}) WHERE orientation = 'v')
    SELECT b.doc_id, b.page_number, b.top, count(DISTINCT round(v.position, 3)) AS crossing, min(v.position) AS first FROM b JOIN v ON b.doc_id = v.doc_id AND b.page_number = v.page_number AND v.low <= (b.top + b.bottom) / 2 + 2 AND v.high >= (b.top + b.bottom) / 2 - 2 GROUP BY ALL""")
def stab_rulings(spark: SparkSession, sf: str) -> DataFrame:
    """Vertical rulings that cross the middle of each line, by an equi-join on the page with bins."""
    bands = words(spark, sf).groupBy(*Y.PAGE, "top").agg(F.max("bottom").alias("bottom")).withColumns({"m0": (F.col("top") + F.col("bottom")) / 2 - 2, "m1": (F.col("top") + F.col("bottom")) / 2 + 2})
    upright = rules(spark, sf).where("orientation = 'v'").select(*Y.PAGE, "position", "low", "high")
    hits = G.binned_overlaps(bands, upright, Y.PAGE, "m0", "m1", "low", "high", 50.0)
    return hits.groupBy(*Y.PAGE, "top").agg(F.countDistinct(F.round("position", 3)).alias("crossing"), F.min("position").alias("first"))


_BOUNDS = "SELECT doc_id, page_number, list_sort(list(DISTINCT round(x0, 1))) AS bounds FROM words GROUP BY doc_id, page_number"


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).groupBy(*Y.PAGE).agg(F.sort_array(F.collect_set(F.round("x0", 1))).alias("bounds"))


def pruned(bounds: str) -> str:
    """Boundaries without those nearer than 3 points to the last kept one, the last one always kept."""
    kept = f"list_reduce(list_transform({bounds}[1:-2], lambda x: [x]), lambda a, v: CASE WHEN v[1] - a[-1] >= 3.0 THEN list_concat(a, v) ELSE a END)"
    return f"CASE WHEN len({bounds}) <= 2 THEN {bounds} ELSE list_concat(list_filter({kept}, lambda k, i: i = 1 OR {bounds}[-1] - k >= 3.0), [{bounds}[-1]]) END"


@query("prune_bounds", f"WITH b AS (SELECT doc_id, page_number, list_sort(list_concat(bounds, list_transform(bounds, lambda x: x + 2.4))) AS b FROM ({_BOUNDS})), p AS (SELECT doc_id, page_number, {pruned('b')} AS p FROM b) SELECT doc_id, page_number, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS bound FROM p")
def prune_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Boundaries of a page, each with another 2.4 points beside it, without those that crowd the one before."""
    twice = F.sort_array(F.concat("bounds", F.transform("bounds", lambda x: x + 2.4)))
    return bounds(spark, sf).select(*Y.PAGE, F.posexplode(G.prune(twice)).alias("pos", "bound"))


@query("nearest_bound", f"""
    WITH b AS ({_BOUNDS}), w AS (SELECT word_id, x1 + 2.5 AS v, bounds FROM words JOIN b USING (doc_id, page_number)),
    d AS (SELECT word_id, abs(unnest(bounds) - v) AS d, generate_subscripts(bounds, 1) - 1 AS i FROM w)
    SELECT word_id, arg_min(i, round(d, 9) * 1000000 - i) AS bound FROM d WHERE d <= 3.0 GROUP BY word_id""")
def nearest_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary nearest to a point right of each word, within 3 points."""
    rows = words(spark, sf).join(bounds(spark, sf), Y.PAGE)
    return rows.select("word_id", G.nearest_boundary(F.col("x1") + 2.5, F.col("bounds")).alias("bound")).where("bound is not null")


@query("column_index", f"""
    WITH b AS ({_BOUNDS}), w AS (SELECT word_id, (x0 + x1) / 2 AS v, bounds FROM words JOIN b USING (doc_id, page_number) WHERE len(bounds) > 1), c AS (SELECT word_id, len(list_filter(bounds, lambda x: x <= v)) - 1 AS j, len(bounds) - 2 AS last FROM w)
    SELECT word_id, CAST(CASE WHEN j < 0 OR j > last THEN last ELSE j END AS INTEGER) AS col FROM c""")
def column_index(spark: SparkSession, sf: str) -> DataFrame:
    """Column of the centre of each word."""
    rows = words(spark, sf).join(bounds(spark, sf), Y.PAGE).where("size(bounds) > 1")
    return rows.select("word_id", G.band_index((F.col("x0") + F.col("x1")) / 2, F.col("bounds")).alias("col"))


@query("overlap_bands", f"""
    WITH b AS ({_BOUNDS}), w AS (SELECT word_id, x0, x1 + 40 AS x1, bounds FROM words JOIN b USING (doc_id, page_number) WHERE len(bounds) > 1),
    e AS (SELECT word_id, x0, x1, i, bounds[i + 1] AS a, bounds[i + 2] AS z FROM (SELECT *, unnest(range(0, len(bounds) - 1)) AS i FROM w)),
    h AS (SELECT word_id, i FROM e WHERE least(x1, z) - greatest(x0, a) >= greatest(0.75, 0.3 * least(x1 - x0, z - a))),
    f AS (SELECT word_id, len(list_filter(bounds, lambda x: x <= (x0 + x1) / 2)) - 1 AS j, len(bounds) - 2 AS last FROM w ANTI JOIN h USING (word_id))
    SELECT word_id, CAST(i AS INTEGER) AS band FROM h UNION ALL SELECT word_id, CAST(CASE WHEN j < 0 OR j > last THEN last ELSE j END AS INTEGER) FROM f""")
def overlap_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that each widened word overlaps enough."""
    rows = words(spark, sf).join(bounds(spark, sf), Y.PAGE).where("size(bounds) > 1")
    return rows.select("word_id", F.explode(G.overlap_bands(F.col("x0"), F.col("x1") + 40, F.col("bounds"))).alias("band"))


@query("det_split", f"""
    WITH v AS (SELECT doc_id, page_number, position FROM ({_RULES}) WHERE orientation = 'v'), w AS (SELECT word_id, w.doc_id, w.page_number, text, x0 - 60 AS x0, x1 + 60 AS x1 FROM words w),
    c AS (SELECT word_id, list_sort(list(DISTINCT position)) AS cuts FROM w JOIN v ON w.doc_id = v.doc_id AND w.page_number = v.page_number AND v.position > w.x0 + 2 AND v.position < w.x1 - 2 GROUP BY word_id),
    e AS (SELECT word_id, text, x0, x1, list_concat(list_concat([x0], coalesce(cuts, [])), [x1]) AS edges FROM w LEFT JOIN c USING (word_id)),
    p AS (SELECT word_id, text, x0, x1, i, edges[i] AS a, edges[i + 1] AS b FROM (SELECT *, unnest(range(1, len(edges))) AS i FROM e)),
    q AS (SELECT word_id, i - 1 AS piece, CAST(round_even(length(text) * ((a - x0) / (x1 - x0)), 0) AS INTEGER) AS f, CAST(round_even(length(text) * ((b - x0) / (x1 - x0)), 0) AS INTEGER) AS t, text FROM p)
    SELECT word_id, CAST(piece AS INTEGER) AS piece, substr(text, f + 1, t - f) AS part FROM q WHERE trim(substr(text, f + 1, t - f)) <> ''""")
def det_split(spark: SparkSession, sf: str) -> DataFrame:
    """Words widened by 60 points and split at the vertical rulings that cross them, the text in proportion."""
    upright = rules(spark, sf).where("orientation = 'v'").select(*Y.PAGE, "position")
    wide = words(spark, sf).select("word_id", *Y.PAGE, "text", (F.col("x0") - 60).alias("x0"), (F.col("x1") + 60).alias("x1"))
    inside = wide.withColumns({"a": F.col("x0") + 2, "b": F.col("x1") - 2})
    crossed = G.binned_overlaps(inside, upright.withColumn("at", F.col("position")), Y.PAGE, "a", "b", "position", "at", 100.0)
    cut = crossed.where("position > a and position < b").groupBy("word_id").agg(F.sort_array(F.collect_set("position")).alias("cuts"))
    edges = F.concat(F.array("x0"), F.coalesce("cuts", F.array().cast("array<double>")), F.array("x1"))
    pieces = wide.join(cut, "word_id", "left").withColumn("edges", edges).select("word_id", "text", "x0", "x1", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("piece"))
    at = lambda i: F.rint(F.length("text") * ((F.get("edges", i) - F.col("x0")) / (F.col("x1") - F.col("x0")))).cast("int")
    pieces = pieces.withColumns({"f": at(F.col("piece")), "t": at(F.col("piece") + 1)}).withColumn("part", F.expr("substring(text, f + 1, t - f)"))
    return pieces.where("trim(part) <> ''").select("word_id", "piece", "part")


@query("band_merge", """
    WITH b AS (SELECT doc_id, page_number, cell_id, bbox.top AS top, bbox.bottom + (cell_id % 4) * 6 AS bottom FROM (SELECT cell_id, any_value(doc_id) AS doc_id, any_value(page_number) AS page_number, any_value(bbox) AS bbox FROM grid_cells GROUP BY cell_id) WHERE bbox IS NOT NULL),
    i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY top, cell_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN top < max(bottom) OVER (PARTITION BY doc_id, page_number ORDER BY top, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2 THEN 0 ELSE 1 END AS n FROM b))
    SELECT doc_id, page_number, min(top) AS top, max(bottom) AS bottom, count(*) AS cells FROM i GROUP BY doc_id, page_number, island""")
def band_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Row bands of cells, overlapping ones merged."""
    cells = table(spark, sf, "grid_cells").where("bbox is not null").select("cell_id", *Y.PAGE, "bbox", "loaded_at")
    bands = latest(cells, "cell_id").select(*Y.PAGE, "cell_id", F.col("bbox.top").alias("top"), (F.col("bbox.bottom") + (F.col("cell_id") % 4) * 6).alias("bottom"))
    w = Window.partitionBy(*Y.PAGE).orderBy("top", "cell_id")
    fresh = F.when(F.col("top") < F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1)) - 2, 0).otherwise(1)
    merged = bands.withColumn("n", fresh).withColumn("island", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return merged.groupBy(*Y.PAGE, "island").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("cells")).drop("island")


@query("page_classify", """
    WITH p AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS chars, (doc_id % 100) / 100.0 AS coverage FROM documents)
    SELECT k.kind, count(p.kind) AS pages FROM (SELECT unnest(['digital', 'scanned', 'hybrid']) AS kind) k LEFT JOIN (SELECT CASE WHEN chars < 150 THEN 'scanned' WHEN coverage >= 0.8 THEN 'hybrid' ELSE 'digital' END AS kind FROM p) p ON p.kind = k.kind GROUP BY k.kind""")
def page_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by kind, every kind with a row; coverage is made from the id."""
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    kind = F.when(chars < 150, "scanned").when(F.col("doc_id") % 100 >= 80, "hybrid").otherwise("digital")
    kinds = spark.createDataFrame([("digital",), ("scanned",), ("hybrid",)], "kind string")
    counted = table(spark, sf, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("pages"))
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("pages", F.lit(0)).alias("pages"))
