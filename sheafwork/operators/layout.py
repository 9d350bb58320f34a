"""From words to lines, runs and separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.operators.geometry import cluster_positions, islands

LINE_OVERLAP, COARSE, WIDE_GAP, GAP_FACTOR = 0.45, 4.0, 18.0, 3.0
STEP, CLEAR_SHARE, WITNESSES, CORRIDOR = 0.5, 0.85, 3, 5.0
PAGE = ["doc_id", "page_number"]


def group_lines(words: DataFrame) -> DataFrame:
    """Add `line` (0-based, by top edge) to words: a word joins the open line while it shares LINE_OVERLAP of the shorter height.

    The band of a line grows with its words and starts anew with the next line, so this is a fold over the
    words of a page in (top, x0, ord) order, not a window. Words without a box are dropped.
    """
    whole = words.where("x0 is not null and top is not null and bottom is not null")
    ordered = whole.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("top", "x0", "ord", "bottom", "word_id"))).alias("ws"))
    zero = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"), F.array().cast("array<struct<word_id:bigint,line:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        shared = F.least(acc["bottom"], w["bottom"]) - F.greatest(acc["top"], w["top"])
        shorter = F.least(acc["bottom"] - acc["top"], w["bottom"] - w["top"])
        same = (acc["line"] >= 0) & (shared / F.when(shorter == 0, 1.0).otherwise(shorter) >= LINE_OVERLAP)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        top, bottom = F.when(same, F.least(acc["top"], w["top"])).otherwise(w["top"]), F.when(same, F.greatest(acc["bottom"], w["bottom"])).otherwise(w["bottom"])
        return F.struct(line.alias("line"), top.alias("top"), bottom.alias("bottom"), F.concat(acc["out"], F.array(F.struct(w["word_id"].alias("word_id"), line.alias("line")))).alias("out"))

    placed = ordered.select(F.inline(F.aggregate("ws", zero, step)["out"]))
    return whole.join(placed, "word_id")


def with_gaps(lines: DataFrame) -> DataFrame:
    """Add `gap`: distance to the word before on the same line, null for the first."""
    along = Window.partitionBy(*PAGE, "line").orderBy("x0", "ord")
    return lines.withColumn("gap", F.round(F.col("x0") - F.lag("x1").over(along), 6))


def split_runs(lines: DataFrame, threshold: Column) -> DataFrame:
    """Add `run` (0-based within the line): a gap beyond the threshold starts a new run."""
    along = Window.partitionBy(*PAGE, "line").orderBy("x0", "ord")
    return with_gaps(lines).withColumn("run", F.sum(F.when(F.col("gap") > threshold, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def coarse_gaps(lines: DataFrame) -> DataFrame:
    """Per line: the gap that separates columns coarsely, from the median font size (10 if none)."""
    size = F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(10.0))
    return lines.groupBy(*PAGE, "line").agg(F.round(F.greatest(F.lit(COARSE), size * 0.28 * 1.6), 6).alias("coarse"))


def outlier_gaps(lines: DataFrame) -> DataFrame:
    """Gaps that stand out on their line: keys, line, gap, position (middle of the gap).

    A single gap must exceed WIDE_GAP; several must also exceed GAP_FACTOR times the value at index
    (n - 1) // 4 of the sorted gaps. Overlapping words (gap not positive) count as no gap.
    """
    gaps = with_gaps(lines).where("gap > 0")
    line = Window.partitionBy(*PAGE, "line")
    sizes = F.sort_array(F.collect_list("gap").over(line))
    quartile = F.element_at(sizes, (F.floor((F.size(sizes) - 1) / 4) + 1).cast("int"))
    limit = F.when(F.size(sizes) == 1, F.lit(WIDE_GAP)).otherwise(F.greatest(F.lit(WIDE_GAP), F.lit(GAP_FACTOR) * quartile))
    out = gaps.withColumn("limit", limit).where("gap > limit")
    return out.select(*PAGE, "line", "gap", F.round(F.col("x0") - F.col("gap") / 2, 6).alias("position"))


def outlier_columns(lines: DataFrame, members: int = 3, tol: float = 10.0) -> DataFrame:
    """Positions where outlier gaps of at least `members` lines meet."""
    return cluster_positions(outlier_gaps(lines), PAGE, "position", tol).where(F.col("members") >= members)


def corridor_spans(lines: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Stretches of half-point bins of a page over which nothing changes: keys, first, last (bins from the left edge of the content), straddling, free, left, right (edges of the content).

    Lines of at least two coarse runs vote, on a page with at least two of them. A line straddles the bins
    strictly between its first and its last one; a bin is free for it where no run of it lies. Both counts
    are running sums over the ends of spans, so the work is in runs, never in bins.
    """
    coarse = lines.join(coarse_gaps(lines), [*PAGE, "line"])
    page, line = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE, "line")
    edges = edges or lines.groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    runs = split_runs(coarse, F.col("coarse")).groupBy(*PAGE, "line", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    bin_of = lambda c: F.floor((F.col(c) - F.col("left")) / STEP)
    runs = runs.join(edges, PAGE).select(*PAGE, "line", "run", "left", "right", bin_of("x0").alias("s"), bin_of("x1").alias("e"))
    runs = runs.withColumns({"n": F.count("*").over(line), "lo": F.min("s").over(line), "hi": F.max("e").over(line)}).where("n >= 2")
    runs = runs.withColumn("first", F.row_number().over(line.orderBy("s", "run")) == 1)
    runs = runs.withColumn("voters", F.sum(F.col("first").cast("int")).over(page)).where("voters >= 2")
    before = F.max("e").over(line.orderBy("s", "run").rowsBetween(Window.unboundedPreceding, -1))  # runs of a line may overlap
    runs = runs.withColumns({"a": F.greatest(F.col("s"), F.col("lo") + 1, F.coalesce(before + 1, F.col("s"))), "b": F.least(F.col("e"), F.col("hi") - 1)})
    change = lambda at, straddling, busy: F.struct(at.alias("bin"), F.lit(straddling).alias("ds"), F.lit(busy).alias("db"))
    none = F.array().cast("array<struct<bin:bigint,ds:int,db:int>>")
    spans = F.when(F.col("first") & (F.col("hi") - F.col("lo") >= 2), F.array(change(F.col("lo") + 1, 1, 0), change(F.col("hi"), -1, 0))).otherwise(none)
    taken = F.when(F.col("a") <= F.col("b"), F.array(change(F.col("a"), 0, 1), change(F.col("b") + 1, 0, -1))).otherwise(none)
    events = runs.select(*PAGE, "left", "right", F.inline(F.concat(spans, taken))).groupBy(*PAGE, "bin").agg(F.sum("ds").alias("ds"), F.sum("db").alias("db"), F.first("left").alias("left"), F.first("right").alias("right"))
    along = page.orderBy("bin")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.select(*PAGE, F.col("bin").alias("first"), (F.lead("bin").over(along) - 1).alias("last"), F.sum("ds").over(upto).alias("straddling"), F.sum("db").over(upto).alias("busy"), "left", "right")
    return summed.where("straddling > 0").select(*PAGE, "first", "last", "straddling", (F.col("straddling") - F.col("busy")).alias("free"), "left", "right")


def corridors(lines: DataFrame, witnesses: int = WITNESSES, share: float = CLEAR_SHARE, edges: DataFrame | None = None) -> DataFrame:
    """Separators between columns: middle of bins that at least `witnesses` lines straddle and `share` of those leave free, at least CORRIDOR wide, off the edges of the content."""
    good = corridor_spans(lines, edges).where((F.col("straddling") >= witnesses) & (F.col("free") >= F.col("straddling") * share))
    along = Window.partitionBy(*PAGE).orderBy("first")
    fresh = F.when(F.col("first") == F.lag("last").over(along) + 1, 0).otherwise(1)
    runs = good.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wide = runs.groupBy(*PAGE, "island").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.first("left").alias("left"), F.first("right").alias("right"))
    ends = wide.select(*PAGE, (F.col("left") + F.col("a") * STEP).alias("s"), (F.col("left") + (F.col("b") + 1) * STEP).alias("e"), "left", "right")
    inner = ends.where((F.col("e") - F.col("s") >= CORRIDOR) & (F.col("s") > F.col("left") + STEP) & (F.col("e") < F.col("right") - STEP))
    return inner.select(*PAGE, ((F.col("s") + F.col("e")) / 2).alias("separator"))


def dominant_words(lines: DataFrame) -> DataFrame:
    """Per line the word that styles it: longest text, then widest, then first."""
    key = F.struct(F.length("text"), F.round(F.col("x1") - F.col("x0"), 6), -F.col("ord"))
    return lines.groupBy(*PAGE, "line").agg(F.max_by(F.struct("text", "font_name", "font_size", "bold", "italic", "color"), key).alias("w"), F.min("confidence").alias("confidence")).select(*PAGE, "line", "w.*", "confidence")
