"""Boxes, one-dimensional clusters, interval islands, nearest boundaries and range joins on page geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "top", "x1", "bottom")]


def normal_box(x0: Column, top: Column, x1: Column, bottom: Column) -> list[Column]:
    """An inverted rectangle with its sides swapped."""
    return [F.least(x0, x1).alias("x0"), F.least(top, bottom).alias("top"), F.greatest(x0, x1).alias("x1"), F.greatest(top, bottom).alias("bottom")]


def area(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """Area with negative sides as 0."""
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), bottom - top)


def shared_area(a: list[Column], b: list[Column]) -> Column:
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Shared part of the first box, 0 if it is empty."""
    whole = area(*a)
    return F.when(whole > 0, shared_area(a, b) / whole).otherwise(0.0)


def union_box() -> list[Column]:
    """Aggregates of the box that holds all boxes of a group."""
    return [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]


def islands(df: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Add `island`: values of a group belong together while the gap to the next smaller one is at most `tol`. Null values are dropped."""
    order = Window.partitionBy(*keys).orderBy(value)
    gap = F.col(value) - F.lag(value).over(order)
    flagged = df.where(F.col(value).isNotNull()).withColumn("__new", F.when(gap <= tol, 0).otherwise(1))
    return flagged.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def cluster_positions(df: DataFrame, keys: list[str], value: str, tol: float = 2.0) -> DataFrame:
    """Single-linkage clusters in one dimension: keys, position (mean), members."""
    return islands(df, keys, value, tol).groupBy(*keys, "island").agg(F.round(F.avg(value), 9).alias("position"), F.count("*").alias("members")).drop("island")


def interval_islands(df: DataFrame, keys: list[str], low: str, high: str, tol: float, *order: str) -> DataFrame:
    """Add `island`: intervals of a group belong together while one starts within `tol` of the furthest end so far."""
    w = Window.partitionBy(*keys).orderBy(low, *order)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.when(F.col(low) <= reach + tol, 0).otherwise(1))
    return flagged.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def merge_rulings(rulings: DataFrame, keys: list[str]) -> DataFrame:
    """Collinear touching segments as one ruling: ord, orientation, position (mean of its whole bucket), low, high, stroke (the heaviest), color (of the first).

    `rulings` has ord, orientation, position, low, high, stroke, color; positions share a bucket if they round to one point.
    """
    of = [*keys, "orientation", "bucket"]
    bucketed = rulings.withColumn("bucket", F.rint("position").cast("bigint"))
    joined = interval_islands(bucketed, of, "low", "high", 1.0, "ord").withColumn("mean", F.avg("position").over(Window.partitionBy(*of)))
    first = F.min_by(F.struct("ord", "color"), F.struct("low", "ord"))
    one = joined.groupBy(*of, "island").agg(first.alias("f"), F.round(F.max("mean"), 4).alias("position"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("stroke").alias("stroke"))
    return one.select(*keys, "f.ord", "orientation", "position", "low", "high", "stroke", "f.color")


def prune(bounds: Column, least: float = 3.0) -> Column:
    """Boundaries without those nearer than `least` to the last kept one; first and last stay, an interior one that crowds the last goes."""
    n = F.size(bounds)
    inner = F.slice(bounds, F.lit(2), F.greatest(n - 2, F.lit(0)))
    start = F.slice(bounds, F.lit(1), F.lit(1))
    kept = F.aggregate(inner, start, lambda acc, v: F.when(v - F.element_at(acc, -1) >= least, F.concat(acc, F.array(v))).otherwise(acc))
    last = F.element_at(bounds, -1)
    roomy = F.filter(kept, lambda v, i: (i == 0) | (last - v >= least))
    return F.when(n <= 2, bounds).otherwise(F.concat(roomy, F.array(last)))


def band_index(value: Column, bounds: Column) -> Column:
    """0-based band of a value, half open; a value outside on either side falls into the last band."""
    at = F.size(F.filter(bounds, lambda b: b <= value)) - 1
    return F.when((at < 0) | (at > F.size(bounds) - 2), F.size(bounds) - 2).otherwise(at)


def nearest_boundary(value: Column, bounds: Column, tol: float = 3.0) -> Column:
    """0-based boundary nearest to a value within `tol`, the last one on ties; null if none."""
    scored = F.transform(bounds, lambda b, i: F.struct(F.abs(b - value).alias("d"), (-i).alias("i")))
    best = F.array_min(F.filter(scored, lambda s: s["d"] <= tol))
    return -best["i"]


def overlap_bands(low: Column, high: Column, bounds: Column, part: float = 0.3, floor: float = 0.75) -> Column:
    """0-based bands that an interval overlaps by max(floor, part of the shorter); else the band of its middle."""
    steps = F.sequence(F.lit(0), F.size(bounds) - 2)

    def over(i: Column) -> Column:
        a, b = F.get(bounds, i), F.get(bounds, i + 1)
        return F.least(high, b) - F.greatest(low, a) >= F.greatest(F.lit(floor), F.lit(part) * F.least(high - low, b - a))

    hits = F.filter(steps, over)
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(band_index((low + high) / 2, bounds)))


def binned_overlaps(left: DataFrame, right: DataFrame, keys: list[str], l_low: str, l_high: str, r_low: str, r_high: str, width: float) -> DataFrame:
    """Interval join by bins: both sides are repeated for the bins they touch and joined on keys and bin, never as a nested loop.

    A pair is kept in the bin where its overlap starts, so it comes out once.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a, b = left.withColumn("__bin", bins(l_low, l_high)), right.withColumn("__bin", bins(r_low, r_high))
    pairs = a.join(b, [*keys, "__bin"]).where((F.col(l_low) <= F.col(r_high)) & (F.col(r_low) <= F.col(l_high)))
    return pairs.where(F.floor(F.greatest(l_low, r_low) / width) == F.col("__bin")).drop("__bin")
