"""Readers that disagree, corrections, and scoring against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.functions.values import squeeze


def same(a: Column, b: Column) -> Column:
    """Equal but for white space; null counts as empty."""
    return squeeze(a) == squeeze(b)


def decide(original: Column, page: Column, crop_a: Column, crop_b: Column) -> Column:
    """struct(resolution, value) of four readings; an empty crop reading abstains.

    Two crop readers that agree win; one that confirms the original keeps it; one that backs the page reading
    corrects it; otherwise the dispute stays open.
    """
    has_a, has_b = F.coalesce(crop_a, F.lit("")) != "", F.coalesce(crop_b, F.lit("")) != ""
    out = lambda r, v: F.struct(F.lit(r).alias("resolution"), v.alias("value"))
    none = F.lit(None).cast("string")
    return (
        F.when(has_a & has_b & same(crop_a, crop_b), F.when(same(crop_a, original), out("agreed", none)).otherwise(out("corrected", crop_a)))
        .when((has_a & same(crop_a, original)) | (has_b & same(crop_b, original)), out("agreed", none))
        .when((has_a & same(crop_a, page)) | (has_b & same(crop_b, page)), out("corrected", page))
        .otherwise(out("open", none))
    )


def reconcile(readings: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Readings with the cell they dispute and the decision; a reading without a cell has '' as original and stays open."""
    joined = readings.join(cells.select(*keys, F.col("text").alias("original")), keys, "left")
    original = F.coalesce("original", F.lit(""))
    found = F.when(F.col("original").isNotNull(), decide(original, F.col("page"), F.col("crop_a"), F.col("crop_b"))).otherwise(F.struct(F.lit("open").alias("resolution"), F.lit(None).cast("string").alias("value")))
    return joined.withColumn("d", found).select(*keys, original.alias("original"), "page", "d.resolution", "d.value")


def apply_corrections(cells: DataFrame, corrections: DataFrame, sheets: DataFrame, keys: list[str], page_keys: list[str]) -> DataFrame:
    """Cells after a review: a full outer merge by position; corrections of unknown pages are dropped, missing cells are made."""
    known = corrections.join(sheets, page_keys, "left_semi")
    merged = cells.select(*keys, F.col("text").alias("old"), "source", "confidence").join(known.select(*keys, F.col("value").alias("new")), keys, "full")
    changed = F.col("new").isNotNull()
    return merged.select(*keys, F.coalesce("new", "old").alias("text"), F.when(changed, "human").otherwise(F.col("source")).alias("source"), F.when(changed, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(changed, F.col("old")).alias("previous"))


def status(disputes: DataFrame, job: str) -> DataFrame:
    """job, open_disputes, status."""
    counted = disputes.groupBy(job).agg(F.count_if(F.col("resolution") == "open").alias("open_disputes"))
    return counted.withColumn("status", F.when(F.col("open_disputes") > 0, "NEEDS_REVIEW").otherwise("DONE"))


def corrupt(text: Column) -> Column:
    """The last digit plus one (mod 10) or the last letter as x (y for x) where it comes later; '?' appended to texts with neither. ASCII letters and digits."""
    tail = F.regexp_extract(text, r"([0-9A-Za-z])[^0-9A-Za-z]*$", 1)
    head = F.regexp_extract(text, r"(?s)^(.*)[0-9A-Za-z][^0-9A-Za-z]*$", 1)
    rest = F.regexp_extract(text, r"(?s)[0-9A-Za-z]([^0-9A-Za-z]*)$", 1)
    digit = ((tail.try_cast("int") + 1) % 10).cast("string")
    letter = F.when(tail == "x", "y").when(tail == "X", "Y").when(tail.rlike("[A-Z]"), "X").otherwise("x")
    return F.when(tail == "", F.concat(text, F.lit("?"))).otherwise(F.concat(head, F.coalesce(digit, letter), rest))


def corruption_plan(texts: DataFrame, count: int) -> DataFrame:
    """original, corrupted of the first `count` texts (by ord) that occur once and whose corruption occurs nowhere."""
    t = texts.where("trim(text) <> ''").select(F.trim("text").alias("original"), "ord")
    once = t.groupBy("original").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    single = once.where("n = 1").withColumn("corrupted", corrupt(F.col("original")))
    free = single.join(once.select(F.col("original").alias("corrupted")), "corrupted", "left_anti")
    return free.orderBy("ord", "original").limit(count).select("original", "corrupted")


def accuracy(expected: DataFrame, actual: DataFrame, keys: list[str], group: str, covered: DataFrame | None = None) -> DataFrame:
    """Per group and as TOTAL: expected, matched, extra cells and accuracy; spurious cells count against it, none at all is 1.0."""
    extra = actual if covered is None else actual.join(covered, keys, "left_anti").unionByName(actual.join(expected, keys, "left_semi")).dropDuplicates(keys)
    both = expected.select(*keys, group, F.col("text").alias("want")).join(extra.select(*keys, F.col(group).alias("__g"), F.col("text").alias("got")), keys, "full")
    both = both.withColumn(group, F.coalesce(group, "__g"))
    sums = both.rollup(group).agg(F.count("want").alias("expected"), F.count_if(F.col("want") == F.col("got")).alias("matched"), F.count_if(F.col("want").isNull()).alias("extra"), F.grouping(group).alias("all"))
    whole = F.col("expected") + F.col("extra")
    return sums.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col(group).cast("string")).alias(group), "expected", "matched", "extra", F.round(F.when(whole > 0, F.col("matched") / whole).otherwise(1.0), 6).alias("accuracy"))


def readings_of(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows of a model's JSON reply: the first {...} block, its `cells` list, malformed entries dropped, confidence in [0, 1]."""
    block = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.from_json(block, "cells array<struct<row:string,col:string,text:string,confidence:string>>")
    rows = replies.select(*[c for c in replies.columns if c != reply], F.inline(parsed["cells"]))
    index = lambda c: F.col(c).try_cast("int")
    good = rows.where(index("row").isNotNull() & index("col").isNotNull())
    clamp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    return good.withColumns({"row": index("row"), "col": index("col"), "text": F.coalesce("text", F.lit("")), "confidence": clamp})


def newest(df: DataFrame, time: str, tie: str, n: int = 100) -> DataFrame:
    """The n newest rows (a top-k, never a full sort)."""
    return df.orderBy(F.desc(time), tie).limit(n)


def occurrences(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("n", F.count("*").over(Window.partitionBy(text)))
