"""Quote sheets: heading rows, column mapping, table location, line items, header fields and batches.

A sheet is a set of cells (sheet, row, col, text). The mapping yields column indices only; values are
always read from the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.functions import labels as L, values as V

MIN_FIELDS, MAX_DEPTH = 3, 3


def row_lines(cells: DataFrame) -> DataFrame:
    """sheet, row, line: the non-blank texts of a row from left to right, one space apart."""
    full = cells.where(V.strip(F.col("text")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("col", V.strip(F.col("text")).alias("t"))))
    return full.groupBy("sheet", "row").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("line"))


def composite_headings(cells: DataFrame, least: int = 0) -> DataFrame:
    """sheet, row, depth, col, text: the texts of one to MAX_DEPTH rows from `row` on, joined per column.

    Every cell is repeated for the windows it falls into, so no rows are joined with each other. Windows
    that reach below the sheet are left out, and with `least` those with fewer columns that may be headings.
    Sheets are dealt once by their key; all later groupings by sheet find their rows together.
    """
    n_rows = F.max("row").over(Window.partitionBy("sheet")) + 1
    full = cells.repartition("sheet").withColumn("n", n_rows).where(V.strip(F.col("text")) != "").withColumn("may", L.may_be_heading(F.col("text")).cast("int"))
    windows = [F.struct((F.col("row") - back).alias("start"), F.lit(depth).alias("depth")) for depth in range(1, MAX_DEPTH + 1) for back in range(depth)]
    spread = full.select("sheet", "row", "col", "text", "may", "n", F.inline(F.array(*windows))).where("start >= 0 and start + depth <= n")
    ordered = F.array_sort(F.collect_list(F.struct("row", "text")))
    if least:
        spread = spread.withColumn("can", F.size(F.collect_set(F.when(F.col("may") == 1, F.col("col"))).over(Window.partitionBy("sheet", "start", "depth")))).where(F.col("can") >= least)
    return spread.groupBy("sheet", F.col("start").alias("row"), "depth", "col").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def claim_columns(headings: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, mapping (map field -> column), matched: every field, in claim order, takes the unclaimed column of its most specific wording, the first on ties."""
    label = headings.withColumn("label", L.heading(F.col("text")))
    spec = label.select(*keys, "col", F.array(*[L.specificity(F.col("label"), f) for f in L.CLAIM_ORDER]).alias("s"))
    if least > 1:  # too few columns with any wording cannot place enough fields
        some = Window.partitionBy(*keys)
        worded = F.when(F.exists("s", lambda x: x.isNotNull()), 1)
        spec = spec.withColumn("worded", F.count(worded).over(some)).where(F.col("worded") >= least)
    rows = spec.groupBy(*keys).agg(F.collect_list(F.struct("col", "s")).alias("cs"), F.count("*").alias("columns"))

    def step(taken: Column, i: Column) -> Column:
        free = F.filter("cs", lambda c: F.get(c["s"], i).isNotNull() & ~F.array_contains(taken, c["col"]))
        best = F.array_max(F.transform(free, lambda c: F.struct(F.get(c["s"], i).alias("spec"), (-c["col"]).alias("neg"))))
        return F.concat(taken, F.array(F.coalesce(-best["neg"], -1 - i).cast("int")))

    none = F.array().cast("array<int>")
    rows = rows.withColumn("taken", F.aggregate(F.sequence(F.lit(0), F.lit(len(L.CLAIM_ORDER) - 1)), none, step))
    chosen = F.map_from_arrays(F.array(*[F.lit(f) for f in L.CLAIM_ORDER]), F.col("taken"))
    mapping = F.map_filter(chosen, lambda _, v: v >= 0)
    return rows.select(*keys, "columns", mapping.alias("mapping")).withColumn("matched", F.size("mapping"))


def usable(mapping: Column) -> Column:
    """A mapping that names the items and their money."""
    has = lambda f: F.map_contains_key(mapping, f)
    return (has("ref") | has("description")) & (has("unit_price") | has("total"))


def find_headers(cells: DataFrame) -> DataFrame:
    """sheet, row, depth, mapping, matched of the most credible heading: most fields, then fewest rows, then the upper one."""
    scored = claim_columns(composite_headings(cells, MIN_FIELDS), ["sheet", "row", "depth"], MIN_FIELDS)
    good = scored.where((F.col("columns") >= MIN_FIELDS) & (F.col("matched") >= MIN_FIELDS) & usable(F.col("mapping")))
    best = F.max_by(F.struct("row", "depth", "mapping", "matched"), F.struct("matched", -F.col("depth"), -F.col("row")))
    return good.groupBy("sheet").agg(best.alias("h")).select("sheet", "h.*")


def locate_tables(cells: DataFrame) -> DataFrame:
    """Headers with `first_data_row`: the first row below the heading with a mapped column and not all heading words."""
    heads = find_headers(cells).withColumnRenamed("row", "header_row")
    word = F.when(L.may_be_heading(F.col("text")), L.looks_like_heading(L.heading(F.col("text")))).otherwise(False)
    full = cells.where(V.strip(F.col("text")) != "").withColumn("word", word)
    rows = full.groupBy("sheet", "row").agg(F.collect_set("col").alias("cols"), F.min("word").alias("all_words"))
    below = heads.select("sheet", "header_row", "depth", "mapping").join(rows, "sheet").where((F.col("row") >= F.col("header_row") + F.col("depth")) & ~F.col("all_words"))
    first = below.where(F.arrays_overlap("cols", F.map_values("mapping"))).groupBy("sheet").agg(F.min("row").alias("first"))
    return heads.join(first, "sheet", "left").withColumn("first_data_row", F.coalesce("first", F.col("header_row") + F.col("depth"))).drop("first")


def extract_items(cells: DataFrame, locations: DataFrame) -> DataFrame:
    """sheet, row and the ten-field values of the line items: rows from the first data row to the first total, with an identity and money."""
    at = cells.groupBy("sheet", "row", "col").agg(F.first("text").alias("text"))  # one cell a position is expected
    rows = at.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", V.strip(F.coalesce("text", F.lit(""))).alias("t")))).alias("m"))
    joined = rows.join(locations.select("sheet", "mapping", "first_data_row"), "sheet").where("row >= first_data_row")
    text = lambda f: F.coalesce(F.try_element_at("m", F.try_element_at("mapping", F.lit(f))), F.lit(""))
    fields = joined.select("sheet", "row", *[text(f).alias(f) for f in L.SYNONYMS])
    name = F.when(F.col("ref") != "", F.col("ref")).otherwise(F.col("description"))
    marked = fields.withColumn("stop", F.when((name != "") & L.ends_items(name), F.col("row")))
    open_ = marked.withColumn("cut", F.min("stop").over(Window.partitionBy("sheet"))).where("cut is null or row < cut")
    number = ("qty", "unit_price", "discount", "discounted_price", "total")
    parsed = open_.select("sheet", "row", F.substring("ref", 1, 120).alias("ref"), F.substring("description", 1, 400).alias("description"), *[V.parse_decimal(F.col(c)).alias(c) for c in number])
    kept = parsed.where("(ref <> '' or description <> '') and (unit_price is not null or total is not null or discounted_price is not null)")
    price = F.when(F.col("discounted_price") != 0, F.col("discounted_price")).otherwise(F.col("unit_price"))
    return kept.withColumn("total", F.when(F.col("total") != 0, F.col("total").cast("decimal(37,8)")).otherwise((F.col("qty") * price).cast("decimal(37,8)")))


def extract_headers(cells: DataFrame, day_first: DataFrame | None = None) -> DataFrame:
    """sheet, supplier, quote_date, currency, reference from the first lines of a sheet."""
    lines = row_lines(cells).withColumn("i", F.row_number().over(Window.partitionBy("sheet").orderBy("row")) - 1).where("i < 40")
    bare = L.strip_furniture(F.col("line"))
    name = F.when((F.col("i") < 6) & (F.length(bare) >= 3) & ~bare.rlike(r"(?i)^(page|quotation|quote|date)\b"), F.substring(F.substring_index(bare, "  ", 1), 1, 120))
    label = lambda names: F.array_compact(F.array(*[F.when(L.labelled(F.col("line"), n).isNotNull(), F.struct(F.col("i").alias("i"), F.lit(k).alias("k"), L.labelled(F.col("line"), n).alias("v"))) for k, n in enumerate(names)]))
    per = lines.select("sheet", "i", "line", name.alias("name"), label(("date", "quote date", "quotation date")).alias("d"), label(("ref", "reference", "quote no", "quotation no", "quote number")).alias("r"))
    first = lambda c: F.array_min(F.flatten(F.collect_list(c)))["v"]
    heads = per.groupBy("sheet").agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("i"))).alias("supplier"), first("d").alias("date_text"), first("r").alias("reference"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") < 25, F.struct("i", "line")))), lambda x: x["line"]), " ").alias("top"),
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("all"),
    )
    unknown = F.lit(None).cast("boolean")
    found = F.filter(F.transform("all", lambda x: V.detect_currency(x["line"])), lambda c: c != "")
    return heads.select(
        "sheet", F.coalesce("supplier", F.lit("")).alias("supplier"), F.coalesce(V.find_date(F.col("date_text"), unknown), V.find_date(F.col("top"), unknown)).alias("quote_date"),
        F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("currency"), F.substring(F.coalesce("reference", F.lit("")), 1, 80).alias("reference"),
    )


def warnings(cells: DataFrame, items: DataFrame, locations: DataFrame) -> DataFrame:
    """sheet, warning: sheets without a table, and tables without items."""
    sheets = cells.select("sheet").distinct()
    none = sheets.join(locations, "sheet", "left_anti").select("sheet", F.lit("no table found").alias("warning"))
    empty = locations.select("sheet").join(items, "sheet", "left_anti").select("sheet", F.lit("no line items").alias("warning"))
    return none.unionByName(empty)
