"""Queries of the quote operators, over sheets made from quote_headers and line_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sheafwork.functions import labels as L
from sheafwork.operators import quotes as Q
from sheafwork.plans import sqltext as S
from sheafwork.plans.registry import Plans
from sheafwork.session import written
from sheafwork.sources.tables import latest, table

plans = Plans()
QUERIES, ORACLE, query = plans.queries, plans.oracle, plans.query

# Headings of the made sheets, by doc_id % 3; the third kind is stacked over two rows.
HEADS = [
    [(4, ["Part No", "Description", "Qty", "Unit Price", "Total Price"])],
    [(4, ["Item Code", "Details", "Quantity", "Rate (USD)", "Amount"])],
    [(4, ["Ref / Code", "Goods Description", "No. of Units", "LIST", "TOTAL"]), (5, ["", "", "", "PRICE USD", "PRICE USD"])],
]
_ITEMS = "SELECT item_id, r.doc_id, r.ref, r.description, r.qty, r.unit_price, r.total FROM (SELECT item_id, arg_max(struct_pack(doc_id := doc_id, ref := ref, description := description, qty := qty, unit_price := unit_price, total := total), loaded_at) AS r FROM line_items GROUP BY item_id)"
_HEAD_SQL = " UNION ALL ".join(f"SELECT doc_id AS sheet, {row} AS row, {c} AS col, {S.lit(t)} AS text FROM d WHERE doc_id % 3 = {k}" for k, rows in enumerate(HEADS) for row, ts in rows for c, t in enumerate(ts) if t)
SHEETS = f"""d AS (SELECT doc_id FROM quote_headers), it AS ({_ITEMS}), n AS (SELECT *, 5 + row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS row FROM it WHERE doc_id IN (SELECT doc_id FROM d)),
    cells AS (SELECT doc_id AS sheet, 0 AS row, 0 AS col, supplier AS text FROM quote_headers WHERE supplier IS NOT NULL
      UNION ALL SELECT doc_id, 1, 0, 'Date: ' || quote_date FROM quote_headers WHERE quote_date IS NOT NULL UNION ALL SELECT doc_id, 1, 2, 'Ref: ' || reference FROM quote_headers WHERE reference IS NOT NULL
      UNION ALL SELECT doc_id, 2, 0, 'All prices in ' || currency FROM quote_headers WHERE currency IS NOT NULL UNION ALL {_HEAD_SQL}
      UNION ALL SELECT doc_id, row, 0, ref FROM n WHERE ref IS NOT NULL UNION ALL SELECT doc_id, row, 1, description FROM n WHERE description IS NOT NULL UNION ALL SELECT doc_id, row, 2, CAST(CAST(qty AS DECIMAL(18,2)) AS VARCHAR) FROM n WHERE qty IS NOT NULL
      UNION ALL SELECT doc_id, row, 3, CASE WHEN doc_id % 2 = 0 THEN format('{{:,.2f}}', CAST(CAST(unit_price AS DECIMAL(18,2)) AS DOUBLE)) ELSE translate(format('{{:,.2f}}', CAST(CAST(unit_price AS DECIMAL(18,2)) AS DOUBLE)), ',.', '.,') END FROM n WHERE unit_price IS NOT NULL
      UNION ALL SELECT doc_id, row, 4, CASE WHEN total < 0 THEN '(' || CAST(CAST(-total AS DECIMAL(18,2)) AS VARCHAR) || ')' ELSE CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR) END FROM n WHERE total IS NOT NULL AND item_id % 5 <> 0
      UNION ALL SELECT doc_id, max(row) + 1, 1, 'Subtotal' FROM n GROUP BY doc_id)"""


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Cells (sheet, row, col, text) of one made sheet per quote."""
    heads = table(spark, sf, "quote_headers").select("doc_id", "supplier", "quote_date", "reference", "currency")
    read = ("doc_id", "ref", "description", "qty", "unit_price", "total")
    once = latest(table(spark, sf, "line_items").select("item_id", *read, "loaded_at"), "item_id", "loaded_at", *read)
    items = once.join(heads.select("doc_id"), "doc_id", "left_semi").withColumn("row", (F.row_number().over(Window.partitionBy("doc_id").orderBy("item_id")) + 5).cast("int"))
    cell = lambda row, col, text: F.struct(F.lit(row).cast("int").alias("row") if isinstance(row, int) else row.alias("row"), F.lit(col).alias("col"), text.alias("text"))
    two = lambda c: F.col(c).cast("decimal(18,2)")
    group = F.format_number(two("unit_price"), 2)
    money = F.when(F.col("doc_id") % 2 == 0, group).otherwise(F.translate(group, ",.", ".,"))
    total = F.when(F.col("item_id") % 5 != 0, F.when(F.col("total") < 0, F.concat(F.lit("("), (-F.col("total")).cast("decimal(18,2)").cast("string"), F.lit(")"))).otherwise(two("total").cast("string")))
    body = [cell(F.col("row"), 0, F.col("ref")), cell(F.col("row"), 1, F.col("description")), cell(F.col("row"), 2, two("qty").cast("string")), cell(F.col("row"), 3, money), cell(F.col("row"), 4, total)]
    fixed = F.coalesce(*[F.when(F.col("doc_id") % 3 == k, F.array(*[cell(r, c, F.lit(t)) for r, ts in rows for c, t in enumerate(ts) if t])) for k, rows in enumerate(HEADS)])
    top = F.array(cell(0, 0, F.col("supplier")), cell(1, 0, F.concat(F.lit("Date: "), "quote_date")), cell(1, 2, F.concat(F.lit("Ref: "), "reference")), cell(2, 0, F.concat(F.lit("All prices in "), "currency")))
    out = heads.select(F.col("doc_id").alias("sheet"), F.inline(F.concat(top, fixed))).unionByName(items.select(F.col("doc_id").alias("sheet"), F.inline(F.array(*body))))
    end = items.groupBy("doc_id").agg((F.max("row") + 1).alias("row")).select(F.col("doc_id").alias("sheet"), "row", F.lit(1).alias("col"), F.lit("Subtotal").alias("text"))
    return out.where("text is not null").unionByName(end)


def _located(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sheets and the locations of their tables, each written once as several steps read them."""
    cells = written(sheets(spark, sf), "sheets")
    return cells, written(Q.locate_tables(cells), "located")


_LINES = f"lines AS (SELECT sheet, row, string_agg({S.strip('text')}, ' ' ORDER BY col) AS line FROM cells WHERE {S.strip('text')} <> '' GROUP BY sheet, row)"
_COMP = f"""full_ AS (SELECT *, max(row) OVER (PARTITION BY sheet) + 1 AS n FROM cells),
    w AS (SELECT sheet, row, col, text, n, CAST(row - b AS INTEGER) AS start, CAST(depth AS INTEGER) AS depth FROM full_, (VALUES (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) v(depth, b) WHERE {S.strip('text')} <> ''),
    comp AS (SELECT sheet, start AS row, depth, col, string_agg(text, ' ' ORDER BY row) AS text FROM w WHERE start >= 0 AND start + depth <= n GROUP BY sheet, start, depth, col)"""
_SPEC = "lab AS (SELECT sheet * 100000 + row * 10 + depth AS k, sheet, row, depth, col, " + S.heading("text") + " AS label FROM comp), spec AS (" + " UNION ALL ".join(f"SELECT k, col, {S.lit(f)} AS field, {S.specificity('label', f)} AS spec FROM lab" for f in L.CLAIM_ORDER) + "), " + S.claims("spec", "k")
_MAP = ", m AS (" + " UNION ALL ".join(f"SELECT * FROM claim_{i}" for i in range(len(L.CLAIM_ORDER))) + """),
    cand AS (SELECT k, count(*) AS matched, bool_or(field IN ('ref', 'description')) AND bool_or(field IN ('unit_price', 'total')) AS usable FROM m GROUP BY k),
    wide AS (SELECT k, any_value(sheet) AS sheet, any_value(row) AS row, any_value(depth) AS depth, count(*) AS columns FROM lab GROUP BY k),
    best AS (SELECT sheet, arg_max(k, matched * 1000000 - depth * 10000 - row) AS k FROM cand JOIN wide USING (k) WHERE usable AND matched >= 3 AND columns >= 3 GROUP BY sheet),
    head AS (SELECT b.sheet, b.k, w.row AS header_row, w.depth, c.matched FROM best b JOIN wide w USING (k) JOIN cand c USING (k))"""
_LOC = f""", rows_ AS (SELECT sheet, row, list(DISTINCT col) AS cols, bool_and({S.heading('text')} IN ({', '.join(S.lit(s) for w in L.SYNONYMS.values() for s in w)})) AS words FROM cells WHERE {S.strip('text')} <> '' GROUP BY sheet, row),
    cols_ AS (SELECT k, list(col) AS mapped FROM m GROUP BY k),
    loc AS (SELECT h.*, coalesce((SELECT min(r.row) FROM rows_ r JOIN cols_ c ON c.k = h.k WHERE r.sheet = h.sheet AND r.row >= h.header_row + h.depth AND NOT r.words AND list_has_any(r.cols, c.mapped)), h.header_row + h.depth) AS first_data_row FROM head h)"""
_FIELDS = ", ".join(f"coalesce(max({S.strip('c.text')}) FILTER (m.field = {S.lit(f)}), '') AS {f}" for f in L.SYNONYMS)


def _number_sql(f: str) -> str:
    """CTEs that parse the texts of one field of `open_`."""
    steps = S.decimal_steps(f"SELECT DISTINCT {f} AS text FROM open_")
    for i in (4, 3, 2, 1):
        steps = steps.replace(f"n{i} ", f"{f}{i} ").replace(f"FROM n{i}", f"FROM {f}{i}")
    return steps


_NUMBERS = ("qty", "unit_price", "discount", "discounted_price", "total")
_ITEMS_SQL = f""", f AS (SELECT c.sheet, c.row, {_FIELDS} FROM cells c JOIN loc l ON l.sheet = c.sheet AND c.row >= l.first_data_row LEFT JOIN m ON m.k = l.k AND m.col = c.col GROUP BY c.sheet, c.row),
    st AS (SELECT *, min(CASE WHEN (CASE WHEN ref <> '' THEN ref ELSE description END) <> '' AND {S.ends_items("CASE WHEN ref <> '' THEN ref ELSE description END")} THEN row END) OVER (PARTITION BY sheet) AS cut FROM f),
    open_ AS (SELECT * FROM st WHERE cut IS NULL OR row < cut), {", ".join(_number_sql(f) for f in _NUMBERS)},
    vals AS (SELECT o.sheet, o.row, substr(o.ref, 1, 120) AS ref, substr(o.description, 1, 400) AS description, {", ".join(f"{f}4.value AS {f}" for f in _NUMBERS)} FROM open_ o {" ".join(f"LEFT JOIN {f}4 ON {f}4.text = o.{f}" for f in _NUMBERS)}),
    items AS (SELECT sheet, row, ref, description, qty, unit_price, discount, discounted_price, CAST(CASE WHEN total <> 0 THEN CAST(total AS DECIMAL(37,8)) ELSE CAST(qty * CASE WHEN discounted_price <> 0 THEN discounted_price ELSE unit_price END AS DECIMAL(37,8)) END AS DECIMAL(37,8)) AS total
      FROM vals WHERE (ref <> '' OR description <> '') AND (unit_price IS NOT NULL OR total IS NOT NULL OR discounted_price IS NOT NULL))"""
_ALL = f"WITH {SHEETS}, {_COMP}, {_SPEC}{_MAP}{_LOC}"


@query("page_lines", f"WITH {SHEETS}, {_LINES} SELECT sheet, CAST(row AS INTEGER) AS row, line FROM lines")
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a sheet as lines of text."""
    return Q.row_lines(sheets(spark, sf))


@query("hdr_composite", f"WITH {SHEETS}, {_COMP} SELECT sheet, row, depth, CAST(col AS INTEGER) AS col, text FROM comp")
def hdr_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Column texts of every one to three stacked rows."""
    return Q.composite_headings(sheets(spark, sf))


@query("hdr_score", f"WITH {SHEETS}, {_COMP}, {_SPEC}{_MAP} SELECT w.sheet, w.row, w.depth, CAST(c.matched AS INTEGER) AS matched, c.usable FROM cand c JOIN wide w USING (k)")
def hdr_score(spark: SparkSession, sf: str) -> DataFrame:
    """How many fields each possible heading places, and whether the mapping is usable."""
    scored = Q.claim_columns(Q.composite_headings(sheets(spark, sf)), ["sheet", "row", "depth"]).where("matched > 0")
    return scored.select("sheet", "row", "depth", "matched", Q.usable(F.col("mapping")).alias("usable"))


@query("hdr_best", f"{_ALL} SELECT h.sheet, h.header_row AS row, h.depth, m.field, CAST(m.col AS INTEGER) AS col FROM head h JOIN m USING (k)")
def hdr_best(spark: SparkSession, sf: str) -> DataFrame:
    """The most credible heading of each sheet and its column mapping."""
    return Q.find_headers(sheets(spark, sf)).select("sheet", "row", "depth", F.explode("mapping").alias("field", "col"))


@query("hdr_claims", f"WITH lab AS (SELECT loc_id AS k, CAST(generate_subscripts(column_heads, 1) - 1 AS INTEGER) AS col, unnest(column_heads) AS text FROM table_locations), lab2 AS (SELECT k, col, {S.heading('text')} AS label FROM lab WHERE text IS NOT NULL), spec AS (" + " UNION ALL ".join(f"SELECT k, col, {S.lit(f)} AS field, {S.specificity('label', f)} AS spec FROM lab2" for f in L.CLAIM_ORDER) + f"), {S.claims('spec', 'k')}" + " SELECT k AS loc_id, field, col FROM (" + " UNION ALL ".join(f"SELECT * FROM claim_{i}" for i in range(len(L.CLAIM_ORDER))) + ")")
def hdr_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Column mapping of the headings in table_locations by the English wordings."""
    heads = table(spark, sf, "table_locations").select("loc_id", F.posexplode("column_heads").alias("col", "text")).where("text is not null")
    return Q.claim_columns(heads, ["loc_id"]).select("loc_id", F.explode("mapping").alias("field", "col"))


@query("tbl_locate", f"{_ALL} SELECT sheet, header_row, depth, CAST(matched AS INTEGER) AS matched, CAST(first_data_row AS INTEGER) AS first_data_row FROM loc")
def tbl_locate(spark: SparkSession, sf: str) -> DataFrame:
    """Where the table of each sheet begins."""
    return _located(spark, sf)[1].select("sheet", "header_row", "depth", "matched", "first_data_row")


@query("quote_items", f"{_ALL}{_ITEMS_SQL} SELECT sheet, CAST(row AS INTEGER) AS row, ref, description, qty, unit_price, discount, discounted_price, total FROM items")
def quote_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of all sheets as exact decimals."""
    cells, located = _located(spark, sf)
    return Q.extract_items(cells, located)


@query("quote_batch", f"{_ALL}{_ITEMS_SQL} SELECT count(DISTINCT sheet) AS sheets, count(*) AS items, sum(total) AS total FROM items")
def quote_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with items, items and their sum."""
    cells, located = _located(spark, sf)
    items = Q.extract_items(cells, located)
    return items.agg(F.countDistinct("sheet").alias("sheets"), F.count("*").alias("items"), F.sum("total").cast("decimal(38,8)").alias("total"))


@query("quote_warnings", f"{_ALL}{_ITEMS_SQL} SELECT sheet, 'no table found' AS warning FROM (SELECT DISTINCT sheet FROM cells) WHERE sheet NOT IN (SELECT sheet FROM loc) UNION ALL SELECT sheet, 'no line items' FROM loc WHERE sheet NOT IN (SELECT sheet FROM items)")
def quote_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets that need a look."""
    cells, located = _located(spark, sf)
    return Q.warnings(cells, written(Q.extract_items(cells, located), "items"), located)


@query("quote_header")
def quote_header(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier, date, currency and reference read from the sheets."""
    return Q.extract_headers(sheets(spark, sf))


@query("quote_currency", f"""WITH {SHEETS}, {_LINES}, c AS (SELECT sheet, row, {S.currency('line')} AS currency FROM lines)
    SELECT s.sheet, coalesce((SELECT arg_min(currency, row) FROM c WHERE c.sheet = s.sheet AND currency <> '' AND c.row IN (SELECT row FROM lines l WHERE l.sheet = s.sheet ORDER BY row LIMIT 40)), '') AS currency FROM (SELECT DISTINCT sheet FROM lines) s""")
def quote_currency(spark: SparkSession, sf: str) -> DataFrame:
    """Currency of each sheet from its first forty lines."""
    return Q.extract_headers(sheets(spark, sf)).select("sheet", "currency")


@query("prompt_rows", f"WITH {SHEETS} SELECT sheet, string_agg(line, chr(10) ORDER BY row) AS prompt FROM (SELECT sheet, row, string_agg('r' || row || 'c' || col || ': ' || substr(text, 1, 60), ' | ' ORDER BY col) AS line FROM cells WHERE row < 60 GROUP BY sheet, row) GROUP BY sheet")
def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet as text for a model: sixty rows, sixty characters a cell."""
    named = F.concat(F.lit("r"), F.col("row"), F.lit("c"), F.col("col"), F.lit(": "), F.substring("text", 1, 60))
    joined = lambda key, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("v")))), lambda x: x["v"]), sep)
    rows = sheets(spark, sf).where("row < 60").groupBy("sheet", "row").agg(joined("col", named, " | ").alias("line"))
    return rows.groupBy("sheet").agg(joined("row", F.col("line"), "\n").alias("prompt"))
