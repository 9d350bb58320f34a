"""Queries of the scalar functions, over all different texts of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.functions import labels as L, values as V
from sheafwork.plans import sqltext as S
from sheafwork.plans.registry import Plans
from sheafwork.sources.tables import latest, table

plans = Plans()
QUERIES, ORACLE, query = plans.queries, plans.oracle, plans.query


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grid_cells").where("text is not null").select("text").distinct()


@query("num_parse", f"WITH {S.decimal_steps(S.TEXTS)} SELECT text, value FROM n4 WHERE value IS NOT NULL")
def num_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are a quote number, as exact decimals."""
    return texts(spark, sf).select("text", V.parse_decimal(F.col("text")).alias("value")).where("value is not null")


@query("num_derive_total", """
    SELECT item_id, CAST(CASE WHEN total <> 0 THEN total ELSE coalesce(CAST(CAST(qty AS DECIMAL(18,4)) * CAST(CASE WHEN discounted_price <> 0 THEN discounted_price ELSE unit_price END AS DECIMAL(18,4)) AS DECIMAL(37,8)), CAST(NULL AS DECIMAL(37,8))) END AS DECIMAL(37,8)) AS total
    FROM (SELECT item_id, unnest(arg_max(struct_pack(qty := qty, unit_price := unit_price, discounted_price := discounted_price, total := total), loaded_at)) FROM line_items GROUP BY item_id)""")
def num_derive_total(spark: SparkSession, sf: str) -> DataFrame:
    """A missing or zero total as quantity times the discounted, else the unit price (zero counts as missing in both)."""
    read = ("qty", "unit_price", "discounted_price", "total")
    once = latest(table(spark, sf, "line_items").select("item_id", *read, "loaded_at"), "item_id", "loaded_at", *read)
    price = F.when(F.col("discounted_price") != 0, F.col("discounted_price")).otherwise(F.col("unit_price"))
    total = F.when(F.col("total") != 0, F.col("total").cast("decimal(37,8)")).otherwise((F.col("qty") * price).cast("decimal(37,8)"))
    return once.select("item_id", total.alias("total"))


_NUM, _SIGN, _SPACE = V.NUM, V.SIGN, V.SPACE
_PCT, _PRE, _SUF = rf"^(-?)({_NUM})%$", rf"^(-?)({_SIGN}|[A-Z]{{3}}{_SPACE})({_NUM})$", rf"^(-?)({_NUM})({_SIGN}|{_SPACE}[A-Z]{{3}})$"
_PAR, _PLAIN = rf"^\(({_SIGN}?)({_NUM})\)$", rf"^(-?)({_NUM})$"
_DMY, _MDY, _SL = r"^([1-9]|[1-3][0-9]) ([A-Z][a-z]+) ([0-9]{4})$", r"^([A-Z][a-z]+) ([1-9]|[1-3][0-9]), ([0-9]{4})$", r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"


def _typed_sql(source: str) -> str:
    """CTEs whose last, `typed`, has text, kind, num, date, number_format."""
    zero = lambda n: f"(length(split_part({n}, '.', 1)) > 1 AND starts_with({n}, '0'))"
    val = lambda n, neg: f"CASE WHEN {neg} THEN -TRY_CAST(replace({n}, ',', '') AS DECIMAL(28,8)) ELSE TRY_CAST(replace({n}, ',', '') AS DECIMAL(28,8)) END"
    pat = lambda n: f"(CASE WHEN contains({n}, ',') THEN '#,##0' ELSE '0' END || CASE WHEN contains({n}, '.') THEN '.' || repeat('0', length(split_part({n}, '.', 2))) ELSE '' END)"
    few = f"length(regexp_replace(s, '[^0-9]', '', 'g')) <= {V.MAX_DIGITS}"
    nz = lambda sign, n: f"({sign} = '' OR {val(n, 'false')} <> 0)"
    cased = lambda m: f"{m} IN ({', '.join(S.lit(x) for mm in V.MONTHS for x in (mm, mm[:3]))})"
    g = lambda p, i: S.get("s", p, i)
    a, b = f"TRY_CAST({g(_SL, 1)} AS INTEGER)", f"TRY_CAST({g(_SL, 2)} AS INTEGER)"
    lead = f"CASE WHEN {g(_PAR, 1)} <> '' THEN '\"' || {g(_PAR, 1)} || '\"' ELSE '' END"
    return f"""t0 AS (SELECT text, {S.strip("text")} AS s FROM ({source})),
    t1 AS (SELECT text, s,
        CASE WHEN regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(s AS DATE) END AS d1,
        CASE WHEN {cased(g(_DMY, 2))} THEN {S.date_of(g(_DMY, 3), S.month(g(_DMY, 2)), g(_DMY, 1))} END AS d2,
        CASE WHEN {cased(g(_MDY, 1))} THEN {S.date_of(g(_MDY, 3), S.month(g(_MDY, 1)), g(_MDY, 2))} END AS d3,
        CASE WHEN {a} > 12 AND {b} <= 12 THEN {S.date_of(g(_SL, 3), b, a)} END AS d4, CASE WHEN {b} > 12 AND {a} <= 12 THEN {S.date_of(g(_SL, 3), a, b)} END AS d5,
        CASE WHEN s = '' THEN 'blank'
          WHEN regexp_matches(s, {S.lit(_PCT)}) AND NOT {zero(g(_PCT, 2))} AND {few} AND {nz(g(_PCT, 1), g(_PCT, 2))} THEN 'percent'
          WHEN regexp_matches(s, {S.lit(_PRE)}) AND NOT {zero(g(_PRE, 3))} AND {few} AND {nz(g(_PRE, 1), g(_PRE, 3))} THEN 'prefix'
          WHEN regexp_matches(s, {S.lit(_SUF)}) AND NOT {zero(g(_SUF, 2))} AND {few} AND {nz(g(_SUF, 1), g(_SUF, 2))} THEN 'suffix'
          WHEN regexp_matches(s, {S.lit(_PAR)}) AND NOT {zero(g(_PAR, 2))} AND {few} AND {val(g(_PAR, 2), 'false')} <> 0 THEN 'accounting'
          WHEN regexp_matches(s, {S.lit(_PLAIN)}) AND NOT {zero(g(_PLAIN, 2))} AND {few} AND {nz(g(_PLAIN, 1), g(_PLAIN, 2))} THEN 'number'
          ELSE 'text' END AS k FROM t0),
    typed AS (SELECT text,
        CASE WHEN k IN ('prefix', 'suffix') THEN 'currency' WHEN k IN ('number', 'text') AND coalesce(d1, d2, d3, d4, d5) IS NOT NULL THEN 'date' ELSE k END AS kind,
        CAST(CASE k WHEN 'percent' THEN CAST({val(g(_PCT, 2), g(_PCT, 1) + " = '-'")} / 100 AS DECIMAL(28,8)) WHEN 'prefix' THEN {val(g(_PRE, 3), g(_PRE, 1) + " = '-'")} WHEN 'suffix' THEN {val(g(_SUF, 2), g(_SUF, 1) + " = '-'")}
          WHEN 'accounting' THEN {val(g(_PAR, 2), 'true')} WHEN 'number' THEN {val(g(_PLAIN, 2), g(_PLAIN, 1) + " = '-'")} END AS DECIMAL(28,8)) AS num,
        CASE WHEN k IN ('number', 'text') THEN coalesce(d1, d2, d3, d4, d5) END AS date,
        CASE k WHEN 'percent' THEN {pat(g(_PCT, 2))} || '%' WHEN 'prefix' THEN '"' || {g(_PRE, 2)} || '"' || {pat(g(_PRE, 3))} WHEN 'suffix' THEN {pat(g(_SUF, 2))} || '"' || {g(_SUF, 3)} || '"'
          WHEN 'accounting' THEN {lead} || {pat(g(_PAR, 2))} || '_);(' || {lead} || {pat(g(_PAR, 2))} || ')' WHEN 'number' THEN {pat(g(_PLAIN, 2))} WHEN 'blank' THEN 'General'
          ELSE CASE WHEN d1 IS NOT NULL THEN 'yyyy-mm-dd' WHEN d2 IS NOT NULL THEN CASE WHEN length({g(_DMY, 2)}) > 3 THEN 'd mmmm yyyy' ELSE 'd mmm yyyy' END
            WHEN d3 IS NOT NULL THEN CASE WHEN length({g(_MDY, 1)}) > 3 THEN 'mmmm d, yyyy' ELSE 'mmm d, yyyy' END WHEN d4 IS NOT NULL THEN 'dd/mm/yyyy' WHEN d5 IS NOT NULL THEN 'mm/dd/yyyy' ELSE 'General' END END AS number_format
        FROM t1)"""


#: Numbers as printed in several notations, made from the amounts of the line items.
_PRINTED = """SELECT DISTINCT unnest([format('{:,.2f}', CAST(u AS DOUBLE)), CAST(CAST(u AS DECIMAL(18,2)) AS VARCHAR), '$' || format('{:,.2f}', CAST(u AS DOUBLE)), 'USD ' || CAST(CAST(u AS DECIMAL(18,2)) AS VARCHAR), '(' || format('{:,.2f}', CAST(u AS DOUBLE)) || ')', CAST(CAST(u AS DECIMAL(18,1)) AS VARCHAR) || '%', strftime(q, '%d/%m/%Y'), strftime(q, '%-d %B %Y'), strftime(q, '%b %-d, %Y'), strftime(q, '%Y-%m-%d')]) AS text
    FROM (SELECT CAST(unit_price AS DECIMAL(18,2)) AS u, quote_date AS q FROM line_items WHERE unit_price >= 1 AND quote_date IS NOT NULL)"""


def printed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "line_items").where("unit_price >= 1 and quote_date is not null").select(F.col("unit_price").cast("decimal(18,2)").alias("u"), F.col("quote_date").alias("q"))
    group, plain = F.format_number("u", 2), F.col("u").cast("string")
    forms = [group, plain, F.concat(F.lit("$"), group), F.concat(F.lit("USD "), plain), F.concat(F.lit("("), group, F.lit(")")), F.concat(F.col("u").cast("decimal(18,1)").cast("string"), F.lit("%")),
             F.date_format("q", "dd/MM/yyyy"), F.date_format("q", "d MMMM yyyy"), F.date_format("q", "MMM d, yyyy"), F.date_format("q", "yyyy-MM-dd")]
    return rows.select(F.explode(F.array(*forms)).alias("text")).distinct()


def _typed(df: DataFrame) -> DataFrame:
    return df.select("text", F.inline(F.array(V.infer_value(F.col("text")))))


@query("num_infer_typed", f"WITH {_typed_sql(S.TEXTS)} SELECT * FROM typed")
def num_infer_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Every different cell text with the kind, value and number format it is typed as."""
    return _typed(texts(spark, sf))


@query("num_infer_printed", f"WITH {_typed_sql(_PRINTED)} SELECT * FROM typed")
def num_infer_printed(spark: SparkSession, sf: str) -> DataFrame:
    """The same over amounts and dates printed in ten notations."""
    return _typed(printed(spark, sf))


@query("num_display_roundtrip", "SELECT text, number_format, text AS shown FROM (SELECT '' AS text, '' AS number_format) WHERE false")
def num_display_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose typed value would display differently: none."""
    every = _typed(texts(spark, sf).unionByName(printed(spark, sf)))
    shown = V.display_string(F.col("kind"), F.col("num"), F.col("date"), F.col("number_format"), V.strip(F.col("text")))
    return every.select("text", "number_format", shown.alias("shown")).where(F.col("shown") != V.strip(F.col("text")))


@query("pct_fraction", f"WITH {_typed_sql(_PRINTED)} SELECT text, num FROM typed WHERE kind = 'percent'")
def pct_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Percent texts as fractions."""
    return _typed(printed(spark, sf)).where("kind = 'percent'").select("text", "num")


@query("acct_negative", f"WITH {_typed_sql(_PRINTED)} SELECT text, num, number_format FROM typed WHERE kind = 'accounting'")
def acct_negative(spark: SparkSession, sf: str) -> DataFrame:
    """Accounting brackets as negative numbers."""
    return _typed(printed(spark, sf)).where("kind = 'accounting'").select("text", "num", "number_format")


@query("cur_detect", f"SELECT text, {S.currency('text')} AS currency FROM ({S.TEXTS})")
def cur_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Currency named in every different cell text."""
    return texts(spark, sf).select("text", V.detect_currency(F.col("text")).alias("currency"))


@query("date_parse", f"SELECT doc_id, {S.parse_date('x', 'day_first')} AS quote_date FROM (SELECT doc_id, day_first, regexp_replace({S.strip('quote_date')}, '{V.SPACE}+', ' ', 'g') AS x FROM quote_headers)")
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Printed quote dates that are a date and nothing else."""
    return table(spark, sf, "quote_headers").select("doc_id", V.parse_date(F.col("quote_date"), F.col("day_first")).alias("quote_date"))


@query("date_find", f"""
    WITH f AS (SELECT cell_id, text, unnest(regexp_extract_all(text, {S.SHAPE}, 1)) AS x, generate_subscripts(regexp_extract_all(text, {S.SHAPE}, 1), 1) AS i FROM ({S.CELLS}) WHERE text IS NOT NULL),
    p AS (SELECT cell_id, i, {S.parse_date('x', 'NULL')} AS d FROM (SELECT cell_id, i, regexp_replace(x, '[ \\t]+', ' ', 'g') AS x FROM f))
    SELECT cell_id, arg_min(d, i) AS found FROM p WHERE d IS NOT NULL GROUP BY cell_id""")
def date_find(spark: SparkSession, sf: str) -> DataFrame:
    """The first date inside each cell text, day order unknown."""
    cells = table(spark, sf, "grid_cells").where("text is not null").select("cell_id", "text").distinct()
    return cells.select("cell_id", V.find_date(F.col("text"), F.lit(None).cast("boolean")).alias("found")).where("found is not null")


_VOTE = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})$"


@query("date_vote", f"""
    WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, {S.SHAPE}, 1)) AS x FROM ({S.CELLS}) WHERE text IS NOT NULL),
    v AS (SELECT doc_id, TRY_CAST({S.get('x', _VOTE, 1)} AS INTEGER) AS a, TRY_CAST({S.get('x', _VOTE, 2)} AS INTEGER) AS b FROM f),
    w AS (SELECT DISTINCT doc_id, CASE WHEN a > 12 AND b <= 12 THEN true WHEN b > 12 AND a <= 12 THEN false END AS vote FROM v)
    SELECT doc_id, CASE WHEN count(vote) = 1 THEN bool_or(vote) END AS day_first FROM w GROUP BY doc_id HAVING count(vote) > 0""")
def date_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Day order that the dates of a document agree on; null where they contradict each other."""
    votes = table(spark, sf, "grid_cells").where("text is not null").select("doc_id", F.explode(V.date_votes(F.col("text"))).alias("vote"))
    agreed = votes.groupBy("doc_id").agg(F.min("vote").alias("a"), F.max("vote").alias("b"))
    return agreed.select("doc_id", F.when(F.col("a") == F.col("b"), F.col("a")).alias("day_first"))


_ROLES = "('heading', 'remark', 'body', 'total')"


@query("hdr_normalise", f"SELECT DISTINCT text, {S.heading('text')} AS heading FROM grid_cells WHERE cell_role = 'heading' AND text IS NOT NULL")
def hdr_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Headings without units, currencies and marks."""
    return table(spark, sf, "grid_cells").where("cell_role = 'heading' and text is not null").select("text").distinct().select("text", L.heading(F.col("text")).alias("heading"))


@query("hdr_looks", f"SELECT text FROM ({S.TEXTS}) WHERE {S.heading('text')} IN ({', '.join(S.lit(s) for w in L.SYNONYMS.values() for s in w)})")
def hdr_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that equal a heading wording."""
    return texts(spark, sf).where(L.looks_like_heading(L.heading(F.col("text"))))


@query("term_cutoff", f"""
    WITH c AS ({S.CELLS}), first AS (SELECT doc_id, page_number, row_idx, arg_min(text, col_idx) AS text FROM c WHERE trim(coalesce(text, '')) <> '' GROUP BY doc_id, page_number, row_idx)
    SELECT doc_id, page_number, min(row_idx) AS cut FROM first WHERE {S.ends_items('text')} GROUP BY doc_id, page_number""")
def term_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of a page whose first text begins like a total."""
    cells = table(spark, sf, "grid_cells").where("trim(coalesce(text, '')) <> ''").select("doc_id", "page_number", "row_idx", "col_idx", "text")
    first = cells.groupBy("doc_id", "page_number", "row_idx").agg(F.min_by("text", "col_idx").alias("text"))
    return first.where(L.ends_items(F.col("text"))).groupBy("doc_id", "page_number").agg(F.min("row_idx").alias("cut"))


@query("ocr_fold", f"SELECT text, {S.squeeze('translate(text, ' + S.lit(L.WIDE) + ', ' + S.lit(L.NARROW) + ')')} AS folded FROM ({S.TEXTS})")
def ocr_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with ASCII punctuation and single spaces."""
    return texts(spark, sf).select("text", L.fold_ocr(F.col("text")).alias("folded"))


@query("furniture_strip", f"""
    SELECT line, {S.strip("regexp_replace(line, '(?i)" + V.SPACE + "*page" + V.SPACE + "+[0-9]+" + V.SPACE + "*(of|/)" + V.SPACE + "*[0-9]+" + V.SPACE + "*', ' ', 'g')")} AS stripped
    FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)""")
def furniture_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents without page numbering."""
    lines = table(spark, sf, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("line", L.strip_furniture(F.col("line")).alias("stripped"))


_LABEL = rf"(?i)LABEL{V.SPACE}*[:\-]?{V.SPACE}*(.+)"


@query("label_value", f"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    v AS (SELECT doc_id, i, k, nullif({S.strip("regexp_extract(" + S.strip('v') + ", '^(.*?)(" + V.SPACE + "{2,}[A-Z][A-Za-z /]{2,}" + V.SPACE + "*:.*)?$', 1)")}, '') AS value FROM (
      SELECT doc_id, i, 0 AS k, {S.get('line', _LABEL.replace('LABEL', 'Quotation'), 1)} AS v FROM l UNION ALL SELECT doc_id, i, 1, {S.get('line', _LABEL.replace('LABEL', 'request'), 1)} FROM l UNION ALL SELECT doc_id, i, 2, {S.get('line', _LABEL.replace('LABEL', 'file'), 1)} FROM l))
    SELECT doc_id, arg_min(value, i * 10 + k) AS value FROM v WHERE value IS NOT NULL GROUP BY doc_id""")
def label_value(spark: SparkSession, sf: str) -> DataFrame:
    """The first labelled value of each document, line before label."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), L.labelled(F.col("line"), label).alias("value")) for k, label in enumerate(("Quotation", "request", "file"))])
    found = lines.select("doc_id", "i", F.inline(each)).where("value is not null")
    return found.groupBy("doc_id").agg(F.min_by("value", F.struct("i", "k")).alias("value"))


@query("norm_same", f"SELECT {S.squeeze('text')} AS normal, count(*) AS texts FROM ({S.TEXTS}) GROUP BY 1 HAVING count(*) > 1")
def norm_same(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are equal but for white space."""
    return texts(spark, sf).groupBy(V.squeeze(F.col("text")).alias("normal")).agg(F.count("*").alias("texts")).where("texts > 1")


@query("sheet_title", "SELECT text, substr(coalesce(nullif(regexp_replace(translate(text, '[]:*?/\\', '-------'), '^''+|''+$', '', 'g'), ''), 'Sheet'), 1, 31) AS title FROM (" + S.TEXTS + ")")
def sheet_title(spark: SparkSession, sf: str) -> DataFrame:
    """Workbook titles made of texts."""
    return texts(spark, sf).select("text", L.sheet_title(F.col("text")).alias("title"))


@query("formula_guard", f"SELECT text FROM ({S.TEXTS}) WHERE substr(text, 1, 1) IN ('=', '+', '@')")
def formula_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Texts a workbook must be told are no formula."""
    return texts(spark, sf).where(F.substring("text", 1, 1).isin("=", "+", "@"))


@query("column_labels", """
    SELECT i, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(64 + i // 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER))
      ELSE chr(CAST(65 + (i - 702) // 676 AS INTEGER)) || chr(CAST(65 + ((i - 702) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (i - 702) % 26 AS INTEGER)) END AS label FROM (SELECT DISTINCT cell_id % 18278 AS i FROM grid_cells)""")
def column_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Column letters of indices."""
    cells = table(spark, sf, "grid_cells").select((F.col("cell_id") % 18278).alias("i")).distinct()
    return cells.select("i", L.column_label(F.col("i")).alias("label"))


@query("font_parse")
def font_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Family, bold and italic of every font name, as printed and with a subset tag and style."""
    names = table(spark, sf, "words").select("font_name").distinct()
    styled = names.select(F.explode(F.array("font_name", F.concat(F.lit("ABCDEF+"), "font_name", F.lit("-BoldOblique")), F.concat("font_name", F.lit("Bold")))).alias("font_name"))
    name = F.col("font_name")
    return styled.select("font_name", L.font_family(name).alias("family"), L.font_bold(name).alias("bold"), L.font_italic(name).alias("italic"))


@query("color_norm", """
    WITH w AS (SELECT word_id, word_id % 256 AS r, (word_id * 7) % 256 AS g, (word_id * 13) % 256 AS b FROM words)
    SELECT word_id, printf('%02X%02X%02X', r, g, b) AS packed, printf('%02X%02X%02X', CAST(round_even((r / 256.0) * 255.0, 0) AS INTEGER), CAST(round_even((g / 256.0) * 255.0, 0) AS INTEGER), CAST(round_even((b / 256.0) * 255.0, 0) AS INTEGER)) AS unit,
      printf('%02X%02X%02X', CAST(round_even(255.0 * (1.0 - r / 256.0) * (1.0 - b / 512.0), 0) AS INTEGER), CAST(round_even(255.0 * (1.0 - g / 256.0) * (1.0 - b / 512.0), 0) AS INTEGER), CAST(round_even(255.0 * (1.0 - b / 256.0) * (1.0 - b / 512.0), 0) AS INTEGER)) AS cmyk FROM w""")
def color_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Packed, unit-range and CMYK colours as RRGGBB (values made from word ids)."""
    i = F.col("word_id")
    w = table(spark, sf, "words").select("word_id", (i % 256).alias("r"), (i * 7 % 256).alias("g"), (i * 13 % 256).alias("b"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    packed = F.format_string("%06X", r * 65536 + g * 256 + b)
    return w.select("word_id", packed.alias("packed"), L.hex_rgb(r / 256, g / 256, b / 256).alias("unit"), L.hex_cmyk(r / 256, g / 256, b / 256, b / 512).alias("cmyk"))


@query("near_white", """
    SELECT color, count(*) AS words FROM (SELECT printf('%02X%02X%02X', 240 + word_id % 16, 240 + (word_id * 7) % 16, 240 + (word_id * 13) % 16) AS color FROM words)
    WHERE substr(color, 2, 1) >= '8' AND substr(color, 4, 1) >= '8' AND substr(color, 6, 1) >= '8' GROUP BY color""")
def near_white(spark: SparkSession, sf: str) -> DataFrame:
    """Colours that print as white."""
    i = F.col("word_id")
    colors = table(spark, sf, "words").select(F.format_string("%06X", (i % 16 + 240) * 65536 + (i * 7 % 16 + 240) * 256 + i * 13 % 16 + 240).alias("color"))
    return colors.where(L.near_white(F.col("color"))).groupBy("color").agg(F.count("*").alias("words"))


@query("border_weight", """
    SELECT style, count(*) AS edges FROM (SELECT CASE WHEN w >= 2.5 THEN 'thick' WHEN w >= 1.2 THEN 'medium' ELSE 'thin' END AS style FROM (SELECT (word_id % 31) / 10.0 AS w FROM words)) GROUP BY style""")
def border_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Border styles by stroke width."""
    return table(spark, sf, "words").select(L.border_style((F.col("word_id") % 31) / 10).alias("style")).groupBy("style").agg(F.count("*").alias("edges"))


@query("argb_color", "SELECT DISTINCT color, CASE WHEN length(color) = 8 THEN color ELSE 'FF' || lpad(color, 6, '0') END AS argb FROM words WHERE color IS NOT NULL")
def argb_color(spark: SparkSession, sf: str) -> DataFrame:
    """Colours with an opaque alpha channel."""
    return table(spark, sf, "words").where("color is not null").select("color").distinct().select("color", L.argb(F.col("color")).alias("argb"))
