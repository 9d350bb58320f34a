"""Pieces of DuckDB SQL that the checks share, written apart from the Catalyst expressions they check."""

from __future__ import annotations

from sheafwork.functions.labels import CLAIM_ORDER, SYNONYMS, TOTAL_MARKERS
from sheafwork.functions.values import CODES, DATE_SHAPE, MONTHS, SPACE, SYMBOLS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g')")


def get(x: str, pattern: str, i: int) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {i})"


def decimal_steps(source: str, key: str = "text") -> str:
    """CTEs n1..n4 over a relation with a column `key`: n4 has key and value DECIMAL(18,4)."""
    return f"""
    n1 AS (SELECT {key}, translate({strip(key)}, '０１２３４５６７８９', '0123456789') AS r FROM ({source})),
    n2 AS (SELECT {key}, r, (starts_with(r, '(') AND ends_with(r, ')')) AS neg,
            regexp_replace({strip("regexp_replace(" + strip("regexp_replace(r, '^[()]+|[()]+$', '', 'g')") + ", '%" + SPACE + "*$', '')")}, '[^0-9.,()-]', '', 'g') AS c FROM n1),
    n3 AS (SELECT {key}, neg, CASE
            WHEN regexp_matches(c, '^-?[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+$') THEN replace(replace(c, '.', ''), ',', '.')
            WHEN contains(c, ',') AND contains(c, '.') THEN CASE WHEN strpos(reverse(c), '.') < strpos(reverse(c), ',') THEN replace(c, ',', '') ELSE replace(replace(c, '.', ''), ',', '.') END
            WHEN contains(c, ',') THEN CASE WHEN strpos(reverse(c), ',') IN (2, 3) THEN replace(c, ',', '.') ELSE replace(c, ',', '') END
            ELSE c END AS d FROM n2),
    n4 AS (SELECT {key}, CAST(CASE WHEN regexp_matches(d, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN TRY_CAST(d AS DECIMAL(18,4)) * CASE WHEN neg THEN -1 ELSE 1 END END AS DECIMAL(18,4)) AS value FROM n3)"""


def month(x: str) -> str:
    return f"nullif(list_position([{', '.join(lit(m[:3].lower()) for m in MONTHS)}], CASE WHEN lower({x}) IN ({', '.join(lit(s.lower()) for m in MONTHS for s in (m, m[:3]))}) THEN substr(lower({x}), 1, 3) END), 0)"


def date_of(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST(({m}) AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE)"


def parse_date(x: str, day_first: str) -> str:
    """x: an expression already stripped and with single spaces."""
    iso, dmy, mdy, dash = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", r"^([0-9]{1,2}) ([A-Za-z]+),? ([0-9]{4})$", r"^([A-Za-z]+) ([0-9]{1,2}),? ([0-9]{4})$", r"^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{4})$"
    num = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})$"
    a, b, y = (f"TRY_CAST({get(x, num, i)} AS INTEGER)" for i in (1, 2, 3))
    same = f"regexp_matches({x}, '^[0-9]+-[0-9]+-|^[0-9]+/[0-9]+/|^[0-9]+\\.[0-9]+\\.')"
    return f"""coalesce(CASE WHEN {same} THEN {date_of(get(x, iso, 1), get(x, iso, 2), get(x, iso, 3))} END,
      {date_of(get(x, dmy, 3), month(get(x, dmy, 2)), get(x, dmy, 1))}, {date_of(get(x, mdy, 3), month(get(x, mdy, 1)), get(x, mdy, 2))}, {date_of(get(x, dash, 3), month(get(x, dash, 2)), get(x, dash, 1))},
      CASE CASE WHEN {a} > 12 AND {b} <= 12 THEN true WHEN {b} > 12 AND {a} <= 12 THEN false ELSE {day_first} END WHEN true THEN {date_of(y, b, a)} WHEN false THEN {date_of(y, a, b)} END)"""


def currency(x: str) -> str:
    codes = " ".join(f"WHEN regexp_matches(upper({x}), '(^|[^A-Z0-9_]){c}($|[^A-Z0-9_])') THEN '{c}'" for c in CODES)
    symbols = " ".join(f"WHEN contains({x}, {lit(s)}) THEN '{c}'" for s, c in SYMBOLS)
    return f"CASE {codes} {symbols} ELSE '' END"


def heading(x: str) -> str:
    low = f"lower({squeeze(x)})"
    bare = f"regexp_replace({low}, '[（(][ \\t]*(usd|eur|gbp|mur|incl|excl)[^)）]*[)）]', ' ', 'g')"
    bare = f"regexp_replace({bare}, '\\b(usd|eur|gbp|mur|zar|inr|aed|vat|excl|incl)\\b', ' ', 'g')"
    return f"regexp_replace(regexp_replace({bare}, ' +', ' ', 'g'), '^[ .:\\-]+|[ .:\\-]+$', '', 'g')"


def specificity(label: str, field: str) -> str:
    import re

    hits = " ".join(f"WHEN {label} = {lit(s)} OR regexp_matches({label}, {lit(chr(92) + 'b' + re.escape(s) + chr(92) + 'b')}) THEN {len(s)}" for s in SYNONYMS[field])
    return f"CASE WHEN {label} = '' THEN NULL {hits} END"


def claims(spec: str, sheet: str) -> str:
    """CTEs claim_0.. that give each field, in claim order, the unclaimed column of the highest specificity; relation `spec` has sheet, col, field, spec."""
    parts = []
    for i, f in enumerate(CLAIM_ORDER):
        taken = " ".join(f"AND NOT EXISTS (SELECT 1 FROM claim_{j} t WHERE t.{sheet} = s.{sheet} AND t.col = s.col)" for j in range(i))
        parts.append(f"claim_{i} AS (SELECT {sheet}, {lit(f)} AS field, arg_min(col, (-spec) * 100000 + col) AS col FROM {spec} s WHERE field = {lit(f)} AND spec IS NOT NULL {taken} GROUP BY {sheet})")
    return ",\n".join(parts)


def ends_items(x: str) -> str:
    low = f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"regexp_matches({low}, '^({'|'.join(TOTAL_MARKERS)})')"


SHAPE = lit(DATE_SHAPE)
ONCE = "SELECT cell_id, arg_max(struct_pack(doc_id := doc_id, page_number := page_number, ord := ord, row_idx := row_idx, col_idx := col_idx, row_span := row_span, col_span := col_span, text := text, cell_role := cell_role, number_format := number_format, bbox := bbox, style := style, source := source, confidence := confidence), loaded_at) AS c FROM grid_cells GROUP BY cell_id"
CELLS = f"SELECT cell_id, c.doc_id, c.page_number, c.ord, c.row_idx, c.col_idx, c.row_span, c.col_span, c.text, c.cell_role, c.number_format, c.bbox, c.style, c.source, c.confidence FROM ({ONCE})"
TEXTS = "SELECT DISTINCT text FROM grid_cells WHERE text IS NOT NULL"
