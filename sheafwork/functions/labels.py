"""Headings, labels, titles, fonts and colours as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from sheafwork.functions.values import SPACE, let, squeeze, strip

# Heading wordings per template field, in list order.
SYNONYMS = {
    "ref": ("ref / code", "ref/code", "part number", "part no", "item code", "product code", "sku", "article", "reference", "ref", "code", "item no", "material", "mpn"),
    "description": ("description", "product description", "item description", "details", "product", "item", "designation", "particulars"),
    "qty": ("quantity", "qty", "units", "no. of units", "nos", "pcs"),
    "unit_price": ("list price", "unit price", "rate", "price each", "unit cost", "gross price", "u/price", "price"),
    "discount": ("disc %", "discount %", "discount", "disc", "rebate", "less"),
    "discounted_price": ("discounted price", "net price", "net unit price", "net rate", "price after discount", "net"),
    "total": ("total price", "line total", "extended price", "amount", "total", "sub total", "subtotal", "value"),
}
#: Fields by falling length of their longest wording; equal lengths keep list order.
CLAIM_ORDER = tuple(sorted(SYNONYMS, key=lambda f: -max(map(len, SYNONYMS[f]))))
_WORDS = "|".join(sorted({w for words in SYNONYMS.values() for s in words for w in re.findall("[a-z]+", s)}))
# Beginnings of the labels that end the line items.
TOTAL_MARKERS = ("total", "subtotal", "sub total", "grand total", "vat", "tax", "shipping", "delivery charge", "amount due", "balance", "net total", "total due")
# Full-width and typographic punctuation and its ASCII form.
WIDE, NARROW = "，。：；！？（）％＄－＝＋＃＠‘’“”　", ",.:;!?()%$-=+#@''\"\" "
# Style words at the end of font names, in the order they are cut, and families by their letters.
BOLD_WORDS, ITALIC_WORDS = ("bold", "black", "heavy", "semibold", "demibold", "extrabold"), ("italic", "oblique")
FAMILIES = {"helvetica": "Arial", "arial": "Arial", "times": "Times New Roman", "timesnewroman": "Times New Roman", "timesroman": "Times New Roman", "courier": "Courier New", "couriernew": "Courier New", "symbol": "Symbol", "zapfdingbats": "Wingdings"}


def heading(text: Column) -> Column:
    """Heading in lower case without bracketed currency, currency and tax words, and marks at its ends."""
    low = F.lower(squeeze(text))
    bare = F.regexp_replace(low, r"[（(][ \t]*(usd|eur|gbp|mur|incl|excl)[^)）]*[)）]", " ")
    bare = F.regexp_replace(bare, r"\b(usd|eur|gbp|mur|zar|inr|aed|vat|excl|incl)\b", " ")
    return F.regexp_replace(F.regexp_replace(bare, " +", " "), r"^[ .:\-]+|[ .:\-]+$", "")


def specificity(label: Column, field: str) -> Column:
    """Length of the first wording of a field, in list order, that a normal heading equals or contains as words; null if none."""
    return let(label, lambda label: F.when(label != "", F.coalesce(*[F.when((label == s) | label.rlike(rf"\b{re.escape(s)}\b"), F.lit(len(s))) for s in SYNONYMS[field]])))


def may_be_heading(text: Column) -> Column:
    """Whether a text holds any word of any wording; one cheap test that no heading fails."""
    return text.rlike(rf"(?i)\b(?:{_WORDS})\b")


def looks_like_heading(label: Column) -> Column:
    """Whether a normal heading equals a wording of any field."""
    return label.isin(*[s for words in SYNONYMS.values() for s in words])


def ends_items(text: Column) -> Column:
    """Whether the letters of a text begin with a marker of totals."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z ]", " "), " +", " "))
    return low.rlike("^(" + "|".join(TOTAL_MARKERS) + ")")


def strip_furniture(line: Column) -> Column:
    """A line without 'Page n of m'."""
    return strip(F.regexp_replace(line, rf"(?i){SPACE}*page{SPACE}+[0-9]+{SPACE}*(of|/){SPACE}*[0-9]+{SPACE}*", " "))


def fold_ocr(text: Column) -> Column:
    """Full-width punctuation folded to ASCII, white space collapsed."""
    return squeeze(F.translate(text, WIDE, NARROW))


def labelled(line: Column, label: str) -> Column:
    """The value after a label up to the next label of the line; null where there is none."""
    value = F.regexp_extract(line, rf"(?i){re.escape(label)}{SPACE}*[:\-]?{SPACE}*(.+)", 1)
    cut = F.element_at(F.split(strip(value), rf"{SPACE}{{2,}}[A-Z][A-Za-z /]{{2,}}{SPACE}*:"), 1)
    return F.nullif(strip(cut), F.lit(""))


def sheet_title(text: Column) -> Column:
    """A title a workbook accepts: no []:*?/\\, no outer quotes, 31 characters, 'Sheet' if nothing is left."""
    bare = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "[]:*?/\\", "-------"), "^'+|'+$", "")
    return F.substring(F.coalesce(F.nullif(bare, F.lit("")), F.lit("Sheet")), 1, 31)


def column_label(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to three letters."""
    letter = lambda n: F.char(F.lit(65) + n.cast("int"))
    one, two = F.pmod(index, F.lit(26)), F.floor(index / 26) - 1
    three = F.floor((index - 702) / 676)
    return (
        F.when(index < 26, letter(one)).when(index < 702, F.concat(letter(two), letter(one)))
        .otherwise(F.concat(letter(three), letter(F.pmod(F.floor((index - 702) / 26), F.lit(26))), letter(F.pmod(index - 702, F.lit(26)))))
    )


def bare_font(name: Column) -> Column:
    """Font name without the tag of an embedded subset."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", "")


def font_bold(name: Column) -> Column:
    return F.lower(bare_font(name)).rlike("bold|black|heavy")


def font_italic(name: Column) -> Column:
    return F.lower(bare_font(name)).rlike("italic|oblique")


def font_family(name: Column) -> Column:
    """Family a spreadsheet knows: style cut off, known families by alias, CamelCase spaced, Calibri if nothing is left."""
    base = F.regexp_extract(bare_font(name), "^[^-,]*", 0)
    for word in (*BOLD_WORDS, *ITALIC_WORDS):
        base = F.regexp_replace(base, rf"(?i)(?<=.){word}$", "")
    key = F.regexp_replace(F.lower(base), "[^a-z]", "")
    known = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[key]
    spaced = strip(F.regexp_replace(base, "(?<=[a-z])(?=[A-Z])", " "))
    return F.coalesce(known, F.nullif(spaced, F.lit("")), F.lit("Calibri"))


def byte(value: Column) -> Column:
    """Colour component as 0..255, half-even rounding."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(value).cast("int")))


def component(value: Column) -> Column:
    """A component given as 0..1 or 0..255."""
    return byte(F.when(value > 1.0, value).otherwise(value * 255.0))


def hex_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%02X%02X%02X", component(r), component(g), component(b))


def hex_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    part = lambda v: byte(255.0 * (1.0 - v) * (1.0 - k))
    return F.format_string("%02X%02X%02X", part(c), part(m), part(y))


def near_white(color: Column, threshold: int = 248) -> Column:
    """Whether every channel of RRGGBB reaches the threshold; malformed text is not white."""
    channel = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    good = color.rlike("^[0-9A-Fa-f]{6}$")
    return F.coalesce(F.when(good, (channel(1) >= threshold) & (channel(3) >= threshold) & (channel(5) >= threshold)), F.lit(False))


def argb(color: Column) -> Column:
    return F.when(F.length(color) == 8, color).otherwise(F.concat(F.lit("FF"), F.lpad(color, 6, "0")))


def border_style(width: Column) -> Column:
    return F.when(width >= 2.5, "thick").when(width >= 1.2, "medium").otherwise("thin")
