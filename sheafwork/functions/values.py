"""Numbers, dates, currencies and labels in quote text, and the typing of cell texts, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What counts as white space, for both Java and RE2 patterns.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
# Currency codes in alphabetical order, and symbols in order of precedence.
CODES = ("AED", "AUD", "BRL", "CAD", "CHF", "CNY", "EUR", "GBP", "INR", "JPY", "KES", "MUR", "NGN", "SGD", "USD", "ZAR")
SYMBOLS = (("$", "USD"), ("US$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₹", "INR"), ("¥", "JPY"), ("Rs", "MUR"), ("R$", "BRL"))
# Month names; the first three letters are the short names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DATE_SHAPE = r"([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|[0-9]{1,2}[ \t]+[A-Za-z]{3,9},?[ \t]+[0-9]{4}|[A-Za-z]{3,9}[ \t]+[0-9]{1,2},?[ \t]+[0-9]{4})"
NUM = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
SIGN = "[$£€¥₹]"
MAX_DIGITS = 15  #: more digits than a double holds do not survive the round trip and stay text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda over a one-element array, so nothing is written out twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces and stripped; null becomes ''."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def parse_decimal(text: Column) -> Column:
    """Quote number to DECIMAL(18,4), null where it is none; 1,234.50 and 1.234,50, (x) negative, % dropped.

    A lone comma is decimal before one or two last digits, else grouping; full-width digits count.
    """
    none = F.lit("")

    def clean_of(raw: Column) -> Column:
        bare = strip(F.regexp_replace(strip(F.regexp_replace(raw, r"^[()]+|[()]+$", "")), f"%{SPACE}*$", ""))
        return F.regexp_replace(bare, r"[^0-9.,\-()]", "")

    def number_of(clean: Column) -> Column:
        comma, dot = F.instr(clean, ","), F.instr(clean, ".")
        back = F.reverse(clean)
        as_dot = lambda c: F.replace(c, F.lit(","), F.lit("."))
        return (
            F.when(clean.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$"), as_dot(F.replace(clean, F.lit("."), none)))
            .when((comma > 0) & (dot > 0), F.when(F.instr(back, ".") < F.instr(back, ","), F.replace(clean, F.lit(","), none)).otherwise(as_dot(F.replace(clean, F.lit("."), none))))
            .when(comma > 0, F.when(F.length(F.substring_index(clean, ",", -1)).isin(1, 2), as_dot(clean)).otherwise(F.replace(clean, F.lit(","), none)))
            .otherwise(clean)
        )

    def value_of(number: Column) -> Column:
        return F.when(number.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("decimal(18,4)"))

    def whole(raw: Column) -> Column:
        sign = F.when(raw.startswith("(") & raw.endswith(")"), F.lit(-1)).otherwise(F.lit(1))
        return (let(let(clean_of(raw), number_of), value_of) * sign).cast("decimal(18,4)")

    return let(F.translate(strip(text), WIDE_DIGITS, DIGITS), whole)


def month_number(name: Column) -> Column:
    """1 to 12 of a full or three-letter English month name in any case, else null."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.isin(m.lower(), m[:3].lower()), F.lit(i)) for i, m in enumerate(MONTHS, 1)])


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where it does not exist."""
    part = lambda c, n: F.lpad(c.cast("int").cast("string"), n, "0")
    return F.concat(part(year, 4), F.lit("-"), part(month, 2), F.lit("-"), part(day, 2)).try_cast("date")


def parse_date(text: Column, day_first: Column) -> Column:
    """Date of a whole text: ISO-like, spelled month, or day/month/year where the order is forced or `day_first` tells it."""
    return let(F.regexp_replace(strip(text), f"{SPACE}+", " "), lambda raw: _date_of(raw, day_first))


def _date_of(raw: Column, day_first: Column) -> Column:
    get = lambda p, i: F.nullif(F.regexp_extract(raw, p, i), F.lit(""))
    iso = r"^([0-9]{4})([-/.])([0-9]{1,2})[-/.]([0-9]{1,2})$"
    dmy, mdy, dash = r"^([0-9]{1,2}) ([A-Za-z]+),? ([0-9]{4})$", r"^([A-Za-z]+) ([0-9]{1,2}),? ([0-9]{4})$", r"^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{4})$"
    num = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})$"
    same = raw.rlike(r"^[0-9]+-[0-9]+-|^[0-9]+/[0-9]+/|^[0-9]+\.[0-9]+\.")
    a, b, y = (get(num, i).cast("int") for i in (1, 2, 3))
    first = F.when((a > 12) & (b <= 12), F.lit(True)).when((b > 12) & (a <= 12), F.lit(False)).otherwise(day_first)
    return F.coalesce(
        F.when(same, safe_date(get(iso, 1), get(iso, 3), get(iso, 4))),
        safe_date(get(dmy, 3), month_number(get(dmy, 2)), get(dmy, 1)),
        safe_date(get(mdy, 3), month_number(get(mdy, 1)), get(mdy, 2)),
        safe_date(get(dash, 3), month_number(get(dash, 2)), get(dash, 1)),
        F.when(first, safe_date(y, b, a)).when(~first, safe_date(y, a, b)),
    )


def find_date(text: Column, day_first: Column) -> Column:
    """The first substring with the shape of a date that is one."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DATE_SHAPE), 1)
    return F.get(F.filter(F.transform(found, lambda t: parse_date(t, day_first)), lambda d: d.isNotNull()), F.lit(0))


def date_votes(text: Column) -> Column:
    """Array of booleans: what each numeric date in a text says about day-first order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DATE_SHAPE), 1)
    num = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})$"

    def vote(t: Column) -> Column:
        a, b = (F.nullif(F.regexp_extract(t, num, i), F.lit("")).cast("int") for i in (1, 2))
        return F.when((a > 12) & (b <= 12), F.lit(True)).when((b > 12) & (a <= 12), F.lit(False))

    return F.filter(F.transform(found, vote), lambda v: v.isNotNull())


def detect_currency(text: Column) -> Column:
    """The alphabetically first currency code that stands as a word, else the first symbol in order of precedence, else ''."""
    upper = F.upper(text)
    codes = [F.when(upper.rlike(rf"(^|[^A-Z0-9_]){c}($|[^A-Z0-9_])"), F.lit(c)) for c in CODES]
    symbols = [F.when(F.contains(text, F.lit(s)), F.lit(c)) for s, c in SYMBOLS]
    return F.coalesce(*codes, *symbols, F.lit(""))


def has_leading_zero(number: Column) -> Column:
    """Whether the integer part is longer than one character and starts with 0 (an identifier, not a quantity)."""
    whole = F.substring_index(number, ".", 1)
    return (F.length(whole) > 1) & whole.startswith("0")


def numeric_pattern(number: Column) -> Column:
    """#,##0.00, 0.00 and the like by grouping and decimals of the source digits."""
    decimals = F.when(F.instr(number, ".") > 0, F.length(F.substring_index(number, ".", -1))).otherwise(0)
    base = F.when(F.instr(number, ",") > 0, F.lit("#,##0")).otherwise(F.lit("0"))
    return F.when(decimals > 0, F.concat(base, F.lit("."), F.repeat(F.lit("0"), decimals))).otherwise(base)


def infer_value(text: Column) -> Column:
    """struct(kind, num DECIMAL(28,8), date, number_format) of a cell text; text that would not display identically again stays text.

    Kinds are tried as percent, currency, accounting, date, number. Null and blank give kind 'blank'.
    """
    return let(strip(text), _infer)


def _infer(s: Column) -> Column:
    digits = F.length(F.regexp_replace(s, "[^0-9]", "")) <= MAX_DIGITS
    get = lambda p, i: F.regexp_extract(s, p, i)
    value = lambda n, neg: (F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(28,8)") * F.when(neg, -1).otherwise(1)).cast("decimal(28,8)")
    none, no_date = F.lit(None).cast("decimal(28,8)"), F.lit(None).cast("date")

    def out(kind: str, num: Column, date: Column, fmt: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), num.alias("num"), date.alias("date"), fmt.alias("number_format"))

    pct = rf"^(-?)({NUM})%$"
    n = get(pct, 2)
    percent = F.when(s.rlike(pct) & ~has_leading_zero(n) & digits & ((get(pct, 1) == "") | (value(n, F.lit(False)) != 0)), out("percent", (value(n, get(pct, 1) == "-") / 100).cast("decimal(28,8)"), no_date, F.concat(numeric_pattern(n), F.lit("%"))))

    pre, suf = rf"^(-?)({SIGN}|[A-Z]{{3}}{SPACE})({NUM})$", rf"^(-?)({NUM})({SIGN}|{SPACE}[A-Z]{{3}})$"
    pn, sn, q = get(pre, 3), get(suf, 2), F.lit('"')
    signed = lambda p, n: (get(p, 1) == "") | (value(n, F.lit(False)) != 0)
    prefix = F.when(s.rlike(pre) & ~has_leading_zero(pn) & digits & signed(pre, pn), out("currency", value(pn, get(pre, 1) == "-"), no_date, F.concat(q, get(pre, 2), q, numeric_pattern(pn))))
    suffix = F.when(s.rlike(suf) & ~has_leading_zero(sn) & digits & signed(suf, sn), out("currency", value(sn, get(suf, 1) == "-"), no_date, F.concat(numeric_pattern(sn), q, get(suf, 3), q)))

    par = rf"^\(({SIGN}?)({NUM})\)$"
    an, lead = get(par, 2), F.when(get(par, 1) != "", F.concat(q, get(par, 1), q)).otherwise("")
    body = F.concat(lead, numeric_pattern(an))
    account = F.when(s.rlike(par) & ~has_leading_zero(an) & digits & (value(an, F.lit(False)) != 0), out("accounting", value(an, F.lit(True)), no_date, F.concat(body, F.lit("_);("), body, F.lit(")"))))

    dmy, mdy, sl = r"^([1-9]|[1-3][0-9]) ([A-Z][a-z]+) ([0-9]{4})$", r"^([A-Z][a-z]+) ([1-9]|[1-3][0-9]), ([0-9]{4})$", r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"
    cased = lambda m: m.isin(*MONTHS, *[x[:3] for x in MONTHS])
    iso_date = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s.try_cast("date"))
    dmy_date = F.when(cased(get(dmy, 2)), safe_date(get(dmy, 3), month_number(get(dmy, 2)), get(dmy, 1)))
    mdy_date = F.when(cased(get(mdy, 1)), safe_date(get(mdy, 3), month_number(get(mdy, 1)), get(mdy, 2)))
    a, b = (F.nullif(get(sl, i), F.lit("")).cast("int") for i in (1, 2))
    eu, us = F.when((a > 12) & (b <= 12), safe_date(get(sl, 3), b, a)), F.when((b > 12) & (a <= 12), safe_date(get(sl, 3), a, b))
    spelled = lambda m, long, short: F.when(F.length(m) > 3, F.lit(long)).otherwise(F.lit(short))
    date = F.coalesce(
        F.when(iso_date.isNotNull(), out("date", none, iso_date, F.lit("yyyy-mm-dd"))), F.when(dmy_date.isNotNull(), out("date", none, dmy_date, spelled(get(dmy, 2), "d mmmm yyyy", "d mmm yyyy"))),
        F.when(mdy_date.isNotNull(), out("date", none, mdy_date, spelled(get(mdy, 1), "mmmm d, yyyy", "mmm d, yyyy"))), F.when(eu.isNotNull(), out("date", none, eu, F.lit("dd/mm/yyyy"))), F.when(us.isNotNull(), out("date", none, us, F.lit("mm/dd/yyyy"))),
    )
    plain = rf"^(-?)({NUM})$"
    mn = get(plain, 2)
    number = F.when(s.rlike(plain) & ~has_leading_zero(mn) & digits & signed(plain, mn), out("number", value(mn, get(plain, 1) == "-"), no_date, numeric_pattern(mn)))
    blank = F.when(F.coalesce(s, F.lit("")) == "", out("blank", none, no_date, F.lit("General")))
    return F.coalesce(blank, percent, prefix, suffix, account, date, number, out("text", none, no_date, F.lit("General")))


def fixed(value: Column, pattern: Column) -> Column:
    """A non-negative decimal with the decimals and grouping of a pattern, by string arithmetic."""
    decimals = F.when(F.instr(pattern, ".") > 0, F.length(F.substring_index(pattern, ".", -1))).otherwise(0)
    whole, rest = F.substring_index(value.cast("string"), ".", 1), F.substring_index(value.cast("string"), ".", -1)
    grouped = F.when(pattern.startswith("#"), F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")).otherwise(whole)
    return F.when(decimals > 0, F.concat(grouped, F.lit("."), F.substring(rest, F.lit(1), decimals))).otherwise(grouped)


def display_string(kind: Column, num: Column, date: Column, fmt: Column, text: Column) -> Column:
    """What a spreadsheet shows for a typed value."""
    literal, body = F.regexp_extract(fmt, '"([^"]*)"', 1), F.regexp_replace(fmt, '"[^"]*"', "")
    size, minus = F.abs(num), F.when(num < 0, F.lit("-")).otherwise(F.lit(""))
    day = F.day(date).cast("string")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(date))
    shown = F.replace(F.replace(F.replace(fmt, F.lit("yyyy"), F.lpad(F.year(date).cast("string"), 4, "0")), F.lit("mmmm"), F.lit("\u0001")), F.lit("mmm"), F.lit("\u0002"))
    shown = F.replace(F.replace(shown, F.lit("mm"), F.lpad(F.month(date).cast("string"), 2, "0")), F.lit("dd"), F.lpad(day, 2, "0"))
    shown = F.replace(F.replace(F.replace(shown, F.lit("d"), day), F.lit("\u0001"), name), F.lit("\u0002"), F.substring(name, 1, 3))
    open_ = F.regexp_replace(F.substring_index(body, ";", 1), r"_\)", "")
    return (
        F.when(kind == "percent", F.concat(minus, fixed((size * 100).cast("decimal(28,8)"), F.regexp_replace(body, "%$", "")), F.lit("%")))
        .when(kind == "accounting", F.when(num < 0, F.concat(F.lit("("), literal, fixed(size, open_), F.lit(")"))).otherwise(F.concat(literal, fixed(size, open_))))
        .when(kind == "currency", F.when(fmt.startswith('"'), F.concat(minus, literal, fixed(size, body))).otherwise(F.concat(minus, fixed(size, body), literal)))
        .when(kind == "number", F.concat(minus, fixed(size, body)))
        .when(kind == "date", shown)
        .otherwise(F.coalesce(text, F.lit("")))
    )
