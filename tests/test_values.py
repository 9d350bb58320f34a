import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import labels as L, values as V


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) or k == 'first' else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("1,234.50", "1234.50"), ("1.234,50", "1234.50"), ("1 234,50", "1234.50"), ("(980.00)", "-980"), ("32%", "32"), ("USD 40.00", "40"), ("40.00 USD", "40"), ("1,234", "1234"),
    ("12,5", "12.5"), ("1.234", "1.234"), ("-7", "-7"), ("n/a", None), ("", None), (None, None), ("-", None), ("1,234,56", None), ("USD (980.00)", None), ("１２", "12"), ("x" * 100_000, None),
])
def test_parse_decimal(spark, text, want):
    got = one(spark, V.parse_decimal(F.col("t")), t=text)
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("text", "first", "want"), [
    ("2026-03-14", None, dt.date(2026, 3, 14)), ("14 March 2026", None, dt.date(2026, 3, 14)), ("Mar 14, 2026", None, dt.date(2026, 3, 14)), ("14-Mar-2026", None, dt.date(2026, 3, 14)), ("27/07/2026", None, dt.date(2026, 7, 27)),
    ("05/06/2026", None, None), ("05/06/2026", True, dt.date(2026, 6, 5)), ("05/06/2026", False, dt.date(2026, 5, 6)), ("31/02/2026", True, None), ("9 septembre 2024", None, None), ("2026-13-01", None, None), ("", None, None), (None, None, None),
])
def test_parse_date(spark, text, first, want):
    assert one(spark, V.parse_date(F.col("t"), F.col("first")), t=text, first=first) == want


@pytest.mark.parametrize(("text", "kind", "fmt"), [
    ("1,234.50", "number", "#,##0.00"), ("007", "text", "General"), ("3.14159", "number", "0.00000"), ("12.5%", "percent", "0.0%"), ("12 %", "text", "General"), ("$1,200.00", "currency", '"$"#,##0.00'), ("$ 100", "text", "General"),
    ("MUR 1,200.00", "currency", '"MUR "#,##0.00'), ("ISO 9001", "currency", '"ISO "0'), ("100 USD", "currency", '0" USD"'), ("(1,234)", "accounting", "#,##0_);(#,##0)"), ("(0.00)", "text", "General"), ("-0", "text", "General"),
    ("2026-07-07", "date", "yyyy-mm-dd"), ("7 July 2026", "date", "d mmmm yyyy"), ("07 July 2026", "text", "General"), ("27 Jul 2026", "date", "d mmm yyyy"), ("27 jul 2026", "text", "General"), ("27/01/2026", "date", "dd/mm/yyyy"), ("1/27/2026", "text", "General"),
    ("01/02/2026", "text", "General"), ("", "blank", "General"), (None, "blank", "General"),
])
def test_infer(spark, text, kind, fmt):
    got = one(spark, V.infer_value(F.col("t")), t=text)
    assert (got.kind, got.number_format) == (kind, fmt)


@pytest.mark.parametrize(("text", "want"), [("USD 40", "USD"), ("40 EUR", "EUR"), ("$ 5", "USD"), ("R$ 5", "USD"), ("Rs 7", "MUR"), ("eurobond", ""), ("price in GBP and ZAR", "GBP"), ("", "")])
def test_currency(spark, text, want):
    assert one(spark, V.detect_currency(F.col("t")), t=text) == want


@pytest.mark.parametrize(("name", "want"), [("ABCDEF+Helvetica-BoldOblique", ("Arial", True, True)), ("OpenSans", ("Open Sans", False, False)), ("ArialBold", ("Arial", True, False)), ("TimesNewRoman,Italic", ("Times New Roman", False, True)), ("", ("Calibri", False, False)), (None, ("Calibri", False, False))])
def test_font(spark, name, want):
    got = one(spark, F.struct(L.font_family(F.col("t")).alias("a"), L.font_bold(F.col("t")).alias("b"), L.font_italic(F.col("t")).alias("c")), t=name)
    assert tuple(got) == want


def test_round_trip_of_typed_texts(spark):
    rng = random.Random(5)
    size = lambda: rng.choice(["0", "7", "12", "999", "1,234", "1234", "12,345,678", "007", "0,123"])
    texts = {rng.choice(["", "-"]) + rng.choice(["", "$", "€", "USD "]) + size() + rng.choice(["", ".5", ".00", ".125"]) + rng.choice(["", "%", " EUR", "€"]) for _ in range(3000)}
    texts |= {f"({t})" for t in list(texts)[:300]}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").select("t", F.inline(F.array(V.infer_value(F.col("t")))))
    bad = df.where(V.display_string(F.col("kind"), F.col("num"), F.col("date"), F.col("number_format"), F.col("t")) != F.col("t"))
    assert bad.collect() == [] and df.where("kind <> 'text'").count() > 100
