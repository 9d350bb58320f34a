import random

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import grid as G

# Declared contents of the test documents.
SIMPLE = dict(
    rows=[["Product", "Region", "Units", "Revenue"], ["Widget A", "North", "1,250", "18,750.00"], ["Widget B", "South", "980", "14,700.00"], ["Gadget C", "East", "2,415", "36,225.00"], ["Gadget D", "West", "760", "11,400.00"], ["Assembly E", "Central", "1,032", "15,480.00"]],
    widths=[150.0, 110.0, 90.0, 130.0], right=(2, 3),
)
INVOICE = dict(
    rows=[["ORDER DETAILS", "", "", ""], ["Category", "Description", "Qty", "Amount"], ["Fasteners", "Hex bolt M8", "1,000", "350.00"], ["", "Washer set", "500", "90.00"], ["Structural", "Steel bracket 40mm", "120", "1,500.00"], ["Logistics", "Delivery", "1", "250.00"], ["TOTAL DUE (MUR)", "", "", "2,190.00"]],
    widths=[110.0, 190.0, 70.0, 110.0], height=22.0, merges={(0, 0): (1, 4), (2, 0): (2, 1), (6, 0): (1, 3)}, right=(2, 3), centre={(0, 0)},
)
INVOICE_HEAD = [("ACME CORPORATION", 18.0), ("123 Industrial Way, Port Louis, Mauritius", 10.0), ("Invoice INV-1042 dated 27 July 2026", 10.0)]
BORDERLESS = dict(
    rows=[["Account", "Type", "Opened", "Balance"], ["Trading", "Current", "2019", "42,180.55"], ["Reserve", "Savings", "2021", "8,904.10"], ["Payroll", "Current", "2020", "15,326.00"], ["Escrow", "Fixed", "2022", "60,000.00"], ["Petty cash", "Current", "2023", "1,204.75"], ["Bond fund", "Fixed", "2018", "97,455.20"]],
    widths=[150.0, 120.0, 100.0, 110.0], height=19.0, ruled=False,
)
FIRST = dict(rows=[["Metric", "Q1", "Q2"], ["Orders shipped", "4,180", "5,067"], ["Average lead time", "3.4", "2.9"], ["Backorder rate", "0.07", "0.04"]], widths=[160.0] * 3, right=(1, 2))
SECOND = dict(rows=[["Depot", "Code", "Staff", "Capacity"], ["Port Louis", "PL01", "34", "12,000"], ["Curepipe", "CP02", "21", "8,400"], ["Grand Baie", "GB03", "17", "6,150"]], widths=[120.0] * 4, right=(2, 3))


class Page:
    """Draws declared blocks on an A4 page as words, rulings and images."""

    def __init__(self, doc):
        self.doc, self.top, self.words, self.rulings, self.images, self.rects = doc, 56.0, [], [], [], []

    def say(self, text, x, top, size, bold=False):
        for w in text.split():
            end = x + len(w) * size * 0.5
            self.words.append((self.doc * 1000 + len(self.words), self.doc, 1, len(self.words), w, x, top, end, top + size, "Helvetica", size, bold, False, "000000", "digital", 1.0))
            x = end + size * 0.28

    def text(self, text, size):
        self.say(text, 56.0, self.top, size)
        self.top += 1.35 * size + 18

    def image(self, width, height):
        self.images.append((self.doc, 1, len(self.images), 56.0, self.top, 56.0 + width, self.top + height))
        self.top += height + 18

    def table(self, rows, widths, height=20.0, size=9.5, ruled=True, merges={}, right=(), centre=(), fill=None):
        xs = [56.0 + sum(widths[:i]) for i in range(len(widths) + 1)]
        inner = {(r + i, c + j): (i, j) for (r, c), (a, b) in merges.items() for i in range(a) for j in range(b)}
        for r, row in enumerate(rows):
            for c, text in enumerate(row):
                top, (down, across) = self.top + r * height, merges.get((r, c), (1, 1))
                if ruled:
                    i, j = inner.get((r, c), (0, 0))
                    self.rulings += [(self.doc, 1, len(self.rulings), "h", top, xs[c], xs[c + 1], 0.75, "262626")] * (i == 0)
                    self.rulings += [(self.doc, 1, len(self.rulings) + 1, "v", xs[c], top, top + height, 0.75, "262626")] * (j == 0)
                width = sum(len(w) for w in text.split()) * size * 0.5 + max(0, len(text.split()) - 1) * size * 0.28
                low, high = xs[c], xs[c + across]
                x = high - 5 - width if c in right else (low + high - width) / 2 if (r, c) in centre else low + 5
                self.say(text, x, top + (down * height - size) / 2, size, r == 0)
        if ruled:
            end = self.top + len(rows) * height
            self.rulings += [(self.doc, 1, 900 + c, "h", end, xs[c], xs[c + 1], 0.75, "262626") for c in range(len(widths))]
            self.rulings += [(self.doc, 1, 950 + r, "v", xs[-1], self.top + r * height, self.top + (r + 1) * height, 0.75, "262626") for r in range(len(rows))]
        if fill:
            self.rects.append((self.doc, 1, 0, xs[0], self.top, xs[-1], self.top + height, fill))
        self.top += len(rows) * height + 18


def merged_rulings(rows):
    """Collinear touching segments as one, as the extraction delivers them."""
    out, lines = [], {}
    for d, p, o, kind, at, low, high, stroke, color in rows:
        lines.setdefault((d, p, kind, at, stroke, color), []).append((low, high))
    for (d, p, kind, at, stroke, color), spans in lines.items():
        spans = sorted(spans)
        while spans:
            low, high = spans.pop(0)
            while spans and spans[0][0] <= high + 1:
                high = max(high, spans.pop(0)[1])
            out.append((d, p, len(out), kind, at, low, high, stroke, color))
    return out


def pages(spark, *drawn):
    make = lambda rows, schema: spark.createDataFrame(rows, "doc_id bigint, page_number int, " + schema)
    words = spark.createDataFrame(sum((p.words for p in drawn), []), "word_id bigint, doc_id bigint, page_number int, ord int, text string, x0 double, top double, x1 double, bottom double, font_name string, font_size double, bold boolean, italic boolean, color string, source string, confidence double")
    rulings = make(merged_rulings(sum((p.rulings for p in drawn), [])), "ord int, orientation string, position double, low double, high double, stroke double, color string")
    rects = make(sum((p.rects for p in drawn), []), "ord int, x0 double, top double, x1 double, bottom double, fill string")
    images = make(sum((p.images for p in drawn), []), "ord int, x0 double, top double, x1 double, bottom double")
    return G.Pages(make([(p.doc, 1, 595.28, 841.89) for p in drawn], "width double, height double"), words, rulings, rects, images)


def wanted(table, row, cols=None):
    merges = table.get("merges", {})
    cols = cols or list(range(len(table["widths"]) + 1))
    for r, texts in enumerate(table["rows"]):
        for c, text in enumerate(texts):
            if text:
                down, across = merges.get((r, c), (1, 1))
                yield (row + r, cols[c], text, down, cols[c + across] - cols[c])


@pytest.fixture(scope="module")
def sheets(spark):
    simple, invoice, open_, multi = (Page(i) for i in (1, 2, 3, 4))
    simple.table(**SIMPLE, fill="1F3864")
    for text, size in INVOICE_HEAD:
        invoice.text(text, size)
    invoice.table(**INVOICE)
    open_.table(**BORDERLESS)
    multi.text("QUARTERLY OPERATIONS", 14.0)
    multi.image(96.0, 42.0)
    multi.table(**FIRST)
    multi.text("Regional breakdown", 11.0)
    multi.table(**SECOND)
    p = pages(spark, simple, invoice, open_, multi)
    cells, bounds = G.sheet_cells(p)
    return cells, bounds, p, G.styled(cells, bounds, p).collect()


def found(sheets, doc):
    return sorted((r.row_idx, r.col_idx, r.text, r.row_span, r.col_span) for r in sheets[0].where(F.col("doc_id") == doc).collect())


def test_simple_table(sheets):
    assert found(sheets, 1) == sorted(wanted(SIMPLE, 0))
    cols = sheets[1].where("doc_id = 1").first().cols
    assert [b - a for a, b in zip(cols, cols[1:])] == pytest.approx(SIMPLE["widths"])


def test_merged_invoice(sheets):
    got = found(sheets, 2)
    assert [g for g in got if g[0] >= 3] == sorted(wanted(INVOICE, 3))
    assert [(g[0], g[1], g[2]) for g in got if g[0] < 3] == [(i, 0, t) for i, (t, _) in enumerate(INVOICE_HEAD)]


def test_borderless_table(sheets):
    assert found(sheets, 3) == sorted(wanted(BORDERLESS, 0))


def test_two_tables_and_an_image(sheets):
    got = found(sheets, 4)
    # edges at 0, 120, 160, 240, 320, 360 and 480 points from the left: both tables share one grid
    assert [g for g in got if 2 <= g[0] < 6] == sorted(wanted(FIRST, 2, [0, 2, 4, 6]))
    assert [g for g in got if g[0] >= 7] == sorted(wanted(SECOND, 7, [0, 1, 3, 5, 6]))


def test_styles(sheets):
    rows = {(r.doc_id, r.row_idx, r.col_idx): r for r in sheets[3]}
    for r in range(6):
        for c in range(4):
            cell = rows[1, r, c]
            assert all(cell.borders[s].style == "thin" and cell.borders[s].color == "262626" for s in ("left", "right", "top", "bottom"))
            assert cell.fill == ("1F3864" if r == 0 else None) and cell.h_align == ("right" if c in (2, 3) else "left") and cell.v_align == "center"
    assert rows[2, 3, 0].h_align == "center" and rows[3, 0, 0].borders is None
    # every slot of the table is covered by a cell or its span; the slots above it share its upper border
    assert {(r.row_idx, r.borders.bottom.style) for r in sheets[3] if r.doc_id == 2 and r.text == ""} == {(2, "thin")}
    assert rows[2, 5, 0].row_span == 2 and rows[2, 9, 0].col_span == 3


def test_decorated_blanks_and_empty_pages(spark):
    p = Page(7)
    p.table(rows=[["A", "B"], ["C", ""], ["", "D"]], widths=[100.0, 100.0])
    made = pages(spark, p, Page(8))
    cells, bounds = G.sheet_cells(made)
    out = {(r.row_idx, r.col_idx): r for r in G.styled(cells, bounds, made).collect()}
    assert set(out) == {(r, c) for r in range(3) for c in range(2)} and out[1, 1].text == "" and out[1, 1].made and out[2, 0].borders.left.style == "thin"
    none = G.Pages(*(df.where("false") for df in (made.pages, made.words, made.rulings, made.rects, made.images)))
    assert G.sheet_cells(none)[0].count() == 0 and G.styled(*G.sheet_cells(none), none).count() == 0


def test_bands(spark):
    def bands(*rows):
        return F.array(*[G._band(*[F.lit(x) for x in r]) for r in rows])

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    merged = one(G.merged_bands(bands((30.0, 40.0, False, False), (0.0, 20.0, True, True), (10.0, 31.0, False, False), (50.0, 60.0, True, True))))
    assert [tuple(b) for b in merged] == [(0.0, 31.0, True, False), (30.0, 40.0, False, False), (50.0, 60.0, True, True)]
    assert one(G.between(bands((0.0, 10.0, False, True), (20.0, 30.0, False, False), (40.0, 50.0, True, True)))) == [10.0, 40.0]
    assert one(G.between(bands((0.0, 10.0, False, False), (20.0, 30.0, False, False)))) == [15.0]


def test_words_are_neither_lost_nor_repeated(spark):
    rng, p = random.Random(3), Page(9)
    for i in range(150):
        p.say("".join(rng.choices("abcdef", k=rng.randint(1, 9))), rng.uniform(20, 560), rng.uniform(20, 780), rng.choice([8.0, 10.0, 14.0]))
    p.rulings += [(9, 1, i, rng.choice("hv"), rng.uniform(50, 500), rng.uniform(0, 200), rng.uniform(250, 700), 0.5, "000000") for i in range(12)]
    cells, _ = G.sheet_cells(pages(spark, p))
    assert sorted(w for r in cells.collect() for w in r.text.split()) == sorted(w[4] for w in p.words)
