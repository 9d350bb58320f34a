from pyspark.sql import functions as F

from sheafwork.operators import pages as P


def test_coverage_is_clipped_and_capped(spark):
    pages = spark.createDataFrame([(1, 1, 10.0, 10.0), (2, 1, 0.0, 10.0), (3, 1, 10.0, 10.0)], "doc_id int, page_number int, width double, height double")
    images = spark.createDataFrame([(1, 1, -5.0, 0.0, 5.0, 20.0), (1, 1, 20.0, 20.0, 30.0, 30.0), (2, 1, 0.0, 0.0, 5.0, 5.0), (3, 1, 0.0, 0.0, 10.0, 10.0), (3, 1, 0.0, 0.0, 9.0, 9.0)], "doc_id int, page_number int, x0 double, top double, x1 double, bottom double")
    assert {r.doc_id: r.coverage for r in P.image_coverage(pages, images, ["doc_id", "page_number"]).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    assert {r.coverage for r in P.image_coverage(pages, images.where("false"), ["doc_id", "page_number"]).collect()} == {0.0}


def test_strokes(spark):
    rows = [(1, 0.0, 5.0, 10.0, 5.5, 1.0, "A"), (2, 3.0, 20.0, 3.0, 2.0, 1.0, "B"), (3, 0.0, 0.0, 10.0, 10.0, 1.0, "C"), (4, 0.0, 0.0, 2.0, 0.0, 1.0, "D"), (5, None, 0.0, 9.0, 0.0, 1.0, "E")]
    strokes = spark.createDataFrame(rows, "ord int, x0 double, y0 double, x1 double, y1 double, stroke double, color string")
    got = {r.ord: (r.orientation, r.position, r.low, r.high) for r in P.strokes_to_rulings(strokes, []).collect()}
    assert got == {1: ("h", 5.25, 0.0, 10.0), 2: ("v", 3.0, 2.0, 20.0)}


def test_grid_json_keeps_odd_texts(spark):
    rows = [(1, 1, 0, 0, 1, 1, ' "{}" \n é '), (1, 2, 0, 0, 2, 3, None), (1, 1, 0, 1, 1, 1, ""), (2, 1, 5, 9, 1, 1, "x" * 50_000)]
    cells = spark.createDataFrame(rows, "doc_id bigint, page_number int, row_idx int, col_idx int, row_span int, col_span int, text string")
    assert sorted(map(tuple, P.grids_from_json(P.grids_to_json(cells)).collect()), key=str) == sorted(rows, key=str)
    broken = spark.createDataFrame([(1, "no grid"), (2, None), (3, "{}")], "doc_id bigint, grid string")
    assert P.grids_from_json(broken).count() == 0


def test_replies(spark):
    rows = [(1, "no json"), (2, None), (3, '{"disagreements": [{"row": 1, "col": 2, "confidence": 7}, {"row": "x", "col": 1}], "missing": "none"}'), (4, '{"missing": [{"row": 0, "col": 0, "text": "a"}]}')]
    df = spark.createDataFrame(rows, "k int, reply string")
    got = sorted((r.k, r.kind, r.row, r.col, r.text, r.confidence) for r in P.verdicts(df).collect())
    assert (4, "missing", 0, 0, "a", 0.0) in got and all(g[0] in (3, 4) for g in got)
    sized = df.withColumns({"n_rows": F.lit(5), "n_cols": F.lit(5)})
    assert P.located_by_reply(sized).count() == 0


def test_corrections_and_titles(spark):
    cells = spark.createDataFrame([(1, "a", "0.00", "digital", 1.0), (2, None, None, "ocr", 0.5)], "cell_id int, text string, number_format string, source string, confidence double")
    fixes = spark.createDataFrame([(1, "corrected", "b"), (2, "open", None), (9, "corrected", "z")], "cell_id int, resolution string, value string")
    got = {r.cell_id: (r.text, r.number_format, r.source, r.confidence) for r in P.corrected(cells, fixes, ["cell_id"]).collect()}
    assert got == {1: ("b", "General", "vlm", 0.95), 2: (None, None, "ocr", 0.5)}
    pages = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "doc_id int, page_number int")
    assert sorted(r.title for r in P.sheet_titles(pages).collect()) == ["Page 1", "Page 2", "Sheet1"]
