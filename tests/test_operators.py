import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.functions import raster
from sheafwork.operators import cells as C, geometry as G, layout as Y
from sheafwork.sources import readers, xlsx
from sheafwork.sources.tables import latest
import pandas as pd
from sheafwork.plans import edges


def test_line_fold_against_a_loop(spark):
    rng = np.random.default_rng(1)
    words = [(int(i), int(i % 7), 1, int(i), f"w{i}", float(rng.uniform(0, 500)), float(t := rng.uniform(0, 300)), 0.0, float(t + rng.uniform(6, 16))) for i in range(300)]
    df = spark.createDataFrame(words, "word_id bigint, doc_id bigint, page_number int, ord int, text string, x0 double, top double, x1 double, bottom double")
    got = {r.word_id: r.line for r in Y.group_lines(df).collect()}
    for doc in range(7):
        page, line, lo, hi = sorted((w for w in words if w[1] == doc), key=lambda w: (w[6], w[5], w[3])), -1, 0.0, 0.0
        for w in page:
            shorter = min(hi - lo, w[8] - w[6]) or 1.0
            if line >= 0 and (min(hi, w[8]) - max(lo, w[6])) / shorter >= 0.45:
                lo, hi = min(lo, w[6]), max(hi, w[8])
            else:
                line, lo, hi = line + 1, w[6], w[8]
            assert got[w[0]] == line


@pytest.mark.parametrize(("bounds", "want"), [([0, 1, 10, 12, 20], [0, 10, 20]), ([0, 5, 10, 18, 20], [0, 5, 10, 20]), ([0, 1], [0, 1]), ([0], [0]), ([0, 19, 20], [0, 20])])
def test_prune(spark, bounds, want):
    df = spark.createDataFrame([([float(b) for b in bounds],)], "b array<double>")
    assert df.select(G.prune(F.col("b")).alias("x")).first().x == [float(w) for w in want]


def test_binned_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = ([(i, int(rng.integers(3)), float(x := rng.uniform(0, 200)), float(x + rng.uniform(0, 60))) for i in range(80)] for _ in range(2))
    left, right = spark.createDataFrame(a, "i int, k int, al double, ah double"), spark.createDataFrame(b, "j int, k int, bl double, bh double")
    got = sorted((r.i, r.j) for r in G.binned_overlaps(left, right, ["k"], "al", "ah", "bl", "bh", 25.0).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_latest_keeps_one_row_a_key(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None), (2, "x", None), (None, "y", 5), (1, "b", 2)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in latest(df, "k", "t").collect()) == [(1, "b"), (2, "x")]


def test_workbook_round_trip(spark):
    cells = [(1, 1, "A", 0, 0, "=1+1", 1, 1), (1, 1, "A", 2, 30, " <&> \n é", 2, 3), (1, 2, "a", 0, 1, "", 1, 1), (2, 1, "Q", 5, 0, "x" * 40_000, 1, 1), (3, 1, "N", 0, 0, None, 1, 1)]
    schema = "doc_id bigint, page_number int, title string, row int, col int, text string, row_span int, col_span int"
    back = xlsx.from_workbooks(xlsx.to_workbooks(spark.createDataFrame(cells, schema))).collect()
    assert sorted((r.doc_id, r.page_number, r.row, r.col, r.text, r.row_span, r.col_span) for r in back) == sorted((d, p, r, c, t, a, b) for d, p, _, r, c, t, a, b in cells if t is not None)
    assert {r.title for r in back if r.doc_id == 1} == {"A", "a_2"}
    assert list(xlsx.read_workbook(xlsx.workbook([]))) == []


def test_raster_kernels():
    rng = np.random.default_rng(3)
    mask = np.where(rng.random((40, 50)) < 0.3, 255, 0).astype(np.uint8)
    seen, boxes = np.zeros(mask.shape, bool), []
    for y, x in np.argwhere(mask):
        if not seen[y, x]:
            stack, points = [(y, x)], []
            seen[y, x] = True
            while stack:
                p = stack.pop()
                points.append(p)
                for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if 0 <= q[0] < 40 and 0 <= q[1] < 50 and mask[q] and not seen[q]:
                        seen[q] = True
                        stack.append(q)
            ys, xs = zip(*points)
            boxes.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(points)))
    assert sorted(raster.components(mask)) == sorted(boxes)
    page = np.full((800, 600), 255, np.uint8)
    page[100:102, 50:550] = 0
    page[100:700, 300:303] = 0
    found = raster.find_rulings(raster.binary(page), 72)
    assert [(o, round(at, 1), low, high) for o, at, low, high, _ in found] == [("h", 101.0, 50.0, 550.0), ("v", 301.5, 100.0, 700.0)]
    assert raster.erased(raster.binary(page), found, 72).sum() == 0
    assert raster.ssim(page, page) == pytest.approx(1.0) and raster.ssim(page[:2], page[:2]) == 0.0
    assert raster.png(page)[:4] == b"\x89PNG" and raster.median_color(np.full((5, 5, 3), 7, np.uint8), 0, 0, 5, 5) == "070707"


def test_readers(spark):
    with pytest.raises(readers.Unavailable):
        readers.get_reader("none")
    df = spark.createDataFrame([(1, "a"), (2, None)], "cell_id bigint, text string")
    assert {r.cell_id: r.reading for r in readers.read_cells(df, "silent").collect()} == {1: "", 2: ""}


def test_rules_of_many_pages_in_one_call():
    page = {"doc_id": [1, 1, 2], "page_number": [1, 2, 1], "orientation": [["h", "v"], ["h"], []], "position": [[50.0, 20.0], [70.0], []], "low": [[10.0, 100.0], [5.0], []], "high": [[110.0, 200.0], [30.0], []]}
    found = [tuple(r) for out in edges._draw(iter([pd.DataFrame(page)])) for r in out.itertuples(index=False)]
    assert found == [(1, 1, "h", 50.5, 10.0, 110.0, 1.0), (1, 1, "v", 20.5, 100.0, 200.0, 1.0)]  # the rule of 25 points is too short


def test_two_values_part_as_any_image():
    image = np.full((40, 60), 200, np.uint8)
    image[5:9, 3:50] = 30
    assert raster.otsu(image) == 30 and (raster.binary(image) == np.where(image == 30, 255, 0)).all()
    assert raster.find_rulings(raster.binary(image), 72) == [("h", 7.0, 3.0, 50.0, 4.0)]


def test_rulings_are_not_broadcast(spark):
    cells = spark.sql("select id as cell_id, 1 as doc_id, named_struct('x0', 0D, 'top', 10D * id, 'x1', 50D, 'bottom', 10D * id + 9) as bbox from range(3)")
    rulings = spark.sql("select 1 as doc_id, 0 as ord, 'h' as orientation, 10D as position, 0D as low, 50D as high, 1D as stroke")
    found = C.best_edges(cells, rulings, ["doc_id"])
    assert {(r.cell_id, r.edge) for r in found.collect()} == {(0, "bottom"), (1, "top")}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
