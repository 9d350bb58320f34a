"""Cells between rulings: what is computed for a run is computed once, and equals brute force."""

import random

from pyspark.sql import functions as F

from sheafwork.operators import grid as G


def brute(low, high, rules, bounds):
    def nearest(v):
        return max(((-abs(b - v), i) for i, b in enumerate(bounds) if abs(b - v) <= 3), default=(0, None))[1]

    before, after = max((r for r in rules if r <= low + 2), default=None), min((r for r in rules if r >= high - 2), default=None)
    if len(rules) < 2 or before is None or after is None or nearest(before) is None or nearest(after) is None or nearest(after) <= nearest(before):
        return None
    return nearest(before), min(nearest(after) - 1, len(bounds) - 2)


def test_rulings_of_a_run_are_computed_once(spark):
    text = str(G._enclosed(F.col("low"), F.col("high"), F.col("the_rules"), F.col("bounds")))
    assert text.count("the_rules") == 1


def test_enclosed_equals_brute_force(spark):
    rng, rows = random.Random(5), [(0, 10.0, 20.0, [], [0.0, 30.0]), (1, 10.0, 20.0, [5.0], [5.0, 25.0]), (2, 10.0, 20.0, [5.0, 25.0], [5.0, 25.0]), (3, 5.0, 9.0, [0.0, 10.0], [2.0, -2.0, 10.0])]
    for i in range(4, 300):
        low = float(rng.randint(0, 40))
        rows.append((i, low, low + rng.randint(0, 20), sorted(float(rng.randint(0, 60)) for _ in range(rng.randint(0, 5))), sorted(float(rng.randint(0, 60)) for _ in range(rng.randint(2, 6)))))
    got = spark.createDataFrame(rows, "i int, low double, high double, rules array<double>, bounds array<double>").select("i", G._enclosed(F.col("low"), F.col("high"), F.col("rules"), F.col("bounds")).alias("e"))
    assert {r.i: None if r.e is None else tuple(r.e) for r in got.collect()} == {r[0]: brute(*r[1:]) for r in rows}
