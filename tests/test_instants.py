import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from sheafwork.operators.instants import to_utc, zone_ids

LABELS = [("UTC", 0), ("CST", -360), ("Mauritius time", 240), ("MESZ", 120)]
U = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


@pytest.fixture(scope="module")
def run(spark):
    labels = spark.createDataFrame(LABELS, "label string, offset_min int")
    zones = zone_ids(spark).cache()

    def call(rows, extra=""):
        return to_utc(spark.createDataFrame(rows, f"text string, issuer_zone string, day_first boolean{extra}"), zones, labels)

    return call


CASES = [
    ("2024-12-23T16:53Z", None, None, U(2024, 12, 23, 16, 53)), ("26.8.2024 00:36:06.268610+02:00", None, True, U(2024, 8, 25, 22, 36, 6) + 268610), ("8. Juni 2026", "Asia/Kolkata", True, U(2026, 6, 7, 18, 30)),
    ("2025-12-23 9:54am America/New_York", "Asia/Dubai", None, U(2025, 12, 23, 14, 54)), ("27 avril 2024 à 04:19", "America/New_York", None, U(2024, 4, 27, 8, 19)), ("1er mars 2025 15:34 (Mauritius time)", None, None, U(2025, 3, 1, 11, 34)),
    ("1731082126340", None, None, 1731082126340000), ("1744573901", None, None, 1744573901000000), ("45875.75", "UTC", None, None), ("45875.75", "Africa/Johannesburg", None, U(2025, 8, 6, 16)), ("20240818T093530", "Indian/Mauritius", None, U(2024, 8, 18, 5, 35, 30)),
    ("05/06/2026", "Asia/Dubai", None, None), ("05/06/2026", "Asia/Dubai", True, U(2026, 6, 4, 20)), ("05/05/2026", "Asia/Dubai", None, U(2026, 5, 4, 20)), ("2025-06-31 10:00", "Asia/Dubai", True, None), ("2024-02-29", "Asia/Dubai", None, U(2024, 2, 28, 20)),
    ("2025-03-30 02:30", "Europe/Berlin", None, U(2025, 3, 30, 1, 30)), ("2025-10-26 02:30", "Europe/Berlin", None, U(2025, 10, 26, 0, 30)), ("12:30 AM", "Asia/Dubai", None, None), ("6 May 2026 12:30 AM CST", None, None, U(2026, 5, 6, 6, 30)),
    ("2024-01-01 10:00:00.123456789 UTC", None, None, U(2024, 1, 1, 10) + 123456), ("Ｐｒｉｎｔｅｄ　３０／０６／２０２５　０７：１８：５８＋０５：３０", None, None, U(2025, 6, 30, 1, 48, 58)), ("2024-01-01", None, None, None), ("2024-01-01", "No/Where", None, None),
    ("week 14", "Asia/Dubai", True, None), ("", "Asia/Dubai", True, None), (None, "Asia/Dubai", True, None), ("tba " * 50_000, "Asia/Dubai", True, None), ("2024-01-01 XYZ", "Asia/Dubai", None, None),
]


def test_cases(run):
    got = {(r.text, r.issuer_zone, r.day_first): r.utc_us for r in run([c[:3] for c in CASES]).collect()}
    assert got == {c[:3]: c[3] for c in CASES}


def test_days_against_the_calendar(run):
    days = [dt.date(1999, 12, 28) + dt.timedelta(days=37 * i) for i in range(400)]
    got = {r.text: r.utc_us for r in run([(d.isoformat(), "Etc/GMT", None) for d in days]).collect()}
    assert got == {d.isoformat(): U(d.year, d.month, d.day) for d in days}


def test_zone_rules_against_zoneinfo(run):
    zone, start = ZoneInfo("America/New_York"), dt.datetime(2024, 1, 1)
    walls = [start + dt.timedelta(hours=13 * i) for i in range(600)]
    got = {r.text: r.utc_us for r in run([(w.isoformat(), "America/New_York", None) for w in walls]).collect()}
    assert got == {w.isoformat(): int(w.replace(tzinfo=zone).timestamp()) * 1_000_000 for w in walls}


def test_clashing_columns_repeats_and_empty(run, spark):
    rows = [("2024-01-01 00:00Z", None, None, 7, "p")] * 3
    out = run(rows, ", utc_us int, _y string")
    assert out.columns == ["text", "issuer_zone", "day_first", "_y", "utc_us"]
    assert [r.utc_us for r in out.collect()] == [U(2024, 1, 1)] * 3
    assert run([]).count() == 0
