import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gustline.functions import alerts, geo, scalar


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


L = F.lit


def test_one_degree_of_latitude(spark):
    assert one(spark, geo.haversine_m(L(43.0), L(-79.0), L(44.0), L(-79.0))) == pytest.approx(111_195, abs=50)


def test_distance_is_symmetric_and_zero_at_home(spark):
    a = one(spark, geo.haversine_m(L(43.6), L(-79.4), L(43.7), L(-79.5)))
    b = one(spark, geo.haversine_m(L(43.7), L(-79.5), L(43.6), L(-79.4)))
    assert a == pytest.approx(b)
    assert one(spark, geo.haversine_m(L(43.6), L(-79.4), L(43.6), L(-79.4))) == 0.0


def test_offsets_point_north_and_east(spark):
    n, e = geo.north_east_m(L(43.0), L(-79.0), L(43.1), L(-79.0))
    assert one(spark, n) > 0 and one(spark, e) == pytest.approx(0)
    n, e = geo.north_east_m(L(43.0), L(-79.0), L(43.0), L(-78.9))
    assert one(spark, e) == pytest.approx(math.radians(0.1) * 6_371_000 * math.cos(math.radians(43)), rel=1e-6)


def test_alignment_is_zero_when_calm(spark):
    assert one(spark, geo.alignment(L(1.0), L(0.0), L(0.0), L(0.0))) == 0.0
    assert one(spark, geo.alignment(L(5.0), L(0.0), L(3.0), L(0.0))) == pytest.approx(1.0)


def test_weight_favours_down_wind(spark):
    w = lambda a: one(spark, geo.edge_weight(L(1000.0), L(a)))
    assert w(0.5) > w(0.0) > w(-0.5) > 0


def test_numbers(spark):
    assert one(spark, scalar.number(L("7.5"))) == 7.5
    assert one(spark, scalar.number(L("n/a"))) is None
    assert one(spark, scalar.number_or_zero(L(None).cast("string"))) == 0.0
    assert one(spark, scalar.log_clip(L(-3.0))) == 0.0
    assert one(spark, scalar.exp_clip(L(-1.0))) == 0.0


def test_zero_counts_as_missing(spark):
    assert one(spark, scalar.truthy_or(L(0.0), L(None).cast("double"), L(4.0))) == 4.0
    assert one(spark, scalar.truthy_or(L(0.0))) == 0.0


def test_hours_are_utc(spark):
    got = one(spark, scalar.utc_hour(L("2024-05-01T10:59:00+02:00")).cast("string"))
    assert got == "2024-05-01 08:00:00"
    assert one(spark, scalar.utc_hour(L("soon"))) is None


def test_parts_default_and_impossible_dates_are_null(spark):
    p = lambda *a: one(spark, scalar.timestamp_from_parts(*[L(x).cast("string") for x in a]).cast("string"))
    assert p("x", "2", "3", "14:00") == "2026-02-03 14:00:00"
    assert p("2024", "2", "31", "1") is None


def test_slug(spark):
    assert one(spark, scalar.city_slug(L("St. John's  North"))) == "st-johns-north"


@pytest.mark.parametrize("html,value", [
    ("<b>PM2.5 is 12.5 today", 12.5), ('<i data-pm25-value="7">', 7.0), ('{"pm25": 3.25}', 3.25), ("<p>clean</p>", None),
    ('{"pm25": 9} pm2.5: 4', 4.0),
])
def test_page_patterns_in_order(spark, html, value):
    assert one(spark, scalar.pm25_from_page(L(html))) == value


def test_page_is_searched_whole(spark):
    assert one(spark, scalar.pm25_from_page(L("x" * 200_000 + ' data-pm25-value="5"'))) == 5.0


@pytest.mark.parametrize("current,forecast,level,advice", [
    (200.0, 210.0, "critical", "critical"), (40.0, 10.0, "warning", "warning"), (10.0, 36.0, "warning", "warning"),
    (5.0, 20.0, "normal", "rising"), (10.0, 12.0, "normal", "normal"), (10.0, 0.0, "normal", "normal"),
    (None, None, "normal", "normal"), (125.5, 1.0, "critical", "critical"), (35.5, 1.0, "warning", "warning"),
])
def test_alert_levels(spark, current, forecast, level, advice):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), current, forecast)],
                               "station_id string, timestamp timestamp, current_pm25 double, forecast_pm25 double")
    r = alerts.alert_records(df).first()
    assert (r.level, r.alert, r.recommendation) == (level, level != "normal", alerts.ADVICE[advice])
    assert r.current_pm25 == current
    assert r.forecast_pm25 == (forecast or current or 0.0)
