"""Scalar operators: risk scales, bounds, label maps (goldens from the reference's tests and reports)."""

import pytest
from pyspark.sql import functions as F

from smogcast.functions import risk
from smogcast.functions import columns as C


def one(spark, expr, value, typ="double"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("aqi,level", [(30, "Good"), (50, "Good"), (75, "Moderate"), (100, "Moderate"),
                                       (125, "Unhealthy for Sensitive Groups"), (175, "Unhealthy"),
                                       (250, "Very Unhealthy"), (301, "Hazardous"), (400, "Hazardous"),
                                       (162, "Unhealthy"), (176.56, "Unhealthy"), (213.26, "Very Unhealthy"),
                                       (250.29, "Very Unhealthy"), (153, "Unhealthy"), (70, "Moderate")])
def test_us_scale_goldens(spark, aqi, level):
    assert one(spark, lambda c: risk.health_risk(c)["level"], float(aqi)) == level


def test_us_colours(spark):
    assert one(spark, lambda c: risk.health_risk(c)["color"], 30.0) == "#00e400"
    assert one(spark, lambda c: risk.health_risk(c)["color"], 400.0) == "#7e0023"


@pytest.mark.parametrize("scale", ["us", "display", "india", "bucket4"])
def test_bounds_inclusive_and_null_takes_last_band(spark, scale):
    bands = risk.SCALES[scale]
    for i, row in enumerate(bands[:-1]):
        b = float(row[0])
        assert one(spark, lambda c: risk.risk_level(c, scale), b) == row[1]
        assert one(spark, lambda c: risk.risk_level(c, scale), b + 0.1) == bands[i + 1][1]
    assert one(spark, lambda c: risk.risk_level(c, scale), None) == bands[-1][1]


def test_label_maps(spark):
    rows = [("Satisfactory",), ("Poor",), ("Severe",), (None,), ("foo",)]
    df = spark.createDataFrame(rows, "b string").select(risk.normalise_label("b").alias("c"))
    got = [r.c for r in df.collect()]
    assert got == ["Moderate", "Unhealthy", "Hazardous", None, "foo"]
    kept = df.where(F.col("c").isin(risk.CLASS_LABELS)).count()
    assert kept == 3
    disp = spark.createDataFrame([("Unhealthy",), ("x",)], "l string").select(risk.display_label("l").alias("d"))
    assert [r.d for r in disp.collect()] == ["Poor", "x"]
    rec = spark.createDataFrame([("Poor",), ("zzz",)], "l string").select(risk.recommendation("l").alias("r"))
    assert [r.r for r in rec.collect()] == [risk.RECOMMENDATIONS["Poor"], risk.DEFAULT_RECOMMENDATION]


def test_alert_threshold_and_text(spark):
    from smogcast.operators.tables import alerts
    df = spark.createDataFrame([("Delhi", 150.0), ("Delhi", 151.0)], "city string, aqi double")
    out = alerts(df, 150).collect()
    assert len(out) == 1 and out[0].aqi == 151.0
    assert out[0].alert_text == "CRITICAL AIR QUALITY ALERT: DELHI AQI 151 — Unhealthy"


def test_proxy_and_parse(spark):
    df = spark.createDataFrame([(100.0, 40.0), (None, 40.0), (None, None)], "pm10 double, no2 double")
    assert [r.a for r in df.select(C.aqi_proxy("pm10", "no2").alias("a")).collect()] == [150.0, 60.0, None]
    d = spark.createDataFrame([("2015-01-01",), ("2015-01-01 00:00:00",), ("bad",)], "s string")
    got = [r.d for r in d.select(C.parse_date("s").alias("d")).collect()]
    assert str(got[0]) == "2015-01-01" and got[1] is None and got[2] is None


def test_pollutant_status_pct_fmt(spark):
    df = spark.createDataFrame([(25.0,), (60.0,), (61.0,), (None,), (2.25,)], "v double")
    out = df.select(C.pollutant_status("v", 25, 60).alias("s"), C.scale_pct("v", 50).alias("p"),
                    C.fmt("v", 1).alias("t")).collect()
    assert [r.s for r in out] == ["OPTIMAL", "NORMAL", "ELEVATED", "ELEVATED", "OPTIMAL"]
    assert out[2].p == 100.0
    assert out[3].t == "N/A" and out[4].t == "2.3"   # half up, as the dashboard


def test_city_list_and_report_name(spark):
    df = spark.createDataFrame([(" A, ,B,A,C,D,E",)], "s string")
    assert df.select(F.slice(C.city_list("s"), 1, 5).alias("l")).first().l == ["A", "B", "A", "C", "D"]
    n = spark.createDataFrame([("New Delhi",)], "c string").select(
        C.report_name("c", F.to_timestamp(F.lit("2026-04-06 20:36:43"))).alias("n")).first().n
    assert n == "report_summary_New_Delhi_20260406_203643.json"


def test_horizon_fallback(spark):
    df = spark.createDataFrame([(0.0, None, 80.0, 70.0)], "a double, b double, c double, t double")
    r = df.select(*C.horizon_fallback("a", "b", "c", "t")).first()
    assert (r.aqi_24h, r.aqi_48h, r.aqi_72h) == (70.0, 70.0, 80.0)


def test_alert_text_uses_health_level_history_uses_dashboard_level(spark):
    from smogcast.operators.tables import alerts
    df = spark.createDataFrame([("Pune", 130.4)], "city string, aqi double")
    r = alerts(df, 120).first()
    assert r.alert_text == "CRITICAL AIR QUALITY ALERT: PUNE AQI 130 — Unhealthy for Sensitive Groups"
    assert r.risk_level == "Unhealthy (S)"


def test_or_zero_and_to_double(spark):
    df = spark.createDataFrame([("12.5",), ("n/a",), (None,)], "s string")
    got = [r.v for r in df.select(C.or_zero(C.to_double("s")).alias("v")).collect()]
    assert got == [12.5, 0.0, 0.0]
