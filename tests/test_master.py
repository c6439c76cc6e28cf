"""Fusion (U3) on hand-made inputs: overlap, stations, bad keys, proxies (FIXTURES §3)."""

from smogcast.plans.master import build_master


def test_fusion_rules(spark):
    hist = spark.createDataFrame([
        ("Delhi", "2015-01-01", 10.0, 1.0, 5.0, 100.0, 1),     # overlaps a modern row: modern wins
        ("Pune", "2014-05-05", 40.0, 1.0, 5.0, 100.0, 2),      # two stations same day: later row wins
        ("Pune", "2014-05-05", 40.0, 1.0, 6.0, None, 3),
        ("Pune", "not a date", 1.0, 1.0, 1.0, 1.0, 4),          # bad date -> dropped
        (None, "2014-05-06", 1.0, 1.0, 1.0, 1.0, 5),            # no city -> dropped
        ("Goa", "2014-05-07", None, 1.0, 1.0, None, 6),         # both proxy inputs missing -> NULL AQI
        ("Goa", "2015-01-01 00:00:00", 1.0, 1.0, 1.0, 1.0, 7),  # other layout -> dropped (Q15)
    ], "location string, date string, no2 double, so2 double, pm2_5 double, rspm double, row_ord long")
    modern = spark.createDataFrame([
        ("Delhi", "2015-01-01", 7.0, 8.0, 9.0, 1.0, 2.0, 3.0, 250.0, "Poor", 1),
    ], "City string, Date string, `PM2.5` double, PM10 double, NO2 double, SO2 double, CO double, "
       "O3 double, AQI double, AQI_Bucket string, row_ord long")
    rows = {(r.city, str(r.date)): r for r in build_master(hist, modern).collect()}
    assert set(rows) == {("Delhi", "2015-01-01"), ("Pune", "2014-05-05"), ("Goa", "2014-05-07")}
    assert rows[("Delhi", "2015-01-01")].aqi == 250.0 and rows[("Delhi", "2015-01-01")].co == 2.0
    assert rows[("Pune", "2014-05-05")].pm25 == 6.0 and rows[("Pune", "2014-05-05")].aqi == 60.0
    assert rows[("Goa", "2014-05-07")].aqi is None


def test_dedup_key_unique_and_idempotent(spark, sf_dir):
    from smogcast.plans.catalog import master
    from smogcast.operators.tables import dedup_last
    m = master(spark, sf_dir)
    assert m.count() == m.select("city", "date").distinct().count()
    again = dedup_last(m.withColumn("r", m.date.cast("string")), ["city", "date"], ["r"])
    assert again.count() == m.count()
