"""Sinks K2-K4, K7, K8 and small projections P3, P7, P12."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from smogcast.operators import tables as tb
from smogcast.plans import sinks
from smogcast.sources import files as fl


def test_append_logs_stamp_and_partition(spark, tmp_path):
    r = spark.createDataFrame([("X", "LIVE SATELLITE", 120.0, 1.0, 2.0, 3.0, 4.0, 20.0, 50.0, 3.0)],
                              "city string, source string, aqi double, pm25 double, pm10 double, no2 double, "
                              "so2 double, temperature double, humidity double, wind_speed double")
    root = str(tmp_path / "logs")
    sinks.append_readings(r, f"{root}/aqi_readings")
    sinks.append_readings(r, f"{root}/aqi_readings")
    p = spark.createDataFrame([("X", "HYBRID (29 CSV + 1 LIVE)", 1.234, 2.345, 3.456)],
                              "city string, data_source string, pred_24h double, pred_48h double, pred_72h double")
    sinks.append_predictions(p, f"{root}/predictions")
    sinks.append_weather(r, f"{root}/weather_logs")
    readings = fl.read_log(spark, root, "aqi_readings")
    assert readings.count() == 2 and readings.where(F.col("ts").isNull()).count() == 0
    assert "day" in readings.columns
    pr = fl.read_log(spark, root, "predictions").first()
    assert (pr.pred_24h, pr.pred_48h, pr.pred_72h) == (1.23, 2.35, 3.46)
    counts = {r.collection: r.n_rows for r in tb.log_counts(readings, fl.read_log(spark, root, "predictions"),
                                                             fl.read_log(spark, root, "weather_logs")).collect()}
    assert counts == {"aqi_readings": 2, "predictions": 1, "weather_logs": 1}


def test_export_csv(spark, tmp_path):
    rows = [("Delhi", dt.date(2020, 1, d), 1.0, None, 3.0, 4.0, 5.0, 6.0, float(d), None) for d in range(1, 6)]
    m = spark.createDataFrame(rows, "city string, date date, pm25 double, pm10 double, no2 double, so2 double, "
                                    "co double, o3 double, aqi double, aqi_bucket string")
    out = str(tmp_path / "csv")
    sinks.export_csv(m, out, n=3)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 3
    assert back.columns[:9] == ["Date", "City", "PM2.5", "PM10", "NO2", "SO2", "CO", "O3", "AQI"]
    assert back.where(F.col("PM10").isNull()).count() == 3      # missing -> empty field
    assert back.select("file_name").first()[0] == "aqi_report_Delhi_3days.csv"
    assert sorted(r.Date for r in back.collect()) == ["2020-01-03", "2020-01-04", "2020-01-05"]


def test_save_and_load_model(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)
    path = str(tmp_path / "artifact")
    sinks.save_model(model, path, {"model_name": "x", "features": ["a", "b"], "labels": ["Good"]})
    loaded, meta = sinks.load_model(path)
    assert meta["features"] == ["a", "b"] and loaded.transform(df).count() == 1
    bad = tmp_path / "bad"
    (bad / "meta").mkdir(parents=True)
    (bad / "meta" / "part-0.txt").write_text(json.dumps({"model_name": "x"}))
    with pytest.raises(ValueError):
        sinks.load_model(str(bad))


def test_projections(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3)], "_id int, city string, pm25 double, event_id long")
    with pytest.raises(ValueError, match="no2"):
        tb.require_columns(df, ["pm25", "no2"])
    assert tb.split_feature_types(df, ["pm25", "city"]) == (["pm25"], ["city"])
    assert tb.drop_internal_ids(df).columns == ["city", "pm25"]
    assert tb.select_available(df, ["pm10", "pm25", "city"]).columns == ["pm25", "city"]


def test_predict_document_json(spark, sf_dir):
    from smogcast.plans import forecast as fc
    from smogcast.plans.catalog import master
    from smogcast.sources import standin as si
    m = master(spark, sf_dir)
    s, fit = fc.scaled_sequences(m)
    model = fc.fit_lag_model(s.where(F.col("part") == "train"), "ar1")
    doc = fc.predict_document(si.live_rows(spark, sf_dir), m, model, fit).first()
    parsed = json.loads(doc.json)
    assert set(parsed["predictions"]) == {"24h", "48h", "72h"}
    assert parsed["predictions"]["24h"]["aqi"] == parsed["predicted_aqi_tomorrow"]


def test_export_report_names_and_content(spark, tmp_path):
    import os
    import re
    df = spark.createDataFrame([("New Delhi", 153.0), ("Pune", 70.0)], "city string, aqi double")
    named = sinks.export_report(df, str(tmp_path / "reports"))
    names = sorted(r.file for r in named.select("file").distinct().collect())
    assert all(re.fullmatch(r"report_summary_(New_Delhi|Pune)_\d{8}_\d{6}\.json", n) for n in names)
    folders = sorted(d for d in os.listdir(tmp_path / "reports") if d.startswith("file="))
    assert folders == ["file=" + n for n in names]     # returned names are the written ones
    back = spark.read.json(str(tmp_path / "reports"))
    assert {r.city: r.aqi for r in back.collect()} == {"New Delhi": 153.0, "Pune": 70.0}


def test_the_same_reports_have_the_same_names_and_manifest(spark, tmp_path):
    rows = [("New Delhi", 153.0, "2024-01-30T05:06:07.000000Z"), ("Pune", 70.0, "2024-01-30T05:06:07.000000Z")]
    df = spark.createDataFrame(rows, "city string, aqi double, generated_at string")
    manifests = []
    for _ in range(2):                       # the second export replaces the first
        named = sinks.export_report(df, str(tmp_path / "r"))
        back = sinks.read_reports(spark, str(tmp_path / "r"), named)
        assert back.count() == 2 and back.columns == named.columns
        manifests.append(sorted(map(tuple, sinks.report_manifest(back).collect())))
    assert manifests[0] == manifests[1] == sorted(map(tuple, sinks.report_manifest(named).collect()))
    assert {m[0] for m in manifests[0]} == {f"report_summary_{c}_20240130_050607.json" for c in ("New_Delhi", "Pune")}
    other = sinks.report_manifest(named.withColumn("aqi", F.lit(1.0))).collect()
    assert not {r.sha256 for r in other} & {m[2] for m in manifests[0]}
