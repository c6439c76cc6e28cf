"""Streams (idempotent store, replay dedup) and file sources."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from smogcast.sources import files as fl
from smogcast.streaming import streams as ss


def test_store_batches_is_idempotent(spark, tmp_path):
    rows = [("X", dt.datetime(2024, 1, 1), 1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 150.0, 20.0, 50.0, 3.0, 1)]
    batch = spark.createDataFrame(rows, "city string, ts timestamp, event_id long, pm25 double, pm10 double, "
                                        "no2 double, so2 double, co double, o3 double, aqi double, "
                                        "temperature double, humidity double, wind_speed double, weather_code int")
    r, w = str(tmp_path / "r"), str(tmp_path / "w")
    write = ss.store_batches(r, w)
    write(batch, 0)
    write(batch, 0)      # replayed batch: replaces, does not add
    assert spark.read.parquet(r).count() == 1 and spark.read.parquet(w).count() == 1


def test_read_first_available_and_metrics(spark, tmp_path):
    p = str(tmp_path / "m")
    spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "city string, date date, aqi double").write.parquet(p)
    df = fl.read_first_available(spark, [str(tmp_path / "missing"), p])
    assert df.count() == 1
    try:
        fl.read_first_available(spark, [str(tmp_path / "none")])
        raise AssertionError("expected an error")
    except FileNotFoundError:
        pass
    assert fl.read_metrics(spark, str(tmp_path / "nothing"), "arima") is None
    doc = tmp_path / "arima.json"
    doc.write_text(json.dumps({"model": "ARIMA", "order": [2, 1, 2], "cities_trained": 1,
                               "aggregate": {"mae_mean": 1.0, "rmse_mean": 2.0, "mae_median": 1.0, "rmse_median": 2.0},
                               "per_city": {"Delhi": {"mae": 1.0, "rmse": 2.0, "holdout": 72, "last_actual": 3.0,
                                                      "last_predicted": 4.0}}}, indent=2))
    m = fl.read_metrics(spark, str(doc), "arima")
    r = m.select(F.col("per_city")["Delhi"]["holdout"].alias("h"), "aggregate.mae_mean").first()
    assert r.h == 72 and r.mae_mean == 1.0


def test_monitor_log_csv(spark, tmp_path):
    p = tmp_path / "log.csv"
    # shape of the reference's monitor log (header + one row)
    p.write_text("timestamp,city,source,aqi_now,pm25,pm10,no2,so2,risk_now,aqi_24h,aqi_48h,aqi_72h\n"
                 "2026-04-05T13:58:12.250677Z,Delhi,LIVE SATELLITE,153,45.9,295.2,18.4,13.6,Unhealthy,175.37,212.07,249.11\n")
    r = fl.read_monitor_log(spark, str(p)).first()
    assert r.aqi_now == 153.0 and r.ts is not None and r.risk_now == "Unhealthy"


def test_city_dim(spark):
    d = fl.city_dim(spark)
    assert d.count() == 10 and d.where("city = 'Delhi'").first().lat == 28.6139


def test_csv_readers_keep_file_order(spark, tmp_path):
    p = str(tmp_path / "h")
    rows = [("Pune", "2014-05-05", 1.0, 1.0, float(i), 1.0) for i in range(5)]
    spark.createDataFrame(rows, "location string, date string, no2 double, so2 double, pm2_5 double, rspm double") \
        .coalesce(1).write.option("header", True).csv(p)
    h = fl.read_historical(spark, p)
    last = h.orderBy(F.col("row_ord").desc()).first()
    assert last.pm2_5 == 4.0


def test_stateful_monitor_carries_prediction_across_batches(spark, tmp_path):
    """A prediction seen in batch 1 is attached to a reading that arrives in batch 2."""
    rd, pr = str(tmp_path / "readings"), str(tmp_path / "preds")
    polls_schema = "city string, ts timestamp, event_id long, current struct<pm10:double,pm2_5:double," \
                   "nitrogen_dioxide:double,sulphur_dioxide:double,carbon_monoxide:double,ozone:double," \
                   "us_aqi:double>, weather struct<temperature_2m:double,relative_humidity_2m:double," \
                   "wind_speed_10m:double,weather_code:int>"
    cur = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 160.0)
    wea = (20.0, 50.0, 2.0, 1)
    pred_schema = "city string, data_source string, pred_24h double, pred_48h double, pred_72h double, " \
                  "ts timestamp, event_id long"

    def land(df, path, name):
        df.coalesce(1).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") \
            .json(f"{path}/{name}")

    t = dt.datetime
    land(spark.createDataFrame([("X", t(2024, 1, 1, 10), 1, cur, wea)], polls_schema), rd, "b1")
    land(spark.createDataFrame([("X", "s", 7.0, 8.0, 9.0, t(2024, 1, 1, 9), 100)], pred_schema), pr, "b1")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        polls = ss.read_payload_stream(spark, f"{rd}/*").where(F.col("aqi").isNotNull())
        preds = ss.read_prediction_stream(spark, f"{pr}/*")
        ss.run_available(ss.stream_monitor_state(polls, preds), out, ck)

    run()
    land(spark.createDataFrame([("X", t(2024, 1, 2, 10), 2, cur, wea)], polls_schema), rd, "b2")
    run()                                   # second micro-batch: no prediction, state carries it
    got = {r.event_id: (r.aqi_24h, r.risk_now) for r in spark.read.parquet(out).collect()}
    assert got == {1: (7.0, "Unhealthy"), 2: (7.0, "Unhealthy")}


def test_csv_columns_matched_by_name_with_extra_columns(spark, tmp_path):
    """Real exports carry extra columns in their own order; wanted ones are picked by name."""
    p = tmp_path / "city_day.csv"
    p.write_text("City,Date,PM2.5,PM10,NO,NO2,NOx,NH3,CO,SO2,O3,Benzene,Toluene,Xylene,AQI,AQI_Bucket\n"
                 "Delhi,2015-01-01,313.22,607.98,69.16,36.39,110.59,33.85,15.2,9.25,41.68,14.36,24.86,9.84,472,Severe\n"
                 "Delhi,2015-01-02,bad,,1,2,3,4,5,6,7,8,9,10,,\n")
    r = fl.read_modern(spark, str(p), parse=True).orderBy("Date").collect()
    assert r[0]["PM2.5"] == 313.22 and r[0].NO2 == 36.39 and r[0].SO2 == 9.25 and r[0].AQI == 472.0
    assert r[0].AQI_Bucket == "Severe" and str(r[0].Date) == "2015-01-01"
    assert r[1]["PM2.5"] is None and r[1].PM10 is None and r[1].AQI is None
    h = tmp_path / "data.csv"
    h.write_text("stn_code,sampling_date,state,location,agency,type,so2,no2,rspm,spm,"
                 "location_monitoring_station,pm2_5,date\n"
                 "150,February - M021990,Andhra Pradesh,Hyderabad,,Residential,4.8,17.4,,,,,1990-02-01\n")
    hr = fl.read_historical(spark, str(h)).first()
    assert (hr.location, hr.date, hr.so2, hr.no2, hr.rspm, hr.pm2_5) == ("Hyderabad", "1990-02-01", 4.8, 17.4, None, None)


def test_payload_readers_do_not_mutate_shared_schemas(spark, tmp_path):
    from smogcast import schemas
    before = len(schemas.AQI_PAYLOAD.fields), len(schemas.WEATHER_PAYLOAD.fields)
    p = str(tmp_path / "x")
    spark.createDataFrame([("X",)], "city string").write.json(p)
    for _ in range(2):
        fl.read_aqi_payloads(spark, p)
        fl.read_weather_payloads(spark, p)
    assert (len(schemas.AQI_PAYLOAD.fields), len(schemas.WEATHER_PAYLOAD.fields)) == before


def test_checkpoint_dir_is_set_when_the_session_has_none(spark, tmp_path):
    """Operators that checkpoint work even if the context has no checkpoint folder yet."""
    from smogcast.session import reliable_checkpoint
    sc = spark.sparkContext
    saved = sc.getCheckpointDir()
    setter = getattr(sc._jsc.sc(), "checkpointDir_$eq")
    setter(sc._jvm.scala.Option.empty())   # simulate a session without a checkpoint folder
    try:
        assert sc.getCheckpointDir() is None
        out = reliable_checkpoint(spark.range(10))
        assert out.count() == 10 and sc.getCheckpointDir()
    finally:
        if saved:
            setter(sc._jvm.scala.Option.apply(saved))


def test_logs_can_be_read_by_the_log_operators(spark, tmp_path):
    from smogcast.operators.status import monitor_log
    from smogcast.operators.tables import recent_predictions, recent_readings
    from smogcast.plans import sinks
    t = dt.datetime(2024, 1, 1)
    readings = spark.createDataFrame([("X", "live", 50.0, t, 7)], "city string, source string, aqi double, ts timestamp, event_id long")
    preds = spark.createDataFrame([("X", "m", 1.0, 2.0, 3.0, t, 6)], "city string, data_source string, pred_24h double, "
                                  "pred_48h double, pred_72h double, ts timestamp, event_id long")
    r, p = str(tmp_path / "r"), str(tmp_path / "p")
    sinks.append_predictions(preds, p)
    sinks.append_readings(readings, r)
    r, p = spark.read.parquet(r), spark.read.parquet(p)
    assert [x.event_id for x in recent_readings(r).collect()] == [7]
    assert [x.event_id for x in recent_predictions(p).collect()] == [6]
    assert [(x.aqi_now, x.aqi_24h, x.aqi_72h) for x in monitor_log(r, p).collect()] == [(50.0, 1.0, 3.0)]


def test_metrics_documents_of_several_runs_one_broken(spark, tmp_path):
    from smogcast.plans import reports as rp
    root = tmp_path / "arima"
    root.mkdir()
    doc = {"model": "ARIMA", "order": [2, 1, 2], "cities_trained": 1, "aggregate": {"mae_mean": 1.0}, "per_city": {}}
    for name, text in (("run-1.json", json.dumps(doc, indent=2)), ("run-2.json", json.dumps({**doc, "cities_trained": 7})),
                       ("run-3.json", '{"model": "ARIMA", "order": [2,'), ("run-4.json", '{"other": 1}')):
        (root / name).write_text(text)
    runs = {r.run: r for r in fl.read_metrics_runs(spark, str(root), "arima").collect()}
    assert {k: r.bad is None for k, r in runs.items()} == {"run-1.json": True, "run-2.json": True, "run-3.json": False, "run-4.json": False}
    assert sorted(r.cities_trained for r in fl.read_metrics(spark, str(root), "arima").collect()) == [1, 7]
    row = rp.model_metrics(spark, paths={"arima": str(root), "classifier": str(tmp_path / "none")}).first()
    assert (row.arima_available, row.classifier_available, row.arima_metrics.cities_trained) == (True, False, 7)
    every = rp.metrics_runs(spark, {"arima": str(root), "sequence": str(tmp_path / "none")}).collect()
    assert sorted((r.kind, r.run) for r in every if r.document is None) == [("arima", "run-3.json"), ("arima", "run-4.json")]
    assert len(every) == 4 and fl.read_metrics(spark, str(root / "run-3.json"), "arima") is None
