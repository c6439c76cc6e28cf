"""The command line end to end on real-format files landed from the test tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from smogcast import cli
from smogcast.sources import standin as si
from smogcast.streaming import streams as ss


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    hist = si.historical(spark, sf_dir).orderBy("row_ord").drop("row_ord")
    hist.write.option("header", True).option("encoding", "ISO-8859-1").csv(str(root / "data.csv"))
    si.modern(spark, sf_dir).orderBy("row_ord").drop("row_ord").write.option("header", True) \
        .csv(str(root / "city_day.csv"))
    ss.land_payloads(si.poll_payloads(spark, sf_dir), str(root / "polls"), files=2)
    return root


def q(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)


def test_cli_chain(spark, sf_dir, landed):
    r = str(landed)
    out = cli.main(["build-master", "--historical", f"{r}/data.csv", "--modern", f"{r}/city_day.csv",
                    "--out", f"{r}/master"], spark)
    assert out["records"] == q(spark, sf_dir, "build_master").count()

    fc = cli.main(["train-forecaster", "--master", f"{r}/master", "--out", f"{r}/models/fc"], spark)
    ev = q(spark, sf_dir, "evaluate_ar1").first()
    assert round(fc["mae"], 6) == ev.mae and fc["test_sequences"] == ev.test_sequences
    doc = spark.read.json(f"{r}/models/fc/metrics").first()
    assert doc.sequence_length == 30 and doc.epochs_ran == 1
    assert round(doc.best_val_loss, 6) == q(spark, sf_dir, "forecaster_validation").first().best_val_loss

    summ = q(spark, sf_dir, "backtest_summary").first()
    args = ["backtest", "--master", f"{r}/master", "--out", f"{r}/models/arima", "--order", "1,1,0"]
    if summ.cities_trained:
        bt = cli.main(args, spark)
        assert bt["cities_trained"] == summ.cities_trained and round(bt["mae_mean"], 6) == summ.mae_mean
    else:   # as the reference's script: no city long enough is an error
        with pytest.raises(RuntimeError, match="too short a series"):
            cli.main(args, spark)

    stt = cli.main(["status", "--master", f"{r}/master", "--polls", f"{r}/polls", "--out", f"{r}/status"], spark)
    assert stt["cities"] == q(spark, sf_dir, "current_status").count()

    pr = cli.main(["predict", "--master", f"{r}/master", "--polls", f"{r}/polls", "--model", f"{r}/models/fc",
                   "--log", f"{r}/logs"], spark)
    want = {row.city: row.pred_24h for row in q(spark, sf_dir, "predict").collect()}
    got = {row.city: row.pred_24h for row in spark.read.parquet(f"{r}/logs/predictions").collect()}
    assert pr["cities"] == len(want) and got == want

    sm = cli.main(["stream", "--master", f"{r}/master", "--polls", f"{r}/polls", "--logs", f"{r}/logs",
                   "--checkpoint", f"{r}/ck", "--once"], spark)
    assert sm["status_rows"] == q(spark, sf_dir, "stream_status").count()
    readings = spark.read.parquet(f"{r}/logs/aqi_readings")
    assert readings.count() == si.readings_log(spark, sf_dir).count()
    assert readings.where(F.col("aqi").isNull()).count() == 0
    assert readings.select("stream").distinct().count() == 1
    cli.main(["stream", "--master", f"{r}/master", "--polls", f"{r}/polls", "--logs", f"{r}/logs",
              "--checkpoint", f"{r}/ck2", "--once"], spark)      # another checkpoint adds nothing that is there
    again = spark.read.parquet(f"{r}/logs/aqi_readings")
    assert again.count() == readings.count() and again.where("stream = 'none'").count() == 0
    assert spark.read.parquet(f"{r}/logs/alerts").count() == q(spark, sf_dir, "stream_alerts").count()
    served_answers(spark, sf_dir, r)


def served_answers(spark, sf_dir, r):
    """The commands that answer from the master, the polls, the logs and the models."""
    files = ["--master", f"{r}/master", "--polls", f"{r}/polls"]
    status = {row.city: row for row in q(spark, sf_dir, "current_status").where("error is null").collect()}
    names = sorted(status)[:2]
    rows = cli.main(["history", "--master", f"{r}/master", "--out", f"{r}/a1", "--city", names[0], "--rows", "7"], spark)
    hist = spark.read.json(f"{r}/a1").collect()
    assert rows["rows"] == len(hist) <= 7 and {x.city for x in hist} <= {names[0]}
    out = cli.main(["export", "--master", f"{r}/master", "--out", f"{r}/a2"], spark)
    assert out["rows"] == q(spark, sf_dir, "export_rows").count()
    cli.main(["compare", *files, "--cities", f"{names[1]}, {names[0]}, Nowhere", "--out", f"{r}/a3"], spark)
    got = spark.read.json(f"{r}/a3").orderBy("pos").collect()
    assert [x.city for x in got] == names[::-1]
    assert all(round(x.aqi, 6) == round(status[x.city].aqi, 6) for x in got)
    assert cli.main(["weather", "--polls", f"{r}/polls", "--cities", f"{names[0]},Nowhere", "--out", f"{r}/a4"], spark)["cities"] == 2
    assert spark.read.json(f"{r}/a4").where("city = 'Nowhere' and error is not null").count() == 1
    logs = cli.main(["logs", "--logs", f"{r}/logs", "--out", f"{r}/a5", "--name", "predictions", "--rows", "3"], spark)
    assert logs["aqi_readings"] == spark.read.parquet(f"{r}/logs/aqi_readings").count()
    assert logs["rows"] == min(3, logs["predictions"])
    city, n = spark.read.parquet(f"{r}/logs/aqi_readings").groupBy("city").count().orderBy("city").first()
    assert cli.main(["logs", "--logs", f"{r}/logs", "--out", f"{r}/a8", "--city", city], spark)["rows"] == min(50, n)
    doc = cli.main(["metrics", "--out", f"{r}/a6", "--sequence", f"{r}/models/fc/metrics", "--arima", f"{r}/none"], spark)
    assert doc == {"sequence_available": True, "classifier_available": False, "arima_available": False}
    rep = cli.main(["report", *files, "--model", f"{r}/models/fc", "--sequence", f"{r}/models/fc/metrics",
                    "--out", f"{r}/a7"], spark)
    assert rep["reports"] == len(status)


def test_cli_classifier_refuses_too_few_rows(spark, landed):
    r = str(landed)
    cli.main(["build-master", "--historical", f"{r}/data.csv", "--modern", f"{r}/city_day.csv",
              "--out", f"{r}/master2"], spark)
    n = spark.read.parquet(f"{r}/master2").where(F.col("aqi_bucket").isNotNull()).count()
    if n < 1000:
        with pytest.raises(ValueError, match="too few to train on"):
            cli.main(["train-classifier", "--master", f"{r}/master2", "--out", f"{r}/clf"], spark)


def test_cli_classifier_train_and_score(spark, tmp_path):
    """sf0.01 has enough labelled rows: train, save (K8), load and score the status (M9)."""
    sf = "/root/testdata/sf0.01"
    r = str(tmp_path)
    si.historical(spark, sf).orderBy("row_ord").drop("row_ord").write.option("header", True).csv(f"{r}/data.csv")
    si.modern(spark, sf).orderBy("row_ord").drop("row_ord").write.option("header", True).csv(f"{r}/city_day.csv")
    ss.land_payloads(si.poll_payloads(spark, sf), f"{r}/polls", files=2)
    cli.main(["build-master", "--historical", f"{r}/data.csv", "--modern", f"{r}/city_day.csv",
              "--out", f"{r}/master"], spark)
    res = cli.main(["train-classifier", "--master", f"{r}/master", "--out", f"{r}/clf"], spark)
    assert res["selected_model"] in ("random_forest", "logistic_regression") and 0 < res["f1_weighted"] <= 1
    doc = spark.read.json(f"{r}/clf/metrics").first()
    assert doc.selected_model == res["selected_model"] and "city" in doc.feature_columns
    cli.main(["status", "--master", f"{r}/master", "--polls", f"{r}/polls", "--out", f"{r}/status",
              "--classifier", f"{r}/clf"], spark)
    st = spark.read.json(f"{r}/status")
    assert st.count() > 0 and st.where(~F.col("ml_level").isin("Good", "Moderate", "Unhealthy", "Hazardous")).count() == 0


def test_cli_linear30_forecaster_feeds_predict(spark, sf_dir, landed):
    r = str(landed)
    cli.main(["build-master", "--historical", f"{r}/data.csv", "--modern", f"{r}/city_day.csv",
              "--out", f"{r}/master3"], spark)
    fc = cli.main(["train-forecaster", "--master", f"{r}/master3", "--out", f"{r}/models/lin",
                   "--kind", "linear30"], spark)
    assert fc["train_sequences"] > 0 and fc["mae"] >= 0
    model = spark.read.parquet(f"{r}/models/lin/model").first()
    assert len(model.coef) == 30 and model.kind == "linear30"
    doc = spark.read.json(f"{r}/models/lin/metrics").first()
    assert doc.best_val_loss >= 0 and doc.epochs_ran == 1
    out = cli.main(["predict", "--master", f"{r}/master3", "--polls", f"{r}/polls", "--model", f"{r}/models/lin",
                    "--log", f"{r}/logs-lin"], spark)
    preds = spark.read.parquet(f"{r}/logs-lin/predictions")
    assert preds.count() == out["cities"] > 0
    assert preds.where(F.col("pred_24h").isNull() | F.col("pred_72h").isNull()).count() == 0


def test_cli_gbt30_forecaster_feeds_predict(spark, landed):
    r = str(landed)
    cli.main(["build-master", "--historical", f"{r}/data.csv", "--modern", f"{r}/city_day.csv",
              "--out", f"{r}/master4"], spark)
    fc = cli.main(["train-forecaster", "--master", f"{r}/master4", "--out", f"{r}/models/gbt",
                   "--kind", "gbt30"], spark)
    assert fc["train_sequences"] > 0 and fc["rmse"] >= fc["mae"] >= 0
    doc = spark.read.json(f"{r}/models/gbt/metrics").first()
    assert doc.best_val_loss > 0 and 1 <= doc.epochs_ran <= 50      # trees kept by the validation tail
    out = cli.main(["predict", "--master", f"{r}/master4", "--polls", f"{r}/polls", "--model", f"{r}/models/gbt",
                    "--log", f"{r}/logs-gbt"], spark)
    preds = spark.read.parquet(f"{r}/logs-gbt/predictions")
    assert preds.count() == out["cities"] > 0
    assert preds.where(F.col("pred_24h").isNull()).count() == 0
