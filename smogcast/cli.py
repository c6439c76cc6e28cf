"""Command line: the reference's scripts and endpoints as Spark jobs.

    python -m smogcast build-master --historical data.csv --modern city_day.csv --out master/
    python -m smogcast train-forecaster --master master/ --out models/forecaster [--kind ar1|linear30|gbt30]
    python -m smogcast backtest --master master/ --out models/arima [--order 2,1,2|1,1,0]
    python -m smogcast train-classifier --master master/ --out models/classifier
    python -m smogcast status --master master/ --polls polls/ --out status/ [--classifier models/classifier]
    python -m smogcast predict --master master/ --polls polls/ --model models/forecaster --log logs/
    python -m smogcast history --master master/ --out history/ [--city NAME] [--rows 90]
    python -m smogcast export --master master/ --out csv/ [--city NAME] [--rows 90]
    python -m smogcast compare --master master/ --polls polls/ --cities "A,B" --out compare/
    python -m smogcast weather --polls polls/ --cities "A,B" --out weather/
    python -m smogcast logs --logs logs/ --out recent/ [--name predictions] [--city NAME] [--rows 50]
    python -m smogcast metrics --out metrics/ [--sequence DIR] [--classifier DIR] [--arima DIR]
    python -m smogcast report --master master/ --polls polls/ --model models/forecaster --out reports/ [metrics as above]
    python -m smogcast stream --master master/ --polls polls/ --logs logs/ --checkpoint ck/ [--once]

Each command is one Spark application over all cities; paths may be any
Hadoop-compatible location (use shared storage on a cluster).  Under
``spark-submit`` the cluster's session is used; run directly, a local one.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from .session import get_session
    return get_session(app_name="smogcast-cli")


def cmd_build_master(spark, a) -> dict:
    """U3 + K1: fuse the two CSV histories and write the master series."""
    from .plans.master import build_master, write_master
    from .sources.files import read_historical, read_modern
    m = build_master(read_historical(spark, a.historical), read_modern(spark, a.modern))
    write_master(m, a.out)
    out = spark.read.parquet(a.out)
    return {"records": out.count(), "cities": out.select("city").distinct().count()}


def _poll_rows(spark, path):
    """Landed polls as one row per poll with both answers (one scan)."""
    from . import schemas
    from .sources.files import aqi_payload_fields
    raw = (spark.read.schema(schemas.POLL_PAYLOAD).option("timestampFormat", schemas.JSON_TS_FORMAT)
           .json(path))
    weather = [F.col("weather." + f).alias(n) for f, n in (
        ("temperature_2m", "temperature"), ("relative_humidity_2m", "humidity"),
        ("wind_speed_10m", "wind_speed"), ("weather_code", "weather_code"))]
    return aqi_payload_fields(raw, keep=("event_id", *weather))


def _answer(df, out) -> int:
    """Write an answer as JSON lines; the number of rows comes from what was written."""
    df.write.mode("overwrite").json(out)
    return df.sparkSession.read.schema(df.schema).json(out).count()


def cmd_train_forecaster(spark, a) -> dict:
    """M1 + M5 + K5: pooled next-day model, its test metrics, the model as a one-row table."""
    from .plans import forecast as fc
    from .plans.sinks import write_metrics
    from .plans.reports import sequence_metrics_doc
    from .operators.tables import profile
    m = spark.read.parquet(a.master)
    ar1 = a.kind == "ar1"
    s, fit = fc.scaled_sequences(m, arrays=not ar1)
    train = s.where(F.col("part") == "train")
    model = fc.fit_lag_model(train, a.kind)
    if a.kind == "gbt30":
        # a tree model has no coefficient row: save the MLlib model and the scaler fit
        model.write().overwrite().save(f"{a.out}/gbt")
        fit.withColumn("kind", F.lit(a.kind)).write.mode("overwrite").parquet(f"{a.out}/model")
        ev = fc.evaluate_gbt_model(s, model, fit)
    else:
        ev = fc.evaluate_lag_model(s, model, fit, last_only=ar1)
        model.crossJoin(fit).withColumn("kind", F.lit(a.kind)).write.mode("overwrite").parquet(f"{a.out}/model")
    loss = fc.validation_loss(train, a.kind, model)
    write_metrics(sequence_metrics_doc(ev, profile(m.where(F.col("aqi").isNotNull())), loss), f"{a.out}/metrics")
    return ev.first().asDict()


def cmd_backtest(spark, a) -> dict:
    """M6 + A6 + K5: per-city ARIMA backtests on the top cities, with the summary document."""
    from .plans import forecast as fc
    from .plans.reports import arima_metrics_doc
    from .plans.sinks import write_metrics
    from .operators.metrics import summarise_metrics
    m = spark.read.parquet(a.master)
    order = tuple(int(x) for x in a.order.split(","))
    per_city = fc.backtest_arima(m) if order == (2, 1, 2) else fc.backtest_ar1(m)
    summary = summarise_metrics(per_city)
    result = summary.first().asDict()
    if not result["cities_trained"]:
        raise RuntimeError("every city has too short a series for a backtest")
    write_metrics(arima_metrics_doc(per_city, summary, order), a.out)
    return result


def cmd_train_classifier(spark, a) -> dict:
    """M14 + K8 + K5: fit both models, keep the best, write artifact and metrics."""
    from .plans import classify as cl
    from .plans.reports import classifier_metrics_doc
    from .plans.sinks import save_model, write_metrics
    model, metrics, meta = cl.train_and_select(spark.read.parquet(a.master))
    save_model(model, a.out, meta)
    write_metrics(classifier_metrics_doc(metrics, meta["features"]), f"{a.out}/metrics")
    return {"selected_model": meta["model_name"], "f1_weighted": meta["selected_model_f1_weighted"]}


def cmd_status(spark, a) -> dict:
    """J3 + F1: current status of every city (live poll, else history; the poll's weather), as JSON."""
    from .operators.status import current_status
    polls = _poll_rows(spark, a.polls)
    st = current_status(polls, spark.read.parquet(a.master))   # weather from the same polls
    if a.classifier:   # M9: the classifier's level next to the rule-based one
        from .operators.tables import valid_rows
        from .plans.classify import classify
        from .plans.sinks import load_model
        model, meta = load_model(a.classifier)
        st = classify(valid_rows(st), model, meta)
    return {"cities": _answer(st, a.out)}


def _outlook(spark, live, master, model_path):
    """M4 with the saved model, whichever kind it is."""
    from .plans import forecast as fc
    saved = spark.read.parquet(f"{model_path}/model")
    if saved.first()["kind"] == "gbt30":
        from pyspark.ml.regression import GBTRegressionModel
        return fc.predict_gbt(live, master, GBTRegressionModel.load(f"{model_path}/gbt"), saved.select("lo", "hi"))
    return fc.predict(live, master, saved.select("intercept", "coef"), saved.select("lo", "hi"))


def cmd_predict(spark, a) -> dict:
    """M4 + K3: 24/48/72 h outlook for every city, appended to the predictions log."""
    from .plans.sinks import append_predictions
    pred = _outlook(spark, _poll_rows(spark, a.polls), spark.read.parquet(a.master), a.model).persist()
    append_predictions(pred, f"{a.log}/predictions")
    cities = pred.count()
    pred.unpersist()
    return {"cities": cities}


def cmd_history(spark, a) -> dict:
    """The last rows of one city or of every city, as JSON."""
    from .operators.tables import historical
    return {"rows": _answer(historical(spark.read.parquet(a.master), a.rows, a.city), a.out)}


def cmd_export(spark, a) -> dict:
    """K7: the last rows of one city or of every city, as CSV with one folder per city."""
    from .plans.sinks import export_csv
    export_csv(spark.read.parquet(a.master), a.out, a.rows, a.city)
    return {"rows": spark.read.option("header", True).csv(a.out).count()}


def cmd_compare(spark, a) -> dict:
    """Current status of up to five asked cities side by side, in the order asked, as JSON."""
    from .operators.status import asked_cities, compare_cities, current_status, restrict_to
    asked = asked_cities(spark, a.cities)
    st = current_status(restrict_to(_poll_rows(spark, a.polls), asked),
                        restrict_to(spark.read.parquet(a.master), asked))
    return {"cities": _answer(compare_cities(st, asked), a.out)}


def cmd_weather(spark, a) -> dict:
    """Newest weather of up to five asked cities, as JSON; a city without any gets an error text."""
    from .operators.status import asked_cities, current_weather, restrict_to
    asked = asked_cities(spark, a.cities)
    seen = restrict_to(_poll_rows(spark, a.polls), asked).where(
        "coalesce(temperature, humidity, wind_speed, weather_code) is not null")
    return {"cities": _answer(current_weather(seen, asked), a.out)}


def cmd_logs(spark, a) -> dict:
    """A10 + O2/O3: how many rows each log has, and the newest rows of one of them as JSON."""
    from .operators.tables import log_counts, recent_rows
    from .sources.files import read_log
    logs = {name: read_log(spark, a.logs, name) for name in ("aqi_readings", "predictions", "weather_logs")}
    counts = {r["collection"]: r["n_rows"] for r in log_counts(*logs.values()).collect()}     # three rows
    return {**counts, "rows": _answer(recent_rows(logs[a.name], a.city, a.rows), a.out)}


def _metrics(spark, a):
    from .plans.reports import model_metrics
    return model_metrics(spark, paths={"sequence": a.sequence, "classifier": a.classifier, "arima": a.arima})


def cmd_metrics(spark, a) -> dict:
    """The three models' metrics documents side by side, as JSON."""
    doc = _metrics(spark, a)
    _answer(doc, a.out)
    return doc.select("sequence_available", "classifier_available", "arima_available").first().asDict()


def cmd_report(spark, a) -> dict:
    """J9 + K6: one report per city with its status, outlook and the models' metrics."""
    from .operators.status import current_status, report_summary
    from .operators.tables import valid_rows
    from .plans.sinks import export_report
    polls, master = _poll_rows(spark, a.polls), spark.read.parquet(a.master)
    report = report_summary(valid_rows(current_status(polls, master)), _outlook(spark, polls, master, a.model),
                            _metrics(spark, a))
    export_report(report, a.out)
    return {"reports": spark.read.json(a.out).count()}


def cmd_stream(spark, a) -> dict:
    """Poll files -> status, alerts, current status, reading and weather logs, every 60 s (or once).

    One read of the polls feeds the four logs; with ``--predictions`` the monitor log is kept too.
    """
    from .streaming import streams as ss
    master = ss.master_snapshot(spark, a.master)
    sinks = [ss.status_batches(master, f"{a.logs}/status"), ss.alert_batches(master, f"{a.logs}/alerts"),
             ss.latest_batches(master, f"{a.logs}/latest"),
             ss.store_batches(f"{a.logs}/aqi_readings", f"{a.logs}/weather_logs")]
    polls = ss.read_payload_stream(spark, a.polls, max_files_per_trigger=a.max_files)
    streams = [(polls, ss.all_batches(*sinks), f"{a.checkpoint}/polls")]
    if a.predictions:
        feed = ss.read_monitor_feed(polls, ss.read_prediction_stream(spark, a.predictions, a.max_files))
        streams.append((feed, ss.monitor_batches(f"{a.logs}/monitor"), f"{a.checkpoint}/monitor"))
    if a.once:
        for stream, write, checkpoint in streams:
            ss.run_available(stream, None, checkpoint, foreach_batch=write)
        return {"status_rows": spark.read.parquet(f"{a.logs}/status").count()}
    running = [ss.start_stream(stream, None, checkpoint, foreach_batch=write) for stream, write, checkpoint in streams]
    spark.streams.awaitAnyTermination()
    return {"stopped": [q.id for q in running]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="smogcast", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    documents = [(f"--{kind}", {"default": None, "help": f"folder of the {kind} metrics document"})
                 for kind in ("sequence", "classifier", "arima")]

    def city_rows(n):
        return [("--city", {"default": None}), ("--rows", {"type": int, "default": n})]

    spec = {
        "build-master": [("--historical", {}), ("--modern", {}), ("--out", {})],
        "train-forecaster": [("--master", {}), ("--out", {}),
                             ("--kind", {"default": "ar1", "choices": ["ar1", "linear30", "gbt30"]})],
        "backtest": [("--master", {}), ("--out", {}),
                     ("--order", {"default": "2,1,2", "choices": ["2,1,2", "1,1,0"]})],
        "train-classifier": [("--master", {}), ("--out", {})],
        "status": [("--master", {}), ("--polls", {}), ("--out", {}),
                   ("--classifier", {"default": None, "help": "saved classifier (train-classifier --out)"})],
        "predict": [("--master", {}), ("--polls", {}), ("--model", {}), ("--log", {})],
        "history": [("--master", {}), ("--out", {}), *city_rows(90)],
        "export": [("--master", {}), ("--out", {}), *city_rows(90)],
        "compare": [("--master", {}), ("--polls", {}), ("--cities", {}), ("--out", {})],
        "weather": [("--polls", {}), ("--cities", {}), ("--out", {})],
        "logs": [("--logs", {}), ("--out", {}), *city_rows(50),
                 ("--name", {"default": "aqi_readings", "choices": ["aqi_readings", "predictions", "weather_logs"]})],
        "metrics": [("--out", {}), *documents],
        "report": [("--master", {}), ("--polls", {}), ("--model", {}), ("--out", {}), *documents],
        "stream": [("--master", {}), ("--polls", {}), ("--logs", {}), ("--checkpoint", {}),
                   ("--predictions", {"default": None, "help": "folder of landed prediction files"}),
                   ("--once", {"action": "store_true"}), ("--max-files", {"type": int, "default": 16})],
    }
    for name, args in spec.items():
        sp = sub.add_parser(name, help=COMMANDS[name].__doc__.split("\n")[0])
        for flag, kw in args:   # flags without options are required
            sp.add_argument(flag, **(kw or {"required": True}))
    return p


COMMANDS = {"build-master": cmd_build_master, "train-forecaster": cmd_train_forecaster,
            "backtest": cmd_backtest, "train-classifier": cmd_train_classifier, "status": cmd_status,
            "predict": cmd_predict, "history": cmd_history, "export": cmd_export, "compare": cmd_compare,
            "weather": cmd_weather, "logs": cmd_logs, "metrics": cmd_metrics, "report": cmd_report,
            "stream": cmd_stream}


def main(argv=None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    result = COMMANDS[a.command](spark or _session(), a)
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main(sys.argv[1:])
