"""Registered queries for file round trips, model training and scoring, metrics documents,
reports and the stateful monitor stream (S1-S6, K1, K5, K6, M9, M11-M15, A16, U2, F23, F26, T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import classify as cl
from .. import forecast as fc
from .. import oracle as O
from ..master import build_master
from ...operators import metrics as mt
from ...operators import status as st
from ...operators import tables as tb
from ...sources import files as fl
from ...sources import standin as si
from ...streaming import streams as ss
from ...session import reliable_checkpoint
from .registry import MASTER_DOUBLES, SQL, master, register
from .tables import LAST_N_SQL
from .status import NEWEST_SQL, status_frame
from .forecasting import PREDICT_CTES, ar1_frame, seq_frame, prediction_frame
from .streams import LANDED, run_to_parquet, landed_polls


# ------------------------------------------------------------------ S1, S2, K1, S3: CSV round trip



@register("master_from_csv", O.with_ctes(O.finish("SELECT * FROM master", MASTER_DOUBLES, ["date"]), "master"))
def q_master_from_csv(spark, sf_dir):
    """Land both sources as CSV files in file order, read them back with the CSV readers
    (S1/S2, file order -> row_ord), fuse (U3), write partitioned by year (K1), scan (S3)."""
    root = ss.scratch_dir(spark, "csv")
    hist = si.historical(spark, sf_dir).orderBy("row_ord").drop("row_ord")
    hist.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{root}/historical")
    mod = si.modern(spark, sf_dir).orderBy("row_ord").drop("row_ord")
    mod.write.option("header", True).csv(f"{root}/modern")
    built = build_master(fl.read_historical(spark, f"{root}/historical"), fl.read_modern(spark, f"{root}/modern"))
    from ..master import write_master
    write_master(built, f"{root}/master")
    # The first existing of an ordered list of locations
    return fl.read_first_available(spark, [f"{root}/master-missing", f"{root}/master"]).drop("year")


# ------------------------------------------------------------------ M11-M14, M9, A16, M15, J9, K5, K6

_TRAINED: dict = {}


def trained(spark, sf_dir):
    """Fit the classifier once per session and scale (both fits run on executors)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = cl.train_and_select(master(spark, sf_dir))
    return _TRAINED[key]


@register("train_classifier")
def q_train_classifier(spark, sf_dir):
    return trained(spark, sf_dir)[1]


@register("classify_status")
def q_classify_status(spark, sf_dir):
    model, _, meta = trained(spark, sf_dir)
    status = tb.valid_rows(status_frame(spark, sf_dir)).select("city", "source", "aqi", "pm25", "pm10", "no2",
                                                              "so2", "co", "o3", "risk_level")
    return cl.classify(status, model, meta)


@register("training_summary")
def q_training_summary(spark, sf_dir):
    """A16 over the logistic fit's objective history (loss per optimiser round)."""
    _, _, meta = trained(spark, sf_dir)
    hist = spark.createDataFrame([("logistic_regression", meta["objective_history"])],
                                 "model STRING, objective_history ARRAY<DOUBLE>")
    return mt.training_summary(hist).drop("objective_history")


@register("linear30_model")
def q_linear30(spark, sf_dir):
    s, fit = seq_frame(spark, sf_dir)
    m = fc.fit_lag_model(s.where(F.col("part") == "train"), "linear30")
    return fc.evaluate_lag_model(s, m, fit)


@register("gbt30_forecast")
def q_gbt30(spark, sf_dir):
    """M1 ``gbt30`` + M4: the tree model's 24/48/72 h outlook per city (same shape as ``predict``)."""
    m = master(spark, sf_dir)
    s, fit = fc.scaled_sequences(m)
    model = fc.fit_lag_model(s.where(F.col("part") == "train"), "gbt30")
    return fc.predict_gbt(si.live_rows(spark, sf_dir), m, model, fit)


def _metrics_root(spark, sf_dir):
    from .. import reports as rp
    from ..sinks import write_metrics
    key = ("metrics", spark.sparkContext.applicationId, sf_dir)
    if key not in LANDED:
        root = ss.scratch_dir(spark, "metrics")
        m = master(spark, sf_dir)
        s, fit = ar1_frame(spark, sf_dir)
        train = s.where(F.col("part") == "train")
        ev = fc.evaluate_lag_model(s, fc.fit_lag_model(train, "ar1"), fit, last_only=True)
        prof = tb.profile(m.where(F.col("aqi").isNotNull()))
        write_metrics(rp.sequence_metrics_doc(ev, prof, fc.validation_loss(train)), f"{root}/sequence")
        per_city = fc.backtest_arima(m)
        write_metrics(rp.arima_metrics_doc(per_city, mt.summarise_metrics(per_city)), f"{root}/arima")
        _, metrics, meta = trained(spark, sf_dir)
        write_metrics(rp.classifier_metrics_doc(metrics, meta["features"]), f"{root}/classifier")
        LANDED[key] = root
    return LANDED[key]


@register("model_metrics")
def q_model_metrics(spark, sf_dir):
    from .. import reports as rp
    mm = rp.model_metrics(spark, _metrics_root(spark, sf_dir))
    return mm.select("sequence_available", "classifier_available", "arima_available",
                     F.col("sequence_metrics.mae").alias("sequence_mae"),
                     F.col("sequence_metrics.rmse").alias("sequence_rmse"),
                     F.col("classifier_metrics.selected_model").alias("selected_model"),
                     F.col("arima_metrics.aggregate.mae_mean").alias("arima_mae_mean"),
                     F.col("arima_metrics.cities_trained").alias("arima_cities"))


@register("report_summary", (
    "SELECT s.city, 'report_summary_' || replace(s.city, ' ', '_') || '_' || strftime((SELECT date_trunc('day', max(ts)) "
    "FROM events), '%Y%m%d_%H%M%S') || '.json' AS file, s.source, s.aqi, p.pred_24h, true AS classifier_available "
    f"FROM ({SQL['current_status']}) s LEFT JOIN ({SQL['predict']}) p ON p.city = s.city WHERE s.error IS NULL"))
def q_report_summary(spark, sf_dir):
    """The reports of the feed's last day, exported as JSON and read back."""
    from .. import reports as rp
    from ..sinks import export_report, read_reports
    mm = rp.model_metrics(spark, _metrics_root(spark, sf_dir))
    last = si.poll_rows(spark, sf_dir).agg(F.date_trunc("day", F.max("ts"))).first()[0]
    rep = st.report_summary(tb.valid_rows(status_frame(spark, sf_dir)), prediction_frame(spark, sf_dir), mm, last)
    out = ss.scratch_dir(spark, "reports")
    return read_reports(spark, out, export_report(rep, out)).select(
        "city", "file", F.col("current_status.source").alias("source"),
        F.col("current_status.aqi").alias("aqi"), F.col("forecast.pred_24h").alias("pred_24h"),
        F.col("model_metrics.classifier_available").alias("classifier_available"))


# ------------------------------------------------------------------ S5/S6 batch, U2, F23, F26

@register("live_from_json", O.with_ctes(O.finish(
    "SELECT l.city, l.ts, l.event_id, l.pm25, l.pm10, l.no2, l.so2, l.co, l.o3, l.aqi, w.temperature, w.humidity, "
    "w.wind_speed, w.weather_code FROM live l JOIN weather w ON l.event_id = w.event_id",
    ["pm25", "pm10", "no2", "so2", "co", "o3", "aqi", "temperature", "humidity", "wind_speed"], stamps=["ts"]),
    "live", "weather"))
def q_live_from_json(spark, sf_dir):
    """Landed AQI and weather answers read back with the batch JSON readers."""
    root = ss.scratch_dir(spark, "payloads")
    a, w = f"{root}/aqi", f"{root}/weather"
    ss.land_payloads(si.aqi_payloads(spark, sf_dir), a)
    ss.land_payloads(si.weather_payloads(spark, sf_dir), w)
    live = fl.read_aqi_payloads(spark, a)
    weather = fl.read_weather_payloads(spark, w).drop("city", "ts")
    return live.join(weather, "event_id")


@register("append_live", O.with_ctes(O.finish(
    "SELECT city, date, aqi, 'CSV' AS origin FROM (" + LAST_N_SQL.format(n=29) + ") UNION ALL "
    "SELECT city, CAST(ts AS DATE) AS date, aqi, 'LIVE' AS origin FROM live_latest WHERE aqi IS NOT NULL",
    ["aqi"], ["date"]), "master", "live", extra=[("live_latest", NEWEST_SQL.format(src="live"))]))
def q_append_live(spark, sf_dir):
    hist = tb.last_n(master(spark, sf_dir), 29).select("city", "date", "aqi", F.lit("CSV").alias("origin"))
    live = (st.newest_per_city(si.live_rows(spark, sf_dir)).where(F.col("aqi").isNotNull())
            .select("city", F.to_date("ts").alias("date"), "aqi", F.lit("LIVE").alias("origin")))
    return tb.append_live(hist, live)


@register("classifier_metrics_rows")
def q_classifier_metrics_rows(spark, sf_dir):
    """F23 over the classifier metrics document read back from storage."""
    doc = fl.read_metrics(spark, f"{_metrics_root(spark, sf_dir)}/classifier", "classifier")
    return mt.explode_metrics(doc, "all_metrics", "model")


@register("predict_document", O.with_ctes(O.finish(
    "SELECT city, 'LIVE' AS status, data_source, round(raw_24, 2) AS predicted_aqi_tomorrow, "
    + O.us_level("raw_24") + " AS risk_24h, " + O.us_color("raw_24") + " AS color_24h, "
    "round(raw_48, 2) AS aqi_48h, " + O.us_level("raw_48") + " AS risk_48h, "
    "round(raw_72, 2) AS aqi_72h, " + O.us_level("raw_72") + " AS risk_72h FROM predicted",
    ["predicted_aqi_tomorrow", "aqi_48h", "aqi_72h"]), "master", "live", extra=PREDICT_CTES))
def q_predict_document(spark, sf_dir):
    """the nested prediction document per city, compared field by field (its JSON text is
    unit-tested)."""
    m = master(spark, sf_dir)
    s, fit = ar1_frame(spark, sf_dir)
    model = fc.fit_lag_model(s.where(F.col("part") == "train"), "ar1")
    d = fc.predict_document(si.live_rows(spark, sf_dir), m, model, fit)
    return d.select("city", "status", "data_source", "predicted_aqi_tomorrow",
                    F.col("predictions.24h.health_risk.level").alias("risk_24h"),
                    F.col("predictions.24h.health_risk.color").alias("color_24h"),
                    F.col("predictions.48h.aqi").alias("aqi_48h"),
                    F.col("predictions.48h.health_risk.level").alias("risk_48h"),
                    F.col("predictions.72h.aqi").alias("aqi_72h"),
                    F.col("predictions.72h.health_risk.level").alias("risk_72h"))


def _file_count(spark, path) -> int:
    """Data files under ``path``, counted by Spark (works on any shared storage)."""
    return spark.read.text(path).select(F.input_file_name()).distinct().count()


def landed_slices(spark, sf_dir, n_slices: int = 4):
    """Polls and predictions landed as ``n_slices`` time slices, written in time order (a poller
    appends as time passes), each slice as several files written in parallel.

    Returns (root, files per poll slice, files per prediction slice): reading each kind with
    that many files per trigger makes every micro-batch exactly one slice of each kind.  If a
    kind's slices do not all have the same file count, it is landed again one file per slice.
    """
    key = ("slices", spark.sparkContext.applicationId, sf_dir, n_slices)
    if key not in LANDED:
        root = ss.scratch_dir(spark, "slices")
        # derive each source once; the slices below are cheap filters of the materialised data
        polls = reliable_checkpoint(si.poll_payloads(spark, sf_dir))
        preds = reliable_checkpoint(si.predictions_log(spark, sf_dir))
        lo, hi = polls.agg(F.min("ts"), F.max("ts")).first()
        step = (hi - lo) / n_slices

        def cut(df, k):
            a, b = lo + step * k, (lo + step * (k + 1) if k < n_slices - 1 else None)
            d = df.where(F.col("ts") >= F.lit(a))
            return d.where(F.col("ts") < F.lit(b)) if b is not None else d

        def land(df, kind, files):
            tag = f"{kind}-{files}"
            for k in range(n_slices):
                ss.land_payloads(cut(df, k), f"{root}/{tag}/slice={k:04d}", files=files)
            counts = {_file_count(spark, f"{root}/{tag}/slice={k:04d}") for k in range(n_slices)}
            return (f"{root}/{tag}", counts.pop()) if len(counts) == 1 else None

        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = []
        for df, kind in ((polls, "polls"), (preds, "preds")):
            out.append(land(df, kind, width) or land(df, kind, 1))
        LANDED[key] = tuple(out)
    return LANDED[key]


@register("stream_monitor_state", SQL["stream_monitor_log"])
def q_stream_monitor_state(spark, sf_dir):
    """T6 as a stateful stream over time-sliced landed files: one slice of each kind per
    micro-batch, state (newest prediction per city) carried between batches, so no call ever
    sees more than one slice of one city."""
    (polls_root, polls_files), (preds_root, preds_files) = landed_slices(spark, sf_dir)
    polls = ss.read_payload_stream(spark, f"{polls_root}/*/", max_files_per_trigger=polls_files) \
        .where(F.col("aqi").isNotNull())
    preds = ss.read_prediction_stream(spark, f"{preds_root}/*/", max_files_per_trigger=preds_files)
    sink = run_to_parquet(spark, ss.stream_monitor_state(polls, preds), name="monitor-state")
    return spark.read.parquet(sink)


@register("log_roundtrip", O.with_ctes(
    "SELECT 'aqi_readings' AS collection, count(*) AS n_rows FROM readings UNION ALL "
    "SELECT 'predictions', count(*) FROM predictions UNION ALL "
    "SELECT 'weather_logs', count(*) FROM weather", "readings", "predictions", "weather"))
def q_log_roundtrip(spark, sf_dir):
    """K2-K4 append every reading, prediction and weather row to day-partitioned logs; S8 reads
    them back; A10 counts them."""
    from ..sinks import append_predictions, append_readings, append_weather
    root = ss.scratch_dir(spark, "logs")
    append_readings(si.readings_log(spark, sf_dir), f"{root}/aqi_readings")
    append_predictions(si.predictions_log(spark, sf_dir), f"{root}/predictions")
    append_weather(si.weather_log(spark, sf_dir), f"{root}/weather_logs")
    return tb.log_counts(fl.read_log(spark, root, "aqi_readings"), fl.read_log(spark, root, "predictions"),
                         fl.read_log(spark, root, "weather_logs"))


@register("monitor_log_csv", O.with_ctes(O.finish(
    "SELECT strftime(r.ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, r.city, r.source, r.aqi AS aqi_now, "
    f"r.pm25, r.pm10, r.no2, r.so2, {O.us_level('r.aqi')} AS risk_now, "
    "p.pred_24h AS aqi_24h, p.pred_48h AS aqi_48h, p.pred_72h AS aqi_72h "
    "FROM readings r ASOF LEFT JOIN predictions p ON r.city = p.city AND r.ts >= p.ts",
    ["aqi_now", "pm25", "pm10", "no2", "so2", "aqi_24h", "aqi_48h", "aqi_72h"]), "readings", "predictions"))
def q_monitor_log_csv(spark, sf_dir):
    """J11 written as the monitor-log CSV (the reference's column layout) and read back."""
    path = ss.scratch_dir(spark, "monitor-csv")
    log = st.monitor_log(si.readings_log(spark, sf_dir), si.predictions_log(spark, sf_dir))
    (log.withColumn("timestamp", F.concat(F.col("timestamp"), F.lit("Z"))).drop("event_id")
        .write.option("header", True).csv(path))
    return fl.read_monitor_log(spark, path).drop("ts")
