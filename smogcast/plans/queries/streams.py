"""Registered Structured Streaming queries (T1-T6): landed polls -> stream -> sink."""

from __future__ import annotations



from pyspark.sql import functions as F

from .. import oracle as O
from ...operators import tables as tb
from ...sources import files as fl
from ...sources import standin as si
from ...streaming import streams as ss
from ...streaming.logs import read_newest
from .registry import master_path, register
from .status import LATEST_SQL


# ------------------------------------------------------------------ T1-T6 (Structured Streaming)


LANDED: dict = {}


def landed_polls(spark, sf_dir) -> str:
    """Land the stand-in polls as JSON once per session and scale (shared scratch folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in LANDED:
        path = ss.scratch_dir(spark, "polls")
        ss.land_payloads(si.poll_payloads(spark, sf_dir), path)
        LANDED[key] = path
    return LANDED[key]


def _run_batches(spark, sf_dir, sink_of, name):
    """Stream the landed polls into a new sink through ``sink_of(snapshot of the master, path)``."""
    path = ss.scratch_dir(spark, name)
    snapshot = ss.master_snapshot(spark, master_path(spark, sf_dir))
    ss.run_available(ss.read_payload_stream(spark, landed_polls(spark, sf_dir)), None, path + "-checkpoint",
                     foreach_batch=sink_of(snapshot, path))
    return path


def _log(spark, path):
    return spark.read.parquet(path).drop("day", "stream", "batch")


def run_to_parquet(spark, df, mode="append", foreach_batch=None, name="sink"):
    sink = ss.scratch_dir(spark, name)
    ss.run_available(df, sink, sink + "-checkpoint", mode=mode, foreach_batch=foreach_batch)
    return sink


STREAM_STATUS_SQL = (
    "SELECT l.city, l.ts, l.event_id, CASE WHEN l.aqi IS NOT NULL THEN 'LIVE SATELLITE' ELSE 'CSV FALLBACK' END AS source, "
    "CASE WHEN l.aqi IS NOT NULL THEN l.aqi ELSE h.aqi END AS aqi, "
    "CASE WHEN l.aqi IS NOT NULL THEN l.pm25 ELSE h.pm25 END AS pm25, "
    "CASE WHEN l.aqi IS NOT NULL THEN l.pm10 ELSE h.pm10 END AS pm10, "
    "CASE WHEN l.aqi IS NOT NULL THEN l.no2 ELSE h.no2 END AS no2 "
    "FROM live l LEFT JOIN hist_latest h ON l.city = h.city WHERE l.aqi IS NOT NULL OR h.aqi IS NOT NULL")
STREAM_CTES = [("hist_latest", LATEST_SQL), ("sstatus0", STREAM_STATUS_SQL),
               ("sstatus", "SELECT *, " + O.us_level("aqi") + " AS risk_level, " + O.us_color("aqi")
                + " AS risk_color FROM sstatus0")]
S_DOUBLES = ["aqi", "pm25", "pm10", "no2"]


@register("stream_status", O.with_ctes(O.finish("SELECT * FROM sstatus", S_DOUBLES, stamps=["ts"]),
                                       "master", "live", extra=STREAM_CTES))
def q_stream_status(spark, sf_dir):
    return _log(spark, _run_batches(spark, sf_dir, ss.status_batches, "status"))


STREAM_ALERT_SQL = (
    "SELECT city, ts, event_id, aqi, {lvl} AS risk_level, "
    "'CRITICAL AIR QUALITY ALERT: ' || upper(city) || ' AQI ' || CAST(CAST(floor(aqi + 0.5) AS BIGINT) AS VARCHAR) "
    "|| ' — ' || {us} AS alert_text FROM sstatus WHERE aqi > 150.0").format(lvl=O.display_level("aqi"),
                                                                           us=O.us_level("aqi"))


@register("stream_alerts", O.with_ctes(O.finish(STREAM_ALERT_SQL, ["aqi"], stamps=["ts"]),
                                       "master", "live", extra=STREAM_CTES))
def q_stream_alerts(spark, sf_dir):
    return _log(spark, _run_batches(spark, sf_dir, ss.alert_batches, "alerts"))


@register("stream_alert_history", O.with_ctes(O.finish(
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) AS rank "
    f"FROM ({STREAM_ALERT_SQL})) WHERE rank <= 20", ["aqi"], stamps=["ts"]), "master", "live", extra=STREAM_CTES))
def q_stream_alert_history(spark, sf_dir):
    return tb.recent_log(_log(spark, _run_batches(spark, sf_dir, ss.alert_batches, "alerts")), 20, key="city")


@register("stream_latest", O.with_ctes(O.finish(
    "SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) "
    "AS rn_ FROM sstatus) WHERE rn_ = 1", S_DOUBLES, stamps=["ts"]), "master", "live", extra=STREAM_CTES))
def q_stream_latest(spark, sf_dir):
    return read_newest(spark, _run_batches(spark, sf_dir, ss.latest_batches, "latest"))


@register("stream_store", O.with_ctes(O.finish(
    "SELECT city, source, aqi, pm25, pm10, no2, so2, temperature, humidity, wind_speed, event_id, ts AS observed_ts "
    "FROM readings", ["aqi", "pm25", "pm10", "no2", "so2", "temperature", "humidity", "wind_speed"],
    stamps=["observed_ts"]), "readings"))
def q_stream_store(spark, sf_dir):
    readings, _ = _stored(spark, sf_dir)
    return fl.read_log(spark, readings, "").drop("ts", "day", "stream", "batch")


def _stored(spark, sf_dir):
    readings, weather = ss.scratch_dir(spark, "readings"), ss.scratch_dir(spark, "weather")
    ss.run_available(ss.read_payload_stream(spark, landed_polls(spark, sf_dir)), None, readings + "-checkpoint",
                     foreach_batch=ss.store_batches(readings, weather))
    return readings, weather


@register("stream_store_weather", O.with_ctes(O.finish(
    "SELECT city, temperature, humidity, wind_speed, event_id, ts AS observed_ts FROM weather",
    ["temperature", "humidity", "wind_speed"], stamps=["observed_ts"]), "weather"))
def q_stream_store_weather(spark, sf_dir):
    """T2's weather log, by value."""
    _, weather = _stored(spark, sf_dir)
    return fl.read_log(spark, weather, "").drop("ts", "day", "stream", "batch")


@register("stream_monitor_log", O.with_ctes(O.finish(
    "SELECT strftime(r.ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, r.city, r.source, r.aqi AS aqi_now, "
    f"r.pm25, r.pm10, r.no2, r.so2, {O.us_level('r.aqi')} AS risk_now, "
    "p.pred_24h AS aqi_24h, p.pred_48h AS aqi_48h, p.pred_72h AS aqi_72h, r.event_id "
    "FROM readings r ASOF LEFT JOIN predictions p ON r.city = p.city AND r.ts >= p.ts",
    ["aqi_now", "pm25", "pm10", "no2", "so2", "aqi_24h", "aqi_48h", "aqi_72h"]), "readings", "predictions"))
def q_stream_monitor_log(spark, sf_dir):
    """Four batches of both feeds, whose files mix all times: most predictions come after their readings."""
    root = ss.scratch_dir(spark, "monitor")
    polls, preds, files = scattered_feeds(spark, sf_dir)
    most = -(-files // 4)
    feed = ss.read_monitor_feed(ss.read_payload_stream(spark, polls, max_files_per_trigger=most),
                                ss.read_prediction_stream(spark, preds, max_files_per_trigger=most))
    ss.run_available(feed, None, f"{root}/checkpoint", foreach_batch=ss.monitor_batches(root))
    return ss.read_monitor(spark, root)


def scattered_feeds(spark, sf_dir):
    """Polls and predictions landed as files dealt by id, not by time; their folders and the files of each."""
    key = ("scattered", spark.sparkContext.applicationId, sf_dir)
    if key not in LANDED:
        root, files = ss.scratch_dir(spark, "scattered"), max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
        for df, kind in ((si.poll_payloads(spark, sf_dir), "polls"), (si.predictions_log(spark, sf_dir), "preds")):
            ss.land_payloads(df.repartition(files, F.xxhash64("event_id")), f"{root}/{kind}")
        LANDED[key] = (f"{root}/polls", f"{root}/preds", files)
    return LANDED[key]
