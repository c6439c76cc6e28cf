"""Live feeds with Structured Streaming: SURVEY T1-T6.

The reference polls an HTTP API every 60 s and stamps processing time; here
the payloads land as JSON files and a file stream reads them.  Operators:

* T1 ``status_batches``: each poll -> status (live, or history fallback when the
  poll has no AQI): joined with the latest history per city of the newest
  snapshot of the master, which each batch looks up.
* T2 ``store_batches``: readings and weather logs from one cached batch.
* T3 ``latest_batches``: current status per city, a versioned table of one row per
  city that each batch is merged into.
* T4 ``alert_batches``: statuses above a threshold.
* T5 alert history: the batch view W9 over T4's sink.
* T6 ``monitor_batches``: readings as-of joined (J11) with the predictions that
  the same stream collects; a prediction that comes late corrects what was logged.
  ``stream_monitor_state`` is the stateful form for feeds in order.

Streams are stateless but for the last: replays are dropped where rows are written,
against the log's own day partitions (:mod:`smogcast.streaming.logs`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import alert_text, iso_ts
from ..functions.risk import health_risk, risk_display
from ..operators.status import (FALLBACK_TAG, LIVE_TAG, PRED_COLS, asof_predictions, monitor_columns,
                                monitor_readings)
from ..operators.tables import dedup_last, latest_per_city
from ..session import ensure_checkpoint_dir
from ..sources.files import aqi_payload_fields
from .. import schemas
from .logs import (FEW_DAYS, Snapshot, append, append_batches, by_day, day_counts, day_of, listed_in_lots, log_days, new_rows,
                   publish, read_days, read_newest)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder (shared storage)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/smogcast-{name}-{uuid.uuid4().hex[:12]}"


def read_payload_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S5+S6 as a stream of polls: city, ts, event_id, AQI fields and weather fields.

    File streams need an explicit schema; timestamps keep microseconds.
    """
    r = spark.readStream.schema(schemas.POLL_PAYLOAD).option("timestampFormat", schemas.JSON_TS_FORMAT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.json(path)
    weather = [F.col("weather." + f).alias(n) for f, n in (
        ("temperature_2m", "temperature"), ("relative_humidity_2m", "humidity"),
        ("wind_speed_10m", "wind_speed"), ("weather_code", "weather_code"))]
    return aqi_payload_fields(raw, keep=("event_id", *weather))


def latest_history(master: DataFrame) -> DataFrame:
    """The fallback side of T1: the latest history row per city."""
    return latest_per_city(master).select(
        "city", F.col("aqi").alias("h_aqi"), F.col("pm25").alias("h_pm25"),
        F.col("pm10").alias("h_pm10"), F.col("no2").alias("h_no2"), F.col("date").alias("h_date"))


def poll_status(polls: DataFrame, history: DataFrame) -> DataFrame:
    """Per poll, the live reading if it has an AQI, else the city's latest history row.

    ``history`` (:func:`latest_history`) has one row per city.
    """
    j = polls.join(history, "city", "left")
    live = F.col("aqi").isNotNull()
    has_h = F.col("h_aqi").isNotNull()
    aqi = F.when(live, F.col("aqi")).otherwise(F.col("h_aqi"))
    out = j.select(
        "city", "ts", "event_id",
        F.when(live, F.lit(LIVE_TAG)).when(has_h, F.lit(FALLBACK_TAG)).alias("source"),
        aqi.alias("aqi"),
        F.when(live, F.col("pm25")).otherwise(F.col("h_pm25")).alias("pm25"),
        F.when(live, F.col("pm10")).otherwise(F.col("h_pm10")).alias("pm10"),
        F.when(live, F.col("no2")).otherwise(F.col("h_no2")).alias("no2"))
    hr = health_risk("aqi")
    return out.where(F.col("source").isNotNull()).select(
        "*", hr["level"].alias("risk_level"), hr["color"].alias("risk_color"))


def master_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The master's fallback rows, looked up again by each batch."""
    return Snapshot(spark, path, latest_history)


def status_batches(master: Snapshot, path: str):
    """``foreachBatch`` function: the status of each new poll, into a log by day."""
    return append_batches(path, lambda polls: poll_status(polls, master.current()))


def alert_batches(master: Snapshot, path: str, threshold: float = 150):
    """T4: ``foreachBatch`` function: the alerts of each new poll, into a log by day."""
    return append_batches(path, lambda polls: stream_alerts(poll_status(polls, master.current()), threshold))


def latest_batches(master: Snapshot, path: str):
    """``foreachBatch`` function: merges each batch into the table of the current status per city.

    The table has one row per city and is published as a new version; a replayed
    batch merges into the same rows again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = poll_status(batch, master.current())
        before = read_newest(batch.sparkSession, path)
        publish(dedup_last(rows if before is None else before.unionByName(rows), ["city"], ["ts", "event_id"]), path)
    return write


def stream_alerts(status_stream: DataFrame, threshold: float = 150) -> DataFrame:
    """T4: alert rows as they come (stateless, append mode)."""
    a = status_stream.where(F.col("aqi") > F.lit(float(threshold)))
    lvl = risk_display("aqi")["level"]
    return a.select("city", "ts", "event_id", "aqi", lvl.alias("risk_level"),
                    alert_text("city", "aqi", health_risk("aqi")["level"]).alias("alert_text"))


def store_batches(readings_path: str, weather_path: str):
    """``foreachBatch`` function writing both logs from one cached batch.

    Rows keep the id and time of their poll, as the logs of batch jobs do, and lie in
    the folder of the poll's day.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumns({"day": day_of("ts"), "observed_ts": F.col("ts"), "ts": F.current_timestamp()})
        stamped.persist()
        key = ("city", "observed_ts", "event_id")
        readings = stamped.where(F.col("aqi").isNotNull()).select(
            "city", F.lit(LIVE_TAG).alias("source"), "aqi", "pm25", "pm10", "no2", "so2",
            "temperature", "humidity", "wind_speed", "event_id", "observed_ts", "ts", "day")
        weather = stamped.select("city", "temperature", "humidity", "wind_speed", "event_id", "observed_ts", "ts", "day")
        try:
            for rows, path in ((readings, readings_path), (weather, weather_path)):
                append(new_rows(rows, batch_id, path, key), batch_id, path)
        finally:
            stamped.unpersist()
    return write


def all_batches(*sinks):
    """``foreachBatch`` function: one cached read of a batch for several sinks, each of which is safe to repeat."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()
    return write


# ------------------------------------------------------------------ T6: the monitor log

PREDICTION_ROW = "city string, ts timestamp, event_id long, pred_24h double, pred_48h double, pred_72h double"
_PRED = "struct<pts:timestamp,pid:bigint,pred_24h:double,pred_48h:double,pred_72h:double>"
MONITOR_ROW = ("city string, ts timestamp, event_id long, source string, aqi_now double, pm25 double, pm10 double, "
               f"no2 double, so2 double, pred {_PRED}")
_PARTS = ", day string, stream string, batch long"


def read_monitor_feed(polls: DataFrame, predictions: DataFrame) -> DataFrame:
    """The streams of polls and of predictions as one, told apart by ``is_poll``."""
    return polls.withColumn("is_poll", F.lit(True)).unionByName(
        predictions.select("city", "ts", "event_id", *PRED_COLS, F.lit(False).alias("is_poll")), allowMissingColumns=True)


def _order(pred: str):
    return F.struct(F.col(f"{pred}.pts"), F.col(f"{pred}.pid"))


def monitor_batches(root: str):
    """``foreachBatch`` function over :func:`read_monitor_feed`; its tables lie under ``root``.

    1. New predictions go into ``predictions`` by day, and the last one of each city on
       each day they touch into ``last_predictions`` (one row per city and day).
    2. New readings take the newest prediction before them, among those of their days
       and the last ones of earlier days, and go into ``monitor``.
    3. Logged readings from the first day of a new prediction on are joined with the
       batch's predictions; those for which one of them is newer than what they have
       are logged again.

    So the order in which files land doesn't matter.  :func:`read_monitor` takes the
    row with the newest prediction of each reading.  A batch reads the days it touches
    and one row per city and day.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", day_of("ts"))
        batch.persist()
        try:
            told = batch.where(~F.col("is_poll") & F.col("ts").isNotNull()).select(
                "city", "ts", F.col("event_id").cast("long").alias("event_id"), *PRED_COLS, "day")
            fresh = new_rows(told, batch_id, f"{root}/predictions").persist()
            days = sorted(day_counts(fresh))
            if days:
                append(fresh, batch_id, f"{root}/predictions")
                whole = read_days(spark, f"{root}/predictions", days, PREDICTION_ROW + _PARTS)
                last = dedup_last(whole.drop("stream", "batch"), ["city", "day"], ["ts", "event_id"])
                # a number of its own: the table is small, but its files are one a day
                (last.repartition(-(-len(days) // FEW_DAYS), "day").write.mode("overwrite")
                     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/last_predictions"))
            readings = monitor_readings(batch.where(F.col("is_poll") & F.col("aqi").isNotNull())
                                        .withColumn("source", F.lit(LIVE_TAG)), "day")
            readings = new_rows(readings, batch_id, f"{root}/monitor").persist()
            counts = day_counts(readings)
            out = []
            if counts:
                out.append(asof_predictions(readings, _known(spark, root, sorted(counts))))
            if days and (logged := _logged(spark, root, days[0], batch_id)) is not None:
                later = asof_predictions(_newest(logged).withColumnRenamed("pred", "had"), fresh, times=logged)
                newer = F.col("pred").isNotNull() & (F.col("had").isNull() | (_order("pred") > _order("had")))
                out.append(later.where(newer).drop("had"))
                for day, n in day_counts(logged).items():        # the most that can be corrected
                    counts[day] = counts.get(day, 0) + n
            if out:
                rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
                rows = rows.select(*[c.split(" ")[0] for c in MONITOR_ROW.split(", ")], "day")
                append(by_day(rows, counts), batch_id, f"{root}/monitor")
            fresh.unpersist()
            readings.unpersist()
        finally:
            batch.unpersist()
    return write


def _known(spark: SparkSession, root: str, days: list[str]) -> DataFrame:
    """Predictions of ``days``, and the last one of each city on each earlier day."""
    listed_in_lots(spark)
    last = spark.read.schema(PREDICTION_ROW + ", day string").parquet(f"{root}/last_predictions") if log_days(
        spark, f"{root}/last_predictions") else spark.createDataFrame([], PREDICTION_ROW + ", day string")
    columns = ["city", "ts", "event_id", *PRED_COLS]
    out = last.where(F.col("day") < F.lit(days[-1])).select(*columns)
    near = read_days(spark, f"{root}/predictions", days, PREDICTION_ROW + _PARTS)
    return out if near is None else out.unionByName(near.select(*columns))


def _newest(rows: DataFrame) -> DataFrame:
    """Of each logged reading the row with the newest prediction."""
    return dedup_last(rows.withColumn("order", _order("pred")), ["city", "ts", "event_id", "day"], ["order"]).drop("order")


def _logged(spark: SparkSession, root: str, first: str, batch_id: int) -> DataFrame | None:
    """What earlier batches logged for ``first`` and later days, corrections beside what they correct."""
    from .logs import stream_id
    days = [d for d in log_days(spark, f"{root}/monitor") if d >= first]
    rows = read_days(spark, f"{root}/monitor", days, MONITOR_ROW + _PARTS)
    if rows is None:
        return None
    rows = rows.where(~((F.col("stream") == stream_id(spark)) & (F.col("batch") == batch_id)))
    return rows.drop("stream", "batch")


def read_monitor(spark: SparkSession, root: str) -> DataFrame:
    """The monitor log that :func:`monitor_batches` keeps: each reading once, with its newest prediction."""
    listed_in_lots(spark)
    rows = spark.read.schema(MONITOR_ROW + _PARTS).parquet(f"{root}/monitor")
    return monitor_columns(_newest(rows.drop("stream", "batch")))


MONITOR_STATE_SCHEMA = "pts TIMESTAMP, pid LONG, pred_24h DOUBLE, pred_48h DOUBLE, pred_72h DOUBLE"
MONITOR_OUT_SCHEMA = ("city STRING, ts TIMESTAMP, event_id LONG, source STRING, aqi_now DOUBLE, pm25 DOUBLE, "
                      "pm10 DOUBLE, no2 DOUBLE, so2 DOUBLE, aqi_24h DOUBLE, aqi_48h DOUBLE, aqi_72h DOUBLE")


def _carry_predictions(key, batches, state):
    """Per city and micro-batch: order rows by (ts, kind, id), each reading takes the
    whole newest prediction before it, the state's among them; the newest is kept."""
    import numpy as np
    import pandas as pd
    pdf = pd.concat(list(batches), ignore_index=True)
    cols = ["pred_24h", "pred_48h", "pred_72h"]
    if state.exists:
        held = dict(zip(["ts", "event_id", *cols], state.get), _kind=0)
        pdf = pd.concat([pdf, pd.DataFrame([held]).reindex(columns=pdf.columns)], ignore_index=True)
    pdf = pdf.sort_values(["ts", "_kind", "event_id"], kind="mergesort").reset_index(drop=True)
    values = pdf[cols].astype("float64")
    at = np.maximum.accumulate(np.where(pdf["_kind"] == 0, np.arange(len(pdf)), -1))
    carried = values.iloc[np.maximum(at, 0)].reset_index(drop=True)
    carried[at < 0] = np.nan
    if at[-1] >= 0:
        last = pdf.iloc[at[-1]]
        state.update((last["ts"], int(last["event_id"]), *[float(values.at[at[-1], c]) for c in cols]))
    out = pdf.loc[pdf["_kind"] == 1, ["city", "ts", "event_id", "source", "aqi", "pm25", "pm10", "no2", "so2"]]
    out = out.rename(columns={"aqi": "aqi_now"})
    for c, h in zip(cols, ("aqi_24h", "aqi_48h", "aqi_72h")):
        out[h] = carried.loc[out.index, c].values
    yield out


def stream_monitor_state(readings_stream: DataFrame, predictions_stream: DataFrame) -> DataFrame:
    """T6 as a stateful stream: readings as-of joined with the newest prediction per city.

    Both streams are unioned and grouped by city; ``applyInPandasWithState``
    keeps one row of state per city (its newest prediction).  Each call sees
    one city's rows of one micro-batch (bounded by the trigger's input limit),
    never the whole history.  Exact when predictions arrive no later than the
    readings they precede (as in one poll loop).
    """
    from pyspark.sql.streaming.state import GroupStateTimeout
    r = readings_stream.select("city", "ts", "event_id", F.lit(LIVE_TAG).alias("source"), "aqi", "pm25",
                               "pm10", "no2", "so2",
                               *[F.lit(None).cast("double").alias(c) for c in ("pred_24h", "pred_48h", "pred_72h")],
                               F.lit(1).alias("_kind"))
    p = predictions_stream.select("city", "ts", "event_id", F.lit(None).cast("string").alias("source"),
                                  *[F.lit(None).cast("double").alias(c) for c in ("aqi", "pm25", "pm10", "no2", "so2")],
                                  "pred_24h", "pred_48h", "pred_72h", F.lit(0).alias("_kind"))
    out = r.unionByName(p).groupBy("city").applyInPandasWithState(
        _carry_predictions, MONITOR_OUT_SCHEMA, MONITOR_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    return out.select(iso_ts("ts").alias("timestamp"), "city", "source", "aqi_now", "pm25", "pm10", "no2", "so2",
                      health_risk("aqi_now")["level"].alias("risk_now"), "aqi_24h", "aqi_48h", "aqi_72h",
                      "event_id")


def read_prediction_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The predictions log as a file stream (explicit schema)."""
    schema = ("city STRING, data_source STRING, pred_24h DOUBLE, pred_48h DOUBLE, pred_72h DOUBLE, "
              "ts TIMESTAMP, event_id LONG")
    r = spark.readStream.schema(schema).option("timestampFormat", schemas.JSON_TS_FORMAT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def run_available(stream_df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
                  fmt: str = "parquet", foreach_batch=None) -> None:
    """Run a stream over everything available now, then stop (tests, backfills).

    Production runs use ``trigger(processingTime='60 seconds')`` (the poll
    interval) with the same sink and checkpoint.
    """
    w = stream_df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    else:
        w = w.format(fmt).option("path", sink_path)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()


def start_stream(stream_df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
                 foreach_batch=None, every: str = "60 seconds"):
    """Production start: one micro-batch per poll interval; returns the running query.

    The checkpoint folder must be on shared storage; after a driver restart the
    query resumes from it (file offsets, dedup and aggregation state).
    """
    w = stream_df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    w = w.foreachBatch(foreach_batch) if foreach_batch is not None else w.format("parquet").option("path", sink_path)
    return w.trigger(processingTime=every).start()


def land_payloads(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write poll rows as JSON files, the way a poller would land them: one per task, or ``files``."""
    ((df.repartition(files) if files else df).write.mode("overwrite")
       .option("timestampFormat", schemas.JSON_TS_FORMAT).json(path))
