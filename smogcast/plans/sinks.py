"""Sinks: SURVEY K1-K8.

Everything is written by Spark to the given (shared) path: no driver-local
files.  Append logs stamp the write time with ``current_timestamp()`` (UTC
session), as the reference stamps processing time, and keep the poll's id and
observed time, which the log operators order and join by.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import date_text, export_name, report_name
from ..operators.tables import last_n, select_available
from ..schemas import EXPORT_NAMES
from .master import write_master  # noqa: F401  (K1 lives with the fusion)

READING_COLS = ["city", "source", "aqi", "pm25", "pm10", "no2", "so2", "temperature", "humidity",
                "wind_speed"]
PREDICTION_COLS = ["city", "data_source", "pred_24h", "pred_48h", "pred_72h"]
WEATHER_COLS = ["city", "temperature", "humidity", "wind_speed"]


def _append(df: DataFrame, cols, path: str, stamp: bool = True) -> None:
    kept = {"event_id": ("event_id", "long"), "observed_ts": ("ts", "timestamp")}
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in cols],
                    *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(n) for n, (c, t) in kept.items()])
    if stamp:
        out = out.withColumn("ts", F.current_timestamp())
    (out.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path))


def append_readings(df: DataFrame, path: str) -> None:
    """K2: append reading rows with their UTC write time (log partitioned by day)."""
    _append(df, READING_COLS, path)


def append_predictions(df: DataFrame, path: str) -> None:
    """K3: append forecast rows; values rounded to 2 decimals as stored by the reference."""
    r = df
    for c in ("pred_24h", "pred_48h", "pred_72h"):
        if c in r.columns:
            r = r.withColumn(c, F.round(c, 2))
    _append(r, PREDICTION_COLS, path)


def append_weather(df: DataFrame, path: str) -> None:
    """K4: append weather rows."""
    _append(df, WEATHER_COLS, path)


def write_metrics(df: DataFrame, path: str) -> None:
    """K5: metrics document(s) as JSON lines (one file per task; small)."""
    df.write.mode("overwrite").json(path)


def export_report(df: DataFrame, out_dir: str) -> DataFrame:
    """K6: one JSON report per city, file name column ``report_summary_<city>_<stamp>.json``.

    The stamp is the documents' own generation time (without one, now), so the same
    documents have the same names and an export that is repeated replaces itself.  Written partitioned by
    the name column, each city's document in its own folder; the folder is complete when
    its ``_SUCCESS`` file is there.  Returns the rows with their names.
    """
    now = F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))     # fixed before the write
    stamp = F.col("generated_at") if "generated_at" in df.columns else now
    named = df.withColumn("file", report_name("city", F.to_timestamp(stamp)))
    named.write.mode("overwrite").partitionBy("file").json(out_dir)
    return named


def read_reports(spark: SparkSession, out_dir: str, like: DataFrame) -> DataFrame:
    """K6 read back: the exported documents in the columns of ``like`` (what :func:`export_report` returned)."""
    return spark.read.schema(like.schema).json(out_dir)


def report_manifest(reports: DataFrame) -> DataFrame:
    """(file, city, sha256) of each document: what an export holds, to compare two exports by."""
    return reports.select("file", "city", F.sha2(F.to_json(F.struct(
        *[c for c in reports.columns if c != "file"])), 256).alias("sha256"))


def export_rows(master: DataFrame, n: int = 90, city: str | None = None) -> DataFrame:
    """K7 rows: last ``n`` rows per city with the external column names and date text."""
    rows = last_n(master.where(F.col("date").isNotNull()), n)
    if city is not None:
        rows = rows.where(F.col("city") == city)
    rows = rows.withColumn("date", date_text("date"))
    out = select_available(rows, list(EXPORT_NAMES)).withColumnsRenamed(EXPORT_NAMES)
    return out.withColumn("file_name", export_name(F.col("City"), n))


def export_csv(master: DataFrame, path: str, n: int = 90, city: str | None = None) -> None:
    """K7: CSV with header; missing values are empty fields; one file per city folder."""
    rows = export_rows(master, n, city)
    (rows.write.mode("overwrite").option("header", True).option("nullValue", "")
         .partitionBy("file_name").csv(path))


def save_model(model, path: str, meta: dict) -> None:
    """K8: persist a fitted pipeline plus a sidecar document (features, labels, metrics)."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta),)], "meta STRING").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str):
    """K8: load the pipeline and its sidecar; reject an artifact without model or features."""
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    except Exception as exc:  # noqa: BLE001
        raise ValueError(f"Invalid classifier artifact format: {exc}") from exc
    if not isinstance(meta, dict) or "features" not in meta or "model_name" not in meta:
        raise ValueError("Invalid classifier artifact format")
    return PipelineModel.load(f"{path}/model"), meta
