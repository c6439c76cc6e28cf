"""Registered queries over what the sinks stored, by value, and the small operators the dashboard uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import forecast as fc
from .. import oracle as O
from ..classify import prepare_training
from ..sinks import append_predictions, append_readings, append_weather, export_csv, export_rows
from ...functions.columns import horizon_fallback, to_double
from ...operators import sequences as sq
from ...operators import tables as tb
from ...sources import files as fl
from ...sources import standin as si
from ...streaming import streams as ss
from .registry import SQL, master, register


# ------------------------------------------------------------------ K2-K4 + S8: logs by value

def _through(spark, rows, append):
    """``rows`` appended to a new log and read back, without its write time."""
    path = ss.scratch_dir(spark, "log")
    append(rows, path)
    return fl.read_log(spark, path, "").drop("ts", "day")


READING_DOUBLES = ["aqi", "pm25", "pm10", "no2", "so2", "temperature", "humidity", "wind_speed"]


@register("stored_readings", O.with_ctes(O.finish(
    f"SELECT city, source, {', '.join(READING_DOUBLES)}, event_id, ts AS observed_ts FROM readings",
    READING_DOUBLES, stamps=["observed_ts"]), "readings"))
def q_stored_readings(spark, sf_dir):
    return _through(spark, si.readings_log(spark, sf_dir), append_readings)


def _half_up(column: str) -> str:
    """Two decimals of a double as it is written, half up."""
    return f"CAST(round(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38, 17)), 2) AS DOUBLE) AS {column}"


@register("stored_predictions", O.with_ctes(O.finish(
    f"SELECT city, data_source, {', '.join(map(_half_up, ('pred_24h', 'pred_48h', 'pred_72h')))}, "
    "event_id, ts AS observed_ts FROM predictions",
    ["pred_24h", "pred_48h", "pred_72h"], stamps=["observed_ts"]), "predictions"))
def q_stored_predictions(spark, sf_dir):
    return _through(spark, si.predictions_log(spark, sf_dir), append_predictions)


@register("stored_weather", O.with_ctes(O.finish(
    "SELECT city, temperature, humidity, wind_speed, event_id, ts AS observed_ts FROM weather",
    ["temperature", "humidity", "wind_speed"], stamps=["observed_ts"]), "weather"))
def q_stored_weather(spark, sf_dir):
    return _through(spark, si.weather_log(spark, sf_dir), append_weather)


@register("export_csv", SQL["export_rows"])
def q_export_csv(spark, sf_dir):
    """K7: the CSV files themselves, read back."""
    m, path = master(spark, sf_dir), ss.scratch_dir(spark, "export")
    export_csv(m, path, 90)
    return spark.read.schema(export_rows(m, 90).schema).option("header", True).csv(path)


# ------------------------------------------------------------------ P7, P12, P14, F20, F21, W7

@register("feature_types",
          "SELECT * FROM (VALUES ('pm25', 'numeric'), ('pm10', 'numeric'), ('no2', 'numeric'), ('so2', 'numeric'), "
          "('co', 'numeric'), ('o3', 'numeric'), ('city', 'categorical')) v(feature, kind)")
def q_feature_types(spark, sf_dir):
    """The training features of the whole series by type, one row for each that it holds."""
    prepared, features = prepare_training(master(spark, sf_dir))
    numeric, categorical = tb.split_feature_types(prepared, features)
    kinds = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.col(c).isNotNull().alias("held"))
                      for kind, cols in (("numeric", numeric), ("categorical", categorical)) for c in cols])
    return prepared.select(F.inline(kinds)).where("held").select("feature", "kind").distinct()


@register("served_readings", O.with_ctes(O.finish(
    f"SELECT *, count(*) OVER () AS count FROM (SELECT city, source, {', '.join(READING_DOUBLES)}, ts AS timestamp "
    "FROM readings ORDER BY ts DESC, event_id DESC LIMIT 50)", READING_DOUBLES, stamps=["timestamp"]), "readings"))
def q_served_readings(spark, sf_dir):
    """O2 + P12: the newest readings without the storage ids."""
    return tb.drop_internal_ids(tb.recent_readings(si.readings_log(spark, sf_dir), None, 50))


@register("series", O.with_ctes(O.finish("SELECT city, date, aqi, pm25, pm10, no2 FROM master",
                                         ["aqi", "pm25", "pm10", "no2"], ["date"]), "master"))
def q_series(spark, sf_dir):
    return tb.series(master(spark, sf_dir))


# some horizons are missing or zero, by the id's remainder
_GAPS = {"pred_24h": (5, 0.0), "pred_48h": (3, None), "pred_72h": (4, 0.0)}


def _gap(column: str) -> str:
    divisor, value = _GAPS[column]
    return f"CASE WHEN event_id % {divisor} = 0 THEN {'NULL' if value is None else value} ELSE {column} END"


@register("horizon_fallback", O.with_ctes(O.finish(
    "SELECT event_id, a24 AS aqi_24h, a48 AS aqi_48h, coalesce(nullif(p72, 0), a48) AS aqi_72h FROM ("
    "SELECT *, coalesce(nullif(p48, 0), a24) AS a48 FROM (SELECT event_id, p48, p72, coalesce(nullif(p24, 0), nullif(t, 0), 0) "
    f"AS a24 FROM (SELECT event_id, {_gap('pred_24h')} AS p24, {_gap('pred_48h')} AS p48, {_gap('pred_72h')} AS p72, "
    "CASE WHEN event_id % 2 = 0 THEN pred_24h END AS t FROM predictions)))", ["aqi_24h", "aqi_48h", "aqi_72h"]), "predictions"))
def q_horizon_fallback(spark, sf_dir):
    p = si.predictions_log(spark, sf_dir).withColumn("tomorrow", F.expr("CASE WHEN event_id % 2 = 0 THEN pred_24h END"))
    p = p.withColumns({c: F.expr(_gap(c)) for c in _GAPS})
    return p.select("event_id", *horizon_fallback("pred_24h", "pred_48h", "pred_72h", "tomorrow"))


@register("typed_values", O.with_ctes(
    "SELECT event_id, round(k, 6) AS number, CAST(NULL AS DOUBLE) AS word FROM events_city", "events_city"))
def q_typed_values(spark, sf_dir):
    """a number that was sent as text, and text that is none."""
    e = si.table(spark, sf_dir, "events").join(
        si.table(spark, sf_dir, "customer").select("c_custkey"), F.col("user_id") == F.col("c_custkey"))
    return e.select("event_id", to_double(F.get_json_object("props", "$.k")).alias("number"), to_double("event_type").alias("word"))


@register("last_pair", "SELECT city, arg_max(actual, pos) AS last_actual, arg_max(pred, pos) AS last_predicted "
                       f"FROM ({SQL['backtest_predictions']}) GROUP BY city")
def q_last_pair(spark, sf_dir):
    return sq.last_pair(fc.backtest_predictions(master(spark, sf_dir)))
