"""Registered queries over the fused series and logs: fusion, risk scales, panels, alerts,
last-n tables, counts, top-k (U, F, P, W1-W3, W9, O, A1-A3, A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ...functions import risk
from ...operators import tables as tb
from ...sources import standin as si
from .registry import MASTER_DOUBLES, fresh_master, master, register


# ------------------------------------------------------------------ U3 / W1

@register("build_master", O.with_ctes(
    O.finish("SELECT * FROM master", MASTER_DOUBLES, ["date"]), "master"))
def q_build_master(spark, sf_dir):
    return fresh_master(spark, sf_dir)


# ------------------------------------------------------------------ W2 + F1

@register("latest_status", O.with_ctes(O.finish(
    "SELECT city, date, aqi, pm25, pm10, no2, so2, "
    f"{O.us_level('aqi')} AS risk_level, {O.us_color('aqi')} AS risk_color, "
    f"{O.us_advice('aqi')} AS risk_advice FROM ("
    "SELECT *, row_number() OVER (PARTITION BY city ORDER BY date DESC) AS rn FROM master "
    "WHERE aqi IS NOT NULL) WHERE rn = 1", ["aqi", "pm25", "pm10", "no2", "so2"], ["date"]), "master"))
def q_latest_status(spark, sf_dir):
    latest = tb.latest_per_city(master(spark, sf_dir))
    hr = risk.health_risk("aqi")
    return latest.select("city", "date", "aqi", "pm25", "pm10", "no2", "so2",
                         hr["level"].alias("risk_level"), hr["color"].alias("risk_color"),
                         hr["advice"].alias("risk_advice"))


# ------------------------------------------------------------------ F1-F7 on every row

@register("risk_scales", O.with_ctes(O.finish(
    "SELECT city, date, aqi, aqi_bucket, "
    f"{O.us_level('aqi')} AS us_level, {O.display_level('aqi')} AS display_level, "
    f"{O.sql_band('aqi', risk.DISPLAY_SCALE, 3)} AS display_badge, "
    f"{O.india('aqi')} AS india_level, {O.bucket4('aqi')} AS class4, "
    f"{O.sql_lookup(O.india('aqi'), risk.RECOMMENDATIONS, O.q(risk.DEFAULT_RECOMMENDATION))} AS recommendation, "
    f"{O.sql_lookup(O.bucket4('aqi'), risk.DISPLAY_LABELS, O.bucket4('aqi'))} AS class_display, "
    f"{O.sql_lookup('aqi_bucket', risk.BUCKET_TO_CLASS, 'aqi_bucket')} AS bucket_class "
    "FROM master", ["aqi"], ["date"]), "master"))
def q_risk_scales(spark, sf_dir):
    m = master(spark, sf_dir)
    india = risk.risk_india("aqi")
    c4 = risk.risk_bucket4("aqi")
    return m.select("city", "date", "aqi", "aqi_bucket",
                    risk.risk_level("aqi", "us").alias("us_level"),
                    risk.risk_display("aqi")["level"].alias("display_level"),
                    risk.risk_display("aqi")["badge"].alias("display_badge"),
                    india.alias("india_level"), c4.alias("class4"),
                    risk.recommendation(india).alias("recommendation"),
                    risk.display_label(c4).alias("class_display"),
                    risk.normalise_label("aqi_bucket").alias("bucket_class"))


# ------------------------------------------------------------------ F8, F9, F20, F24, P9

def fmt_sql(x, d=1, missing="N/A"):
    return (f"coalesce(printf('%.{d}f', CAST(round(CAST({x} AS DECIMAL(18,6)), {d}) AS DOUBLE)), "
            f"{O.q(missing)})")


#: Gases that the panel shows as "--" when missing or zero; the others show 0.0.
HIDDEN_WHEN_ZERO = ("co", "o3")


def _panel_sql():
    from ...functions.columns import POLLUTANT_LIMITS, SCALE_MAX
    parts = []
    for p, (lo, hi) in POLLUTANT_LIMITS.items():
        z = f"coalesce({p}, 0.0)"
        hide = f"WHEN NOT {z} > 0 THEN '--' " if p in HIDDEN_WHEN_ZERO else ""
        text = f"CASE {hide}ELSE {fmt_sql(z)} END" if hide else fmt_sql(z)
        parts.append(
            f"SELECT city, {O.q(p)} AS pollutant, {p} AS value, "
            f"CASE {hide}WHEN {z} <= {float(lo)} THEN 'OPTIMAL' WHEN {z} <= {float(hi)} THEN 'NORMAL' "
            f"ELSE 'ELEVATED' END AS status, least({z} / {float(SCALE_MAX[p])} * 100.0, 100.0) AS pct, "
            f"CASE WHEN {p} > 0 THEN {p} END AS shown, {text} AS text FROM latest")
    return " UNION ALL ".join(parts)


@register("pollutant_panel", O.with_ctes(O.finish(_panel_sql(), ["value", "pct", "shown"]), "master",
                                         extra=[("latest", "SELECT * FROM (SELECT *, row_number() OVER "
                                                 "(PARTITION BY city ORDER BY date DESC) AS rn FROM master "
                                                 "WHERE aqi IS NOT NULL) WHERE rn = 1")]))
def q_pollutant_panel(spark, sf_dir):
    from ...functions.columns import (fmt, limits_table, or_zero, pollutant_status, positive_or_missing,
                                     scale_pct)
    latest = tb.latest_per_city(master(spark, sf_dir))
    long = latest.unpivot(["city"], ["pm25", "pm10", "no2", "so2", "co", "o3"], "pollutant", "value")
    j = long.join(F.broadcast(limits_table(spark)), "pollutant")   # 6 fixed rows
    z = or_zero("value")
    hidden = F.col("pollutant").isin(*HIDDEN_WHEN_ZERO) & ~(z > 0)
    return j.select("city", "pollutant", "value",
                    F.when(hidden, F.lit("--")).otherwise(
                        pollutant_status(z, F.col("optimal_max"), F.col("normal_max"))).alias("status"),
                    scale_pct(z, F.col("display_max")).alias("pct"),
                    positive_or_missing("value").alias("shown"),
                    F.when(hidden, F.lit("--")).otherwise(fmt(z, 1)).alias("text"))


# ------------------------------------------------------------------ F10

def _precaution_values():
    from ...functions.columns import PRECAUTIONS
    rows = []
    for band_i, (_, items) in enumerate(PRECAUTIONS):
        for pos, (icon, title, desc) in enumerate(items):
            rows.append(f"({band_i}, {pos}, {O.q(icon)}, {O.q(title)}, {O.q(desc)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(band, pos, icon, title, \"desc\")"


def _precaution_band_sql(x):
    from ...functions.columns import PRECAUTIONS
    parts = " ".join(f"WHEN {x} <= {float(b)} THEN {i}" for i, (b, _) in enumerate(PRECAUTIONS[:-1]))
    return f"(CASE {parts} ELSE {len(PRECAUTIONS) - 1} END)"


@register("precautions", O.with_ctes(O.finish(
    "SELECT l.city, l.aqi, CAST(c.pos AS BIGINT) AS pos, c.icon, c.title, c.\"desc\" FROM latest l JOIN cards c "
    f"ON c.band = {_precaution_band_sql('l.aqi')}", ["aqi"]), "master",
    extra=[("latest", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date DESC) "
                      "AS rn FROM master WHERE aqi IS NOT NULL) WHERE rn = 1"),
           ("cards", _precaution_values())]))
def q_precautions(spark, sf_dir):
    from ...functions.columns import precautions
    latest = tb.latest_per_city(master(spark, sf_dir))
    return latest.select("city", "aqi", F.posexplode(precautions("aqi")).alias("pos", "card")) \
        .select("city", "aqi", "pos", "card.icon", "card.title", "card.desc")


# ------------------------------------------------------------------ P8 + F11 + W9

ALERT_SQL_BODY = (
    "SELECT city, ts, event_id, aqi, {lvl} AS risk_level, "
    "'CRITICAL AIR QUALITY ALERT: ' || upper(city) || ' AQI ' || CAST(CAST(floor(aqi + 0.5) AS BIGINT) AS VARCHAR) "
    "|| ' — ' || {us} AS alert_text FROM readings WHERE aqi > 150.0").format(lvl=O.display_level("aqi"),
                                                                            us=O.us_level("aqi"))


@register("alerts", O.with_ctes(O.finish(ALERT_SQL_BODY, ["aqi"], stamps=["ts"]), "readings"))
def q_alerts(spark, sf_dir):
    r = si.readings_log(spark, sf_dir)
    return tb.alerts(r, 150).select("city", "ts", "event_id", "aqi", "risk_level", "alert_text")


@register("recent_alerts", O.with_ctes(O.finish(
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) AS rank "
    "FROM alerts_) WHERE rank <= 20", ["aqi"], stamps=["ts"]), "readings",
    extra=[("alerts_", ALERT_SQL_BODY)]))
def q_recent_alerts(spark, sf_dir):
    r = si.readings_log(spark, sf_dir)
    a = tb.alerts(r, 150).select("city", "ts", "event_id", "aqi", "risk_level", "alert_text")
    return tb.recent_log(a, 20, key="city")


# ------------------------------------------------------------------ W3, P13, O5, K7

LAST_N_SQL = ("SELECT *, count(*) OVER (PARTITION BY city) - rk + 1 AS pos FROM ("
              "SELECT *, row_number() OVER (PARTITION BY city ORDER BY date DESC) AS rk FROM master "
              "WHERE aqi IS NOT NULL) WHERE rk <= {n}")


@register("recent_table", O.with_ctes(O.finish(
    "SELECT city, pos, date, pm25, pm10, no2, co, so2, o3, aqi, aqi_bucket FROM ("
    + LAST_N_SQL.format(n=5) + ")", MASTER_DOUBLES, ["date"]), "master"))
def q_recent_table(spark, sf_dir):
    return tb.recent_table(master(spark, sf_dir), 5)


@register("historical", O.with_ctes(O.finish(
    "SELECT city, pos, strftime(date, '%Y-%m-%d') AS date, aqi, pm25, pm10, no2, CAST(90 AS BIGINT) AS days_requested, "
    "count(*) OVER (PARTITION BY city) AS records_returned FROM (" + LAST_N_SQL.format(n=90) + ")",
    ["aqi", "pm25", "pm10", "no2"]), "master"))
def q_historical(spark, sf_dir):
    return tb.historical(master(spark, sf_dir), 90)


@register("export_rows", O.with_ctes(O.finish(
    'SELECT strftime(date, \'%Y-%m-%d\') AS "Date", city AS "City", pm25 AS "PM2.5", pm10 AS "PM10", '
    'no2 AS "NO2", so2 AS "SO2", co AS "CO", o3 AS "O3", aqi AS "AQI", '
    "'aqi_report_' || city || '_90days.csv' AS file_name FROM (" + LAST_N_SQL.format(n=90) + ")",
    ["\"PM2.5\"", "PM10", "NO2", "SO2", "CO", "O3", "AQI"]), "master"))
def q_export_rows(spark, sf_dir):
    from ...plans.sinks import export_rows
    return export_rows(master(spark, sf_dir), 90)


# ------------------------------------------------------------------ A1-A3, O4, P11, A10

@register("count_by_city", O.with_ctes(
    "SELECT city, count(*) AS n_rows FROM master GROUP BY city", "master"))
def q_count_by_city(spark, sf_dir):
    return tb.count_by(master(spark, sf_dir))


@register("distinct_cities", O.with_ctes("SELECT DISTINCT City AS city FROM modern_raw "
                                         "WHERE City IS NOT NULL", "modern_raw"))
def q_distinct_cities(spark, sf_dir):
    return tb.distinct_cities(si.modern(spark, sf_dir).withColumnRenamed("City", "city"))


@register("profile", O.with_ctes(
    "SELECT count(*) AS records, count(DISTINCT city) AS cities, strftime(min(date), '%Y-%m-%d') AS first_date, "
    "strftime(max(date), '%Y-%m-%d') AS last_date FROM master WHERE aqi IS NOT NULL", "master"))
def q_profile(spark, sf_dir):
    return tb.profile(master(spark, sf_dir).where(F.col("aqi").isNotNull()))


@register("top_cities", O.with_ctes(
    "SELECT city, count(*) AS n_rows FROM master WHERE aqi IS NOT NULL GROUP BY city "
    "ORDER BY n_rows DESC, city LIMIT 8", "master"))
def q_top_cities(spark, sf_dir):
    return tb.top_cities(master(spark, sf_dir).where(F.col("aqi").isNotNull()), 8)


@register("min_history", O.with_ctes(O.finish(
    "SELECT * FROM (SELECT city, date, aqi, count(*) OVER (PARTITION BY city) AS n_rows FROM master "
    "WHERE aqi IS NOT NULL) WHERE n_rows >= 500", ["aqi"], ["date"]), "master"))
def q_min_history(spark, sf_dir):
    m = master(spark, sf_dir).where(F.col("aqi").isNotNull()).select("city", "date", "aqi")
    return tb.min_history(m, 500)


@register("log_counts", O.with_ctes(
    "SELECT 'aqi_readings' AS collection, count(*) AS n_rows FROM readings UNION ALL "
    "SELECT 'predictions', count(*) FROM predictions UNION ALL "
    "SELECT 'weather_logs', count(*) FROM weather", "readings", "predictions", "weather"))
def q_log_counts(spark, sf_dir):
    return tb.log_counts(si.readings_log(spark, sf_dir), si.predictions_log(spark, sf_dir),
                         si.weather_log(spark, sf_dir))


# ------------------------------------------------------------------ O2, O3

@register("recent_readings", O.with_ctes(O.finish(
    "SELECT *, count(*) OVER () AS count FROM (SELECT city, source, aqi, pm25, pm10, no2, so2, temperature, "
    "humidity, wind_speed, ts AS timestamp, event_id FROM readings ORDER BY ts DESC, event_id DESC LIMIT 50)",
    ["aqi", "pm25", "pm10", "no2", "so2", "temperature", "humidity", "wind_speed"], stamps=["timestamp"]),
    "readings"))
def q_recent_readings(spark, sf_dir):
    return tb.recent_readings(si.readings_log(spark, sf_dir), None, 50)


@register("recent_predictions", O.with_ctes(O.finish(
    "SELECT *, count(*) OVER () AS count FROM (SELECT city, data_source, pred_24h, pred_48h, pred_72h, "
    "ts AS timestamp, event_id FROM predictions ORDER BY ts DESC, event_id DESC LIMIT 20)",
    ["pred_24h", "pred_48h", "pred_72h"], stamps=["timestamp"]), "predictions"))
def q_recent_predictions(spark, sf_dir):
    return tb.recent_predictions(si.predictions_log(spark, sf_dir), None, 20)


# ------------------------------------------------------------------ U1 (before dedup)

@register("fused_rows", O.with_ctes(O.finish("SELECT * FROM fused", MASTER_DOUBLES, ["date"]), "fused"))
def q_fused_rows(spark, sf_dir):
    from ..master import prepare_historical, prepare_modern
    return tb.fuse(prepare_historical(si.historical(spark, sf_dir)), prepare_modern(si.modern(spark, sf_dir)))


# ------------------------------------------------------------------ O2 + P5: one city's stored readings

READINGS_CITY = "NATION_7"


@register("recent_readings_city", O.with_ctes(O.finish(
    "SELECT *, count(*) OVER () AS count FROM (SELECT city, source, aqi, pm25, pm10, no2, so2, temperature, "
    "humidity, wind_speed, ts AS timestamp, event_id FROM readings WHERE city = " + O.q(READINGS_CITY) +
    " ORDER BY ts DESC, event_id DESC LIMIT 10)",
    ["aqi", "pm25", "pm10", "no2", "so2", "temperature", "humidity", "wind_speed"], stamps=["timestamp"]),
    "readings"))
def q_recent_readings_city(spark, sf_dir):
    """The dashboard's stored-readings table for one city (city filter, newest 10)."""
    return tb.recent_readings(si.readings_log(spark, sf_dir), READINGS_CITY, 10)
