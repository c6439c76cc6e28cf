"""Registered queries for live-or-fallback status, comparison, coordinates, the as-of monitor
log, weather and the hybrid forecast input (J1-J5, J11, J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ...operators import status as st
from ...sources import standin as si
from .registry import SQL, master, register


# ------------------------------------------------------------------ J3 + J2 + F1


STATUS_DOUBLES = ["aqi", "pm25", "pm10", "no2", "so2", "co", "o3", "temperature", "humidity", "wind_speed"]

NEWEST_SQL = ("SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY city "
               "ORDER BY ts DESC, event_id DESC) AS rn_ FROM {src}) WHERE rn_ = 1")
LATEST_SQL = ("SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY city "
               "ORDER BY date DESC) AS rn_ FROM master WHERE aqi IS NOT NULL) WHERE rn_ = 1")


def _status_sql():
    pick = []
    for c in ["aqi", "pm25", "pm10", "no2", "so2", "co", "o3"]:
        pick.append(f"CASE WHEN l.aqi IS NOT NULL THEN l.{c} WHEN h.aqi IS NOT NULL THEN h.{c} END AS {c}")
    core = (
        "SELECT coalesce(l.city, h.city) AS city, "
        "CASE WHEN l.aqi IS NOT NULL THEN 'LIVE SATELLITE' WHEN h.aqi IS NOT NULL THEN 'CSV FALLBACK' END AS source, "
        "CASE WHEN l.aqi IS NOT NULL THEN strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%f') "
        "WHEN h.aqi IS NOT NULL THEN strftime(h.date, '%Y-%m-%d') END AS as_of, "
        + ", ".join(pick) +
        ", CASE WHEN l.aqi IS NULL AND h.aqi IS NULL THEN 'No data for ' || coalesce(l.city, h.city) END AS error "
        "FROM live_latest l FULL OUTER JOIN hist_latest h ON l.city = h.city")
    return (
        "SELECT s.*, CASE WHEN s.error IS NULL THEN " + O.us_level("s.aqi") + " END AS risk_level, "
        "CASE WHEN s.error IS NULL THEN " + O.us_color("s.aqi") + " END AS risk_color, "
        "CASE WHEN s.error IS NULL THEN " + O.us_advice("s.aqi") + " END AS risk_advice, "
        "w.temperature, w.humidity, w.wind_speed, w.weather_code "
        f"FROM ({core}) s LEFT JOIN weather_latest w ON s.city = w.city")


STATUS_CTES = [("live_latest", NEWEST_SQL.format(src="live")),
               ("hist_latest", LATEST_SQL),
               ("weather_latest", NEWEST_SQL.format(src="weather")),
               ("status", _status_sql())]


def status_frame(spark, sf_dir):
    """J3 over the poll rows, which carry both answers: one scan of the feed."""
    return st.current_status(si.poll_rows(spark, sf_dir), master(spark, sf_dir))


@register("current_status", O.with_ctes(O.finish("SELECT * FROM status", STATUS_DOUBLES),
                                        "master", "live", "weather", extra=STATUS_CTES))
def q_current_status(spark, sf_dir):
    return status_frame(spark, sf_dir)


@register("current_status_feeds", SQL["current_status"])
def q_current_status_feeds(spark, sf_dir):
    """J3 with weather as a separate feed (the reference's second API call), attached by J2."""
    return st.current_status(si.live_rows(spark, sf_dir), master(spark, sf_dir), si.weather_rows(spark, sf_dir))


# ------------------------------------------------------------------ J5 + F18 + O6 + P10

COMPARE_TEXT = " NATION_3, ,NATION_7,NATION_3,NOWHERE,NATION_11,NATION_2"


def _compare_sql():
    from ...functions.columns import city_list  # noqa: F401  (same rule, stated in SQL)
    asked = ("SELECT CAST(i - 1 AS BIGINT) AS pos, l[i] AS city FROM (SELECT list_filter(list_transform("
             f"string_split({O.q(COMPARE_TEXT)}, ','), lambda x: trim(x)), lambda x: x <> '') AS l) AS a, "
             "generate_series(1, least(len(a.l), 5)) AS t(i)")
    return ("SELECT a.pos, s.city, s.source, s.aqi, s.pm25, s.pm10, s.no2, s.so2, s.risk_level "
            f"FROM ({asked}) a JOIN status s ON a.city = s.city WHERE s.error IS NULL")


@register("compare_cities", O.with_ctes(O.finish(_compare_sql(), ["aqi", "pm25", "pm10", "no2", "so2"]),
                                        "master", "live", "weather", extra=STATUS_CTES))
def q_compare_cities(spark, sf_dir):
    asked = st.asked_cities(spark, COMPARE_TEXT, 5)      # only their polls and history are aggregated
    status = st.current_status(st.restrict_to(si.poll_rows(spark, sf_dir), asked),
                               st.restrict_to(master(spark, sf_dir), asked))
    return st.compare_cities(status, asked)


# ------------------------------------------------------------------ J1

@register("with_coords", O.with_ctes(O.finish(
    "SELECT r.event_id, r.city, r.aqi, d.lat, d.lon FROM readings r JOIN city_dim d ON r.city = d.city",
    ["aqi", "lat", "lon"]), "readings", "city_dim"))
def q_with_coords(spark, sf_dir):
    r = si.readings_log(spark, sf_dir).select("event_id", "city", "aqi")
    return st.with_coords(r, si.nation_city_dim(spark, sf_dir))


# ------------------------------------------------------------------ J11 (as-of)

@register("monitor_log", O.with_ctes(O.finish(
    "SELECT strftime(r.ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, r.city, r.source, r.aqi AS aqi_now, "
    f"r.pm25, r.pm10, r.no2, r.so2, {O.us_level('r.aqi')} AS risk_now, "
    "p.pred_24h AS aqi_24h, p.pred_48h AS aqi_48h, p.pred_72h AS aqi_72h, r.event_id "
    "FROM readings r ASOF LEFT JOIN predictions p ON r.city = p.city AND r.ts >= p.ts",
    ["aqi_now", "pm25", "pm10", "no2", "so2", "aqi_24h", "aqi_48h", "aqi_72h"]), "readings", "predictions"))
def q_monitor_log(spark, sf_dir):
    return st.monitor_log(si.readings_log(spark, sf_dir), si.predictions_log(spark, sf_dir))


# ------------------------------------------------------------------ J13

@register("current_weather", O.with_ctes(O.finish(
    "SELECT d.city, w.temperature, w.humidity, w.wind_speed, w.weather_code, "
    "strftime(w.ts, '%Y-%m-%dT%H:%M:%S.%f') AS observed, "
    "CASE WHEN w.ts IS NULL THEN 'Weather data unavailable for ' || d.city END AS error "
    "FROM (SELECT DISTINCT city FROM city_dim) d LEFT JOIN weather_latest w ON d.city = w.city",
    ["temperature", "humidity", "wind_speed"]), "weather", "city_dim",
    extra=[("weather_latest", NEWEST_SQL.format(src="weather"))]))
def q_current_weather(spark, sf_dir):
    return st.current_weather(si.weather_rows(spark, sf_dir), si.nation_city_dim(spark, sf_dir))


# ------------------------------------------------------------------ J4

HYBRID_CTES = [
    ("live_latest", NEWEST_SQL.format(src="live")),
    ("hist30", "SELECT city, list(aqi ORDER BY date) AS h, count(*) AS n_hist FROM ("
               "SELECT *, row_number() OVER (PARTITION BY city ORDER BY date DESC) AS rk FROM master "
               "WHERE aqi IS NOT NULL) WHERE rk <= 30 GROUP BY city"),
    ("hybrid", "SELECT h.city, CASE WHEN l.aqi IS NOT NULL AND h.n_hist >= 29 "
               "THEN list_concat(h.h[-29:], [l.aqi]) WHEN l.aqi IS NULL AND h.n_hist >= 30 THEN h.h[-30:] END AS seq, "
               "CASE WHEN l.aqi IS NOT NULL AND h.n_hist >= 29 THEN " + O.q(st.HYBRID_TAG) +
               " WHEN l.aqi IS NULL AND h.n_hist >= 30 THEN " + O.q(st.CSV_ONLY_TAG) + " END AS data_source "
               "FROM hist30 h LEFT JOIN live_latest l ON h.city = l.city"),
]


@register("hybrid_sequence", O.with_ctes(O.finish(
    "SELECT city, data_source, len(seq) AS n, list_sum(seq) AS seq_sum, seq[1] AS first_value, "
    "seq[len(seq)] AS last_value FROM hybrid WHERE seq IS NOT NULL",
    ["seq_sum", "first_value", "last_value"]), "master", "live", extra=HYBRID_CTES))
def q_hybrid_sequence(spark, sf_dir):
    h = st.hybrid_sequence(si.live_rows(spark, sf_dir), master(spark, sf_dir), 30)
    return h.select("city", "data_source", F.size("seq").alias("n"),
                    F.aggregate("seq", F.lit(0.0), lambda a, x: a + x).alias("seq_sum"),
                    F.element_at("seq", 1).alias("first_value"), F.element_at("seq", -1).alias("last_value"))


# ------------------------------------------------------------------ J13 + F24: weather panel text

WEATHER_TEXT = [("temperature", 1, " °C"), ("humidity", 0, " %"), ("wind_speed", 1, " km/h")]


def _weather_text_sql():
    from .tables import fmt_sql
    cols = []
    for c, d, unit in WEATHER_TEXT:
        cols.append(f"CASE WHEN w.{c} IS NULL THEN 'N/A' ELSE {fmt_sql('w.' + c, d)} || {O.q(unit)} END "
                    f"AS {c}_text")
    return cols


@register("weather_panel", O.with_ctes(O.finish(
    "SELECT d.city, " + ", ".join(_weather_text_sql()) +
    " FROM (SELECT DISTINCT city FROM city_dim) d LEFT JOIN weather_latest w ON d.city = w.city"),
    "weather", "city_dim", extra=[("weather_latest", NEWEST_SQL.format(src="weather"))]))
def q_weather_panel(spark, sf_dir):
    """The dashboard's weather cards for every city: newest weather (J13) as fixed-decimal text."""
    from ...functions.columns import fmt
    w = st.current_weather(si.weather_rows(spark, sf_dir), si.nation_city_dim(spark, sf_dir))
    return w.select("city", *[F.when(F.col(c).isNull(), F.lit("N/A"))
                              .otherwise(F.concat(fmt(c, d), F.lit(unit))).alias(f"{c}_text")
                              for c, d, unit in WEATHER_TEXT])


# ------------------------------------------------------------------ S10: the supported cities

@register("cities", O.with_ctes(O.finish("SELECT city, lat, lon FROM city_dim", ["lat", "lon"]), "city_dim"))
def q_cities(spark, sf_dir):
    """The supported cities with their coordinates (the city-list endpoint)."""
    return si.nation_city_dim(spark, sf_dir)
