"""Stand-in inputs derived from the driver's TPC-H-like tables.

The test tables hold no air data, so each canonical input is a projection of
them, stated once here (Spark) and once in :mod:`smogcast.plans.oracle` (SQL)
with the same rule constants.  Every stand-in reads whole tables, so its work
grows with the scale factor:

* daily series   : ``orders ⋈ customer ⋈ nation``; city = nation name,
                   date = order date, AQI-like values = multiples of the price.
                   Orders before 1999 form the *historical* source (legacy
                   names, text dates, no AQI); orders from 1998 on form the
                   *modern* one, so both overlap in 1998 (quirk Q1).
* live feeds     : ``events ⋈ customer ⋈ nation`` (user -> nation); one event
                   is one poll of one city; ``error`` polls carry no AQI.
* logs           : readings = polls with AQI; weather = all polls;
                   predictions = ``purchase`` polls (a predict request).
* city dimension : ``nation`` with coordinates derived from its key.

Missing values are made by key rules (``key % m == r`` -> NULL): the source
tables hold no NULLs.  The rules only blank cells.  The only rows that later
disappear are the ones the fusion's own cleaning drops, exactly as the
reference does (no city, or a date that does not parse); every query still
reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import date_text
from ..functions.risk import risk_india

# --- rule constants shared with the SQL oracle ------------------------------
HIST_BEFORE = "1999-01-01"        # historical: order date before this day
MODERN_FROM = "1998-01-01"        # modern: order date from this day on
# Divisors are chosen so no quotient of a 2-decimal price ends in an exact
# half at the 7th decimal (engines round such halves differently).
HIST_DIVISORS = {"no2": 9000.0, "so2": 21000.0, "pm2_5": 2600.0, "rspm": 1700.0}
HIST_NULLS = {"no2": (5, 3), "pm2_5": (9, 2), "rspm": (7, 3)}
HIST_BAD_DATE = (53, 7)            # date text that does not parse
HIST_NO_CITY = (61, 5)             # missing location
BAD_DATE_TEXT = "not recorded"
MODERN_DIVISORS = {"PM2.5": 2500.0, "PM10": 1500.0, "NO2": 7700.0, "SO2": 21000.0,
                   "CO": 100.0, "O3": 5000.0, "AQI": 1000.0}
MODERN_NULLS = {"PM2.5": (9, 4), "SO2": (6, 1), "O3": (8, 5), "AQI": (11, 4)}
MODERN_NO_BUCKET = (13, 6)
LIVE_FACTORS = {"pm2_5": 0.35, "pm10": 0.8, "nitrogen_dioxide": 0.12,
                "sulphur_dioxide": 0.05, "carbon_monoxide": 9.0, "ozone": 0.4}
NO_AQI_EVENT = "error"             # polls of this type return no AQI
PREDICT_EVENT = "purchase"         # polls of this type are predict requests
PRED_FACTORS = {"pred_24h": 1.08, "pred_48h": 1.15, "pred_72h": 1.21}
PRED_SOURCE = "HYBRID (29 CSV + 1 LIVE)"
LIVE_SOURCE = "LIVE SATELLITE"
TEMP_BASE, TEMP_STEP = 12.0, 0.25  # temperature = base + k * step
WIND_DIVISOR = 25.0
LAT_BASE, LAT_STEP = -60.0, 4.7
LON_BASE, LON_STEP = -170.0, 13.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_when(key: Column, rule, value: Column) -> Column:
    m, r = rule
    return F.when(key % F.lit(m) == F.lit(r), F.lit(None).cast("double")).otherwise(value)


def _orders_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the nation name of their customer (nation: tiny, broadcast by size)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                   "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cn = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    return orders.join(cn, orders.o_custkey == cn.c_custkey).drop("c_custkey", "o_custkey")


def historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical source with legacy names (location, date text, no2, so2, pm2_5, rspm)."""
    o = _orders_city(spark, sf_dir).where(F.col("o_orderdate") < F.lit(HIST_BEFORE).cast("timestamp"))
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    m, r = HIST_NO_CITY
    bm, br = HIST_BAD_DATE
    cols = [
        F.when(key % m == r, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("location"),
        F.when(key % bm == br, F.lit(BAD_DATE_TEXT)).otherwise(date_text("o_orderdate")).alias("date"),
    ]
    for name, div in HIST_DIVISORS.items():
        v = price / F.lit(div)
        if name in HIST_NULLS:
            v = _null_when(key, HIST_NULLS[name], v)
        cols.append(v.alias(name))
    cols.append(key.alias("row_ord"))
    return o.select(*cols)


def modern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modern source with external names (City, Date text, PM2.5 ... AQI, AQI_Bucket)."""
    o = _orders_city(spark, sf_dir).where(F.col("o_orderdate") >= F.lit(MODERN_FROM).cast("timestamp"))
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    cols = [F.col("n_name").alias("City"), date_text("o_orderdate").alias("Date")]
    for name, div in MODERN_DIVISORS.items():
        v = price / F.lit(div)
        if name in MODERN_NULLS:
            v = _null_when(key, MODERN_NULLS[name], v)
        cols.append(v.alias(name))
    bm, br = MODERN_NO_BUCKET
    aqi = _null_when(key, MODERN_NULLS["AQI"], price / F.lit(MODERN_DIVISORS["AQI"]))
    cols.append(F.when((key % bm == br) | aqi.isNull(), F.lit(None).cast("string"))
                .otherwise(risk_india(aqi)).alias("AQI_Bucket"))
    cols.append(key.alias("row_ord"))
    return o.select(*cols)


def _events_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value", "props")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cn = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    # The tables store wall-clock TIMESTAMP_NTZ; the canonical schema is a UTC
    # TIMESTAMP (same wall clock under the UTC session).
    return (ev.join(cn, ev.user_id == cn.c_custkey)
              .withColumn("ts", F.col("ts").cast("timestamp"))
              .withColumn("k", F.get_json_object("props", "$.k").cast("double"))
              .select(F.col("n_name").alias("city"), "ts", "event_id", "event_type", "value", "k"))


def _aqi_answer() -> Column:
    v = F.col("value")
    fields = [(v * F.lit(f)).alias(n) for n, f in LIVE_FACTORS.items()]
    fields.append(F.when(F.col("event_type") == NO_AQI_EVENT, F.lit(None).cast("double"))
                  .otherwise(v).alias("us_aqi"))
    return F.struct(*fields)


def _weather_answer() -> Column:
    k = F.col("k")
    return F.struct((F.lit(TEMP_BASE) + k * F.lit(TEMP_STEP)).alias("temperature_2m"),
                    k.alias("relative_humidity_2m"),
                    (F.col("value") / F.lit(WIND_DIVISOR)).alias("wind_speed_10m"),
                    (k.cast("int") % 4).alias("weather_code"))


def aqi_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live AQI payloads as landed (city, ts, event_id, current struct)."""
    return _events_city(spark, sf_dir).select("city", "ts", "event_id", _aqi_answer().alias("current"))


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live weather payloads as landed (city, ts, event_id, current struct)."""
    return _events_city(spark, sf_dir).select("city", "ts", "event_id", _weather_answer().alias("current"))


def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical live rows (S5 projection) of every poll: city, ts, event_id, pollutants, aqi."""
    from .files import aqi_payload_fields
    return aqi_payload_fields(aqi_payloads(spark, sf_dir), keep=("event_id",))


def weather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical weather rows (S6 projection) of every poll."""
    from .files import weather_payload_fields
    return weather_payload_fields(weather_payloads(spark, sf_dir), keep=("event_id",))


def readings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``aqi_readings`` log: polls with AQI, with the same poll's weather."""
    e = _events_city(spark, sf_dir).where(F.col("event_type") != NO_AQI_EVENT)
    v, k = F.col("value"), F.col("k")
    return e.select("city", F.lit(LIVE_SOURCE).alias("source"), v.alias("aqi"),
                    (v * F.lit(LIVE_FACTORS["pm2_5"])).alias("pm25"),
                    (v * F.lit(LIVE_FACTORS["pm10"])).alias("pm10"),
                    (v * F.lit(LIVE_FACTORS["nitrogen_dioxide"])).alias("no2"),
                    (v * F.lit(LIVE_FACTORS["sulphur_dioxide"])).alias("so2"),
                    (F.lit(TEMP_BASE) + k * F.lit(TEMP_STEP)).alias("temperature"),
                    k.alias("humidity"), (v / F.lit(WIND_DIVISOR)).alias("wind_speed"),
                    "ts", "event_id")


def weather_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``weather_logs``: every poll's weather."""
    return weather_rows(spark, sf_dir).select("city", "temperature", "humidity", "wind_speed",
                                              "ts", "event_id")


def predictions_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions`` log: one row per predict request."""
    e = _events_city(spark, sf_dir).where(F.col("event_type") == PREDICT_EVENT)
    v = F.col("value")
    return e.select("city", F.lit(PRED_SOURCE).alias("data_source"),
                    *[(v * F.lit(f)).alias(n) for n, f in PRED_FACTORS.items()],
                    "ts", "event_id")


def nation_city_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City dimension of the stand-in: nation with key-derived coordinates."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("double")
    return n.select(F.col("n_name").alias("city"),
                    (F.lit(LAT_BASE) + key * F.lit(LAT_STEP)).alias("lat"),
                    (F.lit(LON_BASE) + key * F.lit(LON_STEP)).alias("lon"))


def poll_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed poll per event: both API answers (AQI and weather) of one city at one time, one scan."""
    e = _events_city(spark, sf_dir)
    return e.select("city", "ts", "event_id", _aqi_answer().alias("current"), _weather_answer().alias("weather"))


def poll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of every poll with both answers (AQI fields and weather), one scan."""
    e = _events_city(spark, sf_dir)
    v, k = F.col("value"), F.col("k")
    return e.select("city", "ts", "event_id",
                    *[(v * F.lit(LIVE_FACTORS[f])).alias(n) for f, n in (
                        ("pm2_5", "pm25"), ("pm10", "pm10"), ("nitrogen_dioxide", "no2"),
                        ("sulphur_dioxide", "so2"), ("carbon_monoxide", "co"), ("ozone", "o3"))],
                    F.when(F.col("event_type") == NO_AQI_EVENT, F.lit(None).cast("double")).otherwise(v)
                    .alias("aqi"),
                    (F.lit(TEMP_BASE) + k * F.lit(TEMP_STEP)).alias("temperature"), k.alias("humidity"),
                    (v / F.lit(WIND_DIVISOR)).alias("wind_speed"), (k.cast("int") % 4).alias("weather_code"))
