"""SQL (DuckDB dialect) for the oracle side of every registered query.

The stand-in inputs are restated here as CTEs from the rule constants of
:mod:`smogcast.sources.standin`; the query bodies are written independently of
the Spark code, in plain SQL.  Output conventions shared with the Spark side:
dates as ``yyyy-MM-dd`` text, timestamps as ISO text, doubles rounded to 6.
"""

from __future__ import annotations

from ..functions import risk
from ..sources import standin as si


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_band(expr: str, scale, field: int = 1) -> str:
    parts = [f"WHEN {expr} <= {float(row[0])} THEN {q(row[field])}" for row in scale[:-1]]
    return f"(CASE {' '.join(parts)} ELSE {q(scale[-1][field])} END)"


def sql_lookup(expr: str, mapping: dict, default: str) -> str:
    parts = " ".join(f"WHEN {expr} = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {parts} ELSE {default} END)"


def us_level(expr): return sql_band(expr, risk.US_SCALE, 1)
def us_color(expr): return sql_band(expr, risk.US_SCALE, 2)
def us_advice(expr): return sql_band(expr, risk.US_SCALE, 3)
def india(expr): return sql_band(expr, risk.INDIA_SCALE, 1)
def bucket4(expr): return sql_band(expr, risk.BUCKET4_SCALE, 1)
def display_level(expr): return sql_band(expr, risk.DISPLAY_SCALE, 1)


def _null_rule(key: str, rule, value: str) -> str:
    m, r = rule
    return f"CASE WHEN {key} % {m} = {r} THEN NULL ELSE {value} END"


def _hist_raw() -> str:
    cols = [
        f"CASE WHEN o_orderkey % {si.HIST_NO_CITY[0]} = {si.HIST_NO_CITY[1]} THEN NULL ELSE n_name END AS location",
        f"CASE WHEN o_orderkey % {si.HIST_BAD_DATE[0]} = {si.HIST_BAD_DATE[1]} THEN {q(si.BAD_DATE_TEXT)} "
        f"ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date",
    ]
    for name, div in si.HIST_DIVISORS.items():
        v = f"o_totalprice / {div}"
        if name in si.HIST_NULLS:
            v = _null_rule("o_orderkey", si.HIST_NULLS[name], v)
        cols.append(f"{v} AS {name}")
    cols.append("o_orderkey AS row_ord")
    return (f"SELECT {', '.join(cols)} FROM orders_city "
            f"WHERE o_orderdate < TIMESTAMP '{si.HIST_BEFORE}'")


def _modern_raw() -> str:
    cols = ["n_name AS City", "strftime(o_orderdate, '%Y-%m-%d') AS Date"]
    for name, div in si.MODERN_DIVISORS.items():
        v = f"o_totalprice / {div}"
        if name in si.MODERN_NULLS:
            v = _null_rule("o_orderkey", si.MODERN_NULLS[name], v)
        cols.append(f'{v} AS "{name}"')
    aqi = _null_rule("o_orderkey", si.MODERN_NULLS["AQI"], f"o_totalprice / {si.MODERN_DIVISORS['AQI']}")
    bm, br = si.MODERN_NO_BUCKET
    cols.append(f"CASE WHEN o_orderkey % {bm} = {br} OR ({aqi}) IS NULL THEN NULL "
                f"ELSE {india('(' + aqi + ')')} END AS AQI_Bucket")
    cols.append("o_orderkey AS row_ord")
    return (f"SELECT {', '.join(cols)} FROM orders_city "
            f"WHERE o_orderdate >= TIMESTAMP '{si.MODERN_FROM}'")


def _events_live() -> str:
    v = "value"
    f = si.LIVE_FACTORS
    return (f"SELECT city, ts, event_id, {v} * {f['pm2_5']} AS pm25, {v} * {f['pm10']} AS pm10, "
            f"{v} * {f['nitrogen_dioxide']} AS no2, {v} * {f['sulphur_dioxide']} AS so2, "
            f"{v} * {f['carbon_monoxide']} AS co, {v} * {f['ozone']} AS o3, "
            f"CASE WHEN event_type = {q(si.NO_AQI_EVENT)} THEN NULL ELSE {v} END AS aqi "
            f"FROM events_city")


def _events_weather() -> str:
    return (f"SELECT city, ts, event_id, {si.TEMP_BASE} + k * {si.TEMP_STEP} AS temperature, "
            f"k AS humidity, value / {si.WIND_DIVISOR} AS wind_speed, "
            f"CAST(CAST(k AS INTEGER) % 4 AS BIGINT) AS weather_code FROM events_city")


def _readings() -> str:
    f = si.LIVE_FACTORS
    return (f"SELECT city, {q(si.LIVE_SOURCE)} AS source, value AS aqi, value * {f['pm2_5']} AS pm25, "
            f"value * {f['pm10']} AS pm10, value * {f['nitrogen_dioxide']} AS no2, "
            f"value * {f['sulphur_dioxide']} AS so2, {si.TEMP_BASE} + k * {si.TEMP_STEP} AS temperature, "
            f"k AS humidity, value / {si.WIND_DIVISOR} AS wind_speed, ts, event_id "
            f"FROM events_city WHERE event_type <> {q(si.NO_AQI_EVENT)}")


def _predictions() -> str:
    cols = ", ".join(f"value * {fac} AS {n}" for n, fac in si.PRED_FACTORS.items())
    return (f"SELECT city, {q(si.PRED_SOURCE)} AS data_source, {cols}, ts, event_id "
            f"FROM events_city WHERE event_type = {q(si.PREDICT_EVENT)}")


def _city_dim() -> str:
    return (f"SELECT n_name AS city, {si.LAT_BASE} + CAST(n_nationkey AS DOUBLE) * {si.LAT_STEP} AS lat, "
            f"{si.LON_BASE} + CAST(n_nationkey AS DOUBLE) * {si.LON_STEP} AS lon FROM nation")


# name -> (SQL body, dependencies).  ``with_ctes`` pulls dependencies in order.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "orders_city": ("SELECT o.o_orderkey, o.o_totalprice, o.o_orderdate, n.n_name FROM orders o "
                    "JOIN customer c ON o.o_custkey = c.c_custkey "
                    "JOIN nation n ON c.c_nationkey = n.n_nationkey", ()),
    "hist_raw": (_hist_raw(), ("orders_city",)),
    "modern_raw": (_modern_raw(), ("orders_city",)),
    "hist_clean": ("SELECT location AS city, CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS date, "
                   "pm2_5 AS pm25, rspm AS pm10, no2, so2, greatest(rspm, no2) * 1.5 AS aqi, row_ord, "
                   "CAST(0 AS BIGINT) AS source_rank FROM hist_raw "
                   "WHERE location IS NOT NULL AND try_strptime(date, '%Y-%m-%d') IS NOT NULL", ("hist_raw",)),
    "modern_clean": ('SELECT City AS city, CAST(try_strptime(Date, \'%Y-%m-%d\') AS DATE) AS date, '
                     '"PM2.5" AS pm25, PM10 AS pm10, NO2 AS no2, SO2 AS so2, CO AS co, O3 AS o3, '
                     'AQI AS aqi, AQI_Bucket AS aqi_bucket, row_ord, CAST(1 AS BIGINT) AS source_rank FROM modern_raw '
                     "WHERE City IS NOT NULL AND try_strptime(Date, '%Y-%m-%d') IS NOT NULL", ("modern_raw",)),
    "fused": ("SELECT city, date, pm25, pm10, no2, so2, CAST(NULL AS DOUBLE) AS co, CAST(NULL AS DOUBLE) AS o3, "
              "aqi, CAST(NULL AS VARCHAR) AS aqi_bucket, row_ord, source_rank FROM hist_clean "
              "UNION ALL SELECT city, date, pm25, pm10, no2, so2, co, o3, aqi, aqi_bucket, row_ord, "
              "source_rank FROM modern_clean", ("hist_clean", "modern_clean")),
    "master": ("SELECT city, date, pm25, pm10, no2, so2, co, o3, aqi, aqi_bucket FROM ("
               "SELECT *, row_number() OVER (PARTITION BY city, date "
               "ORDER BY source_rank DESC, row_ord DESC) AS rn_ FROM fused) WHERE rn_ = 1", ("fused",)),
    "events_city": ("SELECT n.n_name AS city, e.ts, e.event_id, e.event_type, e.value, "
                    "CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS k FROM events e "
                    "JOIN customer c ON e.user_id = c.c_custkey "
                    "JOIN nation n ON c.c_nationkey = n.n_nationkey", ()),
    "live": (_events_live(), ("events_city",)),
    "weather": (_events_weather(), ("events_city",)),
    "readings": (_readings(), ("events_city",)),
    "predictions": (_predictions(), ("events_city",)),
    "city_dim": (_city_dim(), ()),
}


def with_ctes(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding ``names`` (and their dependencies), then ``body``.

    ``extra`` adds query-local CTEs after the shared ones, in order.
    """
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]})" for n in order]
    parts += [f"{n} AS ({s})" for n, s in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def finish(body: str, doubles=(), dates=(), stamps=()) -> str:
    """Round doubles to 6, dates to text, timestamps to ISO text (same as Spark's ``finish``)."""
    rep = [f"round({c}, 6) AS {c}" for c in doubles]
    rep += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
    rep += [f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') AS {c}" for c in stamps]
    if not rep:
        return body
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({body}) AS out_"
