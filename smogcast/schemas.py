"""Canonical schemas.  Lower-case names, NULL for missing."""

from pyspark.sql import types as T

D = T.DoubleType()
S = T.StringType()

POLLUTANTS = ["pm25", "pm10", "no2", "so2", "co", "o3"]

AIR_DAILY = T.StructType([
    T.StructField("city", S, False),
    T.StructField("date", T.DateType(), False),
    *[T.StructField(c, D) for c in POLLUTANTS],
    T.StructField("aqi", D),
    T.StructField("aqi_bucket", S),
])

AIR_READING = T.StructType([
    T.StructField("city", S), T.StructField("source", S), T.StructField("aqi", D),
    T.StructField("pm25", D), T.StructField("pm10", D), T.StructField("no2", D),
    T.StructField("so2", D), T.StructField("temperature", D), T.StructField("humidity", D),
    T.StructField("wind_speed", D), T.StructField("ts", T.TimestampType()),
])

AIR_PREDICTION = T.StructType([
    T.StructField("city", S), T.StructField("data_source", S),
    T.StructField("pred_24h", D), T.StructField("pred_48h", D), T.StructField("pred_72h", D),
    T.StructField("ts", T.TimestampType()),
])

WEATHER_LOG = T.StructType([
    T.StructField("city", S), T.StructField("temperature", D), T.StructField("humidity", D),
    T.StructField("wind_speed", D), T.StructField("ts", T.TimestampType()),
])

CITY_DIM = T.StructType([
    T.StructField("city", S, False), T.StructField("lat", D), T.StructField("lon", D),
])

AQI_CURRENT = T.StructType([
    T.StructField(n, D) for n in
    ["pm10", "pm2_5", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide", "ozone", "us_aqi"]
])
AQI_PAYLOAD = T.StructType([
    T.StructField("city", S), T.StructField("ts", T.TimestampType()),
    T.StructField("current", AQI_CURRENT),
])

WEATHER_CURRENT = T.StructType([
    T.StructField("temperature_2m", D), T.StructField("relative_humidity_2m", D),
    T.StructField("wind_speed_10m", D), T.StructField("weather_code", T.IntegerType()),
])
WEATHER_PAYLOAD = T.StructType([
    T.StructField("city", S), T.StructField("ts", T.TimestampType()),
    T.StructField("current", WEATHER_CURRENT),
])

# One poll as landed: both API answers of one city at one time.
POLL_PAYLOAD = T.StructType([
    T.StructField("city", S), T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("current", AQI_CURRENT), T.StructField("weather", WEATHER_CURRENT),
])

# JSON timestamps keep microseconds (the default text format drops them).
JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# Historical CSV (legacy names) and modern CSV (external names), read as text
# first where the reference parses; numbers typed, bad cells -> NULL.
HISTORICAL_CSV = T.StructType([
    T.StructField("location", S), T.StructField("date", S),
    T.StructField("no2", D), T.StructField("so2", D), T.StructField("pm2_5", D),
    T.StructField("rspm", D),
])

MODERN_CSV = T.StructType([
    T.StructField("City", S), T.StructField("Date", S),
    T.StructField("PM2.5", D), T.StructField("PM10", D), T.StructField("NO2", D),
    T.StructField("SO2", D), T.StructField("CO", D), T.StructField("O3", D),
    T.StructField("AQI", D), T.StructField("AQI_Bucket", S),
])

MONITOR_LOG_CSV = T.StructType([
    T.StructField("timestamp", S), T.StructField("city", S), T.StructField("source", S),
    T.StructField("aqi_now", D), T.StructField("pm25", D), T.StructField("pm10", D),
    T.StructField("no2", D), T.StructField("so2", D), T.StructField("risk_now", S),
    T.StructField("aqi_24h", D), T.StructField("aqi_48h", D), T.StructField("aqi_72h", D),
])

# Legacy -> canonical renames used by the fusion.
HISTORICAL_RENAMES = {"location": "city", "date": "date", "no2": "no2", "so2": "so2",
                      "pm2_5": "pm25", "rspm": "pm10"}
MODERN_RENAMES = {"City": "city", "Date": "date", "PM2.5": "pm25", "PM10": "pm10",
                  "NO2": "no2", "SO2": "so2", "CO": "co", "O3": "o3", "AQI": "aqi",
                  "AQI_Bucket": "aqi_bucket"}
MASTER_COLUMNS = ["city", "date", *POLLUTANTS, "aqi", "aqi_bucket"]
# External names used by exports (K7), in export order.
EXPORT_NAMES = {"date": "Date", "city": "City", "pm25": "PM2.5", "pm10": "PM10", "no2": "NO2",
                "so2": "SO2", "co": "CO", "o3": "O3", "aqi": "AQI"}
