"""File sources.

All readers fix their output schema: no inference pass over the data, columns
are matched by name, malformed cells become NULL, and the scan prunes columns
and pushes filters.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.columns import parse_date


def _csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Read a headed CSV and keep ``schema``'s columns **by name**, typed.

    A user schema on a CSV maps columns by position, but real exports carry
    extra columns in their own order.  So every field is read as text (no
    inference pass: only the header line names the columns), the wanted ones
    are selected by name, numbers are ``try_cast`` (bad cells -> NULL) and a
    wanted column the file lacks comes back as NULL.
    """
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .option("encoding", encoding).option("inferSchema", False).csv(path))
    present = set(raw.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in present else F.lit(None)
        cols.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


def _with_row_ord(df: DataFrame) -> DataFrame:
    """File order as a real column (quirk Q1): file name, then position in it.

    ``monotonically_increasing_id`` increases inside a partition and partitions
    follow file splits, so (file, id) orders rows as they appear on disk.  It is
    written once with the data, never recomputed.
    """
    return (df.withColumn("_file", F.input_file_name())
              .withColumn("_pos", F.monotonically_increasing_id())
              .withColumn("row_ord", F.struct(F.col("_file"), F.col("_pos")))
              .drop("_file", "_pos"))


def read_historical(spark: SparkSession, path: str) -> DataFrame:
    """Historical CSV, Latin-1 text, legacy column names; adds ``row_ord``."""
    return _with_row_ord(_csv(spark, path, schemas.HISTORICAL_CSV, "ISO-8859-1"))


def read_modern(spark: SparkSession, path: str, parse: bool = False) -> DataFrame:
    """Modern daily CSV; ``parse=True`` also parses ``Date``."""
    df = _with_row_ord(_csv(spark, path, schemas.MODERN_CSV))
    if parse:
        df = df.withColumn("Date", parse_date("Date"))
    return df


def read_master(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: the fused series; one scan shared by all cities."""
    if fmt == "csv":
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "date" else f.dataType)
                               for f in schemas.AIR_DAILY.fields])
        return _csv(spark, path, schema).withColumn("date", parse_date("date"))
    return spark.read.parquet(path)


def read_first_available(spark: SparkSession, paths, fmt: str = "parquet") -> DataFrame:
    """The first path of an ordered list that exists; error if none does.

    Resolving a read lists the path (no data is scanned), so a missing path
    fails at once with ``PATH_NOT_FOUND`` and the next candidate is tried.
    """
    for p in paths:
        try:
            df = read_master(spark, p, fmt)
            df.schema   # noqa: B018 - forces path resolution
            return df
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
                raise
    raise FileNotFoundError(f"none of these paths exists: {list(paths)}")


def _with_event_id(schema: T.StructType) -> T.StructType:
    """A new schema with the poll id appended (``StructType.add`` would mutate the shared one)."""
    return T.StructType(list(schema.fields) + [T.StructField("event_id", T.LongType())])


def read_aqi_payloads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed live-AQI JSON -> canonical live row (city, ts, 7 fields)."""
    reader = spark.readStream if stream else spark.read
    raw = (reader.schema(_with_event_id(schemas.AQI_PAYLOAD))
           .option("timestampFormat", schemas.JSON_TS_FORMAT).json(path))
    return aqi_payload_fields(raw, keep=("event_id",))


def aqi_payload_fields(raw: DataFrame, keep=()) -> DataFrame:
    """Pick ``current.*`` and rename to canonical names (S5 projection)."""
    c = "current."
    return raw.select("city", "ts", *keep,
                      F.col(c + "pm2_5").alias("pm25"), F.col(c + "pm10").alias("pm10"),
                      F.col(c + "nitrogen_dioxide").alias("no2"),
                      F.col(c + "sulphur_dioxide").alias("so2"),
                      F.col(c + "carbon_monoxide").alias("co"), F.col(c + "ozone").alias("o3"),
                      F.col(c + "us_aqi").alias("aqi"))


def read_weather_payloads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed live-weather JSON -> (city, ts, temperature, humidity, wind_speed, weather_code)."""
    reader = spark.readStream if stream else spark.read
    raw = (reader.schema(_with_event_id(schemas.WEATHER_PAYLOAD))
           .option("timestampFormat", schemas.JSON_TS_FORMAT).json(path))
    return weather_payload_fields(raw, keep=("event_id",))


def weather_payload_fields(raw: DataFrame, keep=()) -> DataFrame:
    c = "current."
    return raw.select("city", "ts", *keep,
                      F.col(c + "temperature_2m").alias("temperature"),
                      F.col(c + "relative_humidity_2m").alias("humidity"),
                      F.col(c + "wind_speed_10m").alias("wind_speed"),
                      F.col(c + "weather_code").alias("weather_code"))


CLASSIFIER_METRICS_SCHEMA = "selected_model STRING, selected_model_f1_weighted DOUBLE, " \
    "all_metrics MAP<STRING, STRUCT<accuracy: DOUBLE, f1_weighted: DOUBLE, " \
    "classification_report: MAP<STRING, STRING>>>, feature_columns ARRAY<STRING>"
ARIMA_METRICS_SCHEMA = "model STRING, order ARRAY<INT>, cities_trained INT, " \
    "aggregate STRUCT<mae_mean: DOUBLE, rmse_mean: DOUBLE, mae_median: DOUBLE, rmse_median: DOUBLE>, " \
    "per_city MAP<STRING, STRUCT<mae: DOUBLE, rmse: DOUBLE, holdout: INT, last_actual: DOUBLE, " \
    "last_predicted: DOUBLE>>"
SEQUENCE_METRICS_SCHEMA = "sequence_length INT, records BIGINT, cities BIGINT, train_sequences BIGINT, " \
    "test_sequences BIGINT, mae DOUBLE, rmse DOUBLE, best_val_loss DOUBLE, epochs_ran INT"
METRICS_SCHEMAS = {"classifier": CLASSIFIER_METRICS_SCHEMA, "arima": ARIMA_METRICS_SCHEMA,
                   "sequence": SEQUENCE_METRICS_SCHEMA}


def read_metrics_runs(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Every metrics document below ``path``, one row each: (run, document, bad).

    ``run`` is the name of the document's file; a document that is no JSON of the
    kind's schema, or holds none of its fields, is kept as ``bad`` text with a null
    ``document``.  A path that does not exist gives ``None``.
    """
    names = T.StructType.fromDDL(METRICS_SCHEMAS[kind]).fieldNames()
    # Spark's reader splits no multi-line document, and says which one it could not parse
    reader = (spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "bad_record"))
    try:
        rows = reader.schema(METRICS_SCHEMAS[kind] + ", bad_record STRING").json(path)
        run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        rows = rows.select(run.alias("run"), "bad_record", F.struct(*names).alias("document"))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return None
    empty = F.forall(F.array(*[F.col(f"document.{n}").isNull() for n in names]), lambda x: x)
    bad = F.coalesce("bad_record", F.when(empty, F.lit("no field of the kind")))
    return rows.select("run", F.when(bad.isNull(), F.col("document")).alias("document"), bad.alias("bad"))


def read_metrics(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The metrics documents that can be read, in their own columns; none readable or no path gives ``None``."""
    runs = read_metrics_runs(spark, path, kind)
    if runs is None:
        return None
    good = runs.where(F.col("document").isNotNull()).select("document.*")
    return good if good.limit(1).count() else None


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one of the three append logs (readings / predictions / weather)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}" if name else root)


def read_monitor_log(spark: SparkSession, path: str) -> DataFrame:
    """CSV monitor log, timestamp parsed as UTC."""
    return (_csv(spark, path, schemas.MONITOR_LOG_CSV)
            .withColumn("ts", F.try_to_timestamp(F.col("timestamp"),
                                                 F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"))))


# ---------------------------------------------------------------------------
# The reference's city list with coordinates (S10), in its order.
# ---------------------------------------------------------------------------
CITY_COORDS = [
    ("Delhi", 28.6139, 77.2090),
    ("Mumbai", 19.0760, 72.8777),
    ("Bangalore", 12.9716, 77.5946),
    ("Chennai", 13.0827, 80.2707),
    ("Kolkata", 22.5726, 88.3639),
    ("Hyderabad", 17.3850, 78.4867),
    ("Pune", 18.5204, 73.8567),
    ("Lucknow", 26.8467, 80.9462),
    ("Ahmedabad", 23.0225, 72.5714),
    ("Jaipur", 26.9124, 75.7873),
]


def city_dim(spark: SparkSession) -> DataFrame:
    """The 10 supported cities with coordinates (a fixed, tiny dimension)."""
    return spark.createDataFrame(CITY_COORDS, schemas.CITY_DIM)
