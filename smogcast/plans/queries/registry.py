"""Query registry: registration, output conventions and the shared fused series.

Each Spark query takes ``(spark, sf_dir)``, reads whole stand-in tables and
returns a lazy DataFrame.  ``finish`` applies the conventions shared with the
SQL oracle: doubles rounded to 6 decimals, integers widened to BIGINT, dates
as ``yyyy-MM-dd`` text and timestamps as ISO text, so values compare exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..master import build_master, write_clustered
from ...session import ensure_checkpoint_dir
from ...streaming.logs import publish, read_newest
from ...sources import standin as si
from ...functions.columns import date_text, iso_ts


SparkQuery = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, SparkQuery] = {}
SQL: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for name, t in df.dtypes:
        c = F.col(f"`{name}`")
        if t in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif t in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif t == "date":
            c = date_text(c)
        elif t.startswith("timestamp"):
            c = iso_ts(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: SparkQuery) -> SparkQuery:
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ inputs

def fresh_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused daily series of the stand-in (U3 over historical + modern), as a lazy plan."""
    return build_master(si.historical(spark, sf_dir), si.modern(spark, sf_dir))


_MASTER: dict = {}


def master_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the published fused series, written once per session and scale (K1)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MASTER:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/smogcast-master-{uuid.uuid4().hex[:12]}"
        publish(fresh_master(spark, sf_dir), path, write_clustered)
        _MASTER[key] = path
    return _MASTER[key]


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused series as production serves it: Parquet clustered by (city, date), scanned by every query (S3).

    City and date filters reach the scan, and a query reads only its columns.
    """
    return read_newest(spark, master_path(spark, sf_dir))


MASTER_DOUBLES = ["pm25", "pm10", "no2", "so2", "co", "o3", "aqi"]
