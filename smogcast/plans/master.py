"""U3 ``build_master``: fuse historical and modern daily data into one series.

One lazy plan: P1 rename -> F13 parse dates -> P4 drop rows without city or
date -> F14 proxy AQI (historical only) -> P2 keep the master columns -> U1
union by name -> W1 dedup on (city, date), modern source first, then the later
file row (Q1).  The only shuffle is the dedup aggregation on (city, date),
combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import aqi_proxy, parse_date
from ..operators.tables import align_columns, dedup_last, drop_missing, fuse, select_available, sort_master
from ..schemas import HISTORICAL_RENAMES, MASTER_COLUMNS, MODERN_RENAMES

HIST_RANK, MODERN_RANK = 0, 1


def prepare_historical(hist: DataFrame, date_formats=("yyyy-MM-dd",)) -> DataFrame:
    df = align_columns(hist, HISTORICAL_RENAMES)
    df = df.withColumn("date", parse_date("date", date_formats))
    df = drop_missing(df, ["date", "city"])
    df = df.withColumn("aqi", aqi_proxy("pm10", "no2"))
    return select_available(df, MASTER_COLUMNS + ["row_ord"]).withColumn("source_rank", F.lit(HIST_RANK))


def prepare_modern(modern: DataFrame, date_formats=("yyyy-MM-dd",)) -> DataFrame:
    df = align_columns(modern, MODERN_RENAMES)
    if dict(df.dtypes).get("date") == "string":
        df = df.withColumn("date", parse_date("date", date_formats))
    df = drop_missing(df, ["date", "city"])
    return select_available(df, MASTER_COLUMNS + ["row_ord"]).withColumn("source_rank", F.lit(MODERN_RANK))


def build_master(hist: DataFrame, modern: DataFrame, date_formats=("yyyy-MM-dd",)) -> DataFrame:
    """The fused, deduplicated daily series with the canonical columns."""
    fused = fuse(prepare_historical(hist, date_formats), prepare_modern(modern, date_formats))
    out = dedup_last(fused, ["city", "date"], ["source_rank", "row_ord"],
                     keep=[c for c in MASTER_COLUMNS if c not in ("city", "date")])
    return out.select(*MASTER_COLUMNS)


def write_master(df: DataFrame, path: str, partition_by_year: bool = True) -> None:
    """K1: write the series as Parquet, partitioned by year, sorted inside files.

    Sorting inside each task (no global sort) keeps per-file min/max statistics
    tight on (city, date), so city and date filters skip row groups.
    """
    if partition_by_year:
        (df.withColumn("year", F.year("date"))
           .sortWithinPartitions("year", "city", "date")
           .write.mode("overwrite").partitionBy("year").parquet(path))
    else:
        sort_master(df).write.mode("overwrite").parquet(path)


def write_clustered(df: DataFrame, path: str) -> None:
    """K1 for serving: files are ranges of (city, date), sorted inside.

    Each file's and row group's statistics are then tight, so that a filter on cities
    or dates skips most of them; a city of any size is split over files by its dates.
    """
    (df.repartitionByRange("city", "date").sortWithinPartitions("city", "date")
       .write.mode("overwrite").parquet(path))
