"""Table operators: projections, filters, windows, top-k, set ops, counts.

SURVEY P1-P14, W1-W3, W9, O1-O6, U1-U2, A1-A3, A10.

Partitioning rule used throughout: per-city *windows* run only on the fused
daily series, which holds at most one row per city and day, so one city's
partition is bounded by the calendar (~11k rows for 30 years) however large the
raw feeds grow.  Raw feeds (logs, payloads) are reduced per key with
aggregations (partial, map-side) or window-group limits (partial top-k before
the shuffle), so a hot key never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import date_text, iso_ts


# ---------------------------------------------------------------- projections

def align_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename legacy -> canonical names (only those present)."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def select_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keep wanted ∩ existing, in wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Analysis-time check; raises naming the missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the input: {missing}")
    return df


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with any missing value in ``subset``."""
    return df.na.drop(how="any", subset=list(subset))


def for_city(df: DataFrame, city: str | None = None, col: str = "city") -> DataFrame:
    """P5: equality predicate (pushed to the Parquet scan); ``None`` keeps all."""
    return df if city is None else df.where(F.col(col) == F.lit(city))


def keep_labels(df: DataFrame, col: str, labels: Iterable[str]) -> DataFrame:
    """Membership filter (NULL is never a member)."""
    return df.where(F.col(col).isin(list(labels)))


def split_feature_types(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns among ``cols``, from the schema."""
    types = dict(df.dtypes)
    numeric = [c for c in cols if types.get(c) in ("double", "float", "int", "bigint", "smallint")]
    categorical = [c for c in cols if c not in numeric]
    return numeric, categorical


def alerts(df: DataFrame, threshold: float = 150, aqi: str = "aqi") -> DataFrame:
    """P8 + F11: rows with AQI strictly above ``threshold`` and their alert text.

    The banner text names the health level of the status (US scale, F1); the
    alert history entry keeps the dashboard's short level (F2).
    """
    from ..functions.columns import alert_text
    from ..functions.risk import health_risk, risk_display
    return (df.where(F.col(aqi) > F.lit(float(threshold)))
              .withColumn("risk_level", risk_display(aqi)["level"])
              .withColumn("alert_text", alert_text("city", aqi, health_risk(aqi)["level"])))


def valid_rows(df: DataFrame, error_col: str = "error") -> DataFrame:
    """P10: drop error rows before comparing."""
    return df.where(F.col(error_col).isNull()) if error_col in df.columns else df


def min_history(df: DataFrame, n: int, key: str = "city", name: str = "n_rows") -> DataFrame:
    """Keep series with at least ``n`` rows.

    A window count on ``key`` shares its exchange with the per-city windows that
    usually follow (one shuffle for both).
    """
    return (df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))
              .where(F.col(name) >= F.lit(n)))


def drop_internal_ids(df: DataFrame, ids: Sequence[str] = ("_id", "event_id")) -> DataFrame:
    """Projection without storage ids."""
    return df.drop(*[c for c in ids if c in df.columns])


RECENT_COLUMNS = ["date", "pm25", "pm10", "no2", "co", "so2", "o3", "aqi", "aqi_bucket"]


def recent_table(df: DataFrame, n: int = 5) -> DataFrame:
    """The 9 named columns of the last ``n`` rows per city."""
    return last_n(df, n).select("city", "pos", *RECENT_COLUMNS)


def series(df: DataFrame) -> DataFrame:
    """Date-labelled AQI / PM2.5 / PM10 / NO2 (data behind the trend charts)."""
    return df.select("city", date_text("date").alias("date"), "aqi", "pm25", "pm10", "no2")


# ---------------------------------------------------------------- windows

def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               keep: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` tuple.

    Written as ``max_by`` aggregation rather than a ``row_number`` window: the
    hash aggregate combines map-side, so even a key holding a third of all rows
    leaves each map task as one row, and no task ever holds a whole group.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in keys]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in keep]),
                    F.struct(*[F.col(c) for c in order]))
    return (df.groupBy(*keys).agg(best.alias("_best"))
              .select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in keep]))


def latest_per_city(df: DataFrame, key: str = "city", order: str | Sequence[str] = "date",
                    require: str | None = "aqi") -> DataFrame:
    """Newest row per key (with ``require`` not NULL), as an aggregation."""
    order = [order] if isinstance(order, str) else list(order)
    if require:
        df = df.where(F.col(require).isNotNull())
    return dedup_last(df, [key], order, keep=[c for c in df.columns if c != key])


def last_n(df: DataFrame, n: int, key: str = "city", order: str = "date",
           require: str | None = "aqi") -> DataFrame:
    """Last ``n`` rows per key with ``pos`` 1..n ascending by ``order`` (Q7: rows, not days).

    ``row_number() <= n`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the exchange, so only n rows per key and map task are shuffled.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    if require:
        df = df.where(F.col(require).isNotNull())
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    ranked = df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    cnt = Window.partitionBy(key)
    return (ranked.withColumn("pos", F.count(F.lit(1)).over(cnt) - F.col("_rk") + 1)
                  .drop("_rk"))


def recent_log(df: DataFrame, k: int, key: str | None = "city", ts: str = "ts",
               tiebreak: str | None = "event_id") -> DataFrame:
    """Newest ``k`` entries per key (or overall when ``key`` is None), rank 1 = newest."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    if key is None:
        # global newest k: a top-k per task, then a merge; only k rows are ranked
        top = df.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- sorts / top-k

def sort_master(df: DataFrame, within_partitions: bool = True) -> DataFrame:
    """O1: order by city, date (inside partitions at write time, for Parquet stats)."""
    return df.sortWithinPartitions("city", "date") if within_partitions else df.orderBy("city", "date")


def recent_rows(df: DataFrame, city: str | None = None, limit: int = 50, ts: str = "ts",
                tiebreak: str = "event_id") -> DataFrame:
    """O2/O3: newest first, optional city, at most ``limit`` rows; ts as ISO text.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own top ``limit`` and only those reach the final merge.
    """
    top = (for_city(df, city).orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(limit))
    return (top.withColumn("timestamp", iso_ts(ts))
               .withColumn("count", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
               .drop(ts))


def recent_readings(readings: DataFrame, city: str | None = None, limit: int = 50) -> DataFrame:
    """O2: newest readings."""
    return recent_rows(readings, city, limit)


def recent_predictions(preds: DataFrame, city: str | None = None, limit: int = 20) -> DataFrame:
    """O3: newest predictions."""
    return recent_rows(preds, city, limit)


def top_cities(df: DataFrame, k: int = 8, key: str = "city") -> DataFrame:
    """Cities with most rows; ties by city ascending (Q17)."""
    return count_by(df, key).orderBy(F.col("n_rows").desc(), F.col(key)).limit(k)


def historical(df: DataFrame, n: int = 90, city: str | None = None) -> DataFrame:
    """Last ``n`` rows per city ascending, date text, rows asked and returned."""
    rows = last_n(for_city(df.where(F.col("date").isNotNull()), city), n)
    return (rows.select("city", "pos", date_text("date").alias("date"), "aqi", "pm25", "pm10", "no2")
                .withColumn("days_requested", F.lit(n))
                .withColumn("records_returned", F.count(F.lit(1)).over(Window.partitionBy("city"))))


def first_k_items(arr, k: int = 5) -> Column:
    """First ``k`` items of an array column."""
    return F.slice(F.col(arr) if isinstance(arr, str) else arr, 1, k)


# ---------------------------------------------------------------- set ops

def fuse(hist: DataFrame, modern: DataFrame) -> DataFrame:
    """UNION ALL by name; columns missing on one side become NULL."""
    return hist.unionByName(modern, allowMissingColumns=True)


def append_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """Add live rows to history (by name)."""
    return history.unionByName(live, allowMissingColumns=True)


# ---------------------------------------------------------------- aggregations

def count_by(df: DataFrame, key: str = "city") -> DataFrame:
    """A1: rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_cities(df: DataFrame, key: str = "city") -> DataFrame:
    """A2: distinct values."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def profile(df: DataFrame, key: str = "city", date: str = "date", approx: bool = False) -> DataFrame:
    """A3: rows, distinct cities, first and last date.

    ``approx=True`` swaps the exact distinct count (a shuffle of distinct keys)
    for a HyperLogLog sketch merged map-side.
    """
    distinct = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return df.agg(F.count(F.lit(1)).alias("records"), distinct.alias("cities"),
                  date_text(F.min(date)).alias("first_date"), date_text(F.max(date)).alias("last_date"))


def log_counts(readings: DataFrame, predictions: DataFrame, weather: DataFrame) -> DataFrame:
    """A10: rows in each of the three logs (one global count each)."""
    def one(df, name):
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("collection"), "n_rows")
    return one(readings, "aqi_readings").unionByName(one(predictions, "predictions")) \
        .unionByName(one(weather, "weather_logs"))
