"""Sequence features and splits: SURVEY W4-W8, W10, A4, F15.

Per-city windows here run on the fused daily series (one row per city and
day), so a city's partition is bounded by the calendar however many rows the
raw sources hold.  Global positions (W5) come from a per-city count table and
a running offset over it, never from a window without a partition key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import minmax


def fit_minmax(df: DataFrame, col: str = "aqi") -> DataFrame:
    """A4: one row (lo, hi) over all cities: min and max of ``col``."""
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def scale_minmax(df: DataFrame, fit: DataFrame, col: str = "aqi", out: str | None = None) -> DataFrame:
    """F15 with the fitted (lo, hi): one-row side, so a broadcast of proven size."""
    return (df.crossJoin(F.broadcast(fit))
              .withColumn(out or col + "_scaled", minmax(col, "lo", "hi")))


def sequences(df: DataFrame, n: int = 30, col: str = "aqi", key: str = "city",
              order: str = "date") -> DataFrame:
    """Per key, the ``n`` preceding values (oldest first) and the current one as label.

    ``prev`` (the newest lag) is also a column, so consumers that need only it
    let Catalyst prune the 30-value arrays away.

    A key needs n+1 rows for one sequence.  NULLs are dropped first
    (``collect_list`` would skip them and shift the lags).
    """
    w = Window.partitionBy(key).orderBy(order)
    return (df.where(F.col(col).isNotNull())
              .withColumn("lags", F.collect_list(col).over(w.rowsBetween(-n, -1)))
              .withColumn("prev", F.lag(col, 1).over(w))
              .withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") > n)
              .select(key, order, "lags", "prev", F.col(col).alias("label")))


def _global_position(df: DataFrame, key: str, order: str) -> DataFrame:
    """0-based position in (key, order) order plus the total count ``_n``.

    Counts per key (one row each) -> running offset over that small table ->
    offset + row number inside the key.
    """
    w = Window.partitionBy(key).orderBy(order)
    ranked = (df.withColumn("_rk", F.row_number().over(w))
                .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(key))))
    # one row per key, taken from data already partitioned by key (no new shuffle)
    counts = ranked.where(F.col("_rk") == 1).select(key, "_cnt")
    offs = counts.select(
        key,
        F.coalesce(F.sum("_cnt").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_n"))
    return (ranked.join(offs, key)
                  .withColumn("gpos", F.col("_off") + F.col("_rk") - 1).drop("_rk", "_off", "_cnt"))


def position_split(df: DataFrame, frac: float = 0.8, key: str = "city", order: str = "date") -> DataFrame:
    """First ``int(frac*N)`` rows in (key, order) order are ``train``, the rest ``test`` (Q6)."""
    g = _global_position(df, key, order)
    split_at = F.floor(F.col("_n") * F.lit(frac))
    return (g.withColumn("part", F.when(F.col("gpos") < split_at, "train").otherwise("test"))
             .drop("_n"))


def time_split(df: DataFrame, frac: float = 0.8, key: str = "city", order: str = "date") -> DataFrame:
    """W5 variant (Q6): per key, the first ``int(frac * n_key)`` rows in time are ``train``.

    Unlike the positional split, every city contributes its own past to train
    and its own future to test.  One exchange on ``key``, shared with W4.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return (df.withColumn("_rk", F.row_number().over(w)).withColumn("_n", n)
              .withColumn("part", F.when(F.col("_rk") <= F.floor(F.col("_n") * F.lit(frac)), "train")
                          .otherwise("test"))
              .drop("_rk", "_n"))


def validation_tail(train: DataFrame, frac: float = 0.1, key: str = "city", order: str = "date") -> DataFrame:
    """The last ``frac`` of the training rows (in order) are held for validation."""
    g = _global_position(train.drop("gpos", "part") if "gpos" in train.columns else train, key, order)
    split_at = F.floor(F.col("_n") * F.lit(1.0 - frac))
    return (g.withColumn("part", F.when(F.col("gpos") < split_at, "fit").otherwise("validation"))
             .drop("_n"))


def holdout_split(df: DataFrame, h: int = 72, key: str = "city", order: str = "date") -> DataFrame:
    """The last ``h`` rows per key are ``test``; ``pos`` counts from 1 in order."""
    w = Window.partitionBy(key).orderBy(order)
    wd = Window.partitionBy(key)
    return (df.withColumn("pos", F.row_number().over(w))
              .withColumn("_n", F.count(F.lit(1)).over(wd))
              .withColumn("part", F.when(F.col("pos") > F.col("_n") - h, "test").otherwise("train"))
              .drop("_n"))


def last_pair_aggs(actual: str = "actual", pred: str = "pred", pos: str = "pos") -> list:
    """W7 as aggregate expressions: the values at the greatest position."""
    return [F.max_by(actual, pos).alias("last_actual"), F.max_by(pred, pos).alias("last_predicted")]


def last_pair(df: DataFrame, actual: str = "actual", pred: str = "pred", pos: str = "pos",
              key: str = "city") -> DataFrame:
    """Last actual and last predicted value per key."""
    return df.groupBy(key).agg(*last_pair_aggs(actual, pred, pos))


def differences(df: DataFrame, col: str = "aqi", key: str = "city", order: str = "date") -> DataFrame:
    """First difference ``d`` and its lags ``d_lag1``, ``d_lag2`` (the d=1, p=2 terms)."""
    w = Window.partitionBy(key).orderBy(order)
    return (df.withColumn("d", F.col(col) - F.lag(col, 1).over(w))
              .withColumn("d_lag1", F.lag("d", 1).over(w))
              .withColumn("d_lag2", F.lag("d", 2).over(w)))
