"""Metric aggregations: SURVEY A5-A9, A13-A16, F23, F25.

All are hash aggregations (partial + final).  Classification reports are built
from the confusion counts (one row per label/prediction pair), never from rows
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import risk_india


def error_aggs(y: str = "actual", yhat: str = "pred") -> list:
    """A5 as aggregate expressions (compose them into one aggregation)."""
    err = F.col(y) - F.col(yhat)
    return [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.count(F.lit(1)).alias("n")]


def error_metrics(df: DataFrame, y: str = "actual", yhat: str = "pred",
                  by: Sequence[str] = ()) -> DataFrame:
    """A5: MAE = avg|y-ŷ|, RMSE = sqrt(avg (y-ŷ)²), count; global or per ``by``."""
    aggs = error_aggs(y, yhat)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def summarise_metrics(per_key: DataFrame, mae: str = "mae", rmse: str = "rmse") -> DataFrame:
    """Mean and exact median of per-key MAE / RMSE, and the number of keys."""
    return per_key.agg(F.avg(mae).alias("mae_mean"), F.avg(rmse).alias("rmse_mean"),
                       F.median(mae).alias("mae_median"), F.median(rmse).alias("rmse_median"),
                       F.count(F.lit(1)).alias("cities_trained"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts.

    Classes are those seen as label or prediction; undefined ratios are 0.
    """
    # one pass: each count adds to its label's class and to its prediction's
    shares = F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp"))))
    j = conf.select(shares.alias("s")).select("s.*").groupBy("cls").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return j.select(F.col("cls").alias("class"), p.alias("precision"), r.alias("recall"),
                    f1.alias("f1"), F.col("support").cast("long").alias("support"))


def overall_report(report: DataFrame) -> DataFrame:
    """Accuracy (= support-weighted recall), macro and weighted averages."""
    s = F.col("support").cast("double")
    tot = F.sum(s)
    return report.agg(
        (F.sum(F.col("recall") * s) / tot).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * s) / tot).alias("weighted_precision"),
        (F.sum(F.col("recall") * s) / tot).alias("weighted_recall"),
        (F.sum(F.col("f1") * s) / tot).alias("weighted_f1"),
        F.sum("support").cast("long").alias("support"))


def select_best(metrics: DataFrame, score: str = "f1_weighted", name: str = "model",
                order: str = "ord") -> DataFrame:
    """The model with the highest score; the first (lowest ``order``) on ties."""
    return metrics.agg(F.max_by(name, F.struct(F.col(score), -F.col(order))).alias("selected_model"),
                       F.max(score).alias("selected_score"))


def class_fractions(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts and their share of all rows."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def training_summary(history: DataFrame, col: str = "objective_history") -> DataFrame:
    """Lowest loss and number of rounds run of a fit's objective history array.

    The history starts with the loss before the first round, which is no round.
    """
    return history.select("*", F.array_min(col).alias("best_loss"),
                          F.greatest(F.size(col) - 1, F.lit(0)).alias("rounds"))


def horizon_rows(df: DataFrame, cols=("pred_24h", "pred_48h", "pred_72h"), hours=(24, 48, 72)) -> DataFrame:
    """wide horizons -> rows (horizon, predicted AQI, Indian risk)."""
    keep = [c for c in df.columns if c not in cols]
    stacked = df.unpivot(keep, list(cols), "horizon_col", "predicted_aqi")
    mapping = F.create_map(*[x for c, h in zip(cols, hours) for x in (F.lit(c), F.lit(h))])
    return (stacked.withColumn("horizon_hours", F.try_element_at(mapping, F.col("horizon_col")))
                   .withColumn("risk", risk_india("predicted_aqi")).drop("horizon_col"))


def explode_metrics(df: DataFrame, col: str, key_name: str = "name",
                    fields: Sequence[str] = ("accuracy", "f1_weighted")) -> DataFrame:
    """map of name -> metrics struct to rows; missing fields -> 0."""
    e = df.select(F.explode(col).alias(key_name, "_m"))
    return e.select(key_name, *[F.coalesce(F.col("_m." + f), F.lit(0.0)).alias(f) for f in fields])
