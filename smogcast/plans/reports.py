"""Reports and metrics documents: SURVEY J9, K5, K6, M15, S7.

The reference reads three JSON metrics files written by its training scripts;
here the same documents are produced by our own Spark jobs (K5) and read back
with explicit schemas (S7).  A missing document is reported as unavailable,
not as an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_metrics_runs


def sequence_metrics_doc(evaluation: DataFrame, profile: DataFrame, validation: DataFrame,
                         seq_len: int = 30) -> DataFrame:
    """The sequence-model metrics document (one row) from M5's evaluation, A3's profile and M1's validation loss."""
    return evaluation.crossJoin(profile).crossJoin(validation).select(
        F.lit(seq_len).alias("sequence_length"), F.col("records").cast("long").alias("records"),
        F.col("cities").cast("long").alias("cities"), F.col("train_sequences").cast("long").alias("train_sequences"),
        F.col("test_sequences").cast("long").alias("test_sequences"), "mae", "rmse",
        "best_val_loss", "epochs_ran")


def arima_metrics_doc(per_city: DataFrame, summary: DataFrame, order=(2, 1, 2)) -> DataFrame:
    """The ARIMA baseline document (one row): aggregate + per-city map."""
    entries = per_city.agg(F.map_from_entries(F.collect_list(F.struct(
        "city", F.struct("mae", "rmse", F.col("holdout").cast("int").alias("holdout"),
                         "last_actual", "last_predicted")))).alias("per_city"))
    return summary.crossJoin(entries).select(
        F.lit("ARIMA").alias("model"), F.array(*[F.lit(int(o)) for o in order]).alias("order"),
        F.col("cities_trained").cast("int").alias("cities_trained"),
        F.struct("mae_mean", "rmse_mean", "mae_median", "rmse_median").alias("aggregate"), "per_city")


def classifier_metrics_doc(metrics: DataFrame, features) -> DataFrame:
    """The classifier document (one row): best model, its weighted F1, all metrics, features."""
    best = metrics.agg(F.max_by("model", F.struct("f1_weighted", -F.col("ord"))).alias("selected_model"),
                       F.max("f1_weighted").alias("selected_model_f1_weighted"))
    allm = metrics.agg(F.map_from_entries(F.collect_list(F.struct(
        "model", F.struct("accuracy", "f1_weighted",
                          F.create_map(F.lit("f1_macro"), F.col("f1_macro").cast("string"))
                          .alias("classification_report"))))).alias("all_metrics"))
    return best.crossJoin(allm).withColumn("feature_columns", F.array(*[F.lit(f) for f in features]))


def model_metrics(spark: SparkSession, root: str | None = None, paths: dict | None = None) -> DataFrame:
    """The three documents side by side with availability flags (one row).

    They lie below ``root``, or at the ``paths`` given; one without a path is
    unavailable.  Of several documents of a kind the one of the last run (by name)
    that can be read counts; :func:`metrics_runs` has them all.
    """
    kinds = ("sequence", "classifier", "arima")
    paths = paths or {k: f"{root}/{k}" for k in kinds}
    docs = {}
    for k in kinds:
        runs = read_metrics_runs(spark, paths[k], k) if paths.get(k) else None
        last = None if runs is None else runs.where(F.col("document").isNotNull()).agg(F.max_by("document", "run").alias("last"))
        docs[k] = None if last is None or last.where(F.col("last").isNull()).count() else last.select("last.*")
    cols = []
    for k, df in docs.items():
        cols.append(F.lit(df is not None).alias(f"{k}_available"))
    row = spark.range(1).select(*cols)
    for k, df in docs.items():
        if df is not None:
            row = row.crossJoin(F.broadcast(df.select(F.struct(*df.columns).alias(f"{k}_metrics"))))   # one row
        else:
            row = row.withColumn(f"{k}_metrics", F.lit(None).cast("string"))
    return row


def metrics_runs(spark: SparkSession, paths: dict) -> DataFrame:
    """Every metrics document: (kind, run, document as JSON, bad); ``bad`` is the text of one that can't be read."""
    out = spark.createDataFrame([], "kind string, run string, document string, bad string")
    for kind, path in sorted(paths.items()):
        runs = read_metrics_runs(spark, path, kind)
        if runs is not None:
            out = out.unionByName(runs.select(F.lit(kind).alias("kind"), "run", F.to_json("document").alias("document"), "bad"))
    return out
