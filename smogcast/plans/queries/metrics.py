"""Registered queries for classification and error metrics and the AR backtests
(A5-A9, A14, M6, W7, J10, J12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as _W
from pyspark.sql import functions as F

from .. import forecast as fc
from .. import oracle as O
from ...functions import risk
from ...operators import metrics as mt
from ...operators import status as st
from .registry import master, register
from .forecasting import SEQ_CTES, UNSCALE_SQL, ar1_frame


# ------------------------------------------------------------------ A5-A9, A14 on a stand-in predictor



def persistence(spark, sf_dir, lag: int = 1) -> DataFrame:
    """Stand-in classifier output: label = 4-class risk of today's AQI,
    prediction = 4-class risk of the AQI ``lag`` rows earlier (a persistence model)."""
    c = master(spark, sf_dir).where(F.col("aqi").isNotNull()).select("city", "date", "aqi")
    w = _W.partitionBy("city").orderBy("date")
    prev = F.lag("aqi", lag).over(w)
    return (c.withColumn("prev_aqi", prev).where(F.col("prev_aqi").isNotNull())
             .select("city", "date", F.col("aqi").alias("actual"), F.col("prev_aqi").alias("pred"),
                     risk.risk_bucket4("aqi").alias("label"), risk.risk_bucket4("prev_aqi").alias("prediction")))


def _persist_sql(lag):
    return ("SELECT city, date, aqi AS actual, prev_aqi AS pred, " + O.bucket4("aqi") + " AS label, "
            + O.bucket4("prev_aqi") + " AS prediction FROM (SELECT city, date, aqi, "
            f"lag(aqi, {lag}) OVER (PARTITION BY city ORDER BY date) AS prev_aqi FROM master "
            "WHERE aqi IS NOT NULL) WHERE prev_aqi IS NOT NULL")


CONF_SQL = "SELECT label, prediction, count(*) AS n FROM p1 GROUP BY label, prediction"
REPORT_SQL = (
    "SELECT cls AS class, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, "
    "coalesce(tp / nullif(support, 0), 0.0) AS recall, "
    "coalesce(2 * (coalesce(tp / nullif(predicted, 0), 0.0) * coalesce(tp / nullif(support, 0), 0.0)) / "
    "nullif(coalesce(tp / nullif(predicted, 0), 0.0) + coalesce(tp / nullif(support, 0), 0.0), 0), 0.0) AS f1, "
    "CAST(support AS BIGINT) AS support FROM ("
    "SELECT c.cls, CAST(coalesce(s.support, 0) AS DOUBLE) AS support, CAST(coalesce(p.predicted, 0) AS DOUBLE) AS predicted, "
    "CAST(coalesce(t.tp, 0) AS DOUBLE) AS tp FROM "
    "(SELECT label AS cls FROM conf UNION SELECT prediction FROM conf) c "
    "LEFT JOIN (SELECT label AS cls, sum(n) AS support FROM conf GROUP BY label) s ON c.cls = s.cls "
    "LEFT JOIN (SELECT prediction AS cls, sum(n) AS predicted FROM conf GROUP BY prediction) p ON c.cls = p.cls "
    "LEFT JOIN (SELECT label AS cls, sum(n) AS tp FROM conf WHERE label = prediction GROUP BY label) t "
    "ON c.cls = t.cls)")
OVERALL_SQL = (
    "SELECT sum(recall * support) / sum(support) AS accuracy, avg(precision) AS macro_precision, "
    "avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(precision * support) / sum(support) AS weighted_precision, "
    "sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1, "
    "CAST(sum(support) AS BIGINT) AS support FROM report")
METRIC_CTES = [("p1", _persist_sql(1)), ("conf", CONF_SQL), ("report", REPORT_SQL)]


@register("confusion", O.with_ctes("SELECT * FROM conf", "master", extra=METRIC_CTES[:2]))
def q_confusion(spark, sf_dir):
    return mt.confusion(persistence(spark, sf_dir, 1))


@register("class_report", O.with_ctes(O.finish("SELECT * FROM report", ["precision", "recall", "f1"]),
                                      "master", extra=METRIC_CTES))
def q_class_report(spark, sf_dir):
    return mt.class_report(mt.confusion(persistence(spark, sf_dir, 1)))


@register("overall_report", O.with_ctes(O.finish(OVERALL_SQL, [
    "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall",
    "weighted_f1"]), "master", extra=METRIC_CTES))
def q_overall_report(spark, sf_dir):
    return mt.overall_report(mt.class_report(mt.confusion(persistence(spark, sf_dir, 1))))


def _model_scores_sql():
    parts = []
    for order, lag in enumerate((1, 7)):
        ctes = (f"WITH p AS ({_persist_sql(lag)}), conf AS ({CONF_SQL.replace('p1', 'p')}), "
                f"report AS ({REPORT_SQL}) ")
        parts.append(f"SELECT 'persistence_{lag}d' AS model, {order} AS ord, * FROM ({ctes}{OVERALL_SQL})")
    return " UNION ALL ".join(f"({p})" for p in parts)


@register("select_best", O.with_ctes(O.finish(
    "SELECT arg_max(model, weighted_f1 * 1e12 - ord) AS selected_model, max(weighted_f1) AS selected_score "
    f"FROM ({_model_scores_sql()})", ["selected_score"]), "master"))
def q_select_best(spark, sf_dir):
    scores = None
    for order, lag in enumerate((1, 7)):
        ov = mt.overall_report(mt.class_report(mt.confusion(persistence(spark, sf_dir, lag))))
        one = ov.select(F.lit(f"persistence_{lag}d").alias("model"), F.lit(order).alias("ord"),
                        F.col("weighted_f1").alias("f1_weighted"))
        scores = one if scores is None else scores.unionByName(one)
    return mt.select_best(scores)


@register("error_metrics", O.with_ctes(O.finish(
    "SELECT city, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse, "
    "count(*) AS n FROM p1 GROUP BY city", ["mae", "rmse"]), "master", extra=METRIC_CTES[:1]))
def q_error_metrics(spark, sf_dir):
    return mt.error_metrics(persistence(spark, sf_dir, 1), by=["city"])


@register("summarise_metrics", O.with_ctes(O.finish(
    "SELECT avg(mae) AS mae_mean, avg(rmse) AS rmse_mean, median(mae) AS mae_median, median(rmse) AS rmse_median, "
    "count(*) AS cities_trained FROM (SELECT city, avg(abs(actual - pred)) AS mae, "
    "sqrt(avg((actual - pred) * (actual - pred))) AS rmse FROM p1 GROUP BY city)",
    ["mae_mean", "rmse_mean", "mae_median", "rmse_median"]), "master", extra=METRIC_CTES[:1]))
def q_summarise_metrics(spark, sf_dir):
    return mt.summarise_metrics(mt.error_metrics(persistence(spark, sf_dir, 1), by=["city"]))


# ------------------------------------------------------------------ M6 (1,1,0), W7, J12, J10

BT_CTES = [
    ("bt_clean", "SELECT city, date, aqi FROM master WHERE aqi IS NOT NULL"),
    ("bt_top", "SELECT city FROM bt_clean GROUP BY city ORDER BY count(*) DESC, city LIMIT 8"),
    ("bt", "SELECT *, n - 72 AS n_train FROM (SELECT c.*, row_number() OVER (PARTITION BY c.city ORDER BY date) AS pos, "
           "count(*) OVER (PARTITION BY c.city) AS n FROM bt_clean c WHERE city IN (SELECT city FROM bt_top)) "
           "WHERE n >= 112"),
    ("bt_tr", "SELECT *, lag(d) OVER (PARTITION BY city ORDER BY pos) AS d_lag1 FROM ("
              "SELECT *, aqi - lag(aqi) OVER (PARTITION BY city ORDER BY pos) AS d FROM bt WHERE pos <= n_train)"),
    ("bt_par", "SELECT city, coalesce(sum(d * d_lag1) / sum(d_lag1 * d_lag1), 0.0) AS phi, arg_max(aqi, pos) AS y_last, "
               "arg_max(d, pos) AS d_last FROM bt_tr GROUP BY city"),
    ("bt_pred", "SELECT b.city, b.pos, b.aqi AS actual, p.y_last + p.d_last * CASE WHEN p.phi = 1 THEN (b.pos - b.n_train) "
                "ELSE p.phi * (1 - pow(p.phi, b.pos - b.n_train)) / (1 - p.phi) END AS pred "
                "FROM bt b JOIN bt_par p ON b.city = p.city WHERE b.pos > b.n_train"),
    ("bt_city", "SELECT city, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse, "
                "count(*) AS holdout, arg_max(actual, pos) AS last_actual, arg_max(pred, pos) AS last_predicted "
                "FROM bt_pred GROUP BY city"),
]


@register("backtest_ar1", O.with_ctes(O.finish("SELECT * FROM bt_city", ["mae", "rmse", "last_actual",
                                                                        "last_predicted"]),
                                      "master", extra=BT_CTES))
def q_backtest_ar1(spark, sf_dir):
    return fc.backtest_ar1(master(spark, sf_dir))


@register("backtest_predictions", O.with_ctes(O.finish("SELECT * FROM bt_pred", ["actual", "pred"]),
                                              "master", extra=BT_CTES))
def q_backtest_predictions(spark, sf_dir):
    return fc.backtest_predictions(master(spark, sf_dir))


@register("backtest_summary", O.with_ctes(O.finish(
    "SELECT avg(mae) AS mae_mean, avg(rmse) AS rmse_mean, median(mae) AS mae_median, median(rmse) AS rmse_median, "
    "count(*) AS cities_trained FROM bt_city", ["mae_mean", "rmse_mean", "mae_median", "rmse_median"]),
    "master", extra=BT_CTES))
def q_backtest_summary(spark, sf_dir):
    return mt.summarise_metrics(fc.backtest_ar1(master(spark, sf_dir)))


@register("compare_models", O.with_ctes(O.finish(
    "SELECT a.metric, a.value AS seq_model, b.value AS baseline, (b.value - a.value) / b.value * 100.0 AS improvement_pct "
    "FROM (SELECT 'mae' AS metric, mae AS value FROM ev UNION ALL SELECT 'rmse', rmse FROM ev) a JOIN "
    "(SELECT 'mae' AS metric, avg(mae) AS value FROM bt_city UNION ALL SELECT 'rmse', avg(rmse) FROM bt_city) b "
    "ON a.metric = b.metric", ["seq_model", "baseline", "improvement_pct"]), "master",
    extra=SEQ_CTES + BT_CTES + [("ev", "SELECT avg(abs(actual - pred)) AS mae, "
                                       "sqrt(avg((actual - pred) * (actual - pred))) AS rmse FROM ("
                                       "SELECT s.label AS actual, " + UNSCALE_SQL.format(x="m.intercept + m.slope * s.last_s")
                                       + " AS pred FROM scaled s, model m, fit f WHERE s.part = 'test')")]))
def q_compare_models(spark, sf_dir):
    s, fit = ar1_frame(spark, sf_dir)
    ev = fc.evaluate_lag_model(s, fc.fit_lag_model(s.where(F.col("part") == "train"), "ar1"), fit, last_only=True)
    a = ev.select(F.explode(F.array(F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")),
                                    F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value")))).alias("m")
                  ).select("m.*")
    sm = mt.summarise_metrics(fc.backtest_ar1(master(spark, sf_dir)))
    b = sm.select(F.explode(F.array(F.struct(F.lit("mae").alias("metric"), F.col("mae_mean").alias("value")),
                                    F.struct(F.lit("rmse").alias("metric"), F.col("rmse_mean").alias("value")))).alias("m")
                  ).select("m.*")
    return st.compare_models(a, b, "seq_model", "baseline")


@register("backtest_arima")
def q_backtest_arima(spark, sf_dir):
    return fc.backtest_arima(master(spark, sf_dir))
