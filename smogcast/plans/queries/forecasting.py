"""Registered queries for sequences, splits, the pooled AR(1) model, recursive forecasts and
the prediction views (W4-W8, W10, A4, F15, M1-M5, A13, F25, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import forecast as fc
from .. import oracle as O
from ...functions import risk
from ...operators import sequences as sq
from ...operators import status as st
from ...operators import tables as tb
from ...sources import standin as si
from .registry import master, register
from .status import HYBRID_CTES, LATEST_SQL


# ------------------------------------------------------------------ W4-W8, W10, A4, F15


SEQ_CTES = [
    ("clean", "SELECT city, date, aqi FROM master WHERE aqi IS NOT NULL"),
    ("fit", "SELECT min(aqi) AS lo, max(aqi) AS hi FROM clean"),
    ("seq_all", "SELECT city, date, aqi AS label, "
                "list(aqi) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS lags, "
                "row_number() OVER (PARTITION BY city ORDER BY date) AS rn FROM clean"),
    ("seqs", "SELECT city, date, lags, label FROM seq_all WHERE rn > 30"),
    ("seq_pos", "SELECT *, row_number() OVER (ORDER BY city, date) - 1 AS gpos, count(*) OVER () AS n_all "
                "FROM seqs"),
    ("seq_split", "SELECT *, CASE WHEN gpos < floor(n_all * 0.8) THEN 'train' ELSE 'test' END AS part "
                  "FROM seq_pos"),
    ("scaled", "SELECT s.*, (s.label - f.lo) / CASE WHEN f.hi - f.lo = 0 THEN 1.0 ELSE f.hi - f.lo END AS label_s, "
               "(s.lags[30] - f.lo) / CASE WHEN f.hi - f.lo = 0 THEN 1.0 ELSE f.hi - f.lo END AS last_s "
               "FROM seq_split s, fit f"),
    ("model", "SELECT regr_intercept(label_s, last_s) AS intercept, regr_slope(label_s, last_s) AS slope "
              "FROM scaled WHERE part = 'train'"),
]


def seq_frame(spark, sf_dir):
    """Scaled sequences with lag arrays (for the multi-lag models)."""
    return fc.scaled_sequences(master(spark, sf_dir))


_AR1: dict = {}


def ar1_frame(spark, sf_dir):
    """Compact scaled sequences for AR(1) consumers, materialised once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _AR1:
        _AR1[key] = fc.scaled_sequences(master(spark, sf_dir), arrays=False)
    return _AR1[key]


@register("sequences", O.with_ctes(O.finish(
    "SELECT city, date, len(lags) AS n_lags, list_sum(lags) AS lag_sum, lags[1] AS lag_first, "
    "lags[len(lags)] AS lag_last, label FROM seqs", ["lag_sum", "lag_first", "lag_last", "label"], ["date"]),
    "master", extra=SEQ_CTES[:4]))
def q_sequences(spark, sf_dir):
    s = sq.sequences(master(spark, sf_dir), 30)
    return s.select("city", "date", F.size("lags").alias("n_lags"),
                    F.aggregate("lags", F.lit(0.0), lambda a, x: a + x).alias("lag_sum"),
                    F.element_at("lags", 1).alias("lag_first"), F.element_at("lags", -1).alias("lag_last"),
                    "label")


@register("position_split", O.with_ctes(O.finish(
    "SELECT city, date, gpos, part FROM seq_split", (), ["date"]), "master", extra=SEQ_CTES[:6]))
def q_position_split(spark, sf_dir):
    return sq.position_split(sq.sequences(master(spark, sf_dir), 30)).select("city", "date", "gpos", "part")


@register("time_split", O.with_ctes(O.finish(
    "SELECT city, date, CASE WHEN rk <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM ("
    "SELECT city, date, row_number() OVER (PARTITION BY city ORDER BY date) AS rk, "
    "count(*) OVER (PARTITION BY city) AS n FROM seqs)", (), ["date"]), "master", extra=SEQ_CTES[:4]))
def q_time_split(spark, sf_dir):
    return sq.time_split(sq.sequences(master(spark, sf_dir), 30)).select("city", "date", "part")


@register("validation_tail", O.with_ctes(O.finish(
    "SELECT city, date, gpos, CASE WHEN gpos < floor(n_t * 0.9) THEN 'fit' ELSE 'validation' END AS part FROM ("
    "SELECT city, date, row_number() OVER (ORDER BY city, date) - 1 AS gpos, count(*) OVER () AS n_t "
    "FROM seq_split WHERE part = 'train')", (), ["date"]), "master", extra=SEQ_CTES[:6]))
def q_validation_tail(spark, sf_dir):
    s = sq.position_split(sq.sequences(master(spark, sf_dir), 30))
    train = s.where(F.col("part") == "train").select("city", "date")
    return sq.validation_tail(train, 0.1).select("city", "date", "gpos", "part")


@register("holdout_split", O.with_ctes(O.finish(
    "SELECT city, date, aqi, pos, CASE WHEN pos > n - 72 THEN 'test' ELSE 'train' END AS part FROM ("
    "SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) AS pos, count(*) OVER (PARTITION BY city) AS n "
    "FROM clean)", ["aqi"], ["date"]), "master", extra=SEQ_CTES[:1]))
def q_holdout_split(spark, sf_dir):
    c = master(spark, sf_dir).where(F.col("aqi").isNotNull()).select("city", "date", "aqi")
    return sq.holdout_split(c, 72)


@register("differences", O.with_ctes(O.finish(
    "SELECT city, date, aqi, d, lag(d, 1) OVER w AS d_lag1, lag(d, 2) OVER w AS d_lag2 FROM ("
    "SELECT *, aqi - lag(aqi) OVER w AS d FROM clean WINDOW w AS (PARTITION BY city ORDER BY date)) "
    "WINDOW w AS (PARTITION BY city ORDER BY date)", ["aqi", "d", "d_lag1", "d_lag2"], ["date"]),
    "master", extra=SEQ_CTES[:1]))
def q_differences(spark, sf_dir):
    c = master(spark, sf_dir).where(F.col("aqi").isNotNull()).select("city", "date", "aqi")
    return sq.differences(c)


@register("minmax_scaled", O.with_ctes(O.finish(
    "SELECT c.city, c.date, c.aqi, f.lo, f.hi, (c.aqi - f.lo) / CASE WHEN f.hi - f.lo = 0 THEN 1.0 ELSE f.hi - f.lo END "
    "AS aqi_scaled, ((c.aqi - f.lo) / CASE WHEN f.hi - f.lo = 0 THEN 1.0 ELSE f.hi - f.lo END) * "
    "CASE WHEN f.hi - f.lo = 0 THEN 1.0 ELSE f.hi - f.lo END + f.lo AS aqi_back FROM clean c, fit f",
    ["aqi", "lo", "hi", "aqi_scaled", "aqi_back"], ["date"]), "master", extra=SEQ_CTES[:2]))
def q_minmax_scaled(spark, sf_dir):
    from ...functions.columns import minmax_inverse
    c = master(spark, sf_dir).where(F.col("aqi").isNotNull()).select("city", "date", "aqi")
    s = sq.scale_minmax(c, sq.fit_minmax(c))
    return s.withColumn("aqi_back", minmax_inverse("aqi_scaled", "lo", "hi"))


# ------------------------------------------------------------------ M1 / M5

@register("ar1_model", O.with_ctes(O.finish(
    "SELECT m.intercept, m.slope, f.lo, f.hi, (SELECT count(*) FROM scaled WHERE part = 'train') AS train_sequences "
    "FROM model m, fit f", ["intercept", "slope", "lo", "hi"]), "master", extra=SEQ_CTES))
def q_ar1_model(spark, sf_dir):
    s, fit = ar1_frame(spark, sf_dir)
    train = s.where(F.col("part") == "train")
    m = fc.fit_lag_model(train, "ar1").select("intercept", "slope")
    n = train.agg(F.count(F.lit(1)).alias("train_sequences"))
    return m.crossJoin(fit).crossJoin(n)


@register("forecaster_validation", O.with_ctes(O.finish(
    "SELECT avg((t.label_s - v.intercept - v.slope * t.last_s) * (t.label_s - v.intercept - v.slope * t.last_s)) "
    "AS best_val_loss, 1 AS epochs_ran FROM tail t, solved v WHERE t.tpos >= floor(t.n_t * 0.9)", ["best_val_loss"]),
    "master", extra=SEQ_CTES + [
        ("tail", "SELECT label_s, last_s, row_number() OVER (ORDER BY city, date) - 1 AS tpos, count(*) OVER () AS n_t "
                 "FROM scaled WHERE part = 'train'"),
        ("solved", "SELECT regr_intercept(label_s, last_s) AS intercept, regr_slope(label_s, last_s) AS slope "
                   "FROM tail WHERE tpos < floor(n_t * 0.9)")]))
def q_forecaster_validation(spark, sf_dir):
    s, _ = ar1_frame(spark, sf_dir)
    return fc.validation_loss(s.where(F.col("part") == "train"), "ar1")


UNSCALE_SQL = "({x}) * CASE WHEN f.hi - f.lo = 0 THEN 1.0 ELSE f.hi - f.lo END + f.lo"
SCALE_SQL = "(({x}) - f.lo) / CASE WHEN f.hi - f.lo = 0 THEN 1.0 ELSE f.hi - f.lo END"


@register("evaluate_ar1", O.with_ctes(O.finish(
    "SELECT avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse, "
    "(SELECT count(*) FROM scaled WHERE part = 'train') AS train_sequences, "
    "(SELECT count(*) FROM scaled WHERE part = 'test') AS test_sequences FROM ("
    "SELECT s.label AS actual, " + UNSCALE_SQL.format(x="m.intercept + m.slope * s.last_s") + " AS pred "
    "FROM scaled s, model m, fit f WHERE s.part = 'test')", ["mae", "rmse"]), "master", extra=SEQ_CTES))
def q_evaluate_ar1(spark, sf_dir):
    s, fit = ar1_frame(spark, sf_dir)
    m = fc.fit_lag_model(s.where(F.col("part") == "train"), "ar1")
    return fc.evaluate_lag_model(s, m, fit, last_only=True)


# ------------------------------------------------------------------ M2 / M3 / M4 / A13 / F25 / J8

def _unrolled_sql(seq_table: str, revert: bool) -> str:
    """3 steps of the AR(1) roll written out; with AR(1) only the newest value matters.

    Nested selects, so each step reads the previous one; ``base`` is the last
    observed value the reverted forecast is pulled toward.
    """
    sql = f"SELECT t.*, t.x0 AS base FROM {seq_table} t"
    for i in range(3):
        w = 0.15 * (i + 1)
        prevcol = "x0" if i == 0 else f"p{i - 1}"
        raw = UNSCALE_SQL.format(x="m.intercept + m.slope * " + SCALE_SQL.format(x=f"s.{prevcol}"))
        val = f"({raw}) * (1 - {w!r}) + s.base * {w!r}" if revert else f"({raw})"
        sql = f"SELECT s.*, {val} AS p{i} FROM ({sql}) s, model m, fit f"
    return sql


@register("forecast_roll", O.with_ctes(O.finish(
    "SELECT city, p0 AS step1, p1 AS step2, p2 AS step3 FROM (" + _unrolled_sql("roll_in", False) + ")",
    ["step1", "step2", "step3"]), "master", extra=SEQ_CTES + HYBRID_CTES[1:2] + [
        ("roll_in", "SELECT city, h[len(h)] AS x0 FROM hist30 WHERE n_hist >= 30")]))
def q_forecast_roll(spark, sf_dir):
    m = master(spark, sf_dir)
    s, fit = ar1_frame(spark, sf_dir)
    model = fc.fit_lag_model(s.where(F.col("part") == "train"), "ar1")
    seqs = st.history_sequence(m, 30).where(F.col("n_hist") >= 30).withColumnRenamed("h", "seq")
    r = fc.forecast_roll(seqs, model, fit, steps=3, revert=False)
    return r.select("city", *[F.col("preds")[i].alias(f"step{i + 1}") for i in range(3)])


@register("forecast_roll_72", O.with_ctes(O.finish(
    "SELECT city, " + ", ".join(
        f"({UNSCALE_SQL.format(x=f'm.intercept * (1 - pow(m.slope, {k})) / (1 - m.slope) + pow(m.slope, {k}) * ' + SCALE_SQL.format(x='r.x0'))}) AS step{k}"
        for k in (24, 48, 72)) + " FROM roll_in r, model m, fit f",
    ["step24", "step48", "step72"]), "master", extra=SEQ_CTES + HYBRID_CTES[1:2] + [
        ("roll_in", "SELECT city, h[len(h)] AS x0 FROM hist30 WHERE n_hist >= 30")]))
def q_forecast_roll_72(spark, sf_dir):
    """Q9: the dashboard's fallback rolls 72 daily steps (no reversion) and reads steps 24/48/72."""
    m = master(spark, sf_dir)
    s, fit = ar1_frame(spark, sf_dir)
    model = fc.fit_lag_model(s.where(F.col("part") == "train"), "ar1")
    seqs = st.history_sequence(m, 30).where(F.col("n_hist") >= 30).withColumnRenamed("h", "seq")
    r = fc.forecast_roll(seqs, model, fit, steps=72, revert=False)
    return r.select("city", *[F.col("preds")[k - 1].alias(f"step{k}") for k in (24, 48, 72)])


PREDICT_CTES = SEQ_CTES + [c for c in HYBRID_CTES] + [
    ("roll_in", "SELECT city, data_source, seq[30] AS x0 FROM hybrid WHERE seq IS NOT NULL"),
    ("predicted", "SELECT city, data_source, p0 AS raw_24, p1 AS raw_48, p2 AS raw_72 FROM ("
                  + _unrolled_sql("roll_in", True) + ")"),
    ("prediction", "SELECT city, data_source, round(raw_24, 2) AS pred_24h, round(raw_48, 2) AS pred_48h, "
                   "round(raw_72, 2) AS pred_72h, " + O.us_level("raw_24") + " AS risk_24h, "
                   + O.us_level("raw_48") + " AS risk_48h, " + O.us_level("raw_72") + " AS risk_72h FROM predicted"),
]


def prediction_frame(spark, sf_dir):
    m = master(spark, sf_dir)
    s, fit = ar1_frame(spark, sf_dir)
    model = fc.fit_lag_model(s.where(F.col("part") == "train"), "ar1")
    return fc.predict(si.live_rows(spark, sf_dir), m, model, fit)


@register("predict", O.with_ctes(O.finish("SELECT * FROM prediction", ["pred_24h", "pred_48h", "pred_72h"]),
                                 "master", "live", extra=PREDICT_CTES))
def q_predict(spark, sf_dir):
    return prediction_frame(spark, sf_dir)


@register("worst_horizon", O.with_ctes(O.finish(
    "SELECT city, CAST(h AS BIGINT) AS worst_hours, v AS worst_aqi, " + O.india("v") + " AS worst_risk, "
    + O.sql_lookup(O.india("v"), risk.RECOMMENDATIONS, O.q(risk.DEFAULT_RECOMMENDATION)) + " AS advice FROM ("
    "SELECT city, CASE WHEN pred_24h >= pred_48h AND pred_24h >= pred_72h THEN 24 "
    "WHEN pred_48h >= pred_72h THEN 48 ELSE 72 END AS h, "
    "CASE WHEN pred_24h >= pred_48h AND pred_24h >= pred_72h THEN pred_24h "
    "WHEN pred_48h >= pred_72h THEN pred_48h ELSE pred_72h END AS v FROM prediction)", ["worst_aqi"]),
    "master", "live", extra=PREDICT_CTES))
def q_worst_horizon(spark, sf_dir):
    p = prediction_frame(spark, sf_dir)
    h = st.worst_horizon(p)
    v = F.when(h == 24, F.col("pred_24h")).when(h == 48, F.col("pred_48h")).otherwise(F.col("pred_72h"))
    india = risk.risk_india(v)
    return p.select("city", h.alias("worst_hours"), v.alias("worst_aqi"), india.alias("worst_risk"),
                    risk.recommendation(india).alias("advice"))


@register("horizon_rows", O.with_ctes(O.finish(
    "SELECT city, data_source, horizon_hours, predicted_aqi, " + O.india("predicted_aqi") + " AS risk FROM ("
    "SELECT city, data_source, CAST(24 AS BIGINT) AS horizon_hours, pred_24h AS predicted_aqi FROM prediction UNION ALL "
    "SELECT city, data_source, 48, pred_48h FROM prediction UNION ALL "
    "SELECT city, data_source, 72, pred_72h FROM prediction)", ["predicted_aqi"]),
    "master", "live", extra=PREDICT_CTES))
def q_horizon_rows(spark, sf_dir):
    from ...operators.metrics import horizon_rows
    p = prediction_frame(spark, sf_dir).select("city", "data_source", "pred_24h", "pred_48h", "pred_72h")
    return horizon_rows(p)


@register("forecast_delta", O.with_ctes(O.finish(
    "SELECT p.city, p.pred_24h, coalesce(h.aqi, p.pred_24h) AS latest_aqi, "
    "p.pred_24h - coalesce(h.aqi, p.pred_24h) AS delta_24h FROM prediction p "
    "LEFT JOIN hist_latest h ON p.city = h.city", ["pred_24h", "latest_aqi", "delta_24h"]),
    "master", "live", extra=PREDICT_CTES + [("hist_latest", LATEST_SQL)]))
def q_forecast_delta(spark, sf_dir):
    p = prediction_frame(spark, sf_dir).select("city", "pred_24h")
    return st.forecast_delta(p, tb.latest_per_city(master(spark, sf_dir)))
