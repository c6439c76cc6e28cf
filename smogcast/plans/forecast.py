"""Forecasting as Spark jobs: SURVEY M1-M6.

* M1 one pooled next-day model over all cities' sequences.  The reference's
  neural network is re-aimed (it is a single-machine solver): ``ar1`` is a SQL
  regression on the last lag, ``linear30`` an MLlib linear regression on all 30
  lags, ``gbt30`` MLlib gradient-boosted trees.  Models are fitted on min-max
  scaled values, as the reference does.
* M2/M3 the recursive roll runs inside each row with ``aggregate`` over a
  struct accumulator: no job per step, no shuffle, no Python.
* M6 per-city ARIMA backtests: moment sums by ``groupBy(city)`` on executors,
  a tiny per-city linear solve written with higher-order functions, and a
  72-step roll in ``aggregate``: no Python anywhere in the row path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import blend, minmax, minmax_inverse, round2
from ..functions.risk import health_risk
from ..operators.sequences import (differences, fit_minmax, holdout_split, position_split,
                                   sequences, validation_tail)
from ..operators.status import hybrid_sequence, restrict_to
from ..operators.tables import top_cities
from ..session import reliable_checkpoint

SEQ_LEN = 30
MAX_REVERT_STEPS = 6   # beyond this the reversion weight passes 1 (Q8)


# ------------------------------------------------------------------ M1

def scaled_sequences(master: DataFrame, n: int = SEQ_LEN, arrays: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sequences with scaled lags/label and train/test part, one-row min-max fit).

    The scaler is fitted on every AQI value (all cities, as the reference),
    the split is positional over (city, date) (Q6).  With ``arrays=False``
    (AR(1) consumers) the lag arrays are never built and the compact result
    is materialised once, so fit, evaluation and counts read it instead of
    re-deriving windows and splits per branch.
    """
    clean = master.where(F.col("aqi").isNotNull())
    fit = fit_minmax(clean)
    seqs = position_split(sequences(clean, n))
    s = seqs.crossJoin(F.broadcast(fit))
    s = (s.withColumn("label_s", minmax("label", "lo", "hi"))
          .withColumn("last_s", minmax("prev", "lo", "hi")))
    if not arrays:
        s = reliable_checkpoint(s.select("city", "date", "gpos", "part", "prev", "label", "label_s", "last_s"))
        return s, reliable_checkpoint(fit)
    s = (s.withColumn("lags_s", F.transform("lags", lambda x: minmax(x, F.col("lo"), F.col("hi"))))
          .drop("lo", "hi"))
    return s, fit


def fit_lag_model(train: DataFrame, kind: str = "ar1", n: int = SEQ_LEN):
    """Fit the pooled next-day model on scaled training sequences.

    Returns a one-row DataFrame (intercept, coef ARRAY<DOUBLE>) for the linear
    kinds, or a fitted MLlib model for ``gbt30``: rounds of trees, stopped early by
    the loss on the validation tail (W8), which trains no tree.
    """
    if kind == "ar1":
        m = train.agg(F.regr_intercept("label_s", "last_s").alias("intercept"),
                      F.regr_slope("label_s", "last_s").alias("slope"))
        return m.select("intercept", F.concat(F.array_repeat(F.lit(0.0), n - 1),
                                              F.array(F.col("slope"))).alias("coef"), "slope")
    from pyspark.ml.functions import array_to_vector
    held = F.lit(False) if kind == "linear30" else F.col("part") == "validation"
    feats = (train if kind == "linear30" else validation_tail(train)).select(
        array_to_vector("lags_s").alias("features"), F.col("label_s").alias("label"), held.alias("held"))
    if kind == "linear30":
        from pyspark.ml.regression import LinearRegression
        lr = LinearRegression(featuresCol="features", labelCol="label", regParam=0.0,
                              elasticNetParam=0.0, standardization=False, solver="normal")
        model = lr.fit(feats)
        spark = train.sparkSession
        coef = [float(x) for x in model.coefficients.toArray()]
        return spark.createDataFrame([(float(model.intercept), coef, float(coef[-1]))],
                                     "intercept DOUBLE, coef ARRAY<DOUBLE>, slope DOUBLE")
    if kind == "gbt30":
        from pyspark.ml.regression import GBTRegressor
        return GBTRegressor(featuresCol="features", labelCol="label", maxIter=50, maxDepth=5,
                            seed=42, validationIndicatorCol="held").fit(feats)
    raise ValueError(f"unknown model kind {kind!r}")


def validation_loss(train: DataFrame, kind: str = "ar1", model=None, n: int = SEQ_LEN) -> DataFrame:
    """One row (best_val_loss, epochs_ran): mean squared scaled error on the validation tail.

    The linear kinds are solved in one round, here from the rows before the tail.
    ``gbt30`` takes its fitted ``model``: the lowest loss after any round, and the
    rounds that early stopping kept.  Without validation rows the loss is NULL.
    """
    parts = validation_tail(train)
    held = parts.where(F.col("part") == "validation")
    if kind == "gbt30":
        from pyspark.ml.functions import array_to_vector
        rows = held.select(array_to_vector("lags_s").alias("features"), F.col("label_s").alias("label"))
        losses = [] if rows.isEmpty() else model.evaluateEachIteration(rows, "squared")
        return train.sparkSession.createDataFrame(
            [(min(map(float, losses), default=None), model.getNumTrees)], "best_val_loss DOUBLE, epochs_ran INT")
    solved = fit_lag_model(parts.where(F.col("part") == "fit"), kind, n)
    scored = held.crossJoin(F.broadcast(solved.select("intercept", "coef", "slope")))
    guess = F.col("intercept") + F.col("slope") * F.col("last_s") if kind == "ar1" else \
        lag_predict(F.col("lags_s"), F.col("intercept"), F.col("coef"))
    return scored.agg(F.avg((F.col("label_s") - guess) * (F.col("label_s") - guess)).alias("best_val_loss"),
                      F.lit(1).alias("epochs_ran"))


def lag_predict(seq: Column, intercept: Column, coef: Column) -> Column:
    """Linear model on an array: ``intercept + Σ coef_i * seq_i``."""
    return intercept + F.aggregate(F.zip_with(coef, seq, lambda a, b: a * b), F.lit(0.0),
                                   lambda acc, x: acc + x)


# ------------------------------------------------------------------ M2 / M3

def forecast_roll(df: DataFrame, model: DataFrame, fit: DataFrame, steps: int = 3,
                  revert: bool = True, seq: str = "seq", out: str = "preds") -> DataFrame:
    """M2 (``revert=False``) / M3: recursive forecast of ``steps`` days per row.

    Each step scales the window, applies the model, unscales, and (M3) blends
    toward the last observed value with weight 0.15*(i+1) before feeding the
    value back: drop the oldest, append the new one.
    """
    if revert and steps > MAX_REVERT_STEPS:
        raise ValueError(f"reversion is defined for at most {MAX_REVERT_STEPS} steps")
    side = model.select("intercept", "coef").crossJoin(fit.select("lo", "hi"))
    d = df.crossJoin(F.broadcast(side))   # one row: proven-size broadcast
    lo, hi = F.col("lo"), F.col("hi")
    base = F.element_at(F.col(seq), -1)

    def step(acc, i):
        scaled = F.transform(acc["seq"], lambda x: minmax(x, lo, hi))
        raw = minmax_inverse(lag_predict(scaled, F.col("intercept"), F.col("coef")), lo, hi)
        p = blend(raw, base, i) if revert else raw
        nxt = F.concat(F.slice(acc["seq"], 2, F.size(acc["seq"]) - 1), F.array(p))
        return F.struct(nxt.alias("seq"), F.concat(acc["preds"], F.array(p)).alias("preds"))

    init = F.struct(F.col(seq).alias("seq"), F.array().cast("array<double>").alias("preds"))
    rolled = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), init, step, lambda acc: acc["preds"])
    return d.withColumn(out, rolled).drop("intercept", "coef", "lo", "hi")


def forecast_roll_gbt(df: DataFrame, model, fit: DataFrame, steps: int = 3, revert: bool = True,
                      seq: str = "seq") -> DataFrame:
    """M2/M3 for a tree model: ``steps`` successive ``transform`` calls in one lazy plan."""
    from pyspark.ml.functions import array_to_vector
    d = df.crossJoin(F.broadcast(fit.select("lo", "hi"))).withColumn("_cur", F.col(seq)) \
          .withColumn("preds", F.array().cast("array<double>"))
    base = F.element_at(F.col(seq), -1)
    for i in range(steps):
        d = d.withColumn("features", array_to_vector(
            F.transform("_cur", lambda x: minmax(x, F.col("lo"), F.col("hi")))))
        d = model.transform(d)
        raw = minmax_inverse(F.col("prediction"), "lo", "hi")
        p = blend(raw, base, i) if revert else raw
        d = (d.withColumn("_p", p).drop("prediction", "features")
              .withColumn("_cur", F.concat(F.slice("_cur", 2, F.size("_cur") - 1), F.array("_p")))
              .withColumn("preds", F.concat("preds", F.array("_p"))).drop("_p"))
    return d.drop("_cur", "lo", "hi")


# ------------------------------------------------------------------ M4 / M5

def predict_raw(live: DataFrame, master: DataFrame, model: DataFrame, fit: DataFrame,
                n: int = SEQ_LEN) -> DataFrame:
    """M4 before rounding: (city, data_source, raw_24, raw_48, raw_72)."""
    seqs = hybrid_sequence(live, master, n)
    rolled = forecast_roll(seqs, model, fit, steps=3, revert=True)
    return rolled.select("city", "data_source",
                         *[F.col("preds")[i].alias(f"raw_{h}") for i, h in enumerate((24, 48, 72))])


def predict_document(live: DataFrame, master: DataFrame, model: DataFrame, fit: DataFrame) -> DataFrame:
    """M4 as the reference's response document per city (F26), plus its JSON text."""
    from ..functions.columns import predictions_struct
    raw = predict_raw(live, master, model, fit)
    doc = raw.select("city", F.lit("LIVE").alias("status"), "data_source",
                     round2("raw_24").alias("predicted_aqi_tomorrow"),
                     health_risk("raw_24").alias("health_risk"),
                     predictions_struct("raw_24", "raw_48", "raw_72").alias("predictions"))
    return doc.withColumn("json", F.to_json(F.struct(*[c for c in doc.columns if c != "city"])))


def predict(live: DataFrame, master: DataFrame, model: DataFrame, fit: DataFrame,
            n: int = SEQ_LEN) -> DataFrame:
    """M4: hybrid sequence -> 3 reverted daily steps -> rounded forecasts with risk, per city."""
    out = predict_raw(live, master, model, fit, n)
    return out.select("city", "data_source",
                      *[round2(f"raw_{h}").alias(f"pred_{h}h") for h in (24, 48, 72)],
                      *[health_risk(f"raw_{h}")["level"].alias(f"risk_{h}h") for h in (24, 48, 72)])


def predict_gbt(live: DataFrame, master: DataFrame, model, fit: DataFrame, n: int = SEQ_LEN) -> DataFrame:
    """M4 with the tree model (``gbt30``): same hybrid input, reversion and output as :func:`predict`."""
    seqs = hybrid_sequence(live, master, n)
    rolled = forecast_roll_gbt(seqs, model, fit, steps=3, revert=True)
    out = rolled.select("city", "data_source",
                        *[F.col("preds")[i].alias(f"raw_{h}") for i, h in enumerate((24, 48, 72))])
    return out.select("city", "data_source",
                      *[round2(f"raw_{h}").alias(f"pred_{h}h") for h in (24, 48, 72)],
                      *[health_risk(f"raw_{h}")["level"].alias(f"risk_{h}h") for h in (24, 48, 72)])


def evaluate_gbt_model(seqs_scaled: DataFrame, model, fit: DataFrame) -> DataFrame:
    """M5 for the tree model: score the test part, unscale, MAE / RMSE with counts."""
    from pyspark.ml.functions import array_to_vector
    test = (seqs_scaled.where(F.col("part") == "test")
            .withColumn("features", array_to_vector("lags_s")))
    scored = model.transform(test).crossJoin(F.broadcast(fit.select("lo", "hi")))
    pred = minmax_inverse(F.col("prediction"), "lo", "hi")
    err = F.col("label") - pred
    metrics = scored.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    counts = seqs_scaled.agg(F.sum(F.when(F.col("part") == "train", 1).otherwise(0)).alias("train_sequences"),
                             F.sum(F.when(F.col("part") == "test", 1).otherwise(0)).alias("test_sequences"))
    return metrics.crossJoin(counts)


def evaluate_lag_model(seqs_scaled: DataFrame, model: DataFrame, fit: DataFrame,
                       last_only: bool = False) -> DataFrame:
    """M5: predictions on the test part, unscaled, scored (MAE / RMSE) with counts.

    ``last_only`` (AR(1) models) reads only the newest lag, so the lag arrays
    are never built.
    """
    side = model.select("intercept", "coef", "slope").crossJoin(fit)
    d = seqs_scaled.crossJoin(F.broadcast(side))
    scaled = (F.col("intercept") + F.col("slope") * F.col("last_s")) if last_only else \
        lag_predict(F.col("lags_s"), F.col("intercept"), F.col("coef"))
    pred = minmax_inverse(scaled, "lo", "hi")
    test = d.where(F.col("part") == "test").select("city", F.col("label").alias("actual"),
                                                 pred.alias("pred"))
    err = F.col("actual") - F.col("pred")
    scored = test.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    counts = seqs_scaled.agg(F.sum(F.when(F.col("part") == "train", 1).otherwise(0)).alias("train_sequences"),
                             F.sum(F.when(F.col("part") == "test", 1).otherwise(0)).alias("test_sequences"))
    return scored.crossJoin(counts)


# ------------------------------------------------------------------ M6

def backtest_frame(master: DataFrame, holdout: int = 72, min_train: int = 40, top_k: int = 8) -> DataFrame:
    """Series of the ``top_k`` cities with most AQI rows that have ``holdout + min_train`` rows.

    Columns: city, date, aqi, pos (1-based), part (train/test), n_train.
    """
    s = master.where(F.col("aqi").isNotNull())
    s = restrict_to(s, top_cities(s, top_k))
    s = holdout_split(s, holdout)
    cnt = Window.partitionBy("city")
    s = s.withColumn("_n", F.count(F.lit(1)).over(cnt)).where(F.col("_n") >= holdout + min_train)
    return s.withColumn("n_train", F.col("_n") - holdout).drop("_n")


def spd_solve(xtx: Column, xty: Column, k: int, ridge: float = 1e-9) -> Column:
    """Solve ``(XᵀX + ridge·s·I) b = Xᵀy`` per row, JVM-side, from flattened moments.

    Gauss-Jordan elimination written with higher-order functions: the
    augmented k×(k+1) matrix is an array of rows; step ``c`` subtracts
    ``row[c] / pivot`` times the pivot row from every other row.  The matrix is
    symmetric positive definite after the ridge term (``s`` = max(mean
    diagonal, 1)), so no pivoting is needed and no pivot is zero.
    """
    diag_mean = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0),
                            lambda acc, i: acc + F.element_at(xtx, i * (k + 1) + 1)) / F.lit(float(k))
    eps = F.lit(ridge) * F.greatest(diag_mean, F.lit(1.0))
    rows = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                    lambda j: F.element_at(xtx, i * k + j + 1) + F.when(i == j, eps).otherwise(F.lit(0.0))),
        F.array(F.element_at(xty, i + 1))))

    def step(m, c):
        pivot_row = F.element_at(m, c + 1)
        pivot = F.element_at(pivot_row, c + 1)
        return F.transform(m, lambda row, r: F.when(r == c, row).otherwise(
            F.zip_with(row, pivot_row, lambda a, p: a - F.element_at(row, c + 1) / pivot * p)))

    reduced = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), rows, step)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.element_at(F.element_at(reduced, i + 1), k + 1)
                       / F.element_at(F.element_at(reduced, i + 1), i + 1))


def _moments(df: DataFrame, xs: list[str], y: str, key: str = "city") -> DataFrame:
    """Per-key XᵀX (flattened, row-major) and Xᵀy as arrays: one aggregation."""
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"_xx_{i}_{j}") for i, a in enumerate(xs)
            for j, b in enumerate(xs)]
    aggs += [F.sum(F.col(a) * F.col(y)).alias(f"_xy_{i}") for i, a in enumerate(xs)]
    m = df.groupBy(key).agg(*aggs)
    k = len(xs)
    return m.select(key, F.array(*[F.col(f"_xx_{i}_{j}") for i in range(k) for j in range(k)]).alias("xtx"),
                    F.array(*[F.col(f"_xy_{i}") for i in range(k)]).alias("xty"))


def _arma_roll(h: int) -> Column:
    """Levels of an ARIMA(p,1,q) forecast, p,q ≤ 2, future shocks 0, from row params.

    Needs columns phi1, phi2, theta1, theta2, y_last, d1, d2 (last two diffs,
    newest first) and e1, e2 (last two residuals).
    """
    def step(acc, _i):
        d = (F.col("phi1") * acc["d1"] + F.col("phi2") * acc["d2"]
             + F.col("theta1") * acc["e1"] + F.col("theta2") * acc["e2"])
        y = acc["y"] + d
        return F.struct(y.alias("y"), d.alias("d1"), acc["d1"].alias("d2"),
                        F.lit(0.0).alias("e1"), acc["e1"].alias("e2"),
                        F.concat(acc["levels"], F.array(y)).alias("levels"))
    init = F.struct(F.col("y_last").alias("y"), F.col("d1").alias("d1"), F.col("d2").alias("d2"),
                    F.col("e1").alias("e1"), F.col("e2").alias("e2"),
                    F.array().cast("array<double>").alias("levels"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(h)), init, step, lambda acc: acc["levels"])


def _positions(frame: DataFrame, params: DataFrame, holdout: int) -> DataFrame:
    """Roll each city's forecast and align it with the holdout by position."""
    from ..operators.status import prediction_actuals
    fc = params.withColumn("levels", _arma_roll(holdout))
    preds = fc.select("city", F.posexplode("levels").alias("k", "pred"), "n_train") \
              .select("city", (F.col("k") + F.col("n_train") + 1).alias("pos"), "pred")
    test = frame.where(F.col("part") == "test").select("city", "pos", F.col("aqi").alias("actual"))
    return prediction_actuals(test, preds)


def _score(frame: DataFrame, params: DataFrame, holdout: int) -> DataFrame:
    """Score the aligned forecasts per city (A5 + W7)."""
    from ..operators.metrics import error_aggs
    from ..operators.sequences import last_pair_aggs
    j = _positions(frame, params, holdout)
    # A5 and W7 composed into one aggregation per city
    return (j.groupBy("city").agg(*error_aggs(), *last_pair_aggs())
             .withColumnRenamed("n", "holdout"))


def _train_state(frame: DataFrame) -> DataFrame:
    """Per city: last level and last two differences of the training part."""
    d = differences(frame.where(F.col("part") == "train"))
    return d.groupBy("city").agg(F.max_by("aqi", "pos").alias("y_last"),
                                 F.max_by("d", "pos").alias("d1"),
                                 F.coalesce(F.max_by("d_lag1", "pos"), F.lit(0.0)).alias("d2"),
                                 F.first("n_train").alias("n_train")), d


def _ar1_params(frame: DataFrame) -> DataFrame:
    state, d = _train_state(frame)
    phi = d.where(F.col("d_lag1").isNotNull()).groupBy("city").agg(
        F.try_divide(F.sum(F.col("d") * F.col("d_lag1")), F.sum(F.col("d_lag1") * F.col("d_lag1"))).alias("phi1"))
    return (state.join(phi, "city")
            .withColumn("phi1", F.coalesce(F.col("phi1"), F.lit(0.0)))
            .withColumn("phi2", F.lit(0.0)).withColumn("theta1", F.lit(0.0))
            .withColumn("theta2", F.lit(0.0)).withColumn("e1", F.lit(0.0)).withColumn("e2", F.lit(0.0)))


def backtest_predictions(master: DataFrame, holdout: int = 72, min_train: int = 40, top_k: int = 8) -> DataFrame:
    """M6 (1,1,0) forecasts aligned with the actual holdout values: (city, pos, actual, pred)."""
    frame = backtest_frame(master, holdout, min_train, top_k)
    return _positions(frame, _ar1_params(frame), holdout)


def backtest_ar1(master: DataFrame, holdout: int = 72, min_train: int = 40, top_k: int = 8) -> DataFrame:
    """M6 with order (1,1,0): AR(1) on differences without constant, by least squares."""
    frame = backtest_frame(master, holdout, min_train, top_k)
    return _score(frame, _ar1_params(frame), holdout)


def backtest_arima(master: DataFrame, holdout: int = 72, min_train: int = 40, top_k: int = 8,
                   long_ar: int = 8) -> DataFrame:
    """M6 with order (2,1,2) by two-stage regression (Hannan-Rissanen), no constant.

    Stage 1: AR(``long_ar``) on the differences -> residuals.  Stage 2: regress
    d_t on d_{t-1}, d_{t-2}, e_{t-1}, e_{t-2}.  Both stages are per-city moment
    sums (``groupBy``) plus a ≤ 8×8 solve per city, done JVM-side (:func:`spd_solve`).  A non-stationary AR part
    falls back to the (1,1,0) fit.  Numbers differ from maximum likelihood.
    """
    # The frame (top_k cities, calendar-bounded) and the residuals feed several
    # branches (state, two regressions, fallback, last shocks): materialise
    # each once instead of re-deriving it per branch.
    frame = reliable_checkpoint(backtest_frame(master, holdout, min_train, top_k))
    state, d = _train_state(frame)
    w = Window.partitionBy("city").orderBy("pos")
    lagc = [f"_l{i}" for i in range(1, long_ar + 1)]
    dl = d.where(F.col("d").isNotNull())
    for i, c in enumerate(lagc, start=1):
        dl = dl.withColumn(c, F.lag("d", i).over(w))
    full = dl.where(F.col(lagc[-1]).isNotNull())
    a = _moments(full, lagc, "d").withColumn("a", spd_solve(F.col("xtx"), F.col("xty"), long_ar)).select("city", "a")
    res = dl.join(a, "city").withColumn(
        "e", F.col("d") - sum((F.col("a")[i] * F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(lagc)),
                              F.lit(0.0)))
    res = res.withColumn("e", F.when(F.col(lagc[-1]).isNotNull(), F.col("e")))
    res = reliable_checkpoint(
        res.withColumn("e_lag1", F.lag("e", 1).over(w)).withColumn("e_lag2", F.lag("e", 2).over(w))
           .withColumn("d_l1", F.lag("d", 1).over(w)).withColumn("d_l2", F.lag("d", 2).over(w)))
    x2 = ["d_l1", "d_l2", "e_lag1", "e_lag2"]
    stage2 = res.where(F.col("e_lag2").isNotNull() & F.col("d_l2").isNotNull())
    b = _moments(stage2, x2, "d").withColumn("b", spd_solve(F.col("xtx"), F.col("xty"), 4)).select("city", "b")
    ar1 = (d.where(F.col("d_lag1").isNotNull()).groupBy("city")
             .agg(F.try_divide(F.sum(F.col("d") * F.col("d_lag1")),
                               F.sum(F.col("d_lag1") * F.col("d_lag1"))).alias("_phi")))
    last_e = res.groupBy("city").agg(F.coalesce(F.max_by("e", "pos"), F.lit(0.0)).alias("e1"),
                                     F.coalesce(F.max_by("e_lag1", "pos"), F.lit(0.0)).alias("e2"))
    p1, p2 = F.col("b")[0], F.col("b")[1]
    stationary = (F.abs(p2) < 1) & (p1 + p2 < 1) & (p2 - p1 < 1)
    params = (state.join(b, "city", "left").join(ar1, "city", "left").join(last_e, "city", "left")
              .withColumn("ok", F.col("b").isNotNull() & stationary)
              .withColumn("phi1", F.when(F.col("ok"), p1).otherwise(F.coalesce(F.col("_phi"), F.lit(0.0))))
              .withColumn("phi2", F.when(F.col("ok"), p2).otherwise(F.lit(0.0)))
              .withColumn("theta1", F.when(F.col("ok"), F.col("b")[2]).otherwise(F.lit(0.0)))
              .withColumn("theta2", F.when(F.col("ok"), F.col("b")[3]).otherwise(F.lit(0.0)))
              .withColumn("e1", F.when(F.col("ok"), F.col("e1")).otherwise(F.lit(0.0)))
              .withColumn("e2", F.when(F.col("ok"), F.col("e2")).otherwise(F.lit(0.0))))
    return _score(frame, params, holdout)
