"""ARIMA(2,1,2) backtest against a numpy brute force of the same two-stage fit."""

import datetime as dt

import numpy as np
import pytest

from smogcast.plans import forecast as fc


def brute(y, h=72, m=8, ridge=1e-9):
    train, test = y[:-h], y[-h:]
    d = np.diff(train)

    def ols(X, t):
        k = X.shape[1]
        xtx, xty = X.T @ X, X.T @ t
        scale = max(np.trace(xtx) / k, 1.0)
        return np.linalg.solve(xtx + ridge * scale * np.eye(k), xty)

    X1 = np.column_stack([d[m - i - 1:len(d) - i - 1] for i in range(m)])
    a = ols(X1, d[m:])
    e = np.full(len(d), np.nan)
    e[m:] = d[m:] - X1 @ a
    rows = [t for t in range(m + 2, len(d))]
    X2 = np.array([[d[t - 1], d[t - 2], e[t - 1], e[t - 2]] for t in rows])
    b = ols(X2, d[rows])
    p1, p2, t1, t2 = b
    assert abs(p2) < 1 and p1 + p2 < 1 and p2 - p1 < 1
    lev, d1, d2, e1, e2 = train[-1], d[-1], d[-2], e[-1], e[-2]
    preds = []
    for _ in range(h):
        nd = p1 * d1 + p2 * d2 + t1 * e1 + t2 * e2
        lev += nd
        preds.append(lev)
        d1, d2, e1, e2 = nd, d1, 0.0, e1
    preds = np.array(preds)
    return np.mean(np.abs(test - preds)), np.sqrt(np.mean((test - preds) ** 2)), preds[-1]


def test_arima_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 400
    x = np.zeros(n)
    eps = rng.normal(0, 5, n)
    for t in range(2, n):
        x[t] = 0.5 * x[t - 1] - 0.2 * x[t - 2] + eps[t] + 0.3 * eps[t - 1]
    y = 150 + np.cumsum(x) * 0.1 + x
    base = dt.date(2010, 1, 1)
    df = spark.createDataFrame([("Z", base + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)],
                               "city string, date date, aqi double")
    got = fc.backtest_arima(df).first()
    mae, rmse, last = brute(y)
    assert got.mae == pytest.approx(mae, rel=1e-6)
    assert got.rmse == pytest.approx(rmse, rel=1e-6)
    assert got.last_predicted == pytest.approx(last, rel=1e-6)
    assert got.holdout == 72 and got.last_actual == pytest.approx(y[-1])
