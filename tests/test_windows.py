"""Windows, splits, forecasts on hand-made series (FIXTURES §3)."""

import datetime as dt

from pyspark.sql import functions as F

from smogcast.operators import sequences as sq
from smogcast.operators import status as st
from smogcast.plans import forecast as fc


def series(spark, lengths, value=None):
    rows = []
    base = dt.date(2020, 1, 1)
    for city, n in lengths.items():
        for i in range(n):
            rows.append((city, base + dt.timedelta(days=i), float(value if value is not None else i + 1)))
    return spark.createDataFrame(rows, "city string, date date, aqi double")


def test_sequences_counts_and_order(spark):
    df = series(spark, {"a": 30, "b": 31, "c": 35})
    s = sq.sequences(df, 30)
    counts = {r.city: r.n for r in s.groupBy("city").agg(F.count("*").alias("n")).collect()}
    assert counts == {"b": 1, "c": 5}
    first = s.where("city = 'c'").orderBy("date").first()
    assert first.lags == [float(i) for i in range(1, 31)] and first.label == 31.0


def test_position_split_sizes(spark):
    df = series(spark, {"a": 5, "b": 6})
    parts = {r.part: r.n for r in sq.position_split(df, 0.8).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 8, "test": 3}
    tr = sq.position_split(df, 0.8).where("part = 'train'")
    assert {r.city for r in tr.where("city = 'b'").collect()} == {"b"}   # a (5) then 3 of b


def test_backtest_minimum_history(spark):
    df = series(spark, {"short": 111, "long": 112})
    f = fc.backtest_frame(df, 72, 40, 8)
    assert {r.city for r in f.select("city").distinct().collect()} == {"long"}


def test_minmax_constant_round_trip(spark):
    from smogcast.functions.columns import minmax_inverse
    df = series(spark, {"a": 4}, value=7.0)
    s = sq.scale_minmax(df, sq.fit_minmax(df)).withColumn("back", minmax_inverse("aqi_scaled", "lo", "hi"))
    assert {(r.aqi_scaled, r.back) for r in s.collect()} == {(0.0, 7.0)}


def _model(spark, intercept, coef):
    return spark.createDataFrame([(float(intercept), [float(c) for c in coef])], "intercept double, coef array<double>")


def test_reversion_steps(spark):
    fit = spark.createDataFrame([(0.0, 400.0)], "lo double, hi double")
    seq = spark.createDataFrame([([100.0] * 30,)], "seq array<double>")
    model = _model(spark, 200.0 / 400.0, [0.0] * 30)     # always predicts 200 (scaled 0.5)
    p = fc.forecast_roll(seq, model, fit, steps=3, revert=True).first().preds
    assert [round(x, 9) for x in p] == [185.0, 170.0, 155.0]
    plain = fc.forecast_roll(seq, model, fit, steps=3, revert=False).first().preds
    assert [round(x, 9) for x in plain] == [200.0, 200.0, 200.0]


def test_identity_model_keeps_constant(spark):
    fit = spark.createDataFrame([(0.0, 100.0)], "lo double, hi double")
    seq = spark.createDataFrame([([42.0] * 30,)], "seq array<double>")
    p = fc.forecast_roll(seq, _model(spark, 0.0, [0.0] * 29 + [1.0]), fit, steps=3).first().preds
    assert [round(x, 9) for x in p] == [42.0, 42.0, 42.0]


def test_hybrid_cases(spark):
    hist = series(spark, {"a": 29, "b": 29, "c": 30})
    live = spark.createDataFrame([("a", dt.datetime(2021, 1, 1), 1, 99.0), ("b", dt.datetime(2021, 1, 1), 2, None)],
                                 "city string, ts timestamp, event_id long, aqi double")
    out = {r.city: r for r in st.hybrid_sequence(live, hist, 30).collect()}
    assert set(out) == {"a", "c"}
    assert out["a"].seq[-1] == 99.0 and len(out["a"].seq) == 30 and out["a"].data_source == st.HYBRID_TAG
    assert out["c"].data_source == st.CSV_ONLY_TAG and out["c"].seq[0] == 1.0


def test_compare_list_order_and_fallback(spark):
    status = spark.createDataFrame([("A", "LIVE SATELLITE", 10.0, None), ("B", "CSV FALLBACK", 20.0, None),
                                    ("C", None, None, "No data for C"), ("D", "LIVE SATELLITE", 5.0, None)],
                                   "city string, source string, aqi double, error string")
    for c in ["pm25", "pm10", "no2", "so2"]:
        status = status.withColumn(c, F.lit(None).cast("double"))
    status = status.withColumn("risk_level", F.lit("x"))
    asked = st.asked_cities(spark, " A, ,B,A,C,D,E", 5)
    got = [r.city for r in st.compare_cities(status, asked).orderBy("pos").collect()]
    assert got == ["A", "B", "A", "D"]


def test_worst_horizon_tie(spark):
    df = spark.createDataFrame([(200.0, 200.0, 150.0), (1.0, 3.0, 3.0)], "pred_24h double, pred_48h double, pred_72h double")
    assert [r.h for r in df.select(st.worst_horizon(df).alias("h")).collect()] == [24, 48]


def test_monitor_log_asof(spark):
    t = dt.datetime
    readings = spark.createDataFrame([
        ("X", t(2024, 1, 1, 10), 1, "LIVE SATELLITE", 100.0, 1.0, 1.0, 1.0, 1.0),
        ("X", t(2024, 1, 2, 9), 2, "LIVE SATELLITE", 160.0, 1.0, 1.0, 1.0, 1.0),
        ("X", t(2024, 1, 2, 11), 3, "LIVE SATELLITE", 70.0, 1.0, 1.0, 1.0, 1.0),
        ("Y", t(2024, 1, 2, 11), 4, "LIVE SATELLITE", 70.0, 1.0, 1.0, 1.0, 1.0),
    ], "city string, ts timestamp, event_id long, source string, aqi double, pm25 double, pm10 double, no2 double, so2 double")
    preds = spark.createDataFrame([
        ("X", t(2024, 1, 1, 10), 10, 1.0, 2.0, 3.0),    # same poll as reading 1 -> matches
        ("X", t(2024, 1, 2, 10), 11, 4.0, 5.0, 6.0),    # after reading 2 -> reading 2 keeps day-1 value
    ], "city string, ts timestamp, event_id long, pred_24h double, pred_48h double, pred_72h double")
    out = {r.event_id: r for r in st.monitor_log(readings, preds).collect()}
    assert out[1].aqi_24h == 1.0 and out[2].aqi_24h == 1.0 and out[3].aqi_24h == 4.0
    assert out[4].aqi_24h is None and out[2].risk_now == "Unhealthy"


def test_monitor_log_hot_city_is_split_and_exact(spark):
    """One city holds almost every row: buckets split it, results equal a brute-force as-of."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    t0 = pd.Timestamp("2024-01-01")
    rows, preds = [], []
    for i in range(3000):
        city = "HOT" if i % 100 else "COLD"
        rows.append((city, (t0 + pd.Timedelta(seconds=int(rng.integers(0, 86400 * 3)))).to_pydatetime(), i,
                     "LIVE SATELLITE", float(i % 400), 1.0, 1.0, 1.0, 1.0))
    for j in range(200):
        city = "HOT" if j % 10 else "COLD"
        preds.append((city, (t0 + pd.Timedelta(seconds=int(rng.integers(0, 86400 * 3)))).to_pydatetime(),
                      10000 + j, float(j), float(j) + 0.5, float(j) + 0.75))
    rs = "city string, ts timestamp, event_id long, source string, aqi double, pm25 double, pm10 double, no2 double, so2 double"
    ps = "city string, ts timestamp, event_id long, pred_24h double, pred_48h double, pred_72h double"
    got = {r.event_id: r.aqi_24h for r in st.monitor_log(spark.createDataFrame(rows, rs),
                                                        spark.createDataFrame(preds, ps)).collect()}
    rp = pd.DataFrame(rows, columns=["city", "ts", "event_id", "source", "aqi", "a", "b", "c", "d"]).sort_values("ts")
    pp = pd.DataFrame(preds, columns=["city", "ts", "pid", "p24", "p48", "p72"]).sort_values(["ts", "pid"])
    want = pd.merge_asof(rp, pp, on="ts", by="city", direction="backward")
    for eid, p in zip(want.event_id, want.p24):
        assert (got[eid] is None and pd.isna(p)) or got[eid] == p
    assert len(got) == len(rows)


def test_backtests_on_a_constant_series_do_not_raise(spark):
    df = series(spark, {"flat": 150}, value=80.0)
    for fn in (fc.backtest_ar1, fc.backtest_arima):
        r = fn(df).first()
        assert r.mae == 0.0 and r.last_predicted == 80.0


def test_exact_stratified_split_counts(spark):
    from smogcast.plans import classify as cl
    rows = [(f"k{i}", "A") for i in range(23)] + [(f"m{i}", "B") for i in range(11)] + [(f"n{i}", "C") for i in range(4)]
    df = spark.createDataFrame(rows, "row_key string, label string")
    q = cl.split_quotas({"A": 23, "B": 11, "C": 4}, 0.2)
    assert sum(q.values()) == 8                       # ceil(0.2 * 38)
    got = {r.label: r.n for r in cl.stratified_split(df).where("part = 'test'").groupBy("label")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in q.items() if v}
    again = cl.stratified_split(df).where("part = 'test'").select("row_key").collect()
    assert {r.row_key for r in again} == {r.row_key for r in cl.stratified_split(df).where("part = 'test'")
                                          .select("row_key").collect()}   # deterministic


def test_sample_sizes_round_half_even(spark):
    """FIXTURES: classes of 5 and 3 rows, half kept -> 2 and 2 (half-even rounding)."""
    from smogcast.plans import classify as cl
    rows = [(f"a{i}", "A") for i in range(5)] + [(f"b{i}", "B") for i in range(3)]
    df = spark.createDataFrame(rows, "row_key string, label string")
    got = {r.label: r.n for r in cl.stratified_sample(df, max_rows=4).groupBy("label")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 2, "B": 2}
    assert cl.stratified_sample(df, max_rows=8).count() == 8      # not larger than max: unchanged


def test_exact_split_takes_the_smallest_hashes_of_each_class(spark):
    from smogcast.plans import classify as cl
    from pyspark.sql import functions as F
    rows = [(f"k{i}", "A" if i % 3 else "B") for i in range(600)] + [("z", "C")]
    df = spark.createDataFrame(rows, "row_key string, label string")
    got = cl.stratified_split(df).withColumn("h", cl.row_hash(F.col("row_key"), 42)).collect()
    quota = cl.split_quotas({"A": 400, "B": 200, "C": 1})
    assert len(got) == 601
    for c, n in quota.items():
        own = sorted((r.h, r.row_key, r.part) for r in got if r.label == c)
        assert [x[2] for x in own] == ["test"] * n + ["train"] * (len(own) - n)
    assert cl.stratified_split(df.limit(0)).count() == 0


def test_exact_medians_do_not_depend_on_brackets(spark, monkeypatch):
    import random
    import statistics
    from smogcast.plans import classify as cl
    monkeypatch.setattr(cl, "MEDIAN_ROWS", 5)
    rng = random.Random(1)
    for n in (1, 2, 7, 300, 301):
        rows = [(rng.gauss(0, 1), float(rng.randrange(3)), 5.0, None if rng.random() < 0.3 else rng.random() * 1e6)
                for _ in range(n)]
        df = spark.createDataFrame(rows, "a double, b double, c double, d double")
        got = cl.exact_medians(df, ["a", "b", "c", "d"])
        for k, c in enumerate("abcd"):
            values = [r[k] for r in rows if r[k] is not None]
            assert got[c] == (statistics.median(values) if values else None), (n, c)


def test_a_training_sample_has_few_parts_whatever_the_shuffles(spark, monkeypatch):
    """Both fits run a task for each part in every round."""
    from pyspark.ml import Pipeline
    from smogcast.plans import classify as cl
    parts, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: parts.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    df = spark.range(0, 1200, 1, 60).selectExpr(
        "concat('c', id % 3) AS city", "date_add(date'2020-01-01', int(id)) AS date", "double(id % 350) AS aqi", "double(id % 350) AS pm25",
        "double(id % 7) AS pm10", "double(id % 11) AS no2", "double(id % 5) AS so2")
    _, metrics, _ = cl.train_and_select(df, num_trees=2, max_depth=3, max_iter=3)
    assert metrics.count() == 2 and len(parts) == 2 and max(parts) <= cl.SAMPLE_PARTS
