"""Metric aggregations against the goldens shipped with the reference."""

import pytest
from pyspark.sql import functions as F

from smogcast.operators import metrics as mt
from smogcast.operators import status as st

# Per-city ARIMA MAE / RMSE published by the reference, and its aggregates.
ARIMA_PER_CITY = [
    ("Jaipur", 18.932458832622633, 23.923581233667043),
    ("Lucknow", 38.01120462957663, 42.2914657641649),
    ("Delhi", 28.314832009373195, 39.49503372087508),
    ("Hyderabad", 18.122045253498413, 22.21202100523284),
    ("Chennai", 17.786894414374096, 25.582728480797627),
    ("Ahmedabad", 53.336015754995195, 56.607227771112264),
    ("Chandigarh", 20.167841769520336, 25.76231634030561),
    ("Nagpur", 14.567588808081403, 28.192369753306643),
]

# Per-class report of the published forest (precision, recall, f1, support).
FOREST_REPORT = [
    ("Good", 0.8177570093457944, 0.6529850746268657, 0.7261410788381742, 268),
    ("Hazardous", 0.914651493598862, 0.8748299319727891, 0.894297635605007, 735),
    ("Moderate", 0.9203020134228188, 0.9648197009674582, 0.9420352082438815, 3411),
    ("Unhealthy", 0.6834381551362684, 0.5863309352517986, 0.6311713455953534, 556),
]


def test_summary_matches_published_aggregates(spark):
    df = spark.createDataFrame(ARIMA_PER_CITY, "city string, mae double, rmse double")
    r = mt.summarise_metrics(df).first()
    assert r.cities_trained == 8
    assert r.mae_mean == pytest.approx(26.154860184005237, abs=1e-9)
    assert r.rmse_mean == pytest.approx(33.00834300868274, abs=1e-9)
    assert r.mae_median == pytest.approx(19.550150301071483, abs=1e-9)
    assert r.rmse_median == pytest.approx(26.977343046806126, abs=1e-9)


def test_overall_report_matches_published(spark):
    rep = spark.createDataFrame(FOREST_REPORT, "class string, precision double, recall double, f1 double, support long")
    r = mt.overall_report(rep).first()
    assert r.weighted_f1 == pytest.approx(0.8885569285249914, abs=1e-9)
    assert r.macro_f1 == pytest.approx(0.798411317070604, abs=1e-9)
    assert r.accuracy == pytest.approx(0.892354124748491, abs=1e-9)
    assert r.support == 4970


def test_class_report_from_confusion(spark):
    rows = [("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("c", "a", 1)]
    conf = spark.createDataFrame(rows, "label string, prediction string, n long")
    rep = {r["class"]: r for r in mt.class_report(conf).collect()}
    assert rep["a"].precision == pytest.approx(0.75) and rep["a"].recall == pytest.approx(0.75)
    assert rep["c"].precision == 0.0 and rep["c"].f1 == 0.0 and rep["c"].support == 1
    assert rep["b"].recall == 1.0


def test_compare_models_improvement(spark):
    a = spark.createDataFrame([("mae", 22.47), ("rmse", 31.85)], "metric string, value double")
    b = spark.createDataFrame([("mae", 26.15), ("rmse", 33.01)], "metric string, value double")
    out = {r.metric: r.improvement_pct for r in st.compare_models(a, b).collect()}
    assert round(out["mae"], 1) == 14.1 and round(out["rmse"], 1) == 3.5


def test_select_best_first_on_ties(spark):
    df = spark.createDataFrame([("rf", 0, 0.9), ("lr", 1, 0.9), ("x", 2, 0.5)], "model string, ord int, f1_weighted double")
    assert mt.select_best(df).first().selected_model == "rf"


def test_error_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 1.0)], "city string, actual double, pred double")
    r = mt.error_metrics(df).first()
    assert r.mae == 1.5 and r.rmse == pytest.approx((2.5) ** 0.5)
