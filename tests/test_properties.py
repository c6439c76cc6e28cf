"""Property tests: counts and sizes that must hold for any per-city lengths."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from smogcast.functions.columns import minmax_inverse
from smogcast.operators import sequences as sq
from smogcast.operators import tables as tb

LENGTHS = hs.lists(hs.integers(min_value=0, max_value=45), min_size=1, max_size=4)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, lengths, seed=0):
    rows = []
    for ci, n in enumerate(lengths):
        for i in range(n):
            rows.append((f"c{ci}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float((i * 37 + ci * 11 + seed) % 500)))
    return spark.createDataFrame(rows, "city string, date date, aqi double")


@SETTINGS
@given(lengths=LENGTHS)
def test_sequence_count_and_split_size(spark, lengths):
    s = sq.sequences(frame(spark, lengths), 30)
    n = sum(max(0, k - 30) for k in lengths)
    assert s.count() == n
    if n:
        split = sq.position_split(s, 0.8)
        train = split.where(F.col("part") == "train")
        assert train.count() == int(0.8 * n)
        # train rows are exactly the first int(0.8 n) in (city, date) order
        ordered = [(r.city, r.date) for r in s.orderBy("city", "date").collect()]
        assert {(r.city, r.date) for r in train.collect()} == set(ordered[: int(0.8 * n)])


@SETTINGS
@given(lengths=LENGTHS, seed=hs.integers(0, 100))
def test_minmax_round_trip_and_range(spark, lengths, seed):
    df = frame(spark, lengths, seed)
    if not sum(lengths):
        return
    s = sq.scale_minmax(df, sq.fit_minmax(df)).withColumn("back", minmax_inverse("aqi_scaled", "lo", "hi"))
    r = s.agg(F.min("aqi_scaled").alias("a"), F.max("aqi_scaled").alias("b"),
              F.max(F.abs(F.col("back") - F.col("aqi"))).alias("err")).first()
    assert r.a >= 0.0 and r.b <= 1.0 and r.err < 1e-9


@SETTINGS
@given(lengths=LENGTHS, n=hs.integers(1, 10))
def test_last_n_keeps_min_of_n_and_length(spark, lengths, n):
    df = frame(spark, lengths)
    got = {r.city: r.k for r in tb.last_n(df, n).groupBy("city").agg(F.count("*").alias("k")).collect()}
    want = {f"c{i}": min(n, k) for i, k in enumerate(lengths) if k}
    assert got == want


def test_profile_approx_and_csv_master(spark, tmp_path, sf_dir):
    from smogcast.plans.catalog import master
    from smogcast.plans.master import write_master
    from smogcast.sources import files as fl
    m = master(spark, sf_dir)
    exact = tb.profile(m).first()
    approx = tb.profile(m, approx=True).first()
    assert exact.records == approx.records and abs(exact.cities - approx.cities) <= 1
    out = str(tmp_path / "m")
    write_master(m, out, partition_by_year=False)
    assert fl.read_master(spark, out).count() == m.count()
    csv = str(tmp_path / "c")
    m.write.option("header", True).csv(csv)
    back = fl.read_master(spark, csv, fmt="csv")
    assert back.count() == m.count() and dict(back.dtypes)["date"] == "date"
