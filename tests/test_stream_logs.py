"""Streams over several batches: late and repeated polls, refreshed master, late predictions, no state that grows."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from smogcast.sources import standin as si
from smogcast.streaming import logs, streams as ss

T = dt.datetime
POLL = ("city string, ts timestamp, event_id long, current struct<pm10:double,pm2_5:double,nitrogen_dioxide:double,"
        "sulphur_dioxide:double,carbon_monoxide:double,ozone:double,us_aqi:double>, "
        "weather struct<temperature_2m:double,relative_humidity_2m:double,wind_speed_10m:double,weather_code:int>")
PRED = "city string, data_source string, pred_24h double, pred_48h double, pred_72h double, ts timestamp, event_id long"
MASTER = ("city string, date date, pm25 double, pm10 double, no2 double, so2 double, co double, o3 double, aqi double, "
          "aqi_bucket string")


def poll(city, ts, event_id, aqi):
    return city, ts, event_id, (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, aqi), (20.0, 50.0, 2.0, 1)


def land(spark, rows, schema, path, name):
    ss.land_payloads(spark.createDataFrame(rows, schema).coalesce(1), f"{path}/{name}")


def master_row(city, day, aqi):
    return city, day, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, aqi, "x"


def run(spark, polls, root, sink, most=None, checkpoint="ck"):
    ss.run_available(ss.read_payload_stream(spark, f"{polls}/*", most), None, f"{root}/{checkpoint}", foreach_batch=sink)


def test_replays_are_dropped_and_late_polls_kept_over_twenty_batches(spark, tmp_path, sf_dir):
    """Twenty files in shuffled time order, every payload landed twice: each poll once, and no state at all."""
    polls, path, out = si.poll_payloads(spark, sf_dir), str(tmp_path / "polls"), str(tmp_path / "out")
    ss.land_payloads(polls.unionByName(polls).repartition(20, F.rand(3)), f"{path}/all")
    run(spark, path, out, logs.append_batches(f"{out}/log"), most=1)
    log = spark.read.parquet(f"{out}/log")
    assert log.select("batch").distinct().count() == 20
    assert log.count() == log.select("event_id").distinct().count() == polls.count()
    assert not os.path.exists(f"{out}/ck/state")
    # the same files again under a new checkpoint: nothing new
    run(spark, path, out, logs.append_batches(f"{out}/log"), checkpoint="ck2")
    assert spark.read.parquet(f"{out}/log").count() == polls.count()


def test_a_replayed_batch_finds_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("X", T(2024, 1, 1), 1), ("X", None, 2), ("X", None, 2), (None, T(2024, 1, 2), None),
                                  (None, T(2024, 1, 2), None)], "city string, ts timestamp, event_id long")
    write = logs.append_batches(path)
    for batch in (0, 0, 1):                  # replayed, then the same rows in another batch
        write(rows, batch)
        got = spark.read.schema("city string, ts timestamp, event_id long, day string, stream string, batch long").parquet(path)
        assert got.count() == 3 and {r.day for r in got.collect()} == {"2024-01-01", "2024-01-02", "none"}
    write(rows.limit(0), 2)
    assert got.count() == 3


def test_a_batch_reads_only_its_own_days(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "city string, ts timestamp, event_id long, day string, stream string, batch long"
    write = logs.append_batches(path)
    for day in range(1, 8):
        write(spark.createDataFrame([("X", T(2024, 1, day, h), h) for h in range(5)], "city string, ts timestamp, event_id long"), day)
    assert len(logs.log_days(spark, path)) == 7
    known = logs.read_days(spark, path, ["2024-01-03", "2023-01-01"], schema)
    assert {f.split("/day=")[1][:10] for f in known.inputFiles()} == {"2024-01-03"}
    assert logs.read_days(spark, path, ["2020-01-01"], schema) is None


@pytest.mark.parametrize("published", [True, False])
def test_a_master_written_between_two_batches_shows_up(spark, tmp_path, published):
    polls, root, master = str(tmp_path / "polls"), str(tmp_path / "root"), str(tmp_path / "master")

    def write(aqi):
        df = spark.createDataFrame([master_row("X", dt.date(2024, 1, 1), aqi)], MASTER)
        logs.publish(df, master) if published else df.write.mode("overwrite").parquet(master)

    write(111.0)
    sink = ss.status_batches(ss.master_snapshot(spark, master), f"{root}/status")
    land(spark, [poll("X", T(2024, 2, 1), 1, None)], POLL, polls, "a")
    run(spark, polls, root, sink)
    if not published:
        os.utime(f"{master}/_SUCCESS", (0, 0))
    write(222.0)
    land(spark, [poll("X", T(2024, 2, 2), 2, None), poll("Y", T(2024, 2, 2), 3, None), poll("X", T(2024, 2, 3), 4, 50.0)],
         POLL, polls, "b")
    run(spark, polls, root, sink)
    got = {r.event_id: (r.aqi, r.source) for r in spark.read.parquet(f"{root}/status").collect()}
    assert got == {1: (111.0, "CSV FALLBACK"), 2: (222.0, "CSV FALLBACK"), 4: (50.0, "LIVE SATELLITE")}


def test_latest_table_is_merged_over_batches_and_keeps_few_versions(spark, tmp_path):
    polls, root, master = str(tmp_path / "polls"), str(tmp_path / "root"), str(tmp_path / "master")
    logs.publish(spark.createDataFrame([master_row("X", dt.date(2024, 1, 1), 9.0)], MASTER), master)
    sink = ss.latest_batches(ss.master_snapshot(spark, master), f"{root}/latest")
    for k, (hour, aqi) in enumerate([(5, 100.0), (9, 160.0), (7, 70.0), (8, 80.0), (3, 1.0), (9, 5.0)]):
        land(spark, [poll("X", T(2024, 2, 1, hour), k, aqi), poll("Z", T(2024, 2, 1, hour), k, aqi)], POLL, polls, f"f{k}")
        run(spark, polls, root, sink)
    rows = logs.read_newest(spark, f"{root}/latest").collect()
    assert {(r.city, r.ts.hour, r.event_id, r.aqi) for r in rows} == {("X", 9, 5, 5.0), ("Z", 9, 5, 5.0)}
    assert len(logs.versions(spark, f"{root}/latest")) <= logs.KEEP_VERSIONS + 1


def test_monitor_equals_a_batch_as_of_join_in_any_order_of_arrival(spark, tmp_path):
    """Readings and predictions of three cities land in eight lots, a prediction often after its readings."""
    import random
    rng = random.Random(5)
    at = lambda: T(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(5 * 24 * 60))
    readings = [poll(rng.choice("AAAAB") if k else "C", at(), k, float(k % 300) if k % 9 else None) for k in range(240)]
    preds = [(rng.choice("AAAAB"), "m", float(k), k + 0.5, k + 0.75, at(), 1000 + k) for k in range(60)]
    polls, told, root = (str(tmp_path / n) for n in ("polls", "preds", "root"))
    sink = ss.monitor_batches(root)
    for lot in range(8):
        land(spark, readings[lot::8] + readings[lot::16], POLL, polls, f"lot{lot}")       # some twice
        land(spark, preds[(lot + 3) % 8::8], PRED, told, f"lot{lot}")
        feed = ss.read_monitor_feed(ss.read_payload_stream(spark, f"{polls}/*"), ss.read_prediction_stream(spark, f"{told}/*"))
        ss.run_available(feed, None, f"{root}/ck", foreach_batch=sink)
    got = {r.event_id: r.aqi_24h for r in ss.read_monitor(spark, root).collect()}
    r = pd.DataFrame([(c, t, e) for c, t, e, x, _ in readings if x[-1] is not None], columns=["city", "ts", "id"]).sort_values(["ts", "id"])
    p = pd.DataFrame([(c, t, k, v) for c, _, v, _, _, t, k in preds], columns=["city", "ts", "pid", "v"]).sort_values(["ts", "pid"])
    want = pd.merge_asof(r, p, on="ts", by="city")
    assert got == {e: None if pd.isna(v) else v for e, v in zip(want.id, want.v)}
    assert not os.path.exists(f"{root}/ck/state")
    last = spark.read.parquet(f"{root}/last_predictions")
    assert last.count() == last.select("city", "day").distinct().count() == len(p.assign(d=p.ts.dt.date)[["city", "d"]].drop_duplicates())


def test_a_batch_writes_one_file_a_day(spark, tmp_path):
    """Also where a batch is checked against what the log holds, and where shuffles have more partitions than days."""
    polls, told, root = (str(tmp_path / n) for n in ("polls", "preds", "root"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink, write = ss.monitor_batches(root), logs.append_batches(f"{root}/log")
        for lot in range(3):
            at = [T(2024, 1, 1 + d, h) for d in range(20) for h in range(lot, 24, 3)]
            land(spark, [poll("ABC"[n % 3], t, 100 * n + lot, 5.0) for n, t in enumerate(at)], POLL, polls, f"lot{lot}")
            land(spark, [("ABC"[n % 3], "m", 1.0, 2.0, 3.0, t, 100 * n + lot) for n, t in enumerate(at)], PRED, told, f"lot{lot}")
            run(spark, polls, root, write, checkpoint="log-ck")
            feed = ss.read_monitor_feed(ss.read_payload_stream(spark, f"{polls}/*"), ss.read_prediction_stream(spark, f"{told}/*"))
            ss.run_available(feed, None, f"{root}/ck", foreach_batch=sink)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for name, batches in (("log", 3), ("predictions", 3), ("monitor", 3), ("last_predictions", 1)):
        files = [(folder, f) for folder, _, inside in os.walk(f"{root}/{name}") for f in inside if f.endswith(".parquet")]
        assert len(files) == len({folder for folder, _ in files}) == 20 * batches, name
    assert ss.read_monitor(spark, root).where("aqi_24h = 1").count() == spark.read.parquet(f"{root}/log").count() == 3 * 160


def test_a_day_of_many_rows_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "FILE_ROWS", 10)
    rows = [("X", T(2024, 1, 1 if n % 4 else 2, 1, n % 60), n) for n in range(120)] + [("X", None, n) for n in range(5)]
    path = str(tmp_path / "log")
    write = logs.append_batches(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in (0, 1):                 # what comes again is not written again
            write(spark.createDataFrame(rows, "city string, ts timestamp, event_id long"), batch)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.schema("event_id long").parquet(path).count() == 125
    files = {day: len([f for _, _, inside in os.walk(f"{path}/day={day}") for f in inside if f.endswith(".parquet")])
             for day in ("2024-01-01", "2024-01-02", "none")}
    assert files["2024-01-01"] > 1 and files["none"] == 1


def test_many_days_are_read_by_what_the_log_has(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "city string, ts timestamp, event_id long, day string, stream string, batch long"
    at = [T(2024, 1, 1) + dt.timedelta(days=d) for d in range(40)]
    logs.append_batches(path)(spark.createDataFrame([("X", t, 1) for t in at], "city string, ts timestamp, event_id long"), 0)
    days = [f"{t:%Y-%m-%d}" for t in at]
    assert logs.read_days(spark, path, days + ["2020-01-01"], schema).count() == 40
    some = logs.read_days(spark, path, days[:30] + ["2020-01-01"], schema)
    assert {r.day for r in some.collect()} == set(days[:30]) and len(some.inputFiles()) == 30
    assert logs.read_days(spark, path, [f"2020-01-{d:02d}" for d in range(1, 31)], schema) is None


def test_start_stream_processing_time_trigger(spark, tmp_path, sf_dir):
    """The production starter (60 s by default; 1 s here)."""
    polls, out = str(tmp_path / "polls"), str(tmp_path / "out")
    ss.land_payloads(si.poll_payloads(spark, sf_dir), polls, files=2)
    q = ss.start_stream(ss.read_payload_stream(spark, polls), None, out + "-ck", foreach_batch=logs.append_batches(out), every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(out).count() == si.poll_payloads(spark, sf_dir).count()


def test_as_of_join_over_buckets_nulls_and_ties(spark):
    from smogcast.operators.status import monitor_log
    rs = "city string, ts timestamp, event_id long, source string, aqi double, pm25 double, pm10 double, no2 double, so2 double"
    ps = "city string, ts timestamp, event_id long, pred_24h double, pred_48h double, pred_72h double"
    reading = lambda c, t, e: (c, t, e, "s", 1.0, 1.0, 1.0, 1.0, 1.0)
    readings = [reading("X", T(2024, 1, 1, 0, 0), 1), reading("X", T(2024, 3, 1), 2), reading("X", None, 3), reading(None, T(2024, 3, 1), 4),
                reading("X", T(2024, 1, 1, 5, 30), 5), reading("X", T(2023, 1, 1), 6), reading("X", T(9999, 1, 1), 7), reading("X", T(1, 1, 1), 8)]
    preds = [("X", T(2024, 1, 1, 0, 0), 10, 1.0, 1.0, 1.0), ("X", T(2024, 1, 1, 5, 0), 12, 3.0, 3.0, 3.0),
             ("X", T(2024, 1, 1, 5, 0), 11, 2.0, 2.0, 2.0), ("X", T(2024, 1, 1, 6, 0), 13, None, None, None), ("X", None, 14, 9.0, 9.0, 9.0)]
    for seconds in (60, 3600, 10 ** 9):
        got = {r.event_id: (r.aqi_24h, r.timestamp is None) for r in monitor_log(
            spark.createDataFrame(readings, rs), spark.createDataFrame(preds, ps), seconds).collect()}
        assert got == {1: (1.0, False), 2: (None, False), 3: (None, True), 4: (None, False), 5: (3.0, False), 6: (None, False),
                       7: (None, False), 8: (None, False)}
    assert monitor_log(spark.createDataFrame([], rs), spark.createDataFrame(preds, ps)).count() == 0
