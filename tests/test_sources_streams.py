"""Sinks, the generator, and streams against batch results."""

import datetime as dt

from pyspark.sql import functions as F

from tidewright.sources import files
from tidewright.sources.generator import Scenario, reports, truth
from tidewright.streaming import messages as st


def test_results_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"a": 0.5})], "run_id long, config map<string,double>")
    files.append_results(rows, str(tmp_path / "r"))
    files.append_results(rows, str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r"), rows.schema).count() == 2
    t = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([(t + dt.timedelta(minutes=i), "op", "act", "demand" if i % 2 else "run", str(i % 3), "{}") for i in range(10)], files.AUDIT)
    files.record(spark, str(tmp_path / "a"), e)
    assert [r.created_at.minute for r in files.recent(spark, str(tmp_path / "a"), 3).collect()] == [9, 8, 7]
    assert [r.created_at.minute for r in files.for_entity(spark, str(tmp_path / "a"), "demand", "1").collect()] == [7, 1]


def test_calibration_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("need", [0.2, 0.6], [0.1, 0.9], 50)], files.STEPS)
    files.save_calibration(s, str(tmp_path / "c"))
    df = spark.createDataFrame([(0.1,), (0.2,), (0.4,), (0.9,)], "raw double")
    got = [round(r.calibrated, 6) for r in files.calibrated(df, files.load_calibration(spark, str(tmp_path / "c")), "need", "raw").orderBy("raw").collect()]
    assert got == [0.1, 0.1, 0.5, 0.9]


def test_generator_is_deterministic(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("seed: 7\ntotal_messages: 500\n")
    s = Scenario.load(str(tmp_path / "s.yaml"))
    a = truth(spark, s)
    b = truth(spark, s).repartition(5)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    r = reports(a, s)
    n = r.count()
    assert 200 < n < 1500
    assert r.select("message_id").distinct().count() == n
    x = a.agg(F.min("onset_min").alias("lo"), F.max("onset_min").alias("hi")).first()
    assert 0 <= x.lo and x.hi <= s.hours * 60


SCHEMA = "message_id string, channel string, sender_hash string, received_at timestamp_ntz"


def stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return st.source(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], SCHEMA).schema)


def test_streams_equal_batch(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [(f"m{i % 40}", "sms" if i % 3 else "chat", f"s{i % 5}", t + dt.timedelta(minutes=i % 40)) for i in range(60)]
    s = stream(spark, tmp_path, [rows[:30], rows[30:]])
    once = st.drained(st.redeliveries_removed(s))
    assert once.count() == 40
    w = {(r.start, r.channel): r.n for r in st.drained(st.window_counts(s), "complete", ["start", "channel"]).collect()}
    want: dict = {}
    for _, c, _, at in rows:
        k = (at.replace(minute=at.minute // 15 * 15), c)
        want[k] = want.get(k, 0) + 1
    assert w == want
    got = {r.sender_hash: r.n for r in st.drained(st.sender_states(s), "update", ["sender_hash"]).collect()}
    assert got == {f"s{k}": 12 for k in range(5)}
