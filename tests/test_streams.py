import datetime as dt
import tempfile

from pyspark.sql import functions as F

from lodestar.operators import embed, stats
from lodestar.sources.store import Storage
from lodestar.streaming import events


def test_lockout_rule():
    rule, state, seen = events.Lockout(3, 300, 300), ([], 0.0), []
    for ts, ok in [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (304, False), (305, True)]:
        failures, until, hit = rule.step(*state, float(ts), ok)
        state = (failures, until)
        seen.append(hit)
    assert seen == [False] * 6 + [True, True, False]


def test_lockout_stream(spark):
    src, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", t0 + dt.timedelta(seconds=i), False) for i in range(11)] + [("ok", t0, True)]
    spark.createDataFrame(rows, "key string, ts timestamp, ok boolean").write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, ts timestamp, ok boolean").parquet(src)
    q = events.lockout(stream).writeStream.format("parquet").option("path", out + "/o").option("checkpointLocation", out + "/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/o").groupBy("key").agg(F.count_if("blocked").alias("b"), F.count("*").alias("n")).collect()
    assert {(r["key"], r["b"], r["n"]) for r in got} == {("k", 1, 11), ("ok", 0, 1)}


def test_change_stream_and_windows(spark):
    src, path = tempfile.mkdtemp(), tempfile.mkdtemp()
    spark.createDataFrame([("", f"r{i}", [1.0, float(i)], 1.0, None, False) for i in range(5)], "namespace string, id string, values array<float>, norm double, metadata string, deleted boolean").write.mode("append").parquet(src)
    storage = Storage(spark, path)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    events.write_changes(stream, storage, path + "/checkpoint", compact_every=3).awaitTermination(120)
    assert storage.live().count() == 5 and storage.numbers("snapshot") == [1]
    # More of the stream: the last of an id in a batch counts, rows are counted over restarts, and a batch run again replaces itself.
    spark.createDataFrame([("", "r1", [float(i)], 1.0, None, False) for i in range(2)], spark.read.parquet(src).schema).coalesce(1).write.mode("append").parquet(src)
    events.write_changes(stream, storage, path + "/checkpoint", compact_every=3).awaitTermination(120)
    assert storage.numbers("changes") == [2] or storage.numbers("changes") == [1, 2]
    assert storage.live().where("id = 'r1'").first()["values"] == [1.0] and storage.numbers("snapshot") == [1]
    name = next(s.getPath().getName() for s in storage.fs.listStatus(storage._p("")) if s.getPath().getName().startswith("stream-"))
    assert storage.read_text(name) == '{"batch": 1, "seq": 2}'
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(t0 + dt.timedelta(seconds=s), "a", float(s)) for s in (0, 1, 10)], "ts timestamp, route string, ms double")
    assert events.windowed_latency(e).agg(F.sum("samples")).first()[0] == 18
    assert events.sessions(e.withColumn("key", F.lit("k"))).count() == 2


def test_reports(spark):
    sweep = spark.createDataFrame([(16, 0.85), (32, 0.94), (64, 0.97), (128, 0.99)], "effort int, recall double")
    assert stats.operating_point(sweep).first()["effort"] == 64
    assert stats.operating_point(sweep.where("effort < 64")).first()["effort"] == 32
    texts = spark.createDataFrame([(1, "red boots"), (2, "iron pan")], "id int, text string")
    ranked, failed = embed.compare_models(texts, "boots", [("hashed", "words", 64), ("openai", "text-embedding-3-small", None)])
    assert ranked.where("rank = 1").first()["id"] == 1 and list(failed) == ["text-embedding-3-small"]
    assert embed.model_table(spark).count() == 25


def test_rolling_equals_sql(spark):
    """Against the window that SQL says, with equal instants, edges of windows and stretches, and missing times, keys and values; no frame moves over its rows."""
    import random

    import duckdb
    import pyarrow as pa

    r, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 41 == 0 else start + dt.timedelta(seconds=r.choice((0, 20, 60)) * r.randrange(60), microseconds=r.choice((0, 1, 999_999))), r.choice(("a", "b", None)), None if i % 7 == 0 else r.randrange(1000) / 4) for i in range(600)]
    said = pa.table({c: list(x) for c, x in zip(("event_id", "ts", "key", "value"), zip(*rows, strict=True), strict=True)})  # noqa: F841
    want = duckdb.sql("SELECT event_id, count(*) OVER w, round(avg(value) OVER w, 6) FROM said WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)").fetchall()
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, key string, value double")
    found = stats.rolling(events, 60)
    got = [(x["event_id"], x["in_window"], x["mean_in_window"] and round(x["mean_in_window"], 6)) for x in found.collect()]
    assert sorted(got) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "unboundedpreceding" in plan
