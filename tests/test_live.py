import datetime as dt
import threading
import time

from cadenza.streaming import live

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "who string, request_id long, ts timestamp, setting string"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def run_stream(spark, tmp_path, batches, plan, name, mode="append"):
    source = f"{tmp_path}/{name}-in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def test_debounce_of_a_stream_and_of_a_table(spark, tmp_path):
    rows = [("a", 1, at(0), "x"), ("a", 2, at(0.1), "y"), ("a", 3, at(5), "z"), ("b", 4, at(0.05), "q")]
    want = {("a", 2, 2), ("a", 3, 1), ("b", 4, 1)}
    got = live.debounced(spark.createDataFrame(rows, SCHEMA), "who").collect()
    assert {(r["who"], r["request_id"], r["requests"]) for r in got} == want
    got = run_stream(spark, tmp_path, [rows, [("c", 9, at(100), "end")]], lambda s: live.debounced(s, "who"), "bursts")
    assert {(r["who"], r["request_id"], r["requests"]) for r in got} == want  # the last burst still waits


def test_stale_requests_go(spark, tmp_path):
    batches = [[("a", 1, at(0), ""), ("a", 3, at(1), ""), ("b", 5, at(1), "")], [("a", 2, at(2), ""), ("a", 4, at(3), ""), ("b", 5, at(4), ""), ("b", 1, at(5), "")]]
    got = run_stream(spark, tmp_path, batches, lambda s: live.without_stale(s, "who"), "fresh")
    assert sorted((r["who"], r["request_id"]) for r in got) == [("a", 1), ("a", 3), ("a", 4), ("b", 5), ("b", 5)]


def test_newest_events(spark):
    rows = [("a", i, at(i), "") for i in range(300)]
    assert {r["request_id"] for r in live.newest_events(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(200, 300))


def test_previews_are_used_again(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(10).selectExpr("id * 0.1 as pts")

    store = live.PreviewStore(spark, str(tmp_path))
    assert store.get(("q", 80), 0.0, 1.0, build).count() == 10
    assert store.get(("q", 80), 0.15, 0.45, build).count() == 3 and len(made) == 1
    store.get(("q", 70), 0.2, 0.5, build)
    store.get(("q", 80), 0.5, 1.5, build)
    assert len(made) == 3


def test_the_newest_job_wins(spark):
    latest, results = live.LatestWins(spark), {}
    spark.range(2).rdd.map(lambda x: x).count()  # so that the first job starts at once

    def slow():
        return spark.range(0, 8, 1, 2).rdd.map(lambda x: time.sleep(5)).count()

    first = threading.Thread(target=lambda: results.update(old=latest.run(slow)))
    began = time.time()
    first.start()
    time.sleep(4)
    results["new"] = latest.run(lambda: spark.range(5).count())
    first.join()
    assert results == {"old": None, "new": 5} and time.time() - began < 18


def test_progress():
    assert live.weighted_progress([(0.67, 1.0), (0.33, 0.5)]) == 0.67 + 0.33 * 0.5
    assert live.weighted_progress([]) == 0.0
