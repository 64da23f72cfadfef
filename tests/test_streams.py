import datetime as dt
import time

import numpy as np
import pytest

from cadenza.functions import pixels
from cadenza.operators import smooth

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stateful(spark):
    """The state store that timers and expiry need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def fed(spark, tmp_path, schema, batches, plan, name, mode="append", pause=0.0, wanted=0):
    """What a stream gives whose files come one after another."""
    source = f"{tmp_path}/{name}-in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-check")
    if not pause:
        query.trigger(availableNow=True).start().awaitTermination()
    else:
        running = query.trigger(processingTime="200 milliseconds").start()
        end, rows = time.time() + 60, -1
        while time.time() < end and running.exception() is None and rows < wanted:
            time.sleep(0.5)
            rows = spark.table(name).count()
        time.sleep(pause)
        running.stop()
        assert running.exception() is None
    return spark.sql(f"select * from {name}").collect()


FRAMES = "clip_id string, frame_index long, rgba binary, blur binary, is_last boolean"


def clips():
    rng = np.random.default_rng(3)
    found = {}
    for name, n in (("a", 9), ("b", 3), ("c", 6)):
        x = np.repeat(rng.integers(0, 256, (n, 1, 10, 4)), 1, axis=0).astype(np.uint8)
        x[1::2] = x[: n - 1 : 2][: len(x[1::2])]
        x[..., 3] = np.where(rng.random((n, 1, 10)) < 0.1, 0, 255)
        found[name] = (x, np.stack([pixels.blur(f) for f in x]))
    return found


@pytest.mark.parametrize("tile", [4096, 4])
def test_smoothing_stream_equals_the_table(stateful, tmp_path, tile):
    own, batches = clips(), [[] for _ in range(3)]
    for name, (x, blur) in own.items():
        for t in range(len(x)):
            batches[t * 3 // len(x)].append((name, t, bytearray(x[t].tobytes()), bytearray(blur[t].tobytes()), t == len(x) - 1 and name != "c"))
    name = f"smooth{tile}"
    rows = fed(stateful, tmp_path, FRAMES, batches, lambda s: smooth.smoothing_stream(s, 70, tile_pixels=tile, quiet=1.0), name, pause=0.5, wanted=sum(len(x) * -(-10 // tile) for x, _ in own.values()))
    got = {}
    for r in sorted(rows, key=lambda r: r.tile):
        a, b = got.get((r.clip_id, r.frame_index), (b"", b""))
        got[r.clip_id, r.frame_index] = a + bytes(r.rgba), b + bytes(r.importance)
    want = {}
    for name, (x, blur) in own.items():
        out, weight = smooth.smooth(x.reshape(len(x), -1, 4), blur.reshape(len(x), -1, 3), 70)
        want |= {(name, t): (out[t].tobytes(), weight[t].tobytes()) for t in range(len(x))}
    assert got == want  # the clip without an end is given after a time of quiet


REQUESTS = "who string, request_id long, ts timestamp, setting string"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_settled_requests_of_a_stream_and_of_a_table(stateful, tmp_path):
    from cadenza.streaming import bursts

    rows = [("a", 1, at(0), "x"), ("a", 3, at(0.1), "y"), ("a", 2, at(0.2), "stale"), ("a", 7, at(5), "z"), ("a", 6, at(5.1), "stale"), ("b", 4, at(0.05), "q"), ("b", 2, at(9), "a new burst")]
    want = {("a", 3, "y", 2), ("a", 7, "z", 1), ("b", 4, "q", 1), ("b", 2, "a new burst", 1)}
    table = bursts.settled(stateful.createDataFrame(rows, REQUESTS), "who", quiet=0.5)
    assert {(r.who, r.request_id, r.setting, r.requests) for r in table.collect()} == want
    late = [("a", 5, at(5.2), "overtaken, and later than the watermark")]
    batches = [rows[:2], rows[2:], [("c", 9, at(100), "")], late, [("c", 10, at(200), "end")]]
    got = fed(stateful, tmp_path, REQUESTS, batches, lambda s: bursts.settled(s, "who", quiet=0.5), "settled")
    assert {(r.who, r.request_id, r.setting, r.requests) for r in got} == want | {("c", 9, "", 1)}  # the last one still waits


def test_quiet_keys_have_no_state(stateful, tmp_path):
    from cadenza.streaming import bursts

    batches = [[(f"k{i}", 1, at(0), "") for i in range(50)], [("last", 1, at(100), "")], [("last", 2, at(200), "")]]
    fed(stateful, tmp_path, REQUESTS, batches, lambda s: bursts.settled(s, "who", quiet=0.5), "quiet")
    left = stateful.read.format("statestore").option("stateVarName", "burst").load(f"{tmp_path}/quiet-check")
    assert [r.key.who for r in left.collect()] == ["last"]


def test_a_reader_that_is_behind_gets_the_newest(spark, tmp_path):
    import json

    from cadenza.sources import events

    def write(name, first, n):
        (tmp_path / f"{name}.tmp").write_text("".join(json.dumps({"request_id": i, "key": f"k{i % 3}"}) + "\n" for i in range(first, first + n)))
        (tmp_path / f"{name}.tmp").rename(tmp_path / f"{name}.jsonl")

    events.register(spark)
    seen = []
    stream = spark.readStream.format("newest_events").option("path", f"file://{tmp_path}").load()

    def run():
        query = stream.writeStream.foreachBatch(lambda df, k: seen.append(sorted((r.request_id, r.dropped) for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            end = time.time() + 40
            while time.time() < end and not seen:
                time.sleep(0.2)
            query.processAllAvailable()
        finally:
            query.stop()

    write("a", 0, 30)
    write("b", 30, 320)
    run()  # behind by 350
    assert seen == [[(250, 250), *((i, 0) for i in range(251, 350))]]
    write("c", 350, 60)
    seen.clear()
    run()  # goes on where it was
    assert seen == [[(i, 0) for i in range(350, 410)]]


def test_progress_counts_rows_and_abort_ends_its_own_jobs(spark, tmp_path):
    from threading import Thread

    from pyspark.sql import functions as F

    from cadenza.streaming import progress

    said = []
    watch = progress.Progress(spark, lambda name, rows: said.append((name, rows)))
    try:
        events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
        watch.watched(events, "table").write.format("noop").mode("overwrite").save()
        assert watch.done("table") == events.count()
        fed(spark, tmp_path, REQUESTS, [[("a", i, at(i), "") for i in range(7)], [("b", 1, at(1), "")]], lambda s: watch.watched(s, "stream"), "counted")
        end = time.time() + 10
        while watch.rows["stream"] < 8 and time.time() < end:
            time.sleep(0.2)
        assert watch.rows["stream"] == 8 and [x for x in said if x[0] == "stream"] == [("stream", 7), ("stream", 8)]
    finally:
        watch.close()

    ended = {}
    slow = F.udf(lambda i: time.sleep(20 if i >= 0 else 0) or i, "long")

    def run(tag, df):
        with progress.tagged(spark, tag):
            try:
                ended[tag] = df.collect()
            except Exception as e:
                ended[tag] = e

    threads = [Thread(target=run, args=x) for x in (("gone", spark.range(0, 2, 1, 2).select(slow("id"))), ("stays", spark.range(0, 1, 1, 1).select(F.udf(lambda i: time.sleep(4) or i, "long")("id"))))]
    for t in threads:
        t.start()
    time.sleep(3)
    progress.abort(spark, "gone")
    began = time.time()
    for t in threads:
        t.join(30)
    assert isinstance(ended["gone"], Exception) and ended["stays"][0][0] == 0 and time.time() - began < 15
