import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.operators import ranges, scan, timeline

SCHEMA = "clip string, at long, nr long, v string, keeps boolean, changed boolean, size long, done long"
ORDER = ["at", "nr"]


def made_up(n=3000, hot=0.9):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        clip = "hot" if rng.random() < hot else rng.choice(["a", "b", None, "c"])
        rows.append((clip, rng.randint(0, n), i, rng.choice(["x", "x", "y", None]), rng.random() < 0.3, rng.random() < 0.2, rng.randint(0, 9), rng.randint(0, 20 * n) // rng.choice([1, 7, 40])))
    return rows


@pytest.fixture
def frames(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 50)
    return spark.createDataFrame(made_up(), SCHEMA)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    assert Counter(map(tuple, a.select(names).collect())) == Counter(map(tuple, b.select(names).collect()))


def test_scans_equal_windows(frames):
    same(scan.numbered(frames, "clip", ORDER), timeline.numbered(frames, "clip", ORDER).withColumn("i", F.col("i").cast("long")))
    same(scan.monotonic(frames, "clip", ORDER, "done"), timeline.monotonic(frames, "clip", ORDER, "done"))
    same(scan.drop_unchanged(frames, "clip", ORDER, "changed", "keeps"), timeline.drop_unchanged(frames, "clip", ORDER, "changed", "keeps"))
    same(scan.collapse_runs(frames, "clip", ORDER, "v", ["nr", "size"]), timeline.collapse_runs(frames, "clip", ORDER, "v", ["nr", "size"]))


def test_bytes_and_lookups_equal_windows(spark, frames):
    from cadenza.operators import estimate

    numbered = timeline.numbered(frames, "clip", ORDER)
    same(scan.written_bytes(numbered, "clip", ["i"], F.col("size")), estimate.written_bytes(numbered, "clip", "i", F.col("size")))
    times = spark.createDataFrame([(c, t) for c in ("hot", "a", "b", "zz") for t in range(-5, 3100, 61)], "clip string, t long")
    same(scan.frame_at(frames, times, "clip", ["nr"], "at", "t", "nr"), timeline.frame_at(frames, times, "clip", ["nr"], "at", "t", "nr"))


@pytest.mark.parametrize("most", [7, 40, 30_000])
def test_limited_delays_equal_turns(frames, most):
    same(scan.limited_delays(frames, "clip", ORDER, "done", most=most), timeline.delays_in_turn(frames, "clip", ORDER, "done", most=most))


def test_empty_tables_and_null_ends(spark, frames):
    none = frames.limit(0)
    assert scan.limited_delays(none, "clip", ORDER, "done").collect() == scan.numbered(none, "clip", ORDER).collect() == []
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 9), (None, 1, 5)], "clip string, at long, done long")
    assert {(r.clip, r.at, r.delay) for r in scan.limited_delays(rows, "clip", ["at"], "done").collect()} == {("a", 1, 2), ("a", 2, 7), (None, 1, 5)}


def test_carries_compose():
    rng = random.Random(4)
    for _ in range(300):
        least, most = 2, rng.choice([2, 5, 30])
        ends = [rng.randint(-20, 300) for _ in range(rng.randint(0, 12))]
        carry = scan.Carry()
        for e in ends:
            carry.then(e, least, most)
        for total in range(-40, 340, 3):
            want = total
            for e in ends:
                want += min(max(e - want, least), most)
            assert carry(total) == want
        again = scan.Carry(carry.x.tolist(), carry.y.tolist())
        assert [again(t) for t in range(0, 300, 7)] == [carry(t) for t in range(0, 300, 7)]


def test_no_task_has_most_of_a_hot_clip(spark, frames, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for found in (scan.limited_delays(frames, "clip", ORDER, "done"), scan.drop_unchanged(frames.withColumn("changed", F.lit(True)), "clip", ORDER, "changed", "keeps")):
            counts = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(counts) == 3000 and max(counts) <= 2 * sum(counts) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block", [3, 16, 512])
def test_newest_holding_range_against_loops(spark, block):
    rng = random.Random(block)
    rows = []
    for i in range(400):
        low, high = sorted((rng.randint(0, 30), rng.randint(0, 30)))
        low, high = (None if rng.random() < 0.04 else low / 2), (None if rng.random() < 0.04 else high / 2)
        rows.append((rng.choice(["hot", "hot", "hot", "a", None]), rng.choice(["p", "q"]), i, rng.randint(0, 90), low, high))
    want, ends = {}, {i: (float("-inf") if a is None else a, float("inf") if b is None else b) for _, _, i, _, a, b in rows}
    in_turn = sorted(rows, key=lambda r: (r[3], r[2]))
    for k, r in enumerate(in_turn):
        lo, hi = ends[r[2]]
        want[r[2]] = next((o[2] for o in reversed(in_turn[:k]) if o[:2] == r[:2] and ends[o[2]][0] <= lo and hi <= ends[o[2]][1]), None)
    df = spark.createDataFrame(rows, "who string, what string, id long, at long, low double, high double")
    got = ranges.newest_holding(df, ["who", "what"], ["at", "id"], "id", "low", "high", block_rows=block)
    assert got.columns == [*df.columns, "reused"]
    assert {r.id: r.reused for r in got.collect()} == want
    assert ranges.newest_holding(df.limit(0), ["who"], ["at", "id"], "id", "low", "high").collect() == []


def test_stored_tables_are_deleted_on_request(spark, monkeypatch):
    import os

    from cadenza.sources import shared

    monkeypatch.setattr(shared, "_made", [])
    kept = shared.stored(spark.range(3), "kept")
    path = shared._made[0].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(path) and path.startswith(shared.folder(spark).removeprefix("file://"))
    shared.new_path(spark, "unwritten")
    shared.clean_up()
    assert not os.path.exists(path) and shared._made == []
