import os

import pyarrow as pa

from cadenza.llm import common


def test_clean_up_deletes_what_operators_left(spark, monkeypatch):
    monkeypatch.setattr(common, "_made", [])
    _, first = common.stored(spark.range(3), "a")
    _, second = common.stored(spark.range(3), "b")
    common.work_dir(spark, "unwritten")
    common.remove(first)
    paths = [x.removeprefix("file://") for x in (first, second)]
    assert [os.path.exists(x) for x in paths] == [False, True]
    common.clean_up()
    assert not os.path.exists(paths[1]) and common._made == []


def test_slices_hold_so_much_text_or_one_row():
    texts = ["a" * 10, None, "b" * 95, "", "c" * 250, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "text"])
    parts = [*common.text_slices(batch, "text", 100)]
    assert [t for _, found in parts for t in found] == [t or "" for t in texts]
    assert all(sum(map(len, found[1:])) <= 100 for _, found in parts) and len(parts) == 3
    assert [*common.text_slices(batch.slice(0, 0), "text", 100)] == []
