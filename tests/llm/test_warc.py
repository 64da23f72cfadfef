import hashlib

from cadenza.llm import warc


def pages(spark):
    same, short = "<p>" + "same payload " * 20 + "</p>", "<p>short</p>"
    rows = [(i, f"http://www.example.com/{i % 7}?b={i}", same if i % 3 == 0 else f"<html>{'page %d ' % i * 30}</html>", "x") for i in range(1, 400)]
    rows += [(1000, None, None, "x"), (1001, "", "", "x"), (1002, "http://[bad/é x", short, "x"), (1003, "HTTPS://Sub.Example.org:8443", short, "x"), (None, "http://a.b/", same, "x"), (None, "http://a.b/", "only without id " * 10, "x"), (None, "http://a.b/", "only without id " * 10, "x")]
    rows += [(5, "http://www.example.com/5", "<html>" + "page 5 " * 30 + "</html>", "x")] * 2  # repeated rows
    rows += [(2000 + i, "http://hot.example/", f"v{i // 2} " * 60, "x") for i in range(300)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def expected(rows):
    first = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and data in first and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


def test_archives_and_merged_index(spark, tmp_path):
    rows, df = pages(spark)
    want = expected(rows)
    captures = warc.archive_pages(df, f"file://{tmp_path}/one")
    got = captures.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want
    order = [(r["urlkey"].encode(), r["timestamp"]) for r in got]
    assert order == sorted(order)


def test_many_runs_are_merged_in_levels(spark, tmp_path):
    rows, df = pages(spark)
    archives = warc.write_archives(warc.plan_records(df.repartition(6)), f"file://{tmp_path}/archives")
    runs = warc.index_runs(archives, f"file://{tmp_path}/runs", run_captures=9)
    assert runs.count() > 50
    merged = warc.merge_runs(runs, f"file://{tmp_path}/merged", fan_in=8, slice_captures=4).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in merged), key=str) == expected(rows)
    order = [(r["urlkey"].encode(), r["timestamp"]) for r in merged]
    assert order == sorted(order)


def test_archives_roll_over_and_hold_long_pages(spark, tmp_path):
    rows = [(1, "http://a.b/", "x" * 3_000_000, 1, "k"), (2, "http://a.b/", "x" * 3_000_000, 2, "k")] + [(i, f"http://a.b/{i}", f"{i} " * 300, 3, "k") for i in range(3, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first int, key string").coalesce(1)
    archives = warc.write_archives(warc.plan_records(df), f"file://{tmp_path}/archives", archive_bytes=2_000)
    assert archives.count() > 3
    got = warc.merge_runs(warc.index_runs(archives, f"file://{tmp_path}/runs"), f"file://{tmp_path}/merged").collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(expected([r[:4] for r in rows]))


def test_history_query(spark):
    sf = "/root/testdata/sf0.001"
    got = warc.warc_history(spark, sf).collect()
    keys = [(r["urlkey"].encode(), r["timestamp"]) for r in got]
    assert keys == sorted(keys)
    want = [(r["page_id"], warc.url_key(r["url"]), f"{warc.capture_time(r['page_id']):%Y%m%d%H%M%S}") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((r["page_id"], r["urlkey"], r["timestamp"]) for r in got) == sorted(want)


def test_records_hold_the_payloads(spark, tmp_path):
    rows, df = pages(spark)
    archives = warc.write_archives(warc.plan_records(df), f"file://{tmp_path}/archives")
    for r in warc.read_records(archives).collect():
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["digest"]
        else:
            assert r["payload"] is None
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)


def test_no_pages(spark, tmp_path):
    _, df = pages(spark)
    assert warc.archive_pages(df.limit(0), f"file://{tmp_path}/none").collect() == []


def test_loser_tree():
    import random

    rng = random.Random(0)
    for k in range(20):
        runs = [sorted(bytes(rng.choices(b"abc", k=3)) + b"\n" for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.com/a?b=1") == "com,example)/a?b=1"
    assert warc.url_key("https://x.example.org:8443/") == "org,example,x:8443)/"
    assert "\t" not in warc.url_key("a\tb") and " " not in warc.url_key("http://a.b/c d")
