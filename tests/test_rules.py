import math

from pyspark.sql import functions as F

from cadenza.functions import rules, validation
from cadenza.operators import estimate, sampling, timeline


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


L = F.lit


def test_output_sizes(spark):
    def size(w, h, ww=None, wh=None):
        k = max(math.floor(math.sqrt((w * h + 240_000) / 480_000) + 0.5), 1)
        if ww is None and wh is None:
            return w // k, h // k
        if ww is not None and wh is not None:
            return min(ww, w), min(wh, h)
        if ww is not None:
            return min(ww, w), h * min(ww, w) // w
        return w * min(wh, h) // h, min(wh, h)

    for args in ((1920, 1080), (640, 480), (1, 1), (5000, 3000), (800, 600, 100), (800, 600, None, 99), (800, 600, 1000, 1000), (333, 777, 100, 50)):
        r = one(spark, rules.output_size(*(L(x) if x is not None else None for x in args)).alias("s"))["s"]
        assert (r["width"], r["height"]) == size(*args)


def test_colours(spark):
    r = one(spark, rules.parse_colours(L("#123456 78abCD,, ,")).alias("a"), rules.parse_colours(L("#12345")).alias("b"))
    assert [tuple(x) for x in r["a"]] == [(0x12, 0x34, 0x56), (0x78, 0xAB, 0xCD)] and r["b"] is None
    colour = lambda r, g, b: F.struct(L(r).alias("r"), L(g).alias("g"), L(b).alias("b"))
    r = one(spark, rules.colour_distance(colour(1, 2, 3), colour(4, 4, 4)).alias("d"), rules.cohort(L(200), L(50), L(10)).alias("c"), rules.over_matte(L(100), L(128), L(0)).alias("m"), rules.importance(L(5000), L(25), L(10), L(110)).alias("i"))
    assert (r["d"], r["c"], r["m"], r["i"]) == (2 * 9 + 3 * 4 + 1, True, 100 * 128 // 255, 120)


def test_ratios_and_numbers(spark):
    r = one(spark, rules.whole_ratio(L(1920), L(1080)).alias("a"), rules.closest_ratio(L(1999), L(1001)).alias("b"), rules.closest_ratio(L(16), L(9)).alias("c"), rules.number_field(L("a01b2c345678")).alias("n"), rules.padded_palette(L(5)).alias("p"), rules.most_colours(L(10), 3).alias("m"), rules.four_cc(L(0x61766331)).alias("f"))
    assert tuple(r["a"]) == (16, 9) and tuple(r["b"]) == (2, 1) and tuple(r["c"]) == (16, 9)
    assert (r["n"], r["p"], r["m"], r["f"]) == (12345, 8, 32, "avc1")


def test_crops_and_ranges(spark):
    rect = lambda x, y, w, h: F.struct(L(float(x)).alias("x"), L(float(y)).alias("y"), L(float(w)).alias("width"), L(float(h)).alias("height"))
    span = lambda a, b: F.struct(L(float(a)).alias("lo"), L(float(b)).alias("hi"))
    r = one(
        spark, rules.crop_inside(rect(-10, 0, 50, 30), L(100.0), L(80.0)).alias("a"), rules.crop_inside(rect(200, 0, 50, 30), L(100.0), L(80.0)).alias("b"),
        rules.centred_crop(L(1.0), L(1.0), L(200.0), L(100.0)).alias("c"), rules.contains_range(span(1, 1.5), span(1.2, 1.3)).alias("d"),
        rules.widen_range(span(1, 1.05), 0.1, span(0, 10)).alias("e"), rules.widen_range(span(9.98, 10), 0.1, span(0, 10)).alias("f"), rules.clamp_range(span(-5, 20), span(0, 10)).alias("g"),
    )
    assert tuple(r["a"]) == (0, 50, 40, 30) and r["b"] is None and tuple(r["c"]) == (0.25, 0, 0.5, 1) and r["d"]
    assert abs(r["e"]["hi"] - 1.1) < 1e-9 and abs(r["f"]["lo"] - 9.9) < 1e-9 and r["f"]["hi"] == 10 and tuple(r["g"]) == (0, 10)


def test_presets(spark):
    r = one(spark, rules.preset_sizes(L(700), L(350)).alias("s"), rules.preset_percents(L(700), L(350)).alias("p"))
    widths = [x["width"] for x in r["s"]]
    assert widths == sorted(widths, reverse=True) and widths[0] == 700 and max(widths) <= 700 and r["s"][0]["height"] == 350
    assert tuple(r["p"][1]) == (50, 350, 175)


def test_reasons_in_order(spark):
    fine = {"size": 10, "is_movie": True, "code": "avc1", "has_audio": True, "has_video": True, "is_protected": False, "is_decodable": True, "fps": 25.0, "duration": 2.0, "width": 10, "height": 10}
    cases = [({}, None), ({"size": 0, "is_movie": False}, "empty file"), ({"is_movie": False}, "not a video"), ({"code": "rle "}, "animation codec"), ({"has_video": False}, "audio only"), ({"has_video": False, "has_audio": False}, "no video track"), ({"is_protected": True}, "protected"), ({"is_decodable": False}, "not decodable though its codec is known"), ({"is_decodable": False, "code": None}, "unknown codec"), ({"is_decodable": False, "code": "hev1"}, "unsupported kind of HEVC"), ({"is_decodable": False, "code": "abcd"}, "unsupported codec"), ({"code": None}, "no codec title"), ({"fps": None}, "no metadata"), ({"width": 3}, "under 4 x 4 pixels")]
    schema = "n int, size long, is_movie boolean, code string, has_audio boolean, has_video boolean, is_protected boolean, is_decodable boolean, fps double, duration double, width int, height int"
    rows = [(n, *(fine | change).values()) for n, (change, _) in enumerate(cases)]
    got = {r["n"]: r["reason"] for r in validation.with_reason(spark.createDataFrame(rows, schema)).collect()}
    assert got == {n: want for n, (_, want) in enumerate(cases)}


def test_lookups(spark):
    r = one(spark, validation.matrix_of(L(" BT709 ")).alias("a"), validation.matrix_of(L("x")).alias("b"), validation.video_frames_estimate(L(10_000), L(100), L(40), L(30), L("420jpeg")).alias("n"), validation.codec_of(L("nope")).alias("c"))
    assert (r["a"], r["b"], r["n"], r["c"]) == ("bt709", None, 9900 // (40 * 30 * 6 // 4 + 6), None)
    kinds = one(spark, *(rules.sniff_type(L(bytearray(h)), L(n)).alias(f"k{i}") for i, (h, n) in enumerate([(b"\x89PNG..", "a.bin"), (b"GIF89a", "b"), (b"YUV4", "c"), (b"\xff\xd8..", "d"), (b"xxxx", "e.Y4M"), (b"xxxx", "f")])))
    assert list(kinds) == ["png", "gif", "y4m", "jpeg", "y4m", None]


def test_natural_order_and_samples(spark):
    names = ["f10.png", "f2.png", "f1.png", "g1", "f02b.png", "f2.10", "f2.9"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(sampling.natural_key(F.col("n"))).collect()]
    assert got.index("f1.png") < got.index("f2.png") < got.index("f10.png") and got.index("f2.9") < got.index("f2.10")
    for n in (1, 7, 30, 101):
        r = one(spark, sampling.even_positions(L(n), 5).alias("p"))["p"]
        assert r == [(j * n + n // 2) // 5 for j in range(5)]


def test_decimation_and_delays(spark):
    for source, wanted in (((30, 1), (7, 1)), ((25, 1), (24, 1)), ((30000, 1001), (10, 1)), ((10, 1), (20, 1)), ((24, 1), (12, 1))):
        got = sorted(r["i"] for r in timeline.decimate(spark.range(200).withColumnRenamed("id", "i"), source, wanted).collect())
        up, down = source[0] * wanted[1], source[1] * wanted[0]
        want = sorted({max(k, -(-k * up // down) - 1) for k in range(201)} & set(range(200))) if up > down else list(range(200))
        assert got == want
    ends = [0, 3, 3, 4, 100, 101, 102, 40_000]
    rows = spark.createDataFrame([(1, i, e) for i, e in enumerate(ends)], "clip long, i long, e long")

    def fold(most):
        total, out = 0, []
        for e in ends:
            out.append(min(max(e - total, 2), most))
            total += out[-1]
        return out

    assert [r["delay"] for r in timeline.delay_ticks(rows, "clip", ["i"], "e").orderBy("i").collect()] == fold(10**9)
    assert [r["delay"] for r in timeline.delays_in_turn(rows, "clip", ["i"], "e").orderBy("i").collect()] == fold(30_000)


def test_times_and_lookup(spark):
    clips = spark.createDataFrame([("a", 1.0, 4.0, 0.5), ("b", 0.3, 4.0, 0.0)], "clip string, duration double, fps double, start double")
    got = [(r["clip"], r["k"], r["time"]) for r in timeline.sample_times(clips).orderBy("clip", "k").collect()]
    assert got == [("a", k, 0.5 + k / 4) for k in range(4)] + [("a", 4, 1.5)]
    assert [r["clip"] for r in timeline.too_short(clips).collect()] == ["b"]
    frames = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 3.0)], "clip string, i long, pts double")
    times = spark.createDataFrame([("a", -1.0), ("a", 0.5), ("a", 1.0), ("a", 9.0), ("b", 1.0)], "clip string, t double")
    found = {(r["clip"], r["t"]): r["found"] for r in timeline.frame_at(frames, times, "clip", ["i"], "pts", "t", "i").collect()}
    assert found == {("a", -1.0): None, ("a", 0.5): 0, ("a", 1.0): 2, ("a", 9.0): 3, ("b", 1.0): None}
    again = timeline.resample(frames, spark.createDataFrame([("a", 4.0)], "clip string, duration double"), "clip", ["i"], "pts", "i", fps=1.0, speed=2.0).orderBy("k").collect()
    assert [(r["k"], r["pts"], r["i"]) for r in again] == [(0, 0.0, 0), (1, 1.0, 2)]


def test_estimates(spark):
    r = one(spark, estimate.remaining_seconds(L(10.0), L(0.5)).alias("a"), estimate.remaining_seconds(L(2.0), L(0.1)).alias("b"), estimate.progress(L(5), L(4)).alias("c"), estimate.output_duration(L(1.0), L(3.0), L(9.0), L(True)).alias("d"), estimate.naive_size(L(10), L(10), L(3), L(1.0)).alias("e"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (10.0, None, 1.0, 4.0, 100.0)


def test_dragging_a_crop(spark):
    crop = F.struct(L(0.2).alias("x"), L(0.2).alias("y"), L(0.5).alias("width"), L(0.5).alias("height"))
    drag = lambda h, dx, dy: rules.dragged_crop(crop, L(h), L(dx), L(dy), L(0.1), L(0.1))
    r = one(spark, drag("top_left", 0.1, -0.5).alias("a"), drag("right", 0.9, 0.9).alias("b"), drag("bottom", 0.3, -0.9).alias("c"), rules.moved_crop(crop, L(0.9), L(-0.1)).alias("d"), rules.handle_position(L("nowhere")).alias("e"), rules.crop_field(L(20), L(500)).alias("f"), rules.ratio_field(L(120)).alias("g"))
    near = lambda x, want: all(abs(a - b) < 1e-9 for a, b in zip(x, want, strict=True))
    assert near(r["a"], (0.3, 0.0, 0.4, 0.7)) and near(r["b"], (0.2, 0.2, 0.8, 0.5)) and near(r["c"], (0.2, 0.2, 0.5, 0.1))
    assert near(r["d"], (0.5, 0.1, 0.5, 0.5)) and r["e"] is None and (r["f"], r["g"]) == (100, 99)


def test_path_problems(tmp_path):
    from cadenza.sources import paths

    (tmp_path / "a.png").write_bytes(b"x")
    assert paths.path_problem(str(tmp_path / "a.png")) is None
    assert "folder" in paths.path_problem(str(tmp_path)) and "matches" in paths.path_problem(str(tmp_path / "*.png"))
    assert "output" in paths.path_problem(str(tmp_path / "b.gif")) and "no folder" in paths.path_problem(str(tmp_path / "x/y.png"))
    assert paths.list_problem(["a.png"]) and paths.list_problem(["a.mp4"]) is None
    assert paths.list_problem(["a.png", "b.jpg"]) and paths.list_problem(["a.png", "b.png"]) is None
