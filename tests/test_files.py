import numpy as np
import pytest

from cadenza.operators import frames as fr
from cadenza.plans.encode import encode_clips
from cadenza.sources import gif, lzw, sink, stills, video


def test_lzw_round_trip():
    rng = np.random.default_rng(0)
    for bits in range(2, 9):
        for n in (0, 1, 2, 7, 500, 20_000):
            for x in (rng.integers(0, 1 << bits, n), np.zeros(n, int), np.arange(n) % 3, np.where(np.arange(n) < n // 2, np.arange(n) % 4, rng.integers(0, 1 << bits, n))):
                x = x.astype(np.uint8)
                assert (lzw.decode(lzw.encode(x, bits), bits, n) == x).all(), (bits, n)


def test_lossy_lzw_stays_within_its_bound():
    rng = np.random.default_rng(1)
    palette = rng.integers(0, 256, (64, 3), dtype=np.uint8)
    x = rng.integers(0, 64, 5000).astype(np.uint8)
    plain = lzw.encode(x, 6)
    lossy = lzw.encode(x, 6, palette, 6000, clear_index=5)
    y = lzw.decode(lossy, 6, 5000)
    d = ((palette[x].astype(int) - palette[y]) ** 2 * [2, 3, 1]).sum(axis=1)
    assert d.max() <= 6000 and len(lossy) < len(plain) and ((x == 5) == (y == 5)).all()


def test_png_round_trip_and_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, 6, 4), dtype=np.uint8)
    assert (stills.decode_png(stills.encode_png(x)) == x).all()
    rows = x.reshape(5, 24).astype(int)
    lines = b""
    for y in range(5):
        up = rows[y - 1] if y else np.zeros(24, int)
        left = np.concatenate([np.zeros(4, int), rows[y][:-4]])
        corner = np.concatenate([np.zeros(4, int), up[:-4]])
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        guess = [np.zeros(24, int), left, up, (left + up) // 2, paeth][y]
        lines += bytes([y]) + ((rows[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = stills.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (stills.decode_png(data) == x).all()


def test_png_sequence_order_and_times(spark, tmp_path):
    for k in (1, 2, 10):
        (tmp_path / f"f{k}.png").write_bytes(stills.encode_png(np.full((2, 3, 4), k, np.uint8)))
    rows = sorted(stills.png_sequences(spark, f"file://{tmp_path}", fps=10, speed=2).collect(), key=lambda r: r["frame_index"])
    assert [r["rgba"][0] for r in rows] == [1, 2, 10] and [r["pts"] for r in rows] == pytest.approx([0, 0.05, 0.1])


def test_y4m(spark, tmp_path):
    frame = lambda v: b"FRAME\n" + bytes([v]) * 12 + bytes([128]) * 8
    (tmp_path / "a.y4m").write_bytes(b"YUV4MPEG2 W4 H3 F30:1 C420jpeg XCOLORRANGE=FULL\n" + b"".join(frame(v) for v in range(0, 240, 8)))
    rows = sorted(stills.y4m_videos(spark, f"file://{tmp_path}").collect(), key=lambda r: r["frame_index"])
    assert len(rows) == 30 and [r["rgba"][0] for r in rows] == list(range(0, 240, 8))
    fewer = sorted(stills.y4m_videos(spark, f"file://{tmp_path}", fps=7, speed=2).collect(), key=lambda r: r["frame_index"])
    kept = sorted({max(k, -(-k * 30 // 7) - 1) for k in range(8)} & set(range(30)))
    assert [r["rgba"][0] for r in fewer] == [8 * i for i in kept]
    assert [r["pts"] for r in fewer] == pytest.approx([i / 60 for i in kept])
    for bad in (b"YUV4MPEG2 W4 H3 Cmono\n", b"YUV4MPEG2 W4 H3 C420p10\n"):
        with pytest.raises(ValueError):
            video.header(bad)


def test_clips_become_gifs_and_come_back(spark):
    rng = np.random.default_rng(3)
    clips = {}
    for c in range(3):
        base = rng.integers(0, 4, (6, 8, 3)) * 80
        x = np.concatenate([np.repeat(base[None], 8, axis=0), np.full((8, 6, 8, 1), 255)], axis=-1).astype(np.uint8)
        for k in range(8):
            x[k, k // 2 % 6, 2:5, :3] = (k // 2) * 60
        clips[f"c{c}"] = x
    rows = [(c, i, 0.1 * i, 8, 6, bytearray(f.tobytes())) for c, x in clips.items() for i, f in enumerate(x)]
    files = encode_clips(spark.createDataFrame(rows, fr.FRAME)).cache()
    assert files.count() == 3
    back = gif.read_clips(files).collect()
    for c, x in clips.items():
        own = sorted((r for r in back if r["clip_id"] == c), key=lambda r: r["frame_index"])
        changes = [i for i in range(8) if i == 7 or (x[i] != x[i + 1]).any()]
        assert len(own) == len(changes)
        for r, i in zip(own, changes):
            assert bytes(r["rgba"]) == x[i].tobytes()
        assert sum(r["delay"] for r in own) == 80


def test_pixels_that_turn_clear_and_long_times(spark):
    x = np.zeros((5, 6, 8, 4), np.uint8)
    x[..., :] = (200, 40, 40, 255)
    x[1, 4:, 6:] = x[2, 4:, 6:] = (0, 90, 200, 255)
    x[2, 0:2, 0:3] = x[3, 0:2, 0:3] = 0
    x[4, 0:6, 0:4] = 0
    times = [0.0, 400.0, 400.1, 400.2, 400.3]
    rows = [("a", i, t, 8, 6, bytearray(f.tobytes())) for i, (t, f) in enumerate(zip(times, x))]
    back = gif.read_clips(encode_clips(spark.createDataFrame(rows, fr.FRAME))).collect()
    own = sorted(back, key=lambda r: r["frame_index"])
    assert len(own) == 5
    for r, f in zip(own, x):
        got = np.frombuffer(bytes(r["rgba"]), np.uint8).reshape(6, 8, 4)
        assert (got[..., 3] == f[..., 3]).all() and (got[f[..., 3] > 0] == f[f[..., 3] > 0]).all()
    assert [r["delay"] for r in own][:2] == [30_000, 10_010]


def noisy_clip():
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:24, 0:32]
    frames = []
    for k in range(4):
        rgb = np.stack([x * 8 % 256, y * 10, (x + y + 9 * k) * 4 % 256], axis=-1) + rng.integers(0, 12, (24, 32, 3))
        frames.append(np.concatenate([np.clip(rgb, 0, 255), np.full((24, 32, 1), 255)], axis=-1).astype(np.uint8))
    return [("a/b", i, 0.2 * i, 32, 24, bytearray(f.tobytes())) for i, f in enumerate(frames)]


def test_files_shrink_with_quality_and_hold_what_cells_do(spark, tmp_path):
    df = spark.createDataFrame(noisy_clip(), fr.FRAME)
    sizes = []
    for quality in (100, 70, 30):
        made = encode_clips(df, quality=quality, folder=f"file://{tmp_path}/q{quality}").collect()
        assert len(made) == 1 and made[0]["path"].endswith("a%2Fb.gif")
        data = open(made[0]["path"].removeprefix("file://"), "rb").read()
        assert len(data) == made[0]["bytes"] and made[0]["frames"] == len(gif.read(data)[3])
        assert data == bytes(encode_clips(df, quality=quality).first()["gif"])
        sizes.append(len(data))
    assert sizes[0] > sizes[1] > sizes[2]


def test_nothing_is_left_of_a_file_that_fails(spark, tmp_path):
    blocks = spark.createDataFrame([("a", k, 4, 3, 7, "keep" if k < 2 else "no such way", -1, bytearray(b"x")) for k in range(3)], "clip_id string, frame_index long, screen_width int, screen_height int, delay int, dispose string, clear int, block binary")
    with pytest.raises(Exception):
        gif.write_files(blocks, f"file://{tmp_path}/out").collect()
    assert not [*(tmp_path / "out").iterdir()]


def test_dithering_keeps_the_mean_and_known_colours():
    from cadenza.operators import palette

    own = np.array([[0, 0, 0], [255, 255, 255]], np.uint8)
    grey = np.full((16, 16, 4), 96, np.uint8)
    grey[..., 3] = 255
    grey[0, 0, :3] = 255
    index, clear = palette.remap(grey, own, None, np.zeros((16, 16), bool), 1.0)
    assert clear == -1 and index[0, 0] == 1 and abs(index.mean() * 255 - 96) < 16
    assert palette.remap(grey, own, None, np.zeros((16, 16), bool), 0.0)[0].sum() == 1


def test_gif_header_says_how_often():
    for repeat in (None, 0, 3):
        data = gif.header(4, 3, repeat) + gif.control_block(7, "background", -1) + gif.frame_block(0, 0, 4, 3, np.zeros(12, np.uint8), np.array([[1, 2, 3]], np.uint8), -1) + b"\x3b"
        width, height, found, frames = gif.read(data)
        assert (width, height, found, frames[0]["delay"], frames[0]["dispose"]) == (4, 3, repeat, 7, "background")


def y4m_file(path, frames, w=4, h=3, rate="30:1", chroma="444", mark=b"FRAME\n"):
    body = [mark + bytes([k % 256]) * (w * h) + bytes([128]) * (2 * w * h) for k in range(frames)]
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} F{rate} C{chroma} XCOLORRANGE=FULL\n".encode() + b"".join(body))


@pytest.mark.parametrize("mark", [b"FRAME\n", b"FRAME Xa=b\n"])
def test_video_is_read_by_ranges(spark, tmp_path, mark):
    for name, n in (("a", 50), ("b", 1), ("c", 0)):
        y4m_file(tmp_path / f"{name}.y4m", n, mark=mark)
    (tmp_path / "other.txt").write_text("no video")
    for fps in (None, 7, 100):
        df = video.read(spark, f"file://{tmp_path}", fps=fps, range_bytes=200)
        rows = sorted((r.clip_id, r.frame_index, r.rgba[0], r.pts) for r in df.collect())
        kept = [i for i in range(50) if fps != 7 or not i or (i + 1) * 7 // 30 > i * 7 // 30]
        assert rows == [(f"file://{tmp_path}/a.y4m", k, i, pytest.approx(i / 30)) for k, i in enumerate(kept)] + [(f"file://{tmp_path}/b.y4m", 0, 0, 0.0)]
    assert df.rdd.getNumPartitions() > 5


def test_ranges_of_files_beyond_two_gigabytes():
    head = video.header(b"YUV4MPEG2 W1920 H1080 F25:1 C420\n")
    step, base = video.frame_bytes(head), head["start"]
    assert step == 6 + 1920 * 1080 * 3 // 2
    size = base + 10_000 * step + 17  # 31 GB and a frame that was cut off
    cuts = [*range(0, size, video.RANGE_BYTES), size]
    found = [i for a, b in zip(cuts, cuts[1:]) for i in video.frames_of_range(a, b, size, head)]
    assert found == [*range(10_000)] and size > 1 << 34


def test_a_cut_frame_and_a_wrong_mark(spark, tmp_path):
    y4m_file(tmp_path / "a.y4m", 3)
    whole = (tmp_path / "a.y4m").read_bytes()
    (tmp_path / "a.y4m").write_bytes(whole[:-5])
    assert video.read(spark, f"file://{tmp_path}").count() == 2
    (tmp_path / "a.y4m").write_bytes(whole.replace(b"FRAME\n\x01", b"BADLY\n\x01"))
    with pytest.raises(Exception, match="frames of one length"):
        video.read(spark, f"file://{tmp_path}").count()


def blocks_of(spark, clips=6):
    rows = [(f"c/{c}", i, 2, 2, 5, "keep", -1, bytearray(gif_block(c, i))) for c in range(clips) for i in range(3)]
    return spark.createDataFrame(rows, "clip_id string, frame_index long, screen_width int, screen_height int, delay long, dispose string, clear int, block binary")


def gif_block(c, i):
    return b"," + bytes([0, 0, 0, 0, 2, 0, 2, 0, 0]) + bytes([2, 2, 0x44, c * 16 + i, 0])


def test_sink_gives_what_files_give(spark, tmp_path):
    blocks = blocks_of(spark)
    sink.save(blocks, f"file://{tmp_path}/out", repeat=3)
    want = {r.clip_id: bytes(r.gif) for r in gif.files(blocks, 3).collect()}
    got = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert got == {f"{k.replace('/', '%2F')}.gif": v for k, v in want.items()}
    sink.save(blocks.filter("clip_id = 'c/0'"), f"file://{tmp_path}/out", repeat=None, mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["c%2F0.gif"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    blocks = blocks_of(spark).withColumn("delay", F.when((F.col("clip_id") == "c/3") & (F.col("frame_index") == 2), F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("delay")))
    with pytest.raises(Exception):
        sink.save(blocks, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or [*(tmp_path / "out").iterdir()] == []


def test_a_doubled_task_leaves_one_file(spark, tmp_path):
    batches = lambda: iter(blocks_of(spark, 2).toArrow().to_batches())
    writer = sink.ClipWriter(f"file://{tmp_path}/out", 0, False)
    first, second = writer.write(batches()), writer.write(batches())
    assert len(first.files) == len(second.files) == 2
    writer.commit([second, None])  # the other attempt is forgotten
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["c%2F0.gif", "c%2F1.gif"]
    torn = sink.ClipWriter(f"file://{tmp_path}/out", 0, False)
    with pytest.raises(ValueError, match="one partition"):
        torn.commit([torn.write(batches()), torn.write(batches())])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["c%2F0.gif", "c%2F1.gif"]
    with pytest.raises(ValueError, match="missing"):
        sink.ClipSink({"path": "x"}).writer(blocks_of(spark).drop("delay").schema, False)
