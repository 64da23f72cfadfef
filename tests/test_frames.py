import numpy as np
import pytest

from cadenza.functions import pixels
from cadenza.operators import frames as fr
from cadenza.operators import palette, smooth

W, B, T, X = (254, 253, 252, 255), (8, 7, 0, 255), (0, 0, 0, 0), (4, 5, 6, 255)
V, C = (255, 254, 253, 255), (1, 2, 3, 255)
SEQUENCES = {"one": [(255, 255, 255, 255)], "two": [W, B], "three": [W, B, B], "four": [W, T, B, W], "five": [W, T, B, B, W], "six": [W, B, B, T, W, X], "many": [V, V, C, C, C, T, C]}


@pytest.mark.parametrize("name", SEQUENCES)
def test_published_sequences_keep_their_colours(name):
    x = np.array(SEQUENCES[name], np.uint8).reshape(-1, 1, 4)
    blur = np.stack([pixels.blur(f.reshape(1, 1, 4)).reshape(1, 3) for f in x])
    out, weight = smooth.smooth(x, blur, 100)
    assert (out == np.where(x[..., 3:] >= 128, x, 0)).all()
    assert weight[0, 0] > 0 or x[0, 0, 3] < 128


def pixel_by_pixel(clip, blur, quality):
    """One pixel's colours and importance, by lists and integers, a frame at a time."""
    n, base = len(clip), (55 - quality // 2) ** 2
    gap = lambda a, b: 2 * (a[0] - b[0]) ** 2 + 3 * (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    screen, promised, stayed, out = None, 0, 0, []
    for t in range(n):
        ahead = [(clip[k][:3], blur[k]) if k < n and clip[k][3] >= 128 else None for k in range(t, t + 5)]
        if ahead[0] is None:
            out.append(((0, 0, 0, 0), 1 if screen else 0))
            promised = 0 if screen else promised
            screen = None
            continue
        now, soft = ahead[0]
        pushed = t + 5 if t + 5 <= n else t + 4
        limit = base if ((now[0] // 2 > now[1]) != (now[2] > 127)) != bool(pushed % 2) else 2 * base
        off = 1 << 20
        if screen:
            a, b = gap(screen, now), gap(screen, soft)
            off = a if a < b else (a + b) // 2
        weigh = lambda least, most: least + min(max(off - limit, 0) * most // (limit * 48), most)
        if stayed < promised:
            second = limit < 300 and stayed < 3 or 300 <= limit < 500 and stayed < 2 or 400 <= limit < 900 and stayed < 1
            out.append(((*screen, 255), weigh(int(second), 0 if stayed else [0, 40, 80, 100, 110][promised])))
            stayed += 1
        elif off < limit:
            out.append(((*screen, 255), 0))
        else:
            lasts = 0
            for k in range(1, 5):
                if ahead[k] is None or not (gap(ahead[k][0], now) < limit or gap(ahead[k][1], soft) < limit):
                    break
                lasts = k
            first = [sorted(x[0][c] for x in ahead[: lasts + 1][:3]) for c in range(3)]
            middle = {0: lambda v: v[0], 1: lambda v: sum(v) // 2, 2: lambda v: v[1], 3: lambda v: (v[1] + v[2]) // 2, 4: lambda v: v[2]}[lasts]
            screen = tuple(map(middle, first))
            out.append(((*screen, 255), weigh(*[(10, 110), (5, 80), (15, 190), (50, 205), (50, 205)][lasts])))
            if lasts:
                promised, stayed = lasts, 0
    return out


@pytest.mark.parametrize("quality", [100, 80, 60, 40, 1])
@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 40])
def test_smoothing_against_loops(quality, n):
    rng = np.random.default_rng(n)
    steps = rng.integers(0, 256, (8, 60, 4))
    x = steps[np.sort(rng.integers(0, 8, (n, 60)), axis=0), np.arange(60)] + rng.integers(-9, 10, (n, 60, 4))
    x = np.clip(x, 0, 255).astype(np.uint8)
    x[..., 3] = np.where(rng.random((n, 60)) < 0.15, 100, 200)
    blur = np.clip(x[..., :3].astype(int) + rng.integers(-20, 21, (n, 60, 3)), 0, 255).astype(np.uint8)
    out, weight = smooth.smooth(x, blur, quality)
    for k in range(60):
        want = pixel_by_pixel([tuple(map(int, p)) for p in x[:, k]], [tuple(map(int, p)) for p in blur[:, k]], quality)
        assert [(tuple(map(int, c)), int(w)) for c, w in zip(out[:, k], weight[:, k])] == want


def test_smoothing_keeps_five_frames():
    own = smooth.Smoother(10, 80)
    rng = np.random.default_rng(0)
    size = None
    for t in range(300):
        own.push(rng.integers(0, 256, (10, 4), dtype=np.uint8), rng.integers(0, 256, (10, 3), dtype=np.uint8))
        state = own.saved()
        assert size in (None, len(state))
        size = len(state)
        if t % 50 == 0:
            own = smooth.Smoother.restored(state, 80)
    assert len([*own.flush()]) == 4


def random_clip(rng, n=8, w=9, h=5):
    x = np.repeat(rng.integers(0, 256, (n // 2, h, w, 4)), 2, axis=0).astype(np.uint8)
    x[..., 3] = np.where(rng.random((n, h, w)) < 0.1, 0, 255)
    return x


def table(spark, clips):
    rows = [(f"c{c}", i, i / 10, x.shape[2], x.shape[1], bytearray(f.tobytes())) for c, x in enumerate(clips) for i, f in enumerate(x)]
    return spark.createDataFrame(rows, fr.FRAME)


def test_tiles_make_no_difference(spark):
    rng = np.random.default_rng(0)
    clips = [random_clip(rng), random_clip(rng, 4)]
    df = fr.with_blur(table(spark, clips))
    for tile in (7, 4096):
        got = smooth.smoothed(df, quality=60, tile_pixels=tile).collect()
        assert len(got) == sum(map(len, clips))
        for r in got:
            x = clips[int(r["clip_id"][1])]
            blur = np.stack([pixels.blur(f) for f in x])
            out, weight = smooth.smooth(x.reshape(len(x), -1, 4), blur.reshape(len(x), -1, 3), 60)
            assert bytes(r["rgba"]) == out[r["frame_index"]].tobytes() and bytes(r["importance"]) == weight[r["frame_index"]].tobytes()


def test_kernels():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (6, 7, 4), dtype=np.uint8)
    assert (pixels.resize(x, 7, 6) == x).all()
    flat = np.full((8, 8, 4), 77, np.uint8)
    assert (pixels.resize(flat, 3, 5) == 77).all()
    assert set(np.unique(pixels.solid_or_clear(x)[..., 3])) <= {0, 255}
    m = pixels.over_matte(x, (10, 20, 30))
    half = (x[..., 3] > 0) & (x[..., 3] < 255)
    assert (m[half][:, 3] == 255).all() and (m[~half] == x[~half]).all()
    argb = x[..., [3, 0, 1, 2]].tobytes()
    assert (pixels.unpack(argb, 7, 6, "argb") == x).all()
    padded = np.concatenate([x, np.zeros((6, 2, 4), np.uint8)], axis=1).tobytes()[:-8]
    assert (pixels.unpack(padded, 7, 6, "rgba", 9) == x).all()
    for bad in ((0, 6, None), (7, 6, 5), (8, 6, None)):
        with pytest.raises(ValueError):
            pixels.unpack(x.tobytes(), bad[0], bad[1], "rgba", bad[2])
    assert pixels.crop(x, 1, 2, 3, 4).shape == (4, 3, 4) and pixels.crop(x, 5, 0, 3, 1) is None
    grey = pixels.yuv_to_rgba(np.full((4, 4), 235, np.uint8), np.full((2, 2), 128, np.uint8), np.full((2, 2), 128, np.uint8))
    assert (grey == 255).all()


def brute_blur(x, median):
    h, w = x.shape[:2]
    out = np.zeros((h, w, 3), np.uint8)
    for i in range(h):
        for j in range(w):
            near = [x[min(max(i + a, 0), h - 1), min(max(j + b, 0), w - 1)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
            near = [tuple(map(int, (p if p[3] > 0 else x[i, j])[:3])) for p in near]
            mix = [sorted(p[c] for p in near)[4] if median else sum(p[c] for p in near) // 9 for c in range(3)]
            d = [int(x[i, j, c]) - mix[c] for c in range(3)]
            out[i, j] = (255, 0, 255) if x[i, j, 3] == 0 else mix if 2 * d[0] ** 2 + 3 * d[1] ** 2 + d[2] ** 2 < 1536 else x[i, j, :3]
    return out


def test_blur_against_loops():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x = (rng.integers(0, 40, (5, 6, 4)) + 100).astype(np.uint8)
        x[..., 3] = np.where(rng.random((5, 6)) < 0.2, 0, 200)
        for median in (False, True):
            assert (pixels.blur(x, median) == brute_blur(x, median)).all()


def test_palette_bounds():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (500, 3), dtype=np.uint8)
    p = palette.build_palette(x, np.ones(500), 16, fixed=[(1, 2, 3)])
    assert len(p) <= 16 and tuple(p[0]) == (1, 2, 3)
    few = x[:5]
    assert {tuple(c) for c in palette.build_palette(few, np.ones(5), 16)} == {tuple(c) for c in few}
    assert len(palette.build_palette(x, np.zeros(500), 16)) == 0
    d = ((x[:, None].astype(int) - p[None]) ** 2 * [2, 3, 1]).sum(axis=2)
    assert (palette.nearest(x, p) == d.argmin(axis=1)).all()


def test_drawing_only_what_changed_gives_the_same_pictures(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    base = rng.integers(0, 4, (1, 6, 8, 3)) * 60
    clip = np.concatenate([np.repeat(base, 6, axis=0), np.full((6, 6, 8, 1), 255)], axis=-1).astype(np.uint8)
    for k in range(1, 6):
        clip[k, 1 + k % 3, 2:5, :3] = k * 30
    df = palette.with_palette(table(spark, [clip]).withColumn("importance", F.lit(None).cast("binary"))).withColumn("dispose", F.lit("keep"))
    screen = np.zeros((6, 8, 4), np.uint8)
    drawn = 0
    for r in sorted(palette.assemble(df).collect(), key=lambda r: r["frame_index"]):
        part = np.frombuffer(r["indices"], np.uint8).reshape(r["height"], r["width"]).astype(int)
        drawn += part.size
        screen = palette.paint(screen, part, np.frombuffer(r["palette"], np.uint8).reshape(-1, 3), r["clear"], r["left"], r["top"])
        assert (screen == clip[r["frame_index"]]).all()
    assert drawn < clip.size // 4


def test_small_palette_helpers_and_planes():
    assert palette.second_pass_size(100) == 128 and palette.second_pass_size(230) == 256 and palette.second_pass_size(150) is None
    index, solid, clear = palette.merge_clear(np.array([0, 1, 2, 3]), np.arange(12).reshape(4, 3), np.array([255, 0, 255, 128]))
    assert index.tolist() == [0, 2, 1, 2] and clear == 2 and solid.tolist() == [[0, 1, 2], [6, 7, 8]]
    assert pixels.copy_plane(b"abcdef", 2, 3, 2, 2) == b"abde" and pixels.copy_plane(b"abcd", 2, 2, 2, 3) == b"ab\0cd\0"
    with pytest.raises(ValueError):
        pixels.copy_plane(b"abcd", 2, 2, 3, 2)
