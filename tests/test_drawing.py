import numpy as np
import pytest

from cadenza.functions import pixels
from cadenza.operators import composite, dither, palette
from cadenza.sources import gif

TABLE = np.array([(0, 0, 0), (255, 255, 255), (200, 50, 60), (40, 215, 20), (90, 165, 118)], np.uint8)


def in_turn(rgba, table, level, screen):
    """Error diffusion pixel by pixel."""
    h, w = rgba.shape[:2]
    lacks, out = {}, np.zeros((h, w), int)
    gap = lambda a, b: 2 * (int(a[0]) - b[0]) ** 2 + 3 * (int(a[1]) - b[1]) ** 2 + (int(a[2]) - b[2]) ** 2
    for y in range(h):
        for x in range(w):
            if rgba[y, x, 3] < 128:
                out[y, x] = len(table)
                continue
            own = lacks.get((x, y), (0, 0, 0))
            value = [min(max(int(rgba[y, x, c]) + own[c] * level // 4096, 0), 255) for c in range(3)]
            gaps = [gap(t, value) for t in table]
            out[y, x] = gaps.index(min(gaps))
            taken = table[out[y, x]]
            if screen is not None and screen[y, x, 3] >= 128 and gap(screen[y, x], value) <= min(gaps):
                out[y, x], taken = len(table), screen[y, x]
            for dx, dy, k in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if 0 <= x + dx < w:
                    more = lacks.get((x + dx, y + dy), (0, 0, 0))
                    lacks[x + dx, y + dy] = tuple(more[c] + k * (value[c] - int(taken[c])) for c in range(3))
    return out


@pytest.mark.parametrize("size", [(1, 1), (1, 9), (9, 1), (7, 5), (4, 11)])
@pytest.mark.parametrize("level", [0, 200, 256])
def test_diffusion_against_loops(size, level):
    rng = np.random.default_rng(size[0] * 20 + size[1])
    for with_screen in (False, True):
        x = rng.integers(0, 256, (*size, 4), dtype=np.uint8)
        screen = np.where(rng.random((*size, 1)) < 0.3, x, rng.integers(0, 256, (*size, 4))).astype(np.uint8) if with_screen else None
        assert (dither.diffused(x, TABLE, level, screen) == in_turn(x, TABLE, level, screen)).all()
    assert (dither.diffused(x, TABLE[:0], level) == 0).all()


def test_diffusion_keeps_the_mean_better_than_the_pattern():
    ramp = np.linspace(20, 235, 64)
    x = np.stack([np.tile(ramp, (32, 1))] * 3 + [np.full((32, 64), 255)], axis=-1).astype(np.uint8)
    table = np.array([(0, 0, 0), (120, 120, 120), (255, 255, 255)], np.uint8)
    near = palette.nearest(x.reshape(-1, 4)[:, :3], table)
    pattern = palette.dithered(x, table, near, 1.0).reshape(32, 64)
    spread = dither.diffused(x, table)
    blocks = lambda v: v.reshape(4, 8, 8, 8).mean(axis=(1, 3))
    want = blocks(x[..., 0].astype(float))
    off = [np.abs(blocks(table[i][..., 0].astype(float)) - want).mean() for i in (near.reshape(32, 64), pattern, spread)]
    assert off[2] < off[1] < off[0] and off[2] < 4


def test_composites_equal_the_fold(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for clip in ("a", "b"):
        width, height, data = 7, 5, gif.header(7, 5, 0)
        for k in range(12):
            w, h = int(rng.integers(1, 8)), int(rng.integers(1, 6))
            left, top = int(rng.integers(0, 8 - w)), int(rng.integers(0, 6 - h))
            index = rng.integers(0, 5, (h, w)).astype(np.uint8)
            clear, dispose = int(rng.integers(-1, 5)), str(rng.choice(["keep", "background", "previous"]))
            rows.append((clip, k, 7, 5, left, top, w, h, bytearray(index.tobytes()), bytearray(TABLE.tobytes()), clear, dispose))
            data += gif.control_block(5, dispose, clear) + gif.frame_block(left, top, w, h, index, TABLE, clear, 0)
        want |= {(clip, k): rgba for k, (_, rgba) in enumerate(gif.pictures(data + b"\x3b"))}
    parts = spark.createDataFrame(rows, "clip_id string, frame_index long, screen_width int, screen_height int, left int, top int, width int, height int, indices binary, palette binary, clear int, dispose string")
    got = {k: np.zeros((5, 7, 4), np.uint8) for k in want}
    shown = composite.composited(composite.coloured(parts)).collect()
    assert len(shown) == 24 * 35
    for r in shown:
        got[r.clip_id, r.frame_index][r.y, r.x] = (r.r, r.g, r.b, r.a)
    for k, v in want.items():
        assert (got[k] == np.where(v[..., 3:] > 0, v, 0)).all()


def test_importance_holds_only_on_pictures_that_stay(spark):
    rows = [("a", 0, "background", b"1"), ("a", 1, "keep", b"2"), ("a", 2, "keep", b"3"), ("b", 0, "keep", b"4"), ("b", 1, "previous", b"5"), ("b", 2, "keep", b"6")]
    found = palette.weighed(spark.createDataFrame([(c, k, d, bytearray(i)) for c, k, d, i in rows], "clip_id string, frame_index long, dispose string, importance binary")).collect()
    assert {(r.clip_id, r.frame_index): r.importance and bytes(r.importance) for r in found} == {("a", 0): b"1", ("a", 1): None, ("a", 2): b"3", ("b", 0): b"4", ("b", 1): b"5", ("b", 2): None}


def test_extra_effort_fills_a_power_of_two(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (30, 30, 4), dtype=np.uint8)
    x[..., 3] = 255
    df = spark.createDataFrame([("a", 0, bytearray(x.tobytes()), None)], "clip_id string, frame_index long, rgba binary, importance binary")
    size = lambda extra: len(palette.with_palette(df, 100, extra=extra).first().palette) // 3
    assert (size(False), size(True)) == (100, 128)
    assert pixels.distance(np.array([1, 2, 3]), np.array([1, 2, 3])) == 0


def test_palettes_as_tables(spark):
    from cadenza.operators import cuts

    rng = np.random.default_rng(12)
    rows, clips = [], {}
    for frame, n in ((1, 400), (2, 5), (3, 1)):
        base = rng.integers(0, 256, (6, 3))
        clips[frame] = np.clip(base[rng.integers(0, 6, n)] + rng.integers(-12, 13, (n, 3)), 0, 255)
        rows += [(frame, *map(int, c), 255, 1 + k % 5) for k, c in enumerate(clips[frame])]
    rows.append((4, 1, 2, 3, 100, 1))
    df = spark.createDataFrame(rows, "f long, r int, g int, b int, a int, w int")
    colours = cuts.histogram(df, "f", "w").cache()
    assert colours.agg({"n": "sum"}).first()[0] == sum(r[5] for r in rows[:-1])
    for rounds in (0, 1, 3, 4):
        boxes = cuts.median_cut(colours, "f", rounds).collect()
        held = {}
        for r in boxes:
            held.setdefault((r.f, r.box), []).append(r)
        assert len(boxes) == colours.count() and max(b for _, b in held) < 2**rounds
        if rounds == 1:  # halves of the weight, but for the colour at the cut
            for f in (1, 2):
                low, high = (sum(r.n for r in held[f, k]) for k in (0, 1))
                assert abs(low - high) <= 2 * max(r.n for r in held[f, 0] + held[f, 1])
        assert {f for f, _ in held} == {1, 2, 3} and [b for f, b in held if f == 3] == [0]
    table = cuts.palettes(colours, "f", 3, 2).cache()
    off = {r.f: r.total / r.n for r in cuts.assigned(colours, table, "f").selectExpr("f", "n", "off * n as weighed").groupBy("f").agg({"weighed": "sum", "n": "sum"}).toDF("f", "total", "n").collect()}
    for f in (1, 2):
        own = np.array([(r.r, r.g, r.b) for r in table.collect() if r.f == f])
        gaps = ((clips[f][:, None] - own[None]) ** 2 * [2, 3, 1]).sum(axis=2).min(axis=1)
        weights = np.array([1 + k % 5 for k in range(len(clips[f]))])
        assert off[f] == pytest.approx((gaps * weights).sum() / weights.sum())
    mean = clips[1].mean(axis=0)
    assert off[1] < 0.1 * ((clips[1] - mean) ** 2 * [2, 3, 1]).sum(axis=1).mean() and off[3] == 0
    with pytest.raises(ValueError):
        cuts.median_cut(colours, "f", 9)
