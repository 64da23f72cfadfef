"""Scalar rules as column expressions: sizes, quality settings, colours, crops, ranges.

Arguments are columns unless said otherwise; null in, null out. Sizes are in pixels, crops and fractions in
0..1 with the origin at the top left, colours are integers 0..255.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest sides that are offered, in pixels, and shares in percent (fixed values).
PRESET_WIDTHS = (1280, 1024, 960, 800, 768, 640, 512, 480, 400, 320, 256, 200)
PRESET_PERCENTS = (100, 50, 33, 25, 20)
#: Frames a second that a rate is kept within, and the area (width, height) that a size without wishes comes near.
LEAST_FPS, MOST_FPS = 0.1, 50.0
USUAL_AREA = (800, 600)


def _long(x: Column) -> Column:
    return x.cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, towards zero."""
    return F.call_function("div", _long(a), _long(b))


# sizes


def output_size(width: Column, height: Column, want_width: Column | None = None, want_height: Column | None = None) -> Column:
    """struct<width, height>: never larger than the source. No wish: both sides over a whole number that brings the area
    near the usual one. Both wished: each side's least, without keeping the ratio. One: it is capped, the other follows."""
    w, h = _long(width), _long(height)
    ww = _long(want_width) if want_width is not None else F.lit(None).cast("long")
    wh = _long(want_height) if want_height is not None else F.lit(None).cast("long")
    area = USUAL_AREA[0] * USUAL_AREA[1]
    k = F.greatest(F.round(F.sqrt((w * h + area // 2) / F.lit(float(area)))).cast("long"), F.lit(1).cast("long"))
    cw, ch = F.least(ww, w), F.least(wh, h)
    out_w = F.when(ww.isNull() & wh.isNull(), _div(w, k)).when(ww.isNull(), _div(w * ch, h)).otherwise(cw)
    out_h = F.when(ww.isNull() & wh.isNull(), _div(h, k)).when(wh.isNull(), _div(h * cw, w)).otherwise(ch)
    return F.struct(out_w.alias("width"), out_h.alias("height"))


def aspect_fit(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """struct<width, height>: as large as goes into a box at the same ratio (may grow)."""
    k = F.least(box_width / width, box_height / height)
    return F.struct((width * k).alias("width"), (height * k).alias("height"))


def aspect_fill(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """struct<width, height>: as small as covers a box at the same ratio."""
    k = F.greatest(box_width / width, box_height / height)
    return F.struct((width * k).alias("width"), (height * k).alias("height"))


def fit_wishes(width: Column, height: Column, want_width: Column, want_height: Column, grow: bool = True) -> Column:
    """struct<width, height> at the same ratio for a wished width, height or both (then inside both); neither: as it is.
    Without ``grow`` never above the original."""
    k = F.coalesce(F.least(want_width / width, want_height / height), F.lit(1.0))
    k = k if grow else F.least(k, F.lit(1.0))
    return F.struct((width * k).alias("width"), (height * k).alias("height"))


def scaled_size(width: Column, height: Column, fraction: Column) -> Column:
    """struct<width, height>, rounded."""
    return F.struct(_long(F.round(width * fraction)).alias("width"), _long(F.round(height * fraction)).alias("height"))


def fraction_of(width: Column, original_width: Column) -> Column:
    return width / original_width


def size_bounds(width: Column, height: Column, least: int = 5) -> Column:
    """struct<least_width, most_width, least_height, most_height> of sizes at the same ratio: from where both sides are
    ``least`` pixels at least (rounded, and no more than there is) up to the original."""
    small = aspect_fill(width, height, F.lit(float(least)), F.lit(float(least)))
    side = lambda x, most: F.round(F.least(x, most.cast("double")))
    return F.struct(side(small["width"], width).alias("least_width"), width.cast("double").alias("most_width"), side(small["height"], height).alias("least_height"), height.cast("double").alias("most_height"))


def mean_percent(width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    """A new size as percent of the original: the mean of both sides'."""
    return (new_width / width * 100 + new_height / height * 100) / 2


def size_by_width(width: Column, height: Column, new_width: Column) -> Column:
    """struct<width, height>, rounded: the original's ratio at a new width; an original without width stays as it is."""
    return F.when(width == 0, F.struct(width.cast("double").alias("width"), height.cast("double").alias("height"))).otherwise(F.struct(F.round(new_width.cast("double")).alias("width"), F.round(height * (new_width / F.nullif(width, F.lit(0)))).alias("height")))


def preset_sizes(width: Column, height: Column) -> Column:
    """array<struct<width, height>>: the preset widths (and the own one) that the clip has, in falling order."""
    own = F.array_union(F.array(*(F.lit(x).cast("long") for x in PRESET_WIDTHS)), F.array(_long(width)))
    fits = F.reverse(F.array_sort(F.filter(own, lambda x: x <= width)))
    return F.transform(fits, lambda x: F.struct(x.alias("width"), _long(F.round(height * x / width)).alias("height")))


def preset_percents(width: Column, height: Column) -> Column:
    """array<struct<percent, width, height>>."""
    return F.array(*(F.struct(F.lit(p).alias("percent"), _long(F.round(width * p / 100)).alias("width"), _long(F.round(height * p / 100)).alias("height")) for p in PRESET_PERCENTS))


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """By Euclid's steps, as a fold over as many as a 64-bit number can take (two digits fall every five steps)."""
    start = F.struct(F.abs(_long(a)).alias("a"), F.abs(_long(b)).alias("b"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole_ratio(width: Column, height: Column) -> Column:
    """struct<width, height>: a ratio in least whole numbers."""
    return once(greatest_common_divisor(width, height), lambda d: F.struct(_div(width, d).alias("width"), _div(height, d).alias("height")))


def closest_ratio(width: Column, height: Column, most: int = 99) -> Column:
    """struct<width, height>: the exact ratio if its numbers are 1..``most``, else the nearest such (least denominator first)."""

    def nearest(target: Column) -> Column:
        over = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda d: F.struct(d.alias("d"), F.least(F.greatest(F.round(target * d), F.lit(1.0)), F.lit(float(most))).alias("n")))
        best = F.array_min(F.transform(over, lambda x: F.struct(F.abs(x["n"] / x["d"] - target).alias("error"), x["d"].alias("height"), x["n"].alias("width"))))
        return once(best, lambda b: F.struct(_long(b["width"]).alias("width"), _long(b["height"]).alias("height")))

    fits = lambda e: e["width"].between(1, most) & e["height"].between(1, most)
    return once(whole_ratio(width, height), lambda e: F.when(fits(e), e).otherwise(once(width / height, nearest)))


# quality


def quality_from_share(share: Column) -> Column:
    """1..100 from 0..1."""
    return F.least(F.greatest(F.round(share * 100), F.lit(1.0)), F.lit(100.0)).cast("long")


def colour_quality(quality: Column) -> Column:
    return F.least(_div(quality * 4, F.lit(3)), F.lit(100).cast("long"))


def lossy_level(quality: Column) -> Column:
    """How much loss the compressor may take: 0 at quality 100."""
    base = F.ceil(F.pow(F.greatest(20 - quality / 5, F.lit(0.0)), F.lit(1.8))) + 10
    return F.when(quality < 100, base * 10).otherwise(F.lit(0)).cast("long")


def dither_level(quality: Column, lossy_quality: Column) -> Column:
    return F.least(F.greatest(quality * (0.25 + lossy_quality * 0.75 / 90) / 50 - 1, F.lit(0.2)), F.lit(1.0))


def most_colours(quality: Column, fixed: Column | int = 0) -> Column:
    """Colours of a palette: all 256 from quality 50 up, below it a power of two."""
    want = F.greatest(_long(quality) * 2, F.lit(5).cast("long") + fixed)
    power = F.pow(F.lit(2.0), F.ceil(F.log2(want.cast("double"))))
    return F.when(quality < 50, F.least(power, F.lit(256.0))).otherwise(F.lit(256.0)).cast("long")


def padded_palette(colours: Column) -> Column:
    """The power of two, 2 at least, that a palette is padded to."""
    return F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(colours, F.lit(1)).cast("double")))), F.lit(2.0)).cast("long")


def second_pass_size(found: Column) -> Column:
    """With extra effort: the power of two of colours for which a small or nearly full palette is built again; else null."""
    return F.when((found < 128) | (found > 220), padded_palette(found))


def leaves_unchanged(keeps: Column, fast: Column, quality: Column, index: Column) -> Column:
    """Whether a frame's unimportant pixels are left to the frame before: that one stays on screen, and the encoder is
    in a hurry or, under quality 100, in the turn of five that the quality gives."""
    spared = _div(F.greatest(quality - 80, F.lit(0)), F.lit(4))
    return keeps & (fast | ((quality < 100) & (F.pmod(_long(index), F.lit(5).cast("long")) >= spared)))


def smoothing_threshold(quality: Column) -> Column:
    t = 55 - _div(quality, F.lit(2))
    return t * t


def repeat_count(loops: Column) -> Column:
    """What is written for loops: null none, 0 for ever, n times; any negative number means none."""
    return F.when(loops >= 0, _long(loops))


# colours


def colour_distance(a: Column, b: Column) -> Column:
    """2 dr^2 + 3 dg^2 + db^2 of structs with r, g, b."""
    d = {k: _long(a[k]) - _long(b[k]) for k in "rgb"}
    return 2 * d["r"] * d["r"] + 3 * d["g"] * d["g"] + d["b"] * d["b"]


def importance(distance: Column, threshold: Column, least: Column, most: Column) -> Column:
    """How much a pixel matters to the palette, by how far it is over the threshold."""
    over = F.greatest(_long(distance) - threshold, F.lit(0).cast("long"))
    return _long(least) + F.least(_div(over * most, threshold * 48), _long(most))


def cohort(r: Column, g: Column, b: Column) -> Column:
    """Which half of the colours a pixel is in; the halves are smoothed in turn."""
    return (_div(r, F.lit(2)) > g) != (b > 127)


def over_matte(colour: Column, alpha: Column, matte: Column) -> Column:
    """One channel of a half-transparent pixel over a background; clear and solid pixels stay."""
    mixed = _div(_long(colour) * alpha + _long(matte) * (255 - alpha), F.lit(255))
    return F.when((alpha > 0) & (alpha < 255), mixed).otherwise(_long(colour))


def parse_colours(text: Column) -> Column:
    """array<struct<r, g, b>> of hex colours set apart by spaces or commas; null if one of them isn't six hex digits."""
    parts = F.transform(F.filter(F.split(text, "[ ,]"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), "^#", ""))
    part = lambda x, at: F.conv(F.substring(x, at, 2), 16, 10).cast("int")
    colours = F.transform(parts, lambda x: F.struct(part(x, 1).alias("r"), part(x, 3).alias("g"), part(x, 5).alias("b")))
    return F.when(F.forall(parts, lambda x: x.rlike("^[0-9A-Fa-f]{6}$")), colours)


def default_matrix(width: Column, height: Column) -> Column:
    """The colour matrix of video that names none, by its size."""
    return F.when((width <= 720) & (height <= 480), "bt601").otherwise("bt709")


# rates


def clip_rate(wanted: Column, own: Column) -> Column:
    """Frames a second: the wanted rate (or the own one) within limits, never above the own one."""
    return F.least(F.least(F.greatest(F.coalesce(wanted, own), F.lit(LEAST_FPS)), F.lit(MOST_FPS)), own)


def rate_ceiling(own: Column, speed: Column) -> Column:
    return F.least(F.greatest(F.round(own * speed), F.lit(3.0)), F.lit(MOST_FPS)).cast("long")


# crops


def crop_pixels(crop: Column, width: Column, height: Column) -> Column:
    """A unit rectangle (x, y, width, height) in pixels."""
    return F.struct((crop["x"] * width).alias("x"), (crop["y"] * height).alias("y"), (crop["width"] * width).alias("width"), (crop["height"] * height).alias("height"))


def crop_unit(rect: Column, width: Column, height: Column) -> Column:
    """A pixel rectangle as shares of a frame."""
    return F.struct((rect["x"] / width).alias("x"), (rect["y"] / height).alias("y"), (rect["width"] / width).alias("width"), (rect["height"] / height).alias("height"))


def cropped_size(crop: Column, width: Column, height: Column) -> Column:
    """struct<width, height>: whole pixels of a unit crop."""
    return F.struct(_long(crop["width"] * width).alias("width"), _long(crop["height"] * height).alias("height"))


def crop_inside(rect: Column, width: Column, height: Column) -> Column:
    """The part of a pixel rectangle, whose y counts from the bottom, inside a frame, counted from the top; null if it is under 1 x 1."""
    x0, x1 = F.greatest(rect["x"], F.lit(0.0)), F.least(rect["x"] + rect["width"], width)
    y0, y1 = F.greatest(height - rect["y"] - rect["height"], F.lit(0.0)), F.least(height - rect["y"], height)
    inside = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))
    return F.when((x1 - x0 >= 1) & (y1 - y0 >= 1), inside)


def centred_crop(aspect_width: Column, aspect_height: Column, width: Column, height: Column, least: int = 100) -> Column:
    """The largest centred unit crop of a ratio; sides are ``least`` pixels at least, as far as the frame has them."""
    k = F.least(width / aspect_width, height / aspect_height)
    w = F.least(F.greatest(aspect_width * k, F.lit(float(least))), width) / width
    h = F.least(F.greatest(aspect_height * k, F.lit(float(least))), height) / height
    return F.struct(((1 - w) / 2).alias("x"), ((1 - h) / 2).alias("y"), w.alias("width"), h.alias("height"))


#: Where the nine handles of a crop sit in it (fixed values).
HANDLES = {
    "top_left": (0.0, 0.0), "top": (0.5, 0.0), "top_right": (1.0, 0.0), "left": (0.0, 0.5), "center": (0.5, 0.5),
    "right": (1.0, 0.5), "bottom_left": (0.0, 1.0), "bottom": (0.5, 1.0), "bottom_right": (1.0, 1.0),
}


def handle_position(name: Column) -> Column:
    """struct<x, y> of a handle; null if there is none of that name."""
    pairs = [x for k, (u, v) in HANDLES.items() for x in (F.lit(k), F.struct(F.lit(u).alias("x"), F.lit(v).alias("y")))]
    return F.try_element_at(F.create_map(*pairs), name)


def crop_field(value: Column, side: Column, least: int = 100) -> Column:
    """A typed crop side in pixels, kept within what a frame's side allows."""
    return F.least(F.greatest(_long(value), F.lit(least).cast("long")), _long(side))


def ratio_field(value: Column) -> Column:
    """A typed part of a ratio, 1 to 99."""
    return F.least(F.greatest(_long(value), F.lit(1).cast("long")), F.lit(99).cast("long"))


def moved_crop(crop: Column, dx: Column, dy: Column) -> Column:
    """A unit crop moved by shares of the frame, as far as it stays inside."""
    at = lambda x, d, size: F.least(F.greatest(x + d, F.lit(0.0)), 1 - size)
    return F.struct(at(crop["x"], dx, crop["width"]).alias("x"), at(crop["y"], dy, crop["height"]).alias("y"), crop["width"].alias("width"), crop["height"].alias("height"))


def dragged_crop(crop: Column, handle: Column, dx: Column, dy: Column, least_width: Column, least_height: Column) -> Column:
    """A unit crop after one of its outer handles is dragged: the sides at the handle move, the others stay, and neither
    side falls under its least or leaves the frame."""
    spot = handle_position(handle)
    left = F.when(spot["x"] == 0, F.greatest(F.least(crop["x"] + dx, crop["x"] + crop["width"] - least_width), F.lit(0.0))).otherwise(crop["x"])
    right = F.when(spot["x"] == 1, F.least(F.greatest(crop["x"] + crop["width"] + dx, crop["x"] + least_width), F.lit(1.0))).otherwise(crop["x"] + crop["width"])
    top = F.when(spot["y"] == 0, F.greatest(F.least(crop["y"] + dy, crop["y"] + crop["height"] - least_height), F.lit(0.0))).otherwise(crop["y"])
    bottom = F.when(spot["y"] == 1, F.least(F.greatest(crop["y"] + crop["height"] + dy, crop["y"] + least_height), F.lit(1.0))).otherwise(crop["y"] + crop["height"])
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))


def _bounded(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def mirrored_crop(crop: Column, handle: Column, dx: Column, dy: Column, least_width: Column, least_height: Column) -> Column:
    """A unit crop after one of its outer handles is dragged while its centre stays: the opposite side moves alike, and
    neither side falls under its least or leaves the frame."""
    spot = handle_position(handle)

    def grown(at: Column, start: Column, size: Column, delta: Column, least: Column) -> Column:
        """By how much the side at the handle moves out; its opposite does too."""
        out = F.when(at == 0, -delta).when(at == 1, delta).otherwise(F.lit(0.0))
        room = F.least(start, 1 - start - size)
        return F.when(at == 0.5, F.lit(0.0)).otherwise(_bounded(out, (least - size) / 2, room))

    gx = grown(spot["x"], crop["x"], crop["width"], dx, least_width)
    gy = grown(spot["y"], crop["y"], crop["height"], dy, least_height)
    return F.struct((crop["x"] - gx).alias("x"), (crop["y"] - gy).alias("y"), (crop["width"] + 2 * gx).alias("width"), (crop["height"] + 2 * gy).alias("height"))


def scaled_crop(crop: Column, handle: Column, dx: Column, dy: Column, least_width: Column, least_height: Column) -> Column:
    """A unit crop after one of its outer handles is dragged at a fixed ratio: what lies opposite the handle stays where it
    is (the middle of a side that the handle doesn't move), and the scale is the mean of what the moved sides ask
    for, as far as the frame and the least sides let it."""
    spot = handle_position(handle)
    ways = [(spot["x"], crop["x"], crop["width"], dx, least_width), (spot["y"], crop["y"], crop["height"], dy, least_height)]
    moved = F.greatest(*(F.when(spot[a] != 0.5, 1).otherwise(0) for a in "xy")) + F.least(*(F.when(spot[a] != 0.5, 1).otherwise(0) for a in "xy"))
    scale = 1 + sum((2 * at - 1) * delta / size for at, _, size, delta, _ in ways) / F.greatest(moved, F.lit(1))
    still = []
    for at, start, size, _, _ in ways:
        anchor = start + size * (1 - at)
        still.append(anchor)
        scale = F.when(anchor > start, F.least(scale, anchor / F.nullif(anchor - start, F.lit(0.0)))).otherwise(scale)
        scale = F.when(anchor < start + size, F.least(scale, (1 - anchor) / F.nullif(start + size - anchor, F.lit(0.0)))).otherwise(scale)
    scale = F.greatest(scale, *(least / size for _, _, size, _, least in ways))
    x, y = (a - (a - start) * scale for a, (_, start, _, _, _) in zip(still, ways))
    return F.struct(x.alias("x"), y.alias("y"), (crop["width"] * scale).alias("width"), (crop["height"] * scale).alias("height"))


def centred_scaled_crop(crop: Column, to_x: Column, to_y: Column, least_width: Column, least_height: Column) -> Column:
    """A unit crop scaled about its centre until its edge reaches a point, inside the frame and not under the least sides."""
    cx, cy = crop["x"] + crop["width"] / 2, crop["y"] + crop["height"] / 2
    wish = F.greatest(F.abs(to_x - cx) * 2 / crop["width"], F.abs(to_y - cy) * 2 / crop["height"])
    most = F.least(2 * cx / crop["width"], 2 * (1 - cx) / crop["width"], 2 * cy / crop["height"], 2 * (1 - cy) / crop["height"])
    k = _bounded(wish, F.greatest(least_width / crop["width"], least_height / crop["height"]), most)
    return F.struct((cx - crop["width"] * k / 2).alias("x"), (cy - crop["height"] * k / 2).alias("y"), (crop["width"] * k).alias("width"), (crop["height"] * k).alias("height"))


# ranges: struct<lo, hi>, both ends inside


def in_range_order(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def clamp_range(inner: Column, outer: Column) -> Column:
    at = lambda x: F.least(F.greatest(x, outer["lo"]), outer["hi"])
    return F.struct(at(inner["lo"]).alias("lo"), at(inner["hi"]).alias("hi"))


def contains_range(outer: Column, inner: Column) -> Column:
    return (outer["lo"] <= inner["lo"]) & (outer["hi"] >= inner["hi"])


def range_length(r: Column) -> Column:
    return r["hi"] - r["lo"]


def widen_range(r: Column, length: Column | float, bounds: Column) -> Column:
    """A range of ``length`` at least, grown at its end first and inside the bounds as far as they allow."""
    need = F.greatest(F.lit(length) if not isinstance(length, Column) else length, range_length(r))
    hi = F.least(r["lo"] + need, bounds["hi"])
    return F.struct(F.greatest(hi - need, bounds["lo"]).alias("lo"), hi.alias("hi"))


def range_to_share(r: Column, duration: Column) -> Column:
    return F.struct((r["lo"] / duration).alias("lo"), (r["hi"] / duration).alias("hi"))


def share_to_range(r: Column, duration: Column) -> Column:
    return F.struct((r["lo"] * duration).alias("lo"), (r["hi"] * duration).alias("hi"))


# numbers and texts


def nearly_equal(a: Column, b: Column, tolerance: float = 2.0**-26) -> Column:
    """Equal but for a share of the larger one."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(2.0**-1022)) * tolerance


def number_field(text: Column, digits: int = 5) -> Column:
    """A typed whole number: digits only, no leading zero, at most ``digits`` of them; null if none is left."""
    kept = F.substring(F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0", ""), 1, digits)
    return F.when(kept != "", kept.cast("long"))


def stepped_field(value: Column, step: Column, least: int, most: int) -> Column:
    """A typed number (none: 0) a step up or down; where that leaves ``least`` to ``most`` it stays as it is."""
    new = F.coalesce(_long(value), F.lit(0).cast("long")) + step
    return F.when(new.between(least, most), new).otherwise(_long(value))


def track_bytes(bits_per_second: Column, duration: Column) -> Column:
    return bits_per_second / 8 * duration


def four_cc(code: Column) -> Column:
    """A number as its four characters, highest byte first."""
    return F.concat(*(F.chr(F.shiftright(_long(code), s).bitwiseAND(255)) for s in (24, 16, 8, 0)))


#: Extensions of the two kinds of container that are taken (fixed values).
CONTAINERS = {"mp4": "mpeg4", "mpg4": "mpeg4", "mov": "quicktime", "qt": "quicktime"}


def container_of(name: Column) -> Column:
    """mpeg4 or quicktime, by a file name's extension; null for any other."""
    pairs = [F.lit(x) for p in CONTAINERS.items() for x in p]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))


def sniff_type(head: Column, name: Column) -> Column:
    """File kind by extension (y4m, png), then by the first bytes; null if unknown."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(ext.isin("y4m", "png"), ext)
        .when(F.substring(head, 1, 4) == F.unhex(F.lit("89504E47")), "png")
        .when(F.substring(head, 1, 4) == F.unhex(F.lit("47494638")), "gif")
        .when(F.substring(head, 1, 4) == F.unhex(F.lit("59555634")), "y4m")
        .when(F.substring(head, 1, 2) == F.unhex(F.lit("FFD8")), "jpeg")
    )
