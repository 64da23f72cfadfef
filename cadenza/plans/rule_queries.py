"""The scalar rules over the stored tables, each registered with the same in SQL.

Sizes, crops, texts and the like are derived from every row of a table: k is a part's key, s its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import rules, validation
from cadenza.operators import estimate, sampling, timeline

P_SQL = "p as (select p_partkey, p_partkey as k, cast(p_size as bigint) as s from part)"
L = F.lit


def _parts(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))


def _r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def _fields(struct: Column, **names: str) -> list[Column]:
    return [_r(struct[field]).alias(name) for name, field in names.items()]


def share_quality(spark, sf_dir):
    s = F.col("s")
    return _parts(spark, sf_dir).select("p_partkey", rules.quality_from_share(s / 40.0).alias("quality"))


SHARE_SQL = f"with {P_SQL} select p_partkey, cast(least(greatest(round(s / 40e0 * 100), 1), 100) as bigint) as quality from p"


def palette_sizes(spark, sf_dir):
    """Padding, and the second pass of a palette of as many colours as a part's key leaves over 256."""
    k, s = F.col("k"), F.col("s")
    found = k % 256 + 1
    return _parts(spark, sf_dir).select("p_partkey", rules.padded_palette(s).alias("padded"), rules.second_pass_size(found).alias("again"))


PALETTE_SQL = f"""with {P_SQL} select p_partkey, cast(greatest(pow(2, ceil(log2(cast(greatest(s, 1) as double)))), 2) as bigint) as padded,
  case when k % 256 + 1 < 128 or k % 256 + 1 > 220 then cast(greatest(pow(2, ceil(log2(cast(k % 256 + 1 as double)))), 2) as bigint) end as again from p"""


def unchanged_turns(spark, sf_dir):
    """Whether a frame's unimportant pixels stay, by its number (the key) and the quality (twice the size)."""
    k, s = F.col("k"), F.col("s")
    return _parts(spark, sf_dir).select("p_partkey", rules.leaves_unchanged(k % 7 != 0, k % 11 == 0, s * 2, k).alias("leaves"))


UNCHANGED_SQL = f"with {P_SQL} select p_partkey, k % 7 <> 0 and (k % 11 = 0 or (s * 2 < 100 and k % 5 >= greatest(s * 2 - 80, 0) // 4)) as leaves from p"


def pixel_rules(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    a = F.struct((k % 256).alias("r"), (k * 7 % 256).alias("g"), (s * 5 % 256).alias("b"))
    b = F.struct((k * 3 % 256).alias("r"), (k * 11 % 256).alias("g"), (s * 3 % 256).alias("b"))
    d = rules.colour_distance(a, b)
    return _parts(spark, sf_dir).select("p_partkey", d.alias("distance"), rules.importance(d, L(784), L(10), L(110)).alias("importance"), rules.cohort(a["r"], a["g"], a["b"]).alias("cohort"), rules.over_matte(a["r"], k * 13 % 256, L(40)).alias("matted"))


PIXEL_SQL = f"""with {P_SQL}, c as (select p_partkey, k % 256 as r, k * 7 % 256 as g, s * 5 % 256 as b, k * 3 % 256 as r2, k * 11 % 256 as g2, s * 3 % 256 as b2, k * 13 % 256 as a from p),
  d as (select *, 2 * (r - r2) * (r - r2) + 3 * (g - g2) * (g - g2) + (b - b2) * (b - b2) as d from c)
select p_partkey, d as distance, 10 + least(greatest(d - 784, 0) * 110 // (784 * 48), 110) as importance, (r // 2 > g) <> (b > 127) as cohort,
  case when a > 0 and a < 255 then (r * a + 40 * (255 - a)) // 255 else r end as matted from d"""


def hex_colours(spark, sf_dir):
    """Two colours as text, and a text that is no colour for every seventh part."""
    k = F.col("k")
    digits = lambda x: F.lower(F.lpad(F.hex(x % 16_777_216), 6, "0"))
    text = F.when(k % 7 == 0, F.concat(L("#12345 "), digits(k))).otherwise(F.concat(L(" #"), digits(k * 31), L(", "), F.upper(digits(k * 77_777)), L(",,")))
    found = rules.parse_colours(text)
    return _parts(spark, sf_dir).select("p_partkey", F.when(found.isNotNull(), F.size(found)).alias("n"), *(F.get(found, 1)[c].alias(c) for c in "rgb"))


HEX_SQL = f"""with {P_SQL}, c as (select *, k % 7 <> 0 as ok, k * 77777 % 16777216 as x from p)
select p_partkey, case when ok then 2 end as n, case when ok then x // 65536 end as r, case when ok then x // 256 % 256 end as g, case when ok then x % 256 end as b from c"""

MATRIX_NAMES = (" BT709", "fcc ", "bt470bg", "BT601", "smpte240", "ycgco", "rgb", None)


def matrix_names(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    name = F.get(F.array(*map(L, MATRIX_NAMES)), (k % 8).cast("int"))
    return _parts(spark, sf_dir).select("p_partkey", validation.matrix_of(name).alias("matrix"), rules.default_matrix(k % 1000, s * 20).alias("usual"))


MATRIX_SQL = f"""with {P_SQL}, n as (select *, lower(trim([' BT709', 'fcc ', 'bt470bg', 'BT601', 'smpte240', 'ycgco', 'rgb', null][k % 8 + 1])) as name from p)
select p_partkey, case when name in ('bt709', 'fcc', 'bt470bg', 'bt601', 'smpte240', 'ycgco') then name end as matrix,
  case when k % 1000 <= 720 and s * 20 <= 480 then 'bt601' else 'bt709' end as usual from n"""


def loop_counts(spark, sf_dir):
    s = F.col("s")
    return _parts(spark, sf_dir).select("p_partkey", rules.repeat_count(s - 10).alias("repeat"))


LOOP_SQL = f"""with {P_SQL} select p_partkey, case when s >= 10 then s - 10 end as "repeat" from p"""


def wished_sizes(spark, sf_dir):
    """Frames as wide as a part's key and 40 times its size high: a share of that, and wishes for one or both sides."""
    k, s = F.col("k"), F.col("s")
    w, h = k % 3000 + 1, s * 40
    share = rules.scaled_size(w, h, (k % 100 + 1) / 100)
    both, wide, high = rules.fit_wishes(w, h, L(640.0), L(360.0)), rules.fit_wishes(w, h, L(640.0), L(None).cast("double")), rules.fit_wishes(w, h, L(None).cast("double"), L(360.0), grow=False)
    fit, fill = rules.aspect_fit(w, h, L(300.0), L(200.0)), rules.aspect_fill(w, h, L(300.0), L(200.0))
    columns = [share["width"].alias("share_w"), share["height"].alias("share_h")]
    for name, x in (("both", both), ("wide", wide), ("high", high), ("fit", fit), ("fill", fill)):
        columns += [_r(x["width"]).alias(f"{name}_w"), _r(x["height"]).alias(f"{name}_h")]
    return _parts(spark, sf_dir).select("p_partkey", *columns)


WISHED_SQL = f"""with {P_SQL}, d as (select *, k % 3000 + 1 as w, s * 40 as h, (k % 100 + 1) / 100e0 as f from p),
  q as (select *, least(640e0 / w, 360e0 / h) as kb, 640e0 / w as kw, least(360e0 / h, 1) as kh, least(300e0 / w, 200e0 / h) as kf, greatest(300e0 / w, 200e0 / h) as kl from d)
select p_partkey, cast(round(w * f) as bigint) as share_w, cast(round(h * f) as bigint) as share_h, round(w * kb, 6) as both_w, round(h * kb, 6) as both_h,
  round(w * kw, 6) as wide_w, round(h * kw, 6) as wide_h, round(w * kh, 6) as high_w, round(h * kh, 6) as high_h,
  round(w * kf, 6) as fit_w, round(h * kf, 6) as fit_h, round(w * kl, 6) as fill_w, round(h * kl, 6) as fill_h from q"""


def size_bounds(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    w, h = k % 3000 + 1, s * 40
    bounds, wide = rules.size_bounds(w, h), rules.size_by_width(w, h, s * 10)
    names = ("least_width", "most_width", "least_height", "most_height")
    return _parts(spark, sf_dir).select("p_partkey", *(bounds[n].alias(n) for n in names), wide["width"].alias("new_w"), wide["height"].alias("new_h"), _r(rules.mean_percent(w, h, s * 10, s * 7)).alias("percent"), _r(rules.fraction_of(s * 10, w)).alias("fraction"))


BOUNDS_SQL = f"""with {P_SQL}, d as (select *, k % 3000 + 1 as w, s * 40 as h from p), q as (select *, greatest(5e0 / w, 5e0 / h) as m from d)
select p_partkey, round(least(w * m, cast(w as double))) as least_width, cast(w as double) as most_width, round(least(h * m, cast(h as double))) as least_height, cast(h as double) as most_height,
  round(cast(s * 10 as double)) as new_w, round(h * (s * 10 / cast(w as double))) as new_h,
  round((s * 10 / cast(w as double) * 100 + s * 7 / cast(h as double) * 100) / 2, 6) as percent, round(s * 10 / cast(w as double), 6) as fraction from q"""


def preset_percents(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    found = F.explode(rules.preset_percents(k, s * 40)).alias("x")
    return _parts(spark, sf_dir).select("p_partkey", found).select("p_partkey", "x.percent", "x.width", "x.height")


PERCENTS_SQL = f"""with {P_SQL} select p_partkey, c as percent, cast(round(k * c / 100e0) as bigint) as width, cast(round(s * 40 * c / 100e0) as bigint) as height
from p, (values (100), (50), (33), (25), (20)) v(c)"""


def closest_ratios(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    ratio = rules.closest_ratio(k % 2000 + 1, s * 17 + 3)
    return _parts(spark, sf_dir).select("p_partkey", ratio["width"].alias("a"), ratio["height"].alias("b"))


CLOSEST_SQL = f"""with {P_SQL}, d as (select p_partkey, k % 2000 + 1 as w, s * 17 + 3 as h from p), e as (select *, w // gcd(w, h) as ew, h // gcd(w, h) as eh from d),
  n as (select p_partkey, m, least(greatest(round(w / cast(h as double) * m), 1), 99) as a, w / cast(h as double) as t from e, range(1, 100) r(m) where not (ew between 1 and 99 and eh between 1 and 99)),
  b as (select *, row_number() over (partition by p_partkey order by abs(a / m - t), m) as place from n)
select p_partkey, ew as a, eh as b from e where ew between 1 and 99 and eh between 1 and 99
union all select p_partkey, cast(a as bigint), m from b where place = 1"""


def crop_units(spark, sf_dir):
    """A unit crop by each part in frames of 1921 x 1083 pixels: in pixels, back again, and its whole size."""
    k, s = F.col("k"), F.col("s")
    crop = F.struct((k % 50 / 100).alias("x"), (k % 30 / 100).alias("y"), ((s + 1) / 101).alias("width"), ((s + 3) / 107).alias("height"))
    rect = rules.crop_pixels(crop, L(1921), L(1083))
    back, size = rules.crop_unit(rect, L(1921), L(1083)), rules.cropped_size(crop, L(1921), L(1083))
    return _parts(spark, sf_dir).select("p_partkey", *_fields(rect, x="x", y="y", w="width", h="height"), *_fields(back, ux="x", uw="width"), size["width"].alias("whole_w"), size["height"].alias("whole_h"))


UNITS_SQL = f"""with {P_SQL}, c as (select p_partkey, k % 50 / 100e0 as x, k % 30 / 100e0 as y, (s + 1) / 101e0 as w, (s + 3) / 107e0 as h from p)
select p_partkey, round(x * 1921, 6) as x, round(y * 1083, 6) as y, round(w * 1921, 6) as w, round(h * 1083, 6) as h, round(x * 1921 / 1921, 6) as ux, round(w * 1921 / 1921, 6) as uw,
  cast(trunc(w * 1921) as bigint) as whole_w, cast(trunc(h * 1083) as bigint) as whole_h from c"""


def centred_crops(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    crop = rules.centred_crop((k % 40 + 1).cast("double"), s.cast("double"), L(1000.0), L(600.0))
    return _parts(spark, sf_dir).select("p_partkey", *_fields(crop, x="x", y="y", w="width", h="height"))


CENTRED_SQL = f"""with {P_SQL}, a as (select p_partkey, k % 40 + 1e0 as aw, cast(s as double) as ah from p), b as (select *, least(1000 / aw, 600 / ah) as m from a),
  c as (select p_partkey, least(greatest(aw * m, 100), 1000) / 1000 as w, least(greatest(ah * m, 100), 600) / 600 as h from b)
select p_partkey, round((1 - w) / 2, 6) as x, round((1 - h) / 2, 6) as y, round(w, 6) as w, round(h, 6) as h from c"""


def crop_drags(spark, sf_dir):
    """One crop dragged by each part's handle and way, in the four modes and moved."""
    k, s = F.col("k"), F.col("s")
    crop = F.struct(L(0.2).alias("x"), L(0.3).alias("y"), L(0.5).alias("width"), L(0.4).alias("height"))
    handle = F.get(F.array(*map(L, rules.HANDLES)), (k % 9).cast("int"))
    dx, dy = (k % 41 - 20) / 40, (s - 25) / 50
    spot = rules.handle_position(handle)
    least = (L(0.1), L(0.15))
    free, mirrored, scaled = (f(crop, handle, dx, dy, *least) for f in (rules.dragged_crop, rules.mirrored_crop, rules.scaled_crop))
    locked, moved = rules.centred_scaled_crop(crop, k % 41 / 40, s / 50, *least), rules.moved_crop(crop, dx, dy)
    modes = {"free": free, "mirrored": mirrored, "scaled": scaled, "locked": locked, "moved": moved}
    # each crop is made once, then taken apart
    parts = _parts(spark, sf_dir).withColumns(modes | {"spot": spot})
    columns = [F.col("spot.x").alias("at_x"), F.col("spot.y").alias("at_y")]
    for name in modes:
        columns += _fields(F.col(name), **{f"{name}_x": "x", f"{name}_y": "y", f"{name}_w": "width", f"{name}_h": "height"})
    return parts.select("p_partkey", *columns, rules.crop_field(k % 900, L(600)).alias("side"), rules.ratio_field(k % 200).alias("ratio"))


DRAGS_SQL = f"""with {P_SQL}, d as (select *, [0e0, 0.5e0, 1e0, 0e0, 0.5e0, 1e0, 0e0, 0.5e0, 1e0][k % 9 + 1] as hx, [0e0, 0e0, 0e0, 0.5e0, 0.5e0, 0.5e0, 1e0, 1e0, 1e0][k % 9 + 1] as hy,
    (k % 41 - 20) / 40e0 as dx, (s - 25) / 50e0 as dy, 0.2e0 as x, 0.3e0 as y, 0.5e0 as w, 0.4e0 as h, 0.1e0 as lw, 0.15e0 as lh, k % 41 / 40e0 as tx, s / 50e0 as ty from p),
  n as (select *, case when hx = 0 then greatest(least(dx, w - lw), -x) else 0 end as l, case when hx = 1 then greatest(least(dx, 1 - x - w), lw - w) else 0 end as r,
    case when hy = 0 then greatest(least(dy, h - lh), -y) else 0 end as t, case when hy = 1 then greatest(least(dy, 1 - y - h), lh - h) else 0 end as b,
    case when hx = 0.5 then 0 else least(greatest(case when hx = 0 then -dx else dx end, (lw - w) / 2), least(x, 1 - x - w)) end as gx,
    case when hy = 0.5 then 0 else least(greatest(case when hy = 0 then -dy else dy end, (lh - h) / 2), least(y, 1 - y - h)) end as gy,
    x + w * (1 - hx) as ax, y + h * (1 - hy) as ay, x + w / 2 as cx, y + h / 2 as cy,
    greatest(cast(hx <> 0.5 as int) + cast(hy <> 0.5 as int), 1) as sides from d),
  z as (select *, greatest(least(1 + ((2 * hx - 1) * dx / w + (2 * hy - 1) * dy / h) / sides,
      case when ax > x then ax / (ax - x) else 1e9 end, case when ax < x + w then (1 - ax) / (x + w - ax) else 1e9 end,
      case when ay > y then ay / (ay - y) else 1e9 end, case when ay < y + h then (1 - ay) / (y + h - ay) else 1e9 end), lw / w, lh / h) as m,
    least(greatest(greatest(abs(tx - cx) * 2 / w, abs(ty - cy) * 2 / h), greatest(lw / w, lh / h)), least(2 * cx / w, 2 * (1 - cx) / w, 2 * cy / h, 2 * (1 - cy) / h)) as q from n)
select p_partkey, hx as at_x, hy as at_y, round(x + l, 6) as free_x, round(y + t, 6) as free_y, round(w - l + r, 6) as free_w, round(h - t + b, 6) as free_h,
  round(x - gx, 6) as mirrored_x, round(y - gy, 6) as mirrored_y, round(w + 2 * gx, 6) as mirrored_w, round(h + 2 * gy, 6) as mirrored_h,
  round(ax - (ax - x) * m, 6) as scaled_x, round(ay - (ay - y) * m, 6) as scaled_y, round(w * m, 6) as scaled_w, round(h * m, 6) as scaled_h,
  round(cx - w * q / 2, 6) as locked_x, round(cy - h * q / 2, 6) as locked_y, round(w * q, 6) as locked_w, round(h * q, 6) as locked_h,
  round(least(greatest(x + dx, 0), 1 - w), 6) as moved_x, round(least(greatest(y + dy, 0), 1 - h), 6) as moved_y, w as moved_w, h as moved_h,
  least(greatest(k % 900, 100), 600) as side, least(greatest(k % 200, 1), 99) as ratio from z"""


def time_ranges(spark, sf_dir):
    """A range of time by each part: put in order, kept within a clip, widened, and as shares of the clip and back."""
    k, s = F.col("k"), F.col("s")
    span = rules.in_range_order(k % 150 / 10, s / 5)
    clip = F.struct(L(0.0).alias("lo"), L(12.0).alias("hi"))
    inside = rules.clamp_range(span, clip)
    wide = rules.widen_range(inside, 0.5, clip)
    share = rules.range_to_share(inside, L(12.0))
    back = rules.share_to_range(share, L(24.0))
    return _parts(spark, sf_dir).select("p_partkey", *_fields(span, lo="lo", hi="hi"), *_fields(inside, in_lo="lo", in_hi="hi"), rules.contains_range(clip, span).alias("holds"), _r(rules.range_length(span)).alias("length"), *_fields(wide, wide_lo="lo", wide_hi="hi"), *_fields(share, share_lo="lo", share_hi="hi"), *_fields(back, back_lo="lo", back_hi="hi"))


RANGES_SQL = f"""with {P_SQL}, a as (select p_partkey, least(k % 150 / 10e0, s / 5e0) as lo, greatest(k % 150 / 10e0, s / 5e0) as hi from p),
  b as (select *, least(greatest(lo, 0), 12) as il, least(greatest(hi, 0), 12) as ih from a), c as (select *, least(il + greatest(ih - il, 0.5e0), 12) as wh from b)
select p_partkey, round(lo, 6) as lo, round(hi, 6) as hi, round(il, 6) as in_lo, round(ih, 6) as in_hi, lo >= 0 and hi <= 12 as holds, round(hi - lo, 6) as length,
  round(greatest(wh - greatest(ih - il, 0.5e0), 0), 6) as wide_lo, round(wh, 6) as wide_hi, round(il / 12, 6) as share_lo, round(ih / 12, 6) as share_hi,
  round(il / 12 * 24, 6) as back_lo, round(ih / 12 * 24, 6) as back_hi from c"""


def near_numbers(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    x = k.cast("double")
    return _parts(spark, sf_dir).select("p_partkey", rules.nearly_equal(x, x * (1 + (s - 25) * 1e-9)).alias("same"), _r(x / 7, 3).alias("rounded"))


NEAR_SQL = f"""with {P_SQL}, x as (select p_partkey, cast(k as double) as x, cast(k as double) * (1 + (s - 25) * 1e-9) as y from p)
select p_partkey, abs(x - y) <= greatest(abs(x), abs(y)) * pow(2e0, -26) as same, round(x / 7, 3) as rounded from x"""

CODES = {"avc1": 0x61766331, "hvc1": 0x68766331, "apcn": 0x6170636E, "rle ": 0x726C6520, "abcd": 0x61626364}


def codecs(spark, sf_dir):
    """Codec codes as numbers, their text and name, and a track's bytes."""
    k, s = F.col("k"), F.col("s")
    number = F.get(F.array(*map(L, CODES.values())), (k % 5).cast("int"))
    code = rules.four_cc(number)
    return _parts(spark, sf_dir).select("p_partkey", code.alias("code"), validation.codec_of(code).alias("codec"), rules.track_bytes(k * 1000, s).alias("bytes"))


CODECS_SQL = f"""with {P_SQL} select p_partkey, ['avc1', 'hvc1', 'apcn', 'rle ', 'abcd'][k % 5 + 1] as code,
  ['h264', 'hevc', 'prores_422', 'animation', null][k % 5 + 1] as codec, k * 1000 / 8e0 * s as bytes from p"""


def number_fields(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    text = F.when(k % 13 == 0, L("none")).otherwise(F.concat(L("a0"), k.cast("string"), L("x"), s.cast("string")))
    value = rules.number_field(text)
    return _parts(spark, sf_dir).select("p_partkey", value.alias("value"), rules.stepped_field(value, F.when(k % 2 == 0, 10).otherwise(-1), 100, 60_000).alias("stepped"))


FIELDS_SQL = f"""with {P_SQL}, t as (select *, case when k % 13 = 0 then 'none' else 'a0' || k || 'x' || s end as t from p),
  v as (select *, cast(nullif(left(regexp_replace(regexp_replace(t, '[^0-9]', '', 'g'), '^0', ''), 5), '') as bigint) as v from t),
  n as (select *, coalesce(v, 0) + case when k % 2 = 0 then 10 else -1 end as n from v)
select p_partkey, v as value, case when n between 100 and 60000 then n else v end as stepped from n"""


def clip_reports(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    parts = _parts(spark, sf_dir).select("p_partkey", F.when(k % 5 != 0, s).alias("seconds"), F.concat(L("clip"), k.cast("string")).alias("name"))
    return validation.with_report(parts).select("p_partkey", "report")


REPORTS_SQL = f"""with {P_SQL} select p_partkey, 'p_partkey: ' || k || chr(10) || 'seconds: ' || coalesce(case when k % 5 <> 0 then cast(s as varchar) end, '-') || chr(10) || 'name: clip' || k as report from p"""


def estimates(spark, sf_dir):
    """Sizes, lengths, progress and time left of clips by each part."""
    k, s = F.col("k"), F.col("s")
    low, high = F.when(k % 3 != 0, s / 10), F.when(k % 3 != 0, s / 10 + 2)
    length = estimate.output_duration(low, high, s.cast("double"), k % 2 == 0)
    return _parts(spark, sf_dir).select(
        "p_partkey", _r(estimate.naive_size(k % 900 + 1, s * 10, s, k % 100 / 100)).alias("naive"), _r(length).alias("length"),
        estimate.output_frames(length, L(12.5)).alias("frames"), _r(estimate.progress(s, L(40))).alias("progress"),
        _r(estimate.remaining_seconds(s.cast("double"), (k % 99 + 1) / 100)).alias("left_s"),
        timeline.frame_index_at(s / 7, L(1.0), L(12.5), L(60), 1.5).cast("long").alias("frame"),
    )


ESTIMATES_SQL = f"""with {P_SQL}, a as (select *, case when k % 3 <> 0 then (s / 10e0 + 2) - s / 10e0 else s end * case when k % 2 = 0 then 2e0 else 1e0 end as d,
    s / ((k % 99 + 1) / 100e0) * (1 - (k % 99 + 1) / 100e0) as r from p)
select p_partkey, round((k % 900 + 1) * (s * 10) * s / 3e0 * (k % 100 / 100e0 + 1.5e0) / 2.5e0, 6) as naive, round(d, 6) as length, cast(floor(d * 12.5e0) as bigint) as frames,
  round(least(s / 40e0, 1), 6) as progress, case when s > 3 and r > 1 and s + r > 10 then round(r, 6) end as left_s,
  cast(least(greatest(floor((s / 7e0 * 1.5e0 - 1) * 12.5e0 / 1.5e0), 0), 59) as bigint) as frame from a"""


def file_kinds(spark, sf_dir):
    """What a file is by name and first bytes, whether it can be an input, and its kind of container."""
    k, s = F.col("k"), F.col("s")
    name = F.concat(L("f"), k.cast("string"), F.get(F.array(*map(L, (".png", ".Y4M", ".gif", "", ".mp4", ".MOV"))), (k % 6).cast("int")))
    head = F.unhex(F.get(F.array(*map(L, ("89504E470D", "4749463839", "5955563420", "FFD8FFE000", "0000000000"))), (s % 5).cast("int")))
    return _parts(spark, sf_dir).select("p_partkey", rules.sniff_type(head, name).alias("kind"), validation.input_reason(head, name, k % 11 == 0, s % 3 + 1).alias("reason"), rules.container_of(name).alias("container"))


KINDS_SQL = f"""with {P_SQL}, n as (select *, case when k % 6 = 0 then 'png' when k % 6 = 1 then 'y4m' else ['png', 'gif', 'y4m', 'jpeg', null][s % 5 + 1] end as kind from p)
select p_partkey, kind, case when k % 11 = 0 then 'a folder' when s % 3 = 0 and kind in ('png', 'jpeg') then 'a single picture'
  when s % 3 <> 0 and kind in ('jpeg', 'gif', 'y4m') then 'not a PNG among several files' end as reason,
  case when k % 6 = 4 then 'mpeg4' when k % 6 = 5 then 'quicktime' end as container from n"""


def clip_reasons(spark, sf_dir):
    """Why each part's clip is refused, with every check in reach."""
    k, s = F.col("k"), F.col("s")
    code = F.get(F.array(*map(L, ("avc1", "hev1", "rle ", "abcd", None))), (k % 5).cast("int"))
    clips = _parts(spark, sf_dir).select(
        "p_partkey", (k % 31).alias("size"), (k % 29 != 0).alias("is_movie"), code.alias("code"), (s % 2 == 0).alias("has_audio"), (k % 17 != 0).alias("has_video"), (k % 19 == 0).alias("is_protected"),
        (s % 4 != 0).alias("is_decodable"), F.when(k % 23 != 0, 25.0).alias("fps"), L(3.0).alias("duration"), (s % 13 + 1).alias("width"), F.when(k % 37 != 0, 9).alias("height"),
        (k % 3 != 0).alias("is_extractable"), (s % 5 != 0).alias("is_trimmable"), F.when(k % 2 == 0, False).alias("can_trim_codec"),
    )
    return validation.with_reason(clips).select("p_partkey", "reason")


REASONS_SQL = f"""with {P_SQL}, c as (select *, ['avc1', 'hev1', 'rle ', 'abcd', null][k % 5 + 1] as code, ['h264', null, 'animation', null, null][k % 5 + 1] as codec, k % 17 <> 0 as video, s % 4 <> 0 as decodes from p)
select p_partkey, case when k % 31 <= 0 then 'empty file' when k % 29 = 0 then 'not a video' when codec = 'animation' then 'animation codec' when s % 2 = 0 and not video then 'audio only'
  when not video then 'no video track' when k % 19 = 0 then 'protected' when not decodes and codec is not null then 'not decodable though its codec is known'
  when not decodes and code is null then 'unknown codec' when not decodes and code = 'hev1' then 'unsupported kind of HEVC' when not decodes then 'unsupported codec' when code is null then 'no codec title'
  when k % 23 = 0 then 'no metadata' when not coalesce(s % 13 + 1 >= 4 and case when k % 37 <> 0 then 9 end >= 4, false) then 'under 4 x 4 pixels'
  when k % 3 = 0 then 'video track not readable alone' when s % 5 = 0 and k % 2 <> 0 then 'blank start not trimmable' end as reason from c"""


def raw_video_frames(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    chroma = F.get(F.array(*map(L, ("420jpeg", "422", "444alpha", "mono", "other"))), (k % 5).cast("int"))
    return _parts(spark, sf_dir).select("p_partkey", validation.video_frames_estimate(k * 100_000, s, k % 300 + 1, s * 4, chroma).alias("frames"))


VIDEO_SQL = f"""with {P_SQL} select p_partkey, greatest(k * 100000 - s, 0) // (cast(floor((k % 300 + 1) * (s * 4) * [6, 8, 12, 4, 12][k % 5 + 1] / 4e0) as bigint) + 6) as frames from p"""


def middle_of_nine(spark, sf_dir):
    """The fifth least of each vector's first nine numbers."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 9).cast("array<double>").alias("v"))
    return vectors.select("vec_id", sampling.kth(F.col("v"), 4).alias("middle"))


NINE_SQL = "select vec_id, cast(list_sort(embedding[1:9])[5] as double) as middle from embeddings"

QUERIES = {
    "share_quality": (share_quality, SHARE_SQL),
    "palette_sizes": (palette_sizes, PALETTE_SQL),
    "unchanged_turns": (unchanged_turns, UNCHANGED_SQL),
    "pixel_rules": (pixel_rules, PIXEL_SQL),
    "hex_colours": (hex_colours, HEX_SQL),
    "matrix_names": (matrix_names, MATRIX_SQL),
    "loop_counts": (loop_counts, LOOP_SQL),
    "wished_sizes": (wished_sizes, WISHED_SQL),
    "size_bounds": (size_bounds, BOUNDS_SQL),
    "preset_percents": (preset_percents, PERCENTS_SQL),
    "closest_ratios": (closest_ratios, CLOSEST_SQL),
    "crop_units": (crop_units, UNITS_SQL),
    "centred_crops": (centred_crops, CENTRED_SQL),
    "crop_drags": (crop_drags, DRAGS_SQL),
    "time_ranges": (time_ranges, RANGES_SQL),
    "near_numbers": (near_numbers, NEAR_SQL),
    "codecs": (codecs, CODECS_SQL),
    "number_fields": (number_fields, FIELDS_SQL),
    "clip_reports": (clip_reports, REPORTS_SQL),
    "estimates": (estimates, ESTIMATES_SQL),
    "file_kinds": (file_kinds, KINDS_SQL),
    "clip_reasons": (clip_reasons, REASONS_SQL),
    "raw_video_frames": (raw_video_frames, VIDEO_SQL),
    "middle_of_nine": (middle_of_nine, NINE_SQL),
}
