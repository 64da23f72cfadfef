"""The pixel operators over the stored tables, each registered with the same in SQL.

A picture is a vector: its 64 numbers v make 8 x 8 pixels with r = (v + 3) * 40, whole and within 0 to 255, g = 255 - r,
b = 7 r mod 256 and a = 3 r mod 256. A clip is a label, its frames are ordered by vector id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import pixels
from cadenza.operators import composite, cuts, dither, estimate, frames, palette, ranges, sampling, smooth, timeline
from cadenza.sources import gif, shared, sink, video
from cadenza.streaming import live

PIXELS_SQL = """v as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as j from embeddings),
  q as (select vec_id, label, j % 8 as x, j // 8 as y, cast(least(greatest(floor((v + 3) * 40), 0), 255) as bigint) as r from v),
  p as (select vec_id, label, x, y, r, 255 - r as g, r * 7 % 256 as b, r * 3 % 256 as a from q)"""


def _hex(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def pictures(spark, sf_dir: str, order: str = "rgba", solid: bool = False) -> DataFrame:
    """clip_id (label), frame_index (vector id), width, height, rgba: vectors as pictures, channels in an ``order``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("clip_id"), F.col("vec_id").alias("frame_index"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").cast("array<double>").alias("v"))
    red = F.transform("v", lambda v: F.least(F.greatest(F.floor((v + 3) * 40), F.lit(0)), F.lit(255)).cast("int"))
    channel = {"r": lambda r: _hex(r), "g": lambda r: _hex(255 - r), "b": lambda r: _hex(r * 7 % 256), "a": lambda r: F.lit("FF") if solid else _hex(r * 3 % 256)}
    data = F.unhex(F.array_join(F.transform(red, lambda r: F.concat(*(channel[c](r) for c in order))), ""))
    return rows.select("clip_id", "frame_index", "width", "height", data.alias("rgba"))


def _rows(found: DataFrame, channels: str = "rgba") -> DataFrame:
    return frames.pixel_rows(found).select(F.col("frame_index").alias("vec_id"), *(F.col(c).cast("long").alias(c) for c in f"xy{channels}"))


def picture_alpha(spark, sf_dir):
    """Alpha made solid or clear, edges found by their neighbours."""
    return _rows(frames.solid_or_clear(pictures(spark, sf_dir)), "a")


#: The 8 x 8 thresholds come from the recursive rule, by the bits of x and y.
ALPHA_SQL = f"""with {PIXELS_SQL}, n as (select p.vec_id, p.x, p.y, p.a, dx, dy, o.a as oa
    from p, range(-1, 2) i(dx), range(-1, 2) j(dy) join p o on o.vec_id = p.vec_id and o.x = least(greatest(p.x + dx, 0), 7) and o.y = least(greatest(p.y + dy, 0), 7)),
  m as (select vec_id, x, y, a, max(case when dx = 0 and dy = -1 then oa end) as up, max(case when dx = 0 and dy = 1 then oa end) as down, max(case when dx = -1 and dy = 0 then oa end) as lt, max(case when dx = 1 and dy = 0 then oa end) as rt,
    max(case when dx = -1 and dy = -1 then oa end) as a1, max(case when dx = 1 and dy = 1 then oa end) as a2, max(case when dx = 1 and dy = -1 then oa end) as b1, max(case when dx = -1 and dy = 1 then oa end) as b2 from n group by vec_id, x, y, a),
  e as (select *, (least(up, down) < 12 and greatest(up, down) >= 240) or (least(lt, rt) < 12 and greatest(lt, rt) >= 240) or (least(a1, a2) < 12 and greatest(a1, a2) >= 240) or (least(b1, b2) < 12 and greatest(b1, b2) >= 240) as edge from m),
  t as (select *, case when edge then 89 else 8 + 2 * (16 * (case x % 2 * 2 + y % 2 when 0 then 0 when 3 then 1 when 1 then 2 else 3 end)
    + 4 * (case x // 2 % 2 * 2 + y // 2 % 2 when 0 then 0 when 3 then 1 when 1 then 2 else 3 end) + (case x // 4 * 2 + y // 4 when 0 then 0 when 3 then 1 when 1 then 2 else 3 end)) end as t from e)
select vec_id, x, y, case when a = 255 then 255 when a < t then 0 else 255 end as a from t"""


def _blurred(spark, sf_dir, median: bool) -> DataFrame:
    found = frames.with_blur(pictures(spark, sf_dir), median)
    # three bytes a pixel, made four again
    whole = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.substring(F.hex("blur"), i * 6 + 1, F.lit(6)), F.lit("FF"))), ""))
    return _rows(found.withColumn("rgba", whole), "rgb")


def picture_mean(spark, sf_dir):
    return _blurred(spark, sf_dir, False)


def picture_median(spark, sf_dir):
    return _blurred(spark, sf_dir, True)


def _blur_sql(middle: str) -> str:
    return f"""with {PIXELS_SQL}, n as (select p.*, case when o.a > 0 then o.r else p.r end as nr, case when o.a > 0 then o.g else p.g end as ng, case when o.a > 0 then o.b else p.b end as nb
    from p, range(-1, 2) i(dx), range(-1, 2) j(dy) join p o on o.vec_id = p.vec_id and o.x = least(greatest(p.x + dx, 0), 7) and o.y = least(greatest(p.y + dy, 0), 7)),
  m as (select vec_id, x, y, r, g, b, a, {middle.format('nr')} as mr, {middle.format('ng')} as mg, {middle.format('nb')} as mb from n group by vec_id, x, y, r, g, b, a),
  d as (select *, 2 * (r - mr) * (r - mr) + 3 * (g - mg) * (g - mg) + (b - mb) * (b - mb) < 1536 as near from m)
select vec_id, x, y, case when a = 0 then 255 when near then mr else r end as r, case when a = 0 then 0 when near then mg else g end as g, case when a = 0 then 255 when near then mb else b end as b from d"""


MEAN_SQL, MEDIAN_SQL = _blur_sql("cast(sum({0}) // 9 as bigint)"), _blur_sql("list_sort(list({0}))[5]")


def picture_crop(spark, sf_dir):
    """A part of each picture, where it is by the vector's id; parts that stick out leave their picture out."""
    found = pictures(spark, sf_dir).withColumns({"crop_x": (F.col("frame_index") % 5).cast("int"), "crop_y": (F.col("frame_index") % 4).cast("int"), "crop_width": F.lit(4), "crop_height": F.lit(5)})
    return _rows(frames.cropped(found), "ra")


CROP_SQL = f"""with {PIXELS_SQL} select vec_id, x - vec_id % 5 as x, y - vec_id % 4 as y, r, a from p
where x between vec_id % 5 and vec_id % 5 + 3 and y between vec_id % 4 and vec_id % 4 + 4"""


def picture_matte(spark, sf_dir):
    return _rows(frames.matted(pictures(spark, sf_dir), (10, 200, 30)))


MATTE_SQL = f"""with {PIXELS_SQL} select vec_id, x, y, case when a between 1 and 254 then (r * a + 10 * (255 - a)) // 255 else r end as r,
  case when a between 1 and 254 then (g * a + 200 * (255 - a)) // 255 else g end as g, case when a between 1 and 254 then (b * a + 30 * (255 - a)) // 255 else b end as b, case when a = 0 then 0 else 255 end as a from p"""


def picture_layouts(spark, sf_dir):
    """Rows of seven of eight pixels from raw bytes in another order."""
    found = pictures(spark, sf_dir, "argb").withColumnsRenamed({"rgba": "data"}).withColumns({"width": F.lit(7), "layout": F.lit("argb"), "stride": F.lit(8)})
    return _rows(frames.unpacked(found))


LAYOUTS_SQL = f"with {PIXELS_SQL} select vec_id, x, y, r, g, b, a from p where x < 7"


def premultiplied_layouts(spark, sf_dir):
    """Pictures from raw bytes whose colours hold their alpha."""
    found = pictures(spark, sf_dir, "bgra").withColumnsRenamed({"rgba": "data"}).withColumns({"layout": F.lit("bgra"), "stride": F.lit(None).cast("int"), "premultiplied": F.lit(True)})
    return _rows(frames.unpacked(found))


PREMULTIPLIED_SQL = f"""with {PIXELS_SQL} select vec_id, x, y, {', '.join(f'case when a > 0 then least(({c} * 255 + a // 2) // greatest(a, 1), 255) else 0 end as {c}' for c in 'rgb')}, a from p"""


def changed_bbox(spark, sf_dir):
    """Where each picture differs from the one before of its label, pixels being told apart in four steps of red."""
    coarse = frames.map_images(pictures(spark, sf_dir), lambda x, _: x // 64 * 64)
    found = frames.changed_boxes(coarse)
    return found.select(F.col("frame_index").alias("vec_id"), *(F.col(c).cast("long").alias(n) for c, n in (("left", "x"), ("top", "y"), ("box_width", "w"), ("box_height", "h"))))


CHANGED_SQL = f"""with {PIXELS_SQL}, c as (select *, row_number() over (partition by label, x, y order by vec_id) as i, r // 64 as r4, g // 64 as g4, b // 64 as b4, a // 64 as a4 from p),
  d as (select c.vec_id, c.x, c.y, c.r4 <> o.r4 or c.g4 <> o.g4 or c.b4 <> o.b4 or c.a4 <> o.a4 as differs from c join c o on o.label = c.label and o.x = c.x and o.y = c.y and o.i = c.i - 1),
  m as (select vec_id, min(case when differs then x end) as x, min(case when differs then y end) as y, max(case when differs then x end) as x2, max(case when differs then y end) as y2 from d group by vec_id)
select vec_id, coalesce(x, 0) as x, coalesce(y, 0) as y, coalesce(x2 - x + 1, 1) as w, coalesce(y2 - y + 1, 1) as h from m"""


def video_colours(spark, sf_dir):
    """Pictures whose red is the brightness and whose green and blue are the colour of each 2 x 2 pixels' first, as RGB."""

    def convert(x, _):
        return pixels.yuv_to_rgba(x[..., 0], x[::2, ::2, 1], x[::2, ::2, 2], matrix="bt601", full=True)

    return _rows(frames.map_images(pictures(spark, sf_dir, solid=True), convert), "rgb")


VIDEO_SQL = f"""with {PIXELS_SQL}, c as (select p.vec_id, p.x, p.y, cast(p.r as double) as l, o.g - 128 as u, o.b - 128 as w from p join p o on o.vec_id = p.vec_id and o.x = p.x // 2 * 2 and o.y = p.y // 2 * 2),
  f as (select *, l + 2 * (1 - 0.299e0) * w as red, l + 2 * (1 - 0.114e0) * u as blue from c), h as (select *, (l - 0.299e0 * red - 0.114e0 * blue) / (1 - 0.299e0 - 0.114e0) as green from f)
select vec_id, x, y, cast(least(greatest(round_even(red, 0), 0), 255) as bigint) as r, cast(least(greatest(round_even(green, 0), 0), 255) as bigint) as g, cast(least(greatest(round_even(blue, 0), 0), 255) as bigint) as b from h"""


def video_files(spark, sf_dir):
    """Each label's pictures written as a video of 30 frames a second, and read back by ranges at 7 a second."""
    folder = shared.new_path(spark, "videos")
    made = video.write_files(video.planes_of(pictures(spark, sf_dir, solid=True)), folder, (30, 1))
    made.write.format("noop").mode("overwrite").save()
    found = video.read(spark, folder, fps=7, matrix="bt601", range_bytes=8_000)
    label = F.regexp_extract("clip_id", "([^/]*)[.]y4m$", 1).cast("long")
    rows = frames.pixel_rows(found.withColumn("clip_id", label))
    return rows.select(F.col("clip_id").alias("label"), "frame_index", *(F.col(c).cast("long").alias(c) for c in "xyrgb"))


FILES_SQL = f"""with {PIXELS_SQL}, n as (select *, row_number() over (partition by label, x, y order by vec_id) - 1 as i, cast(r as double) as l, g - 128 as u, b - 128 as w from p),
  k as (select *, row_number() over (partition by label, x, y order by i) - 1 as k from n where i = 0 or (i + 1) * 7 // 30 > i * 7 // 30),
  f as (select *, l + 2 * (1 - 0.299e0) * w as red, l + 2 * (1 - 0.114e0) * u as blue from k), h as (select *, (l - 0.299e0 * red - 0.114e0 * blue) / (1 - 0.299e0 - 0.114e0) as green from f)
select cast(label as bigint) as label, k as frame_index, x, y, cast(least(greatest(round_even(red, 0), 0), 255) as bigint) as r, cast(least(greatest(round_even(green, 0), 0), 255) as bigint) as g, cast(least(greatest(round_even(blue, 0), 0), 255) as bigint) as b from h"""


def clip_files(spark, sf_dir):
    """Each label's pictures as a GIF by the committing sink, without loss, and read back: pixels and display times."""
    whole = pictures(spark, sf_dir, solid=True).withColumn("frame_index", F.col("frame_index").cast("long")).withColumns({"importance": F.lit(None).cast("binary"), "dispose": F.lit("keep")})
    blocks = gif.compressed(palette.assemble(palette.with_palette(whole, palette.MOST_COLOURS - 1))).withColumn("delay", (F.col("frame_index") % 9 + 2).cast("int"))
    folder = shared.new_path(spark, "gifs")
    sink.save(blocks, folder)
    found = gif.read_files(spark, folder).withColumn("clip_id", F.regexp_extract("clip_id", "([^/]*)[.]gif$", 1).cast("long"))
    times = found.select("clip_id", "frame_index", F.col("delay").cast("long").alias("delay"))
    rows = frames.pixel_rows(found).join(times, ["clip_id", "frame_index"])
    return rows.select(F.col("clip_id").alias("label"), "frame_index", *(F.col(c).cast("long").alias(c) for c in "xyrgb"), "delay")


GIF_SQL = f"""with {PIXELS_SQL} select cast(label as bigint) as label, row_number() over (partition by label, x, y order by vec_id) - 1 as frame_index, x, y, r, g, b, cast(vec_id % 9 + 2 as bigint) as delay from p"""


def any_clear(spark, sf_dir):
    """Of each label: whether any, and whether all of its pixels are clear, and how many are."""
    rows = frames.pixel_rows(pictures(spark, sf_dir)).withColumn("clear", F.col("a") < 128)
    return rows.groupBy(F.col("clip_id").cast("long").alias("label")).agg(F.bool_or("clear").alias("some"), F.bool_and("clear").alias("every"), F.count_if("clear").alias("n"))


CLEAR_SQL = f'with {PIXELS_SQL} select cast(label as bigint) as label, bool_or(a < 128) as some, bool_and(a < 128) as "every", count(*) filter (a < 128) as n from p group by label'


def nearest_colours(spark, sf_dir):
    """Each pixel's nearest of eight fixed colours."""
    table = [(0, 0, 0), (255, 255, 255), (200, 50, 60), (40, 215, 20), (90, 165, 118), (130, 125, 142), (170, 85, 166), (60, 195, 164)]

    def remap(x, _):
        import numpy as np

        own = np.array(table, np.uint8)
        index = palette.nearest(x.reshape(-1, 4)[:, :3], own)
        return np.concatenate([index.reshape(8, 8, 1), np.zeros((8, 8, 3), np.int64)], axis=-1).astype(np.uint8)

    return _rows(frames.map_images(pictures(spark, sf_dir), remap), "r").withColumnRenamed("r", "colour")


COLOURS_SQL = f"""with {PIXELS_SQL}, t(c, tr, tg, tb) as (values (0, 0, 0, 0), (1, 255, 255, 255), (2, 200, 50, 60), (3, 40, 215, 20), (4, 90, 165, 118), (5, 130, 125, 142), (6, 170, 85, 166), (7, 60, 195, 164)),
  d as (select vec_id, x, y, c, row_number() over (partition by vec_id, x, y order by 2 * (r - tr) * (r - tr) + 3 * (g - tg) * (g - tg) + (b - tb) * (b - tb), c) as place from p, t)
select vec_id, x, y, cast(c as bigint) as colour from d where place = 1"""


def smoothed_pictures(spark, sf_dir):
    """Pictures smoothed in time at three qualities, and how important each pixel is."""
    blurred = frames.with_blur(pictures(spark, sf_dir))
    found = None
    for quality in (100, 80, 40):
        rows = frames.pixel_rows(smooth.smoothed(blurred, quality), more=("importance",)).withColumn("quality", F.lit(quality))
        found = rows if found is None else found.union(rows)
    return found.select(F.col("frame_index").alias("vec_id"), *(F.col(c).cast("long").alias(c) for c in ("quality", *"xyrgba", "importance")))


#: s is the screen after each frame; everything that doesn't depend on it is in d: the limit by the pixel's turn, how many
#: of the next four frames are like this one, and the colour typical of them.
SMOOTHED_SQL = f"""with recursive {PIXELS_SQL}, n as (select p.*, case when o.a > 0 then o.r else p.r end as nr, case when o.a > 0 then o.g else p.g end as ng, case when o.a > 0 then o.b else p.b end as nb
    from p, range(-1, 2) i(dx), range(-1, 2) j(dy) join p o on o.vec_id = p.vec_id and o.x = least(greatest(p.x + dx, 0), 7) and o.y = least(greatest(p.y + dy, 0), 7)),
  m as (select vec_id, label, x, y, r, g, b, a, cast(sum(nr) // 9 as bigint) as mr, cast(sum(ng) // 9 as bigint) as mg, cast(sum(nb) // 9 as bigint) as mb from n group by all),
  bl as (select *, case when a = 0 then 255 when 2 * (r - mr) * (r - mr) + 3 * (g - mg) * (g - mg) + (b - mb) * (b - mb) < 1536 then mr else r end as br,
    case when a = 0 then 0 when 2 * (r - mr) * (r - mr) + 3 * (g - mg) * (g - mg) + (b - mb) * (b - mb) < 1536 then mg else g end as bg,
    case when a = 0 then 255 when 2 * (r - mr) * (r - mr) + 3 * (g - mg) * (g - mg) + (b - mb) * (b - mb) < 1536 then mb else b end as bb from m),
  t as (select *, row_number() over w - 1 as t, count(*) over (partition by label, x, y) as n, a >= 128 as own, {', '.join(f"lead({c}, {k}) over w as {c}{k}" for k in range(1, 5) for c in ('r', 'g', 'b', 'a', 'br', 'bg', 'bb'))}
    from bl window w as (partition by label, x, y order by vec_id)),
  u as (select t.*, quality, (55 - quality // 2) * (55 - quality // 2) * case when ((r // 2 > g) <> (b > 127)) <> ((t + case when t + 5 <= n then 5 else 4 end) % 2 = 1) then 1 else 2 end as lim from t, (values (100), (80), (40)) z(quality)),
  k as (select *, {', '.join(f"coalesce(a{k} >= 128 and (2*(r{k}-r)*(r{k}-r) + 3*(g{k}-g)*(g{k}-g) + (b{k}-b)*(b{k}-b) < lim or 2*(br{k}-br)*(br{k}-br) + 3*(bg{k}-bg)*(bg{k}-bg) + (bb{k}-bb)*(bb{k}-bb) < lim), false) as l{k}" for k in range(1, 5))} from u),
  h as (select *, case when not l1 then 0 when not l2 then 1 when not l3 then 2 when not l4 then 3 else 4 end as lasts from k),
  d as (select label, vec_id, x, y, t, quality, own, lim, lasts, r, g, b, br, bg, bb, {', '.join(f"case lasts when 0 then {c} when 1 then ({c} + {c}1) // 2 when 2 then list_sort([{c}, {c}1, {c}2])[2] when 3 then (list_sort([{c}, {c}1, {c}2])[2] + list_sort([{c}, {c}1, {c}2])[3]) // 2 else list_sort([{c}, {c}1, {c}2])[3] end as t{c}" for c in 'rgb')} from h),
  s as (select distinct label, x, y, quality, cast(-1 as bigint) as t, cast(0 as bigint) as sr, cast(0 as bigint) as sg, cast(0 as bigint) as sb, false as sh, cast(0 as bigint) as pr, cast(0 as bigint) as st, cast(0 as bigint) as vec_id, false as shown, cast(0 as bigint) as importance from d
    union all select label, x, y, quality, t, case when fresh then tr else sr end, case when fresh then tg else sg end, case when fresh then tb else sb end, own and (sh or fresh),
      cast(case when not own and sh then 0 when fresh and lasts > 0 then lasts else pr end as bigint), cast(case when stay then st + 1 when fresh and lasts > 0 then 0 else st end as bigint), vec_id, own,
      cast(case when not own then (case when sh then 1 else 0 end)
        when stay then (case when (lim < 300 and st < 3) or (lim >= 300 and lim < 500 and st < 2) or (lim >= 400 and lim < 900 and st < 1) then 1 else 0 end)
          + (case when st > 0 then 0 else least(greatest(off - lim, 0) * [0, 40, 80, 100, 110][pr + 1] // (lim * 48), [0, 40, 80, 100, 110][pr + 1]) end)
        when fresh then [10, 5, 15, 50, 50][lasts + 1] + least(greatest(off - lim, 0) * [110, 80, 190, 205, 205][lasts + 1] // (lim * 48), [110, 80, 190, 205, 205][lasts + 1]) else 0 end as bigint)
    from (select *, own and not stay and off >= lim as fresh from (select *, own and st < pr as stay, case when not sh then 1048576 when raw < mild then raw else (raw + mild) // 2 end as off
      from (select d.*, s.sr, s.sg, s.sb, s.sh, s.pr, s.st, 2*(s.sr-d.r)*(s.sr-d.r) + 3*(s.sg-d.g)*(s.sg-d.g) + (s.sb-d.b)*(s.sb-d.b) as raw, 2*(s.sr-d.br)*(s.sr-d.br) + 3*(s.sg-d.bg)*(s.sg-d.bg) + (s.sb-d.bb)*(s.sb-d.bb) as mild
        from s join d on d.label = s.label and d.x = s.x and d.y = s.y and d.quality = s.quality and d.t = s.t + 1))))
select vec_id, cast(quality as bigint) as quality, x, y, case when shown then sr else 0 end as r, case when shown then sg else 0 end as g, case when shown then sb else 0 end as b, cast(case when shown then 255 else 0 end as bigint) as a, importance from s where t >= 0"""


TABLE = [(0, 0, 0), (255, 255, 255), (200, 50, 60), (40, 215, 20), (90, 165, 118), (130, 125, 142), (170, 85, 166), (60, 195, 164)]


def diffused_colours(spark, sf_dir):
    """Each pixel's colour of eight by error diffusion, 8 where it is clear or the picture before already shows it as near."""
    found = pictures(spark, sf_dir)
    before = found.select("clip_id", "frame_index", F.lag("frame_index").over(Window.partitionBy("clip_id").orderBy("frame_index")).alias("before"))
    shown = found.select("clip_id", F.col("frame_index").alias("before"), F.col("rgba").alias("screen"))
    found = found.join(before, ["clip_id", "frame_index"]).join(shown, ["clip_id", "before"], "left")
    done = dither.diffused_frames(found.withColumn("palette", F.unhex(F.lit("".join("%02X%02X%02X" % c for c in TABLE)))), 200)
    return frames.pixel_rows(done, more=("indices",)).select(F.col("frame_index").alias("vec_id"), *(F.col(c).cast("long").alias(c) for c in "xy"), F.col("indices").cast("long").alias("colour"))


def _diffused_sql() -> str:
    """Pixel by pixel: e holds what each pixel still takes, in sixteenths, for each channel a list."""
    gap = lambda r, g, b: f"2 * ({r} - vr) * ({r} - vr) + 3 * ({g} - vg) * ({g} - vg) + ({b} - vb) * ({b} - vb)"
    gaps = "[" + ", ".join(gap(*c) for c in TABLE) + "]"
    pick = lambda c: "[" + ", ".join(str(x["rgb".index(c)]) for x in TABLE) + "]"
    value = lambda c: f"case when a[k + 1] < 128 then 0 else least(greatest({c}[k + 1] + cast(floor(e{c}[k + 1] * 200 / 4096e0) as bigint), 0), 255) end as v{c}"
    share = lambda c: f"list_transform(e{c}, lambda v, i: v + d{c} * case when i = k + 2 and k % 8 < 7 then 7 when i = k + 8 and k % 8 > 0 then 3 when i = k + 9 then 5 when i = k + 10 and k % 8 < 7 then 1 else 0 end)"
    return f"""with recursive {PIXELS_SQL}, l as (select vec_id, label, {', '.join(f'list({c} order by y, x) as {c}' for c in 'rgba')} from p group by vec_id, label),
  w as (select *, {', '.join(f'lag({c}) over (partition by label order by vec_id) as s{c}' for c in 'rgba')} from l),
  s as (select vec_id, cast(0 as bigint) as k, {', '.join(f"list_transform({c}, lambda v: cast(0 as bigint)) as e{c}" for c in 'rgb')}, cast(-1 as bigint) as colour from w
    union all select vec_id, k + 1, {', '.join(share(c) for c in 'rgb')}, colour from (
      select *, {', '.join(f"case when a[k + 1] < 128 then 0 when colour < 8 then v{c} - {pick(c)}[colour + 1] else v{c} - s{c}[k + 1] end as d{c}" for c in 'rgb')} from (
        select *, cast(case when a[k + 1] < 128 then 8 when sa is not null and sa[k + 1] >= 128 and {gap('sr[k + 1]', 'sg[k + 1]', 'sb[k + 1]')} <= list_min(gaps) then 8 else list_position(gaps, list_min(gaps)) - 1 end as bigint) as colour from (
          select *, {gaps} as gaps from (select w.*, s.k, {', '.join(f's.e{c}' for c in 'rgb')}, {', '.join(value(c) for c in 'rgb')} from s join w on w.vec_id = s.vec_id and s.k < 64)))))
select vec_id, (k - 1) % 8 as x, (k - 1) // 8 as y, colour from s where k > 0"""


DIFFUSED_SQL = _diffused_sql()


def median_cuts(spark, sf_dir):
    """A palette of eight colours at most for each picture, by three rounds of halving and one of moving to means."""
    colours = cuts.histogram(frames.pixel_rows(pictures(spark, sf_dir)), "frame_index")
    return cuts.palettes(colours, "frame_index", 3).withColumnRenamed("frame_index", "vec_id")


def _cuts_sql() -> str:
    steps = []
    for k in range(3):
        spread = lambda c, w: f"{w} * (max({c}) over (partition by vec_id, box) - min({c}) over (partition by vec_id, box)) * (max({c}) over (partition by vec_id, box) - min({c}) over (partition by vec_id, box))"
        steps.append(f"""a{k} as (select *, case when dr >= dg and dr >= db then r when dg >= db then g else b end as along from (select *, {spread('r', 2)} as dr, {spread('g', 3)} as dg, {spread('b', 1)} as db from b{k})),
  b{k + 1} as (select vec_id, r, g, b, n, 2 * box + case when 2 * coalesce(sum(n) over (partition by vec_id, box order by along, r, g, b rows between unbounded preceding and 1 preceding), 0) >= sum(n) over (partition by vec_id, box) then 1 else 0 end as box from a{k})""")
    mean = ", ".join(f"cast(floor(cast(2 * sum(n * {c}) + sum(n) as double) / (2 * sum(n))) as bigint) as {c}" for c in "rgb")
    return f"""with {PIXELS_SQL}, b0 as (select vec_id, r, g, b, count(*) as n, cast(0 as bigint) as box from p where a >= 128 group by vec_id, r, g, b),
  {', '.join(steps)}, c as (select vec_id, box, {mean} from b3 group by vec_id, box),
  d as (select o.vec_id, o.r, o.g, o.b, o.n, c.box, row_number() over (partition by o.vec_id, o.r, o.g, o.b order by 2 * (o.r - c.r) * (o.r - c.r) + 3 * (o.g - c.g) * (o.g - c.g) + (o.b - c.b) * (o.b - c.b), c.box) as place from b0 o join c on c.vec_id = o.vec_id)
select vec_id, cast(box as bigint) as box, {mean}, cast(sum(n) as bigint) as n from d where place = 1 group by vec_id, box"""


CUTS_SQL = _cuts_sql()


def composited_pictures(spark, sf_dir):
    """Parts of pictures put on each label's screen, what is left of each afterwards going by its vector's id."""
    found = pictures(spark, sf_dir)
    i = F.col("frame_index")
    found = found.withColumns({"crop_x": (i % 3).cast("int"), "crop_y": (i % 4).cast("int"), "crop_width": (i % 5 + 1).cast("int"), "crop_height": F.lit(4)})
    parts = frames.cropped(found).withColumnsRenamed({"crop_x": "left", "crop_y": "top"}).withColumns({"screen_width": F.lit(8), "screen_height": F.lit(8), "dispose": F.element_at(F.array(*map(F.lit, ("keep", "background", "previous"))), (F.col("frame_index") % 7 % 3 + 1).cast("int"))})
    return composite.composited(parts).select(F.col("frame_index").alias("vec_id"), *(F.col(c).cast("long").alias(c) for c in "xyrgba"))


#: For each frame the newest earlier one that left something at a pixel, by its number, and what that was.
COMPOSITED_SQL = f"""with {PIXELS_SQL}, c as (select *, vec_id % 7 % 3 as d, x between vec_id % 3 and vec_id % 3 + vec_id % 5 and y between vec_id % 4 and vec_id % 4 + 3 as inside from p),
  e as (select *, inside and a >= 128 as draws, inside and (d = 1 or (d = 0 and a >= 128)) as stays from c),
  j as (select e.vec_id, e.x, e.y, max(o.vec_id) as last from e left join e o on o.label = e.label and o.x = e.x and o.y = e.y and o.vec_id < e.vec_id and o.stays group by all),
  f as (select e.vec_id, e.x, e.y, case when e.draws then e.vec_id when o.d = 0 then o.vec_id end as source from e join j on j.vec_id = e.vec_id and j.x = e.x and j.y = e.y left join e o on o.vec_id = j.last and o.x = e.x and o.y = e.y)
select f.vec_id, f.x, f.y, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b, cast(case when source is null then 0 else 255 end as bigint) as a from f left join p on p.vec_id = source and p.x = f.x and p.y = f.y"""


# frames in time


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def resample_even(spark, sf_dir):
    """Each user's events on an even grid, twice as fast: a frame every 32,768 seconds."""
    events = timeline.since_first(_events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", "ts")
    events = events.withColumn("pts", F.col("p") / 1e6)
    clips = events.groupBy("user_id").agg(F.max("pts").alias("duration"))
    found = timeline.resample(events, clips, "user_id", ["event_id"], "pts", "event_id", fps=2.0**-15, speed=2.0)
    return found.select("user_id", F.col("k").cast("long").alias("k"), "pts", "event_id")


RESAMPLE_SQL = """with f as (select user_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as p from events),
  c as (select user_id, cast(ceil(max(p) / 65536e0) as bigint) as n from f group by user_id), g as (select user_id, k, k * 65536e0 as t, k * 32768e0 as pts from c, range(0, (select max(n) from c)) r(k) where k < n),
  j as (select g.user_id, g.k, g.pts, f.event_id, row_number() over (partition by g.user_id, g.k order by f.p desc, f.event_id desc) as best from g join f on f.user_id = g.user_id and f.p <= g.t)
select user_id, k, pts, event_id from j where best = 1"""


def running_estimates(spark, sf_dir):
    """The size on show while a user's events are written, each as long as its properties."""
    events = timeline.numbered(_events(spark, sf_dir).select("user_id", "event_id", "ts", F.length("props").cast("long").alias("size")), "user_id", ["ts", "event_id"], count="n")
    events = estimate.written_bytes(events, "user_id", "i", F.col("size")).withColumn("done", F.col("i").cast("long") + 1)
    return estimate.running_estimates(events, "user_id", ["i"], "written", "done", "n").select("user_id", "event_id", "estimate", "shown")


RUNNING_SQL = """with recursive f as (select user_id, event_id, row_number() over w as i, count(*) over (partition by user_id) as n, cast(sum(length(props)) over w as bigint) as w from events window w as (partition by user_id order by ts, event_id)),
  b as (select *, w * n // i as whole, i > least(greatest(n // 16, 5), 50) as warm from f),
  s as (select user_id, i, event_id, cast(0 as bigint) as e, cast(0 as bigint) as d from b where i = 1
    union all select user_id, i, event_id, e, case when warm and abs(d - e) > e // 10 then e else d end from (
      select b.user_id, b.i, b.event_id, b.warm, case when not b.warm then s.e when b.whole >= s.e then b.whole else (s.e + b.whole) // 2 end as e, s.d as d from s join b on b.user_id = s.user_id and b.i = s.i + 1))
select user_id, event_id, e as estimate, d as shown from s"""


def chunks_flattened(spark, sf_dir):
    """Each user's events by fives, and all fives of a user laid flat again, with how many chunks there were."""
    events = timeline.numbered(_events(spark, sf_dir).select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])
    chunks = sampling.chunk(events, 5).groupBy("user_id", "chunk").agg(F.array_sort(F.collect_list("i")).alias("i"))
    lists = chunks.groupBy("user_id").agg(F.array_sort(F.collect_list("i")).alias("i"), F.count(F.lit(1)).alias("chunks"))
    return sampling.flattened(lists, "i").select("user_id", F.col("i").cast("long").alias("i"), "chunks")


FLAT_SQL = """select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, (count(*) over (partition by user_id) + 4) // 5 as chunks from events"""


def newest_events(spark, sf_dir):
    """The newest hundred events, which a reader who is behind still gets."""
    events = _events(spark, sf_dir).select(F.col("event_id").alias("request_id"), "user_id", "ts")
    return live.newest_events(events).select("user_id", "request_id")


NEWEST_SQL = "select user_id, event_id as request_id from events order by ts desc, event_id desc limit 100"


def stale_dropped(spark, sf_dir):
    """Requests that no higher id came before, as a batch: ids are the events' values in hundredths."""
    events = _events(spark, sf_dir).select("user_id", "event_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("request_id"))
    return live.newest_ids(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "request_id")


STALE_SQL = """select user_id, event_id, r as request_id from (select *, cast(floor(value * 100) as bigint) as r, max(cast(floor(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events)
where before is null or r >= before"""


def preview_reuse(spark, sf_dir):
    """Each request for a range of time, and the newest finished one before it that holds the range under equal settings."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", F.col("value").alias("low"), (F.col("value") + F.col("event_id") % 50).alias("high"))
    return ranges.newest_holding(events, ["user_id", "event_type"], ["ts", "event_id"], "event_id", "low", "high").select("event_id", "reused")


def preview_reuse_by_type(spark, sf_dir):
    """The same among all users' requests of one type: few keys, each with very many requests. Every seventh is for the whole clip."""
    whole = F.col("event_id") % 7 == 0
    events = _events(spark, sf_dir).select("event_id", "ts", "event_type", F.when(~whole, F.col("value")).alias("low"), F.when(~whole, F.col("value") + F.col("event_id") % 50).alias("high"))
    return ranges.newest_holding(events, ["event_type"], ["ts", "event_id"], "event_id", "low", "high").select("event_id", "reused")


REUSE_SQL = """with e as (select *, value as low, value + event_id % 50 as high, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events),
  j as (select a.event_id, b.event_id as reused, row_number() over (partition by a.event_id order by b.i desc) as place from e a left join e b on b.user_id = a.user_id and b.event_type = a.event_type
    and b.i < a.i and b.low <= a.low and a.high <= b.high)
select event_id, reused from j where place = 1"""

TYPE_REUSE_SQL = """with e as (select event_id, event_type, case when event_id % 7 = 0 then '-inf'::double else value end as low, case when event_id % 7 = 0 then 'inf'::double else value + event_id % 50 end as high,
    row_number() over (partition by event_type order by ts, event_id) as i from events)
select a.event_id, max_by(b.event_id, b.i) as reused from e a left join e b on b.event_type = a.event_type and b.i < a.i and b.low <= a.low and a.high <= b.high group by a.event_id"""


def joint_progress(spark, sf_dir):
    """Progress of two tasks in a row, weighing 0.67 and 0.33, by each part."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 100 / 80).alias("a"), (F.col("p_size") / 60).alias("b"))
    return parts.select("p_partkey", F.round(live.joint_progress([(0.67, F.col("a")), (0.33, F.col("b"))]), 6).alias("progress"))


PROGRESS_SQL = "select p_partkey, round((0.67e0 * least(p_partkey % 100 / 80e0, 1) + 0.33e0 * least(p_size / 60e0, 1)) / 1e0, 6) as progress from part"

QUERIES = {
    "picture_alpha": (picture_alpha, ALPHA_SQL),
    "picture_mean": (picture_mean, MEAN_SQL),
    "picture_median": (picture_median, MEDIAN_SQL),
    "picture_crop": (picture_crop, CROP_SQL),
    "picture_matte": (picture_matte, MATTE_SQL),
    "picture_layouts": (picture_layouts, LAYOUTS_SQL),
    "changed_bbox": (changed_bbox, CHANGED_SQL),
    "premultiplied_layouts": (premultiplied_layouts, PREMULTIPLIED_SQL),
    "video_colours": (video_colours, VIDEO_SQL),
    "video_files": (video_files, FILES_SQL),
    "clip_files": (clip_files, GIF_SQL),
    "diffused_colours": (diffused_colours, DIFFUSED_SQL),
    "median_cuts": (median_cuts, CUTS_SQL),
    "composited_pictures": (composited_pictures, COMPOSITED_SQL),
    "any_clear": (any_clear, CLEAR_SQL),
    "nearest_colours": (nearest_colours, COLOURS_SQL),
    "resample_even": (resample_even, RESAMPLE_SQL),
    "running_estimates": (running_estimates, RUNNING_SQL),
    "chunks_flattened": (chunks_flattened, FLAT_SQL),
    "newest_events": (newest_events, NEWEST_SQL),
    "stale_dropped": (stale_dropped, STALE_SQL),
    "preview_reuse": (preview_reuse, REUSE_SQL),
    "preview_reuse_by_type": (preview_reuse_by_type, TYPE_REUSE_SQL),
    "smoothed_pictures": (smoothed_pictures, SMOOTHED_SQL),
    "joint_progress": (joint_progress, PROGRESS_SQL),
}
