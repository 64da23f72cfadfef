"""The sequence operators over the stored tables: a clip is a user's events in order of time.

A frame's picture is its event type, its time whole microseconds since the clip's first event. Each query is
registered with the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import rules
from cadenza.operators import estimate, sampling, scan, timeline
from cadenza.streaming import live

ORDER = ["ts", "event_id"]
#: Ticks of ten minutes, so that the display limit is out of reach.
LONG_TICK_US = 600_000_000


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _frames(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    events = _read(spark, sf_dir, "events", "event_id", "user_id", "ts", *more)
    return timeline.since_first(timeline.numbered(events, "user_id", ORDER, count="n"), "user_id", "ts")


F_SQL = """f as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i,
  count(*) over (partition by user_id) as n,
  epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as p from events)"""


def collapse_runs(spark, sf_dir):
    frames = _read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    found = timeline.collapse_runs(frames, "user_id", ORDER, "event_type", first_of=["event_id", "value"])
    return found.select("user_id", "event_id", "event_type", "first_event_id", F.col("first_value").alias("first_val"))


COLLAPSE_SQL = """with s as (select *, lag(event_type) over w as before, lead(event_type) over w as after,
    row_number() over w as k from events window w as (partition by user_id order by ts, event_id)),
  g as (select *, sum(case when k = 1 or before <> event_type then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from s)
select user_id, event_id, event_type, first_event_id, first_val from (
  select *, first_value(event_id) over r as first_event_id, first_value(value) over r as first_val from g
  window r as (partition by user_id, run order by ts, event_id)) where after is null or after <> event_type"""


def delay_ticks(spark, sf_dir):
    """Runs collapsed, the rest renumbered and given their display time."""
    frames = _read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    frames = timeline.collapse_runs(frames, "user_id", ORDER, "event_type")
    frames = timeline.since_first(timeline.numbered(frames, "user_id", ORDER), "user_id", "ts")
    frames = timeline.durations(frames, "user_id", ORDER, "p", least=10_000)
    frames = frames.withColumn("end_ticks", F.expr(f"(end + {LONG_TICK_US // 2}L) div {LONG_TICK_US}L"))
    return timeline.delay_ticks(frames, "user_id", ORDER, "end_ticks").select("user_id", "event_id", F.col("i").cast("long").alias("i"), "delay")


_KEPT_SQL = """k0 as (select *, lead(event_type) over (partition by user_id order by ts, event_id) as after from events),
  k as (select *, row_number() over w as j, epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as p
    from k0 where after is null or after <> event_type window w as (partition by user_id order by ts, event_id)),
  e as (select *, coalesce(lead(p) over w, p + greatest(p - lag(p, 1, 0) over w, 10000)) as ended
    from k window w as (partition by user_id order by ts, event_id)),
  r as (select *, (ended + 300000000) // 600000000 as r from e)"""

DELAY_SQL = f"""with {_KEPT_SQL},
  a as (select *, 2 * j + greatest(0, max(r - 2 * j) over (partition by user_id order by ts, event_id rows unbounded preceding)) as total from r)
select user_id, event_id, j - 1 as i, total - lag(total, 1, 0) over (partition by user_id order by ts, event_id) as delay from a"""


def delay_ticks_limited(spark, sf_dir):
    """Display times with the upper limit (here 40 ticks), by a scan in two levels; a row per clip."""
    frames = timeline.durations(_frames(spark, sf_dir), "user_id", ORDER, "p", least=10_000)
    frames = frames.withColumn("end_ticks", F.expr(f"(end + {LONG_TICK_US // 2}L) div {LONG_TICK_US}L"))
    found = scan.limited_delays(frames.select("user_id", *ORDER, "end_ticks"), "user_id", ORDER, "end_ticks", most=40)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("delay").alias("ticks"), F.max("delay").alias("longest"))


LIMITED_SQL = f"""with recursive {F_SQL},
  e as (select *, coalesce(lead(p) over w, p + greatest(p - lag(p, 1, 0) over w, 10000)) as ended from f window w as (partition by user_id order by ts, event_id)),
  r as (select user_id, i, n, (ended + 300000000) // 600000000 as r from e),
  s as (select user_id, i, least(greatest(r, 2), 40) as total, least(greatest(r, 2), 40) as delay from r where i = 0
    union all select r.user_id, r.i, s.total + least(greatest(r.r - s.total, 2), 40), least(greatest(r.r - s.total, 2), 40) from s join r on r.user_id = s.user_id and r.i = s.i + 1)
select user_id, count(*) as frames, cast(sum(delay) as bigint) as ticks, max(delay) as longest from s group by user_id"""


def frame_durations(spark, sf_dir):
    frames = timeline.durations(_frames(spark, sf_dir), "user_id", ORDER, "p", least=10_000)
    return frames.select("user_id", "event_id", "p", "duration", F.col("end").alias("ended"))


DURATIONS_SQL = f"""with {F_SQL} select user_id, event_id, p, greatest(p - lag(p, 1, 0) over w, 10000) as duration,
  coalesce(lead(p) over w, p + greatest(p - lag(p, 1, 0) over w, 10000)) as ended
from f window w as (partition by user_id order by ts, event_id)"""


def decimate_fps(spark, sf_dir):
    return timeline.decimate(_frames(spark, sf_dir), (30, 1), (7, 1)).select("user_id", "event_id", F.col("i").cast("long").alias("i"))


DECIMATE_SQL = f"""with {F_SQL}, k as (select distinct greatest(k, (k * 30 + 6) // 7 - 1) as i from range(0, (select max(n) + 1 from f)) t(k))
select user_id, event_id, f.i from f join k on k.i = f.i"""


def even_sample(spark, sf_dir):
    return sampling.even_chunks(_frames(spark, sf_dir), chunks=5, size=5).select("user_id", "event_id", F.col("i").cast("long").alias("i"))


_CHUNKS_SQL = f"""{F_SQL}, c as (select *, i // 5 as chunk, (n + 4) // 5 as nc from f),
  s as (select * from c where n <= 25 or chunk in (nc // 2 // 5, (nc + nc // 2) // 5, (2 * nc + nc // 2) // 5, (3 * nc + nc // 2) // 5, (4 * nc + nc // 2) // 5))"""
EVEN_SQL = f"with {_CHUNKS_SQL} select user_id, event_id, i from s"


def size_estimate(spark, sf_dir):
    frames = _frames(spark, sf_dir, "event_type").withColumn("bytes", F.length("event_type").cast("long"))
    found = estimate.estimated_size(frames, "user_id", "bytes")
    return found.select("user_id", "sampled_size", "sampled", F.round("estimate", 6).alias("estimate"))


SIZE_SQL = f"""with {_CHUNKS_SQL} select user_id, cast(sum(length(event_type)) as bigint) as sampled_size, count(*) as sampled,
  round(cast(sum(length(event_type)) as double) * (cast(max(n) as double) / count(*)) * cast(1.1 as double), 6) as estimate from s group by user_id"""


def bounce_turn(spark, sf_dir):
    return timeline.bounce(_frames(spark, sf_dir)).select("user_id", "event_id", "out_index")


TURN_SQL = f"""with {F_SQL} select user_id, event_id, i as out_index from f
union all select user_id, event_id, 2 * n - 2 - i from f where i < n - 1"""


def bounce_repeat(spark, sf_dir):
    return timeline.bounce(_frames(spark, sf_dir), mode="repeat").select("user_id", "event_id", "out_index")


REPEAT_SQL = f"""with {F_SQL} select user_id, event_id, i as out_index from f
union all select user_id, event_id, 2 * n - 1 - i from f where i > 0"""


def monotonic_filter(spark, sf_dir):
    frames = _read(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return timeline.monotonic(frames, "user_id", ORDER, "value").select("user_id", "event_id", "value")


MONOTONIC_SQL = """select user_id, event_id, value from (select *, max(value) over (partition by user_id order by ts, event_id
  rows between unbounded preceding and 1 preceding) as before from events) where before is null or value > before"""


def drop_leading_blank(spark, sf_dir):
    frames = _read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return timeline.drop_leading_blank(frames, "user_id", ORDER, F.col("event_type") == "view").select("user_id", "event_id", "event_type")


BLANK_SQL = """select user_id, event_id, event_type from (select *, sum(case when event_type <> 'view' then 1 else 0 end)
  over (partition by user_id order by ts, event_id) as seen from events) where seen > 0"""


def drop_unchanged(spark, sf_dir):
    """A frame changes if its value is above 20; one of type click leaves the screen empty."""
    frames = _read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    frames = frames.withColumns({"changed": F.col("value") > 20, "keeps": F.col("event_type") != "click"})
    return scan.drop_unchanged(frames, "user_id", ORDER, "changed", "keeps").select("user_id", "event_id")


UNCHANGED_SQL = f"""with recursive {F_SQL},
  s as (select user_id, event_id, i, true as kept, event_type <> 'click' as keeps from f where i = 0
    union all select f.user_id, f.event_id, f.i, (not s.keeps) or f.value > 20,
      case when (not s.keeps) or f.value > 20 then f.event_type <> 'click' else s.keeps end
    from s join f on f.user_id = s.user_id and f.i = s.i + 1)
select user_id, event_id from s where kept"""


def disposal(spark, sf_dir):
    frames = _read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    frames = frames.withColumn("clear", F.col("event_type") == "click")
    return timeline.disposal(frames, "user_id", ORDER, "clear", "clear").select("user_id", "event_id", "dispose")


DISPOSAL_SQL = """select user_id, event_id, case when coalesce(lead(event_type = 'click') over w, first_value(event_type = 'click') over w)
  then 'background' else 'keep' end as dispose from events window w as (partition by user_id order by ts, event_id)"""


def keyframe_stats(spark, sf_dir):
    frames = _read(spark, sf_dir, "events", "user_id", "event_type")
    found = estimate.keyframe_stats(frames, "user_id", F.col("event_type") == "click")
    return found.select("user_id", "samples", "keyframes", F.round("interval", 9).alias("key_interval"), F.round("rate", 9).alias("key_rate"))


KEYFRAME_SQL = """select user_id, samples, keyframes, round(cast(samples as double) / nullif(keyframes, 0), 9) as key_interval,
  round(cast(keyframes as double) / samples, 9) as key_rate
from (select user_id, count(*) as samples, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as keyframes from events group by user_id)"""


def asof_lookup(spark, sf_dir):
    """What each clip shows on an even grid of 20 steps over its length."""
    frames = _frames(spark, sf_dir)
    clips = _read(spark, sf_dir, "events", "user_id", "ts").groupBy("user_id").agg(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("length"))
    grid = clips.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"), "length").select("user_id", F.col("k").cast("long").alias("k"), F.expr("k * length div 20L").alias("t"))
    return timeline.frame_at(frames, grid, "user_id", ["event_id"], "p", "t", "event_id", "event_id")


ASOF_SQL = f"""with {F_SQL}, c as (select user_id, max(p) as length from f group by user_id),
  g as (select user_id, k, k * length // 20 as t from c, range(0, 21) r(k)),
  j as (select g.user_id, g.k, g.t, f.event_id, row_number() over (partition by g.user_id, g.k order by f.p desc, f.event_id desc) as best
    from g join f on f.user_id = g.user_id and f.p <= g.t)
select user_id, k, t, event_id from j where best = 1"""


def first_offset(spark, sf_dir):
    """Times counted from the table's first event; clips that start later are moved to 0."""
    frames = _read(spark, sf_dir, "events", "event_id", "user_id", "ts")
    origin = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    frames = frames.withColumn("q", F.timestamp_diff("MICROSECOND", origin, "ts"))
    return timeline.without_first_offset(frames, "user_id", ORDER, "q").select("user_id", "event_id", "q", "offset")


OFFSET_SQL = """with t as (select *, epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00') as q0 from events),
  o as (select *, first_value(q0) over (partition by user_id order by ts, event_id) as f0 from t)
select user_id, event_id, q0 - case when f0 > 10000 then f0 else 0 end as q, case when f0 > 10000 then f0 else 0 end as "offset" from o"""


def trim_and_speed(spark, sf_dir):
    frames = timeline.trim(_frames(spark, sf_dir), "p", 3_600_000_000, 864_000_000_000)
    return timeline.retime(frames, "p", 2.0).select("user_id", "event_id", F.col("p").alias("played_at"))


TRIM_SQL = f"with {F_SQL} select user_id, event_id, p / 2.0::double as played_at from f where p between 3600000000 and 864000000000"


def sample_times(spark, sf_dir):
    """Times for each part's clip: as long as its size, at a rate by its key."""
    clips = _read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.col("p_size").cast("double").alias("duration"), (F.col("p_partkey") % 4 + 0.5).alias("fps"), (F.col("p_partkey") % 3).cast("double").alias("start"))
    return timeline.sample_times(clips).select("p_partkey", F.col("k").cast("long").alias("k"), F.round("time", 9).alias("at"))


TIMES_SQL = """with c as (select p_partkey, cast(p_size as double) as duration, p_partkey % 4 + cast(0.5 as double) as fps, cast(p_partkey % 3 as double) as start from part),
  n as (select *, cast(floor(duration * fps) as bigint) as n from c)
select p_partkey, k, round(case when k < n then start + k / fps else start + duration end, 9) as at
from n, range(0, (select max(n) + 1 from n)) r(k) where n >= 2 and k <= n"""


def written_bytes(spark, sf_dir):
    """Bytes of a conversation written so far, turn by turn."""
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return estimate.written_bytes(turns, "conv_id", "turn", F.octet_length("text").cast("long")).select("conv_id", "turn", "written")


WRITTEN_SQL = "select conv_id, turn, cast(sum(strlen(text)) over (partition by conv_id order by turn) as bigint) as written from conversations"


def collapse_order_lines(spark, sf_dir):
    """Runs of lines of an order with one return flag."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
    order = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return timeline.collapse_runs(lines, "l_orderkey", order, "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("runs"), F.sum("l_quantity").alias("last_quantity"))


LINES_SQL = """select l_returnflag, count(*) as runs, sum(l_quantity) as last_quantity from (
  select *, lead(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as after from lineitem)
where after is null or after <> l_returnflag group by l_returnflag"""


def clip_metadata(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_partkey")
    found = estimate.clip_metadata(lines, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity"))
    return found.select("l_orderkey", "frames", F.col("first").alias("first_line"), F.col("last").alias("last_line"), "width", "height", "bytes", F.round("fps", 9).alias("fps"))


METADATA_SQL = """select l_orderkey, count(*) as frames, min(l_linenumber) as first_line, max(l_linenumber) as last_line, max(l_suppkey) as width,
  max(l_partkey) as height, sum(l_quantity) as bytes, round(cast(count(*) - 1 as double) / nullif(max(l_linenumber) - min(l_linenumber), 0), 9) as fps
from lineitem group by l_orderkey"""


def nearest_palette(spark, sf_dir):
    """For each vector the nearest of eight centres (vectors 0 to 7). The centres are eight rows by definition."""
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("v", F.col("embedding").cast("array<double>"))
    centres = F.broadcast(vectors.filter("vec_id < 8").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("c_id"), F.col("v").alias("c")))).alias("centres")))
    gap = lambda v, c: F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    best = F.array_min(F.transform("centres", lambda c: F.struct(gap(F.col("v"), c["c"]).alias("d"), c["c_id"].alias("c_id"))))
    return vectors.join(centres).select("vec_id", best["c_id"].alias("c_id"))


NEAREST_SQL = """with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from embeddings),
  d as (select a.vec_id, c.vec_id as c_id, sum((a.x - c.x) * (a.x - c.x)) as d from v a join v c on a.k = c.k where c.vec_id < 8 group by a.vec_id, c.vec_id)
select vec_id, c_id from (select *, row_number() over (partition by vec_id order by d, c_id) as r from d) where r = 1"""


def output_size(spark, sf_dir):
    """Sizes of frames as wide as a part's key and as high as its size times 40."""
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_size")
    w, h = F.col("p_partkey") % 4000 + 1, F.col("p_size").cast("long") * 40
    free, both, one = rules.output_size(w, h), rules.output_size(w, h, F.lit(640), F.lit(360)), rules.output_size(w, h, F.lit(640))
    return parts.select("p_partkey", free["width"].alias("w"), free["height"].alias("h"), both["width"].alias("w2"), both["height"].alias("h2"), one["width"].alias("w1"), one["height"].alias("h1"))


OUTPUT_SQL = """with s as (select p_partkey, p_partkey % 4000 + 1 as w, cast(p_size as bigint) * 40 as h from part),
  k as (select *, greatest(cast(round(sqrt((w * h + 240000) / 480000.0::double)) as bigint), 1) as k from s)
select p_partkey, w // k as w, h // k as h, least(w, 640) as w2, least(h, 360) as h2, least(w, 640) as w1, h * least(w, 640) // w as h1 from k"""


def quality_rules(spark, sf_dir):
    """The settings that follow from a quality for each part: 1 to 100, by its size and key."""
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("quality", ((F.col("p_size") * 2 + F.col("p_partkey")) % 100 + 1).cast("long"))
    c = F.col("quality")
    return parts.select("p_partkey", "quality", rules.colour_quality(c).alias("colour_quality"), rules.lossy_level(c).alias("lossy"), F.round(rules.dither_level(c, c), 9).alias("dither"), rules.most_colours(c, 3).alias("colours"), rules.smoothing_threshold(c).alias("threshold"))


QUALITY_SQL = """select p_partkey, q as quality, least(q * 4 // 3, 100) as colour_quality,
  case when q < 100 then cast((ceil(pow(greatest(20 - q / 5.0::double, 0), 1.8::double)) + 10) * 10 as bigint) else 0 end as lossy,
  round(least(greatest(q * (0.25::double + q * 0.75::double / 90) / 50 - 1, 0.2::double), 1.0::double), 9) as dither,
  cast(case when q < 50 then least(pow(2, ceil(log2(greatest(2 * q, 8)::double))), 256) else 256 end as bigint) as colours,
  (55 - q // 2) * (55 - q // 2) as threshold from (select p_partkey, cast((p_size * 2 + p_partkey) % 100 + 1 as bigint) as q from part)"""


def natural_sort(spark, sf_dir):
    """The order of the parts' names by the numbers in them, within each brand."""
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_brand").withColumn("name", F.concat(F.lit("frame"), F.col("p_partkey"), F.lit(".png")))
    return scan.numbered(parts, "p_brand", [sampling.natural_key(F.col("name"))], "place").select("p_partkey", (F.col("place") + 1).alias("place"))


NATURAL_SQL = "select p_partkey, row_number() over (partition by p_brand order by p_partkey) as place from part"

def live_debounce(spark, sf_dir):
    """The last event of each burst of a user's events: nothing follows within six hours."""
    events = _read(spark, sf_dir, "events", "user_id", F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    return live.debounced(events, "user_id", quiet=21_600).select("user_id", "request_id", "requests")


DEBOUNCE_SQL = """with g as (select *, case when ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as opens from events
    window w as (partition by user_id order by ts, event_id)),
  b as (select *, sum(opens) over (partition by user_id order by ts, event_id) as burst from g),
  k as (select *, row_number() over (partition by user_id, burst order by ts desc, event_id desc) as r, count(*) over (partition by user_id, burst) as requests from b)
select user_id, event_id as request_id, requests from k where r = 1"""


def rate_rules(spark, sf_dir):
    """Rates that follow from each part's size (as the wish) and key (as the clip's own rate)."""
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_size")
    own = (F.col("p_partkey") % 90 + 1).cast("double")
    wish = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double") * 1.5)
    return parts.select("p_partkey", rules.clip_rate(wish, own).alias("rate"), rules.rate_ceiling(own, F.lit(1.25)).alias("ceiling"))


RATE_SQL = """with p as (select p_partkey, cast(p_partkey % 90 + 1 as double) as own, case when p_size % 5 <> 0 then cast(p_size as double) * 1.5::double end as wish from part)
select p_partkey, least(least(greatest(coalesce(wish, own), 0.1::double), 50::double), own) as rate,
  cast(least(greatest(round(own * 1.25::double), 3), 50) as bigint) as ceiling from p"""


def crop_rules(spark, sf_dir):
    """Crops of frames of 1000 x 600 pixels placed by each part's key and size."""
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_size")
    x, y, side = (F.col("p_partkey") % 1100).cast("double"), (F.col("p_partkey") % 700).cast("double"), F.col("p_size").cast("double") * 10
    rect = F.struct(x.alias("x"), y.alias("y"), side.alias("width"), side.alias("height"))
    inside = rules.crop_inside(rect, F.lit(1000.0), F.lit(600.0))
    return parts.select("p_partkey", inside["x"].alias("x"), inside["y"].alias("y"), inside["width"].alias("w"), inside["height"].alias("h"))


CROP_SQL = """with p as (select p_partkey, cast(p_partkey % 1100 as double) as x, cast(p_partkey % 700 as double) as y, cast(p_size as double) * 10 as s from part),
  c as (select p_partkey, greatest(x, 0) as x0, least(x + s, 1000) as x1, greatest(600 - y - s, 0) as y0, least(600 - y, 600) as y1 from p),
  k as (select *, x1 - x0 >= 1 and y1 - y0 >= 1 as ok from c)
select p_partkey, case when ok then x0 end as x, case when ok then y0 end as y, case when ok then x1 - x0 end as w, case when ok then y1 - y0 end as h from k"""


def whole_ratios(spark, sf_dir):
    """Each part's key to its size in least whole numbers."""
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_size")
    ratio = rules.whole_ratio(F.col("p_partkey"), F.col("p_size"))
    return parts.select("p_partkey", ratio["width"].alias("a"), ratio["height"].alias("b"))


RATIO_SQL = """select p_partkey, p_partkey // gcd(p_partkey, cast(p_size as bigint)) as a,
  cast(p_size as bigint) // gcd(p_partkey, cast(p_size as bigint)) as b from part"""


def first_line(spark, sf_dir):
    """Of each order its returned line of the least number, as a clip has its first video track."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_returnflag").alias("flag"))
    return estimate.first_track(lines, "l_orderkey", "l_linenumber", F.col("flag") == "R")


FIRST_SQL = """with l as (select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_returnflag) as flag from lineitem group by l_orderkey, l_linenumber)
select l_orderkey, l_linenumber, l_partkey, flag from (select *, row_number() over (partition by l_orderkey order by l_linenumber) as r from l where flag = 'R') where r = 1"""


def last_setting(spark, sf_dir):
    """Each user's last event type."""
    events = _read(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id")
    return estimate.last_by_key(events, "user_id", "event_type", ORDER)


LAST_SQL = """select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1"""


def preset_sizes(spark, sf_dir):
    """The sizes on offer for frames one pixel wider than a part's key and half as high."""
    parts = _read(spark, sf_dir, "part", "p_partkey").withColumn("own", F.col("p_partkey") + 1)
    sizes = F.explode(rules.preset_sizes(F.col("own"), F.col("own") / 2))
    return parts.select("p_partkey", sizes.alias("s")).select("p_partkey", F.col("s.width").alias("width"), F.col("s.height").alias("height"))


PRESET_SQL = """with w(width) as (values (1280), (1024), (960), (800), (768), (640), (512), (480), (400), (320), (256), (200)),
  p as (select p_partkey, p_partkey + 1 as own from part),
  s as (select p_partkey, own, cast(width as bigint) as width from p, w where width <= own union select p_partkey, own, own from p)
select p_partkey, width, cast(round((own / 2.0::double) * width / own) as bigint) as height from s"""


QUERIES = {
    "delay_ticks": (delay_ticks, DELAY_SQL),
    "collapse_runs": (collapse_runs, COLLAPSE_SQL),
    "delay_ticks_limited": (delay_ticks_limited, LIMITED_SQL),
    "frame_durations": (frame_durations, DURATIONS_SQL),
    "decimate_fps": (decimate_fps, DECIMATE_SQL),
    "even_sample": (even_sample, EVEN_SQL),
    "size_estimate": (size_estimate, SIZE_SQL),
    "bounce_turn": (bounce_turn, TURN_SQL),
    "bounce_repeat": (bounce_repeat, REPEAT_SQL),
    "monotonic_filter": (monotonic_filter, MONOTONIC_SQL),
    "drop_leading_blank": (drop_leading_blank, BLANK_SQL),
    "drop_unchanged": (drop_unchanged, UNCHANGED_SQL),
    "disposal": (disposal, DISPOSAL_SQL),
    "keyframe_stats": (keyframe_stats, KEYFRAME_SQL),
    "asof_lookup": (asof_lookup, ASOF_SQL),
    "first_offset": (first_offset, OFFSET_SQL),
    "trim_and_speed": (trim_and_speed, TRIM_SQL),
    "sample_times": (sample_times, TIMES_SQL),
    "written_bytes": (written_bytes, WRITTEN_SQL),
    "collapse_order_lines": (collapse_order_lines, LINES_SQL),
    "clip_metadata": (clip_metadata, METADATA_SQL),
    "nearest_palette": (nearest_palette, NEAREST_SQL),
    "output_size": (output_size, OUTPUT_SQL),
    "quality_settings": (quality_rules, QUALITY_SQL),
    "natural_sort": (natural_sort, NATURAL_SQL),
    "rate_rules": (rate_rules, RATE_SQL),
    "crop_rules": (crop_rules, CROP_SQL),
    "whole_ratios": (whole_ratios, RATIO_SQL),
    "first_line": (first_line, FIRST_SQL),
    "last_setting": (last_setting, LAST_SQL),
    "preset_sizes": (preset_sizes, PRESET_SQL),
    "live_debounce": (live_debounce, DEBOUNCE_SQL),
}
