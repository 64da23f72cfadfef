"""Which files and clips can be taken: rules as columns that give the first reason against, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import sniff_type

#: Codecs by their four-character codes (fixed values of the container format).
CODECS = {
    "hvc1": "hevc", "avc1": "h264", "av01": "av1", "vp09": "vp9",
    "aprh": "prores_raw_hq", "aprn": "prores_raw", "ap4x": "prores_4444_xq", "ap4h": "prores_4444",
    "apch": "prores_422_hq", "apcn": "prores_422", "apcs": "prores_422_lt", "apco": "prores_422_proxy",
    "rle": "animation", "smc": "quicktime_graphics", "CFHD": "cineform_hd", "AVdh": "dnxhd",
    "Hap1": "hap1", "Hap5": "hap5", "HapY": "hapy", "HapM": "hapm", "HapA": "hapa", "Hap7": "hap7",
}
#: Names of colour matrices (fixed values).
MATRICES = ("bt709", "fcc", "bt470bg", "bt601", "smpte240", "ycgco")
#: Quarter samples of a pixel by chroma layout (fixed values): 4 is luma alone.
CHROMA_QUARTERS = {"mono": 4, "420": 6, "422": 8, "444": 12}


def codec_of(code: Column) -> Column:
    """A codec's name; null if the code is unknown."""
    pairs = [F.lit(x) for p in CODECS.items() for x in p]
    return F.try_element_at(F.create_map(*pairs), F.trim(code))


def matrix_of(name: Column) -> Column:
    """A colour matrix by name, whatever its case and outer blanks; null if unknown."""
    plain = F.trim(F.lower(name))
    return F.when(plain.isin(*MATRICES), plain)


def video_frames_estimate(size: Column, header: Column, width: Column, height: Column, chroma: Column, bytes_per_sample: Column | int = 1) -> Column:
    """Frames that an uncompressed video of a size must have; unknown chroma counts as full."""
    pairs = [F.lit(x) for p in CHROMA_QUARTERS.items() for x in p]
    quarters = F.coalesce(F.try_element_at(F.create_map(*pairs), F.regexp_extract(chroma, "^(mono|420|422|444)", 1)), F.lit(12))
    frame = F.floor(width.cast("long") * height * bytes_per_sample * quarters / 4) + 6
    return F.call_function("div", F.greatest(size.cast("long") - header, F.lit(0).cast("long")), frame)


def input_reason(head: Column, name: Column, is_folder: Column, files: Column) -> Column:
    """Why a file can't be an input, of ``files`` that are given: null if it can."""
    kind = sniff_type(head, name)
    return (
        F.when(is_folder, "a folder")
        .when((files == 1) & kind.isin("png", "jpeg"), "a single picture")
        .when((files > 1) & kind.isin("jpeg", "gif", "y4m"), "not a PNG among several files")
    )


#: The checks in their order: a name, and when it speaks against a clip.
CHECKS = (
    ("empty file", lambda: F.col("size") <= 0),
    ("not a video", lambda: ~F.col("is_movie")),
    ("animation codec", lambda: F.col("codec").eqNullSafe("animation")),
    ("audio only", lambda: F.col("has_audio") & ~F.col("has_video")),
    ("no video track", lambda: ~F.col("has_video")),
    ("protected", lambda: F.col("is_protected")),
    ("not decodable though its codec is known", lambda: ~F.col("is_decodable") & F.col("codec").isNotNull()),
    ("unknown codec", lambda: ~F.col("is_decodable") & F.col("code").isNull()),
    ("unsupported kind of HEVC", lambda: ~F.col("is_decodable") & (F.col("code") == "hev1")),
    ("unsupported codec", lambda: ~F.col("is_decodable")),
    ("no codec title", lambda: F.col("code").isNull()),
    ("no metadata", lambda: F.col("fps").isNull() | F.col("duration").isNull()),
    ("under 4 x 4 pixels", lambda: ~F.coalesce((F.col("width") >= 4) & (F.col("height") >= 4), F.lit(False))),
)
#: Checks of what a decoder found out, where it was asked: after the others.
LATE_CHECKS = (
    ("video track not readable alone", lambda: ~F.coalesce(F.col("is_extractable"), F.lit(False))),
    # a codec that can't be trimmed is let through
    ("blank start not trimmable", lambda: ~F.coalesce(F.col("is_trimmable"), F.lit(False)) & F.coalesce(F.col("can_trim_codec"), F.lit(True))),
)


def with_reason(clips: DataFrame) -> DataFrame:
    """``reason`` a clip is refused, by the first check that speaks against it; null if it is fine.

    Needs size, is_movie, code (four characters), has_audio, has_video, is_protected, is_decodable, fps, duration,
    width, height. A null answer counts as no. Where there are also is_extractable, is_trimmable and can_trim_codec (null:
    yes), they are asked last. Adds ``codec``.
    """
    late = LATE_CHECKS if {"is_extractable", "is_trimmable", "can_trim_codec"} <= set(clips.columns) else ()
    clips = clips.withColumn("codec", codec_of(F.col("code")))
    reason = F.lit(None).cast("string")
    for name, against in reversed(CHECKS + late):
        reason = F.when(F.coalesce(against(), F.lit(False)), name).otherwise(reason)
    return clips.withColumn("reason", reason)


def with_report(clips: DataFrame) -> DataFrame:
    """``report``: a clip's fields as lines of text, for a diagnosis."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in clips.columns]
    return clips.withColumn("report", F.concat_ws("\n", *lines))
