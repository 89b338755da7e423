"""Referee tracks as text files with a ``# key = value`` head, or as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions.rules import CAMERA_SIDE, lift_of, stem
from kinetrail.sources.packed import unpack

# fixed values: the file format
FRAME_COLUMNS = ("t", "x", "height", "score", "n_markers", "residual_px", "m_per_px_t", "circumradius_px",
                 "axis_ratio", "angle")
SCALARS = ("fps", "m_per_px", "travel_m", "plate_radius_px", "seed_frame", "perspective_shift_cm", "n_rim",
           "sticker_radius_m")
DATASET_DIRS = {"data": "v1", "data_v2": "v2"}


def read_tracks(spark: SparkSession, path: str, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(clips, frames): header scalars, one row per clip; body rows by name.

    Body values are placed through the file's own column line, so files with
    different columns mix.  A file without body rows yields neither.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"),
        F.monotonically_increasing_id().alias("pos"))
    return _clips_and_frames(lines.withColumn("clip_id", stem(F.col("file")) if key is None else key))


def read_packed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from tracks in packed files; the clip is the name each was packed under."""
    return _clips_and_frames(unpack(spark, path).select(
        F.trim("text").alias("line"), F.col("number").alias("pos"), F.col("file").alias("clip_id")))


def _clips_and_frames(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    head = lines.filter(F.col("line").startswith("#") & F.col("line").contains("=")).select(
        "clip_id", F.trim(F.regexp_extract("line", r"^#\s*([^=]*?)\s*=", 1)).alias("k"),
        F.trim(F.regexp_extract("line", r"^#[^=]*=\s*(.*)$", 1)).alias("v"))
    names = lines.filter(F.col("line").rlike(r"^[A-Za-z_]")).groupBy("clip_id").agg(
        F.transform(F.split(F.min_by("line", "pos"), ","), F.trim).alias("names"))
    body = lines.filter(F.col("line").rlike(r"^[-+0-9.nN]") & ~F.col("line").rlike(r"^n_")).join(names, "clip_id")
    values = F.map_from_arrays("names", F.split("line", r"\s*,\s*"))
    frames = body.withColumn("_m", values).select("clip_id", "pos", *[
        F.expr(f"nullif(try_cast(_m['{c}'] as double), double('NaN'))").alias(c) for c in FRAME_COLUMNS])
    alive = frames.select("clip_id").distinct()
    clips = head.join(alive, "clip_id", "left_semi").groupBy("clip_id").agg(*[
        F.max(F.when(F.col("k") == k, F.expr("try_cast(v as double)"))).alias(k) for k in SCALARS
    ], *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("video", "tracker", "lift", "camera_side", "version", "generated")])
    return clips, frames


def write_tracks(clips: DataFrame, frames: DataFrame, path: str, version: str) -> None:
    """Parquet ``clips`` and ``frames`` with provenance, laid out by dataset.

    ``clips`` carries ``video`` (path) and ``tracker``; the version column is
    part of what readers match on, so stale rows are never read back.
    """
    lift = lift_of(F.col("video"))
    side = F.lit(None).cast("string")
    for name, value in CAMERA_SIDE.items():
        side = F.when(lift == name, F.lit(value)).otherwise(side)
    stamped = clips.withColumns({
        "dataset": dataset_of(F.col("video")), "lift": lift, "camera_side": side,
        "version": F.lit(version), "generated_at": F.current_timestamp()})
    stamped.write.mode("append").partitionBy("dataset").parquet(f"{path}/clips")
    ids = stamped.select("clip_id", "dataset")
    (frames.join(ids, "clip_id").withColumn("version", F.lit(version))
     .write.mode("append").partitionBy("dataset").parquet(f"{path}/frames"))


def dataset_of(path):
    """Directory two levels above a file: the dataset it belongs to."""
    return F.element_at(F.split(path, "/"), -3)


def cache_location(path, root: str = "tracked"):
    """Relative place of a clip's cache: dataset / root / stem.csv."""
    return F.concat_ws("/", dataset_of(path), F.lit(root), F.concat(stem(path), F.lit(".csv")))


def figure_location(path):
    """Relative place of a clip's figure, under the dataset's short name."""
    ds = dataset_of(path)
    short = ds
    for name, value in DATASET_DIRS.items():
        short = F.when(ds == name, F.lit(value)).otherwise(short)
    return F.concat_ws("/", short, F.concat(stem(path), F.lit(".png")))


def tracker_of(path):
    """Which referee made a clip, from its directory."""
    return F.when(F.lower(path).rlike("(^|/)data_v2[^/]*(/|$)"), "markers").otherwise("plate")
