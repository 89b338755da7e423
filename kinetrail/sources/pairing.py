"""Which clip belongs to which capture, and what is still to be computed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.functions.rules import stem
from kinetrail.plans.joins import salted_join
from kinetrail.sources.track_files import tracker_of

TRACKERS = ("markers", "plate")
SALTS = 64   # tasks that captures of one prefix are spread over


def pair_captures(captures: DataFrame, clips: DataFrame, capture: str = "path", clip: str = "clip_path") -> DataFrame:
    """Longest clip stem that begins the capture's stem, same dataset; a miss
    keeps the capture with a null clip.

    Any prefix may match, so each capture emits its prefixes (tens of characters) of
    the lengths that the clips of its dataset have, and meets clips by equality instead
    of a prefix join.  Many captures share a prefix; they are spread over ``SALTS`` tasks.
    """
    c = captures.withColumn("_stem", stem(F.col(capture)))
    named = clips.select("dataset", F.col(clip), stem(F.col(clip)).alias("_pre"))
    # one row per dataset
    lengths = named.groupBy("dataset").agg(F.collect_set(F.length("_pre")).alias("_lens"))
    prefixes = c.select("dataset", capture, "_stem").join(F.broadcast(lengths), "dataset").withColumn("_len", F.explode("_lens")).filter(
        F.col("_len").between(1, F.length("_stem"))).withColumn("_pre", F.substring(F.col("_stem"), F.lit(1), F.col("_len"))).drop("_stem", "_lens")
    met = salted_join(prefixes, named, ["dataset", "_pre"], F.xxhash64(capture), SALTS)
    hit = met.groupBy("dataset", F.col(capture)).agg(
        F.max_by(clip, F.struct("_len", clip)).alias(clip))
    return c.drop("_stem").join(hit, ["dataset", capture], "left")


def missing(inputs: DataFrame, done: DataFrame, on: Sequence[str], force: bool = False) -> DataFrame:
    """Inputs with no stored result (all of them when forced)."""
    return inputs if force else inputs.join(done.select(*on), list(on), "left_anti")


def ensure(inputs: DataFrame, path: str, on: Sequence[str], compute: Callable[[DataFrame], DataFrame],
           version: str, force: bool = False) -> DataFrame:
    """Compute-once table: reuse rows of this version, compute the rest, append.

    Every call that computes adds a ``batch``; a key's newest batch is the one
    read, so ``force`` recomputes without rewriting what readers may be using.
    Rows of other versions are never read.
    """
    spark = inputs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    stored = _newest(spark.read.parquet(path), on, version) if exists else None
    todo = inputs if stored is None else missing(inputs, stored, on, force)
    if not todo.isEmpty():
        fresh = compute(todo).withColumns({"version": F.lit(version), "batch": F.unix_micros(F.current_timestamp())})
        fresh.write.mode("append").partitionBy("version").parquet(path)
    return _newest(spark.read.parquet(path), on, version)


def _newest(rows: DataFrame, on: Sequence[str], version: str) -> DataFrame:
    mine = rows.filter(F.col("version") == version)
    latest = mine.groupBy(*on).agg(F.max("batch").alias("batch"))
    return mine.join(latest, [*on, "batch"], "left_semi")


def resolve_tracks(clips: DataFrame, stored: DataFrame, tracker: str | None = None, clip: str = "clip_path") -> DataFrame:
    """Say for each clip which referee to use and whether the store has it.

    A stored track only counts when the wanted tracker is the clip's own.
    """
    if tracker is not None and tracker not in TRACKERS:
        raise ValueError(f"tracker must be one of {TRACKERS}, got {tracker!r}")
    own = tracker_of(F.col(clip))
    want = own if tracker is None else F.lit(tracker)
    have = stored.select(F.col(clip), F.lit(True).alias("_have")).distinct()
    return clips.join(have, clip, "left").withColumns({
        "tracker": want, "cached": F.coalesce("_have", F.lit(False)) & (want == own)}).drop("_have")
