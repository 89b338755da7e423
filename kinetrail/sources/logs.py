"""Sensor recordings as CSV: one file per capture, columns by header name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions import geometry as geo
from kinetrail.functions.rules import stem
from kinetrail.operators.motion import spacing
from kinetrail.plans.blocks import index_series, lookup, per_key
from kinetrail.sources.packed import pack, unpack, with_head

# fixed values: the file format
CORE = ("t", "qw", "qx", "qy", "qz", "ax", "ay", "az", "gx", "gy", "gz")
PHASE = "phase"
DEAD = ("rgt", "rgx", "rgy", "rgz")


def read_logs(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """Raw rows of every file: the core columns, optional ``phase``/``rg*`` (null
    where absent), ``capture_id`` and the row's place in its file, ``line``.

    Files are read once, as lines.  Each line is placed through its own file's
    header, so files with different columns mix, and no list of files is formed.
    ``key`` names the capture (default: the file's stem).
    """
    return place_lines(lines_of(spark.read.text(path)), key)


def lines_of(text: DataFrame) -> DataFrame:
    """(file, text, at) of lines read as text: the file, the line, and where its split of the file begins."""
    return text.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("text"),
                       F.col("_metadata.file_block_start").alias("at"))


def place_lines(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """The rows of :func:`read_logs` from the lines of :func:`lines_of`; a batch of a stream will do if it holds whole files."""
    return _placed(lines.select("file", "text", F.struct("at", F.monotonically_increasing_id().alias("row")).alias("line")),
                   stem(F.col("file")) if key is None else key)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`read_logs` from recordings in packed files; the capture is the name each was packed under."""
    return place_packed(unpack(spark, path), [])


def place_packed(lines: DataFrame, within: Sequence[str]) -> DataFrame:
    """The rows of :func:`read_packed` from the lines of :func:`~kinetrail.sources.packed.unpacked`; names are
    those of other recordings where the columns ``within`` differ."""
    return _placed(lines.select(*within, "file", F.trim("text").alias("text"), F.struct(
        F.lit(0).cast("long").alias("at"), F.col("number").alias("row")).alias("line")), F.col("file"), within)


def _placed(lines: DataFrame, key: Column, within: Sequence[str] = ()) -> DataFrame:
    head = F.col("text").rlike(r"^t\s*,")
    file = [*within, "file"]
    names = lines.filter(head).groupBy(*file).agg(F.min_by(F.split("text", r"\s*,\s*"), "line").alias("names"))
    body = lines.filter(~head & (F.col("text") != "")).join(names, file)
    # a short line leaves its last columns null
    found = F.map_from_entries(F.arrays_zip("names", F.slice(F.split("text", r"\s*,\s*", -1), F.lit(1), F.size("names"))))
    placed = body.withColumn("_m", found)
    return placed.select(
        *[F.expr(f"try_cast(_m['{c}'] as double)").alias(c) for c in (*CORE, PHASE, *DEAD)],
        key.alias("capture_id"), "line")


def load_logs(raw: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Recordings ready for the operators: indexed, rebased to zero, spaced, in
    SI units with the sign of acceleration inverted, whole-channel nulls.

    A ``phase`` with any gap, and raw rates that are all missing, become null
    for the whole capture.
    """
    keys = list(keys)
    s = index_series(raw.filter("t is not null"), keys, ["t", "line"])
    info = per_key(s, keys, F.min("t").alias("_t0"), F.count(PHASE).alias("_phased"),
                   F.sum(F.isnan(PHASE).cast("int")).alias("_nan"), F.count("rgt").alias("_raw"))
    x = lookup(s, keys, info.withColumn("_all", F.col("n")))
    whole = (F.col("_phased") == F.col("_all")) & (F.coalesce("_nan", F.lit(0)) == 0)
    x = x.withColumns({
        "t": F.col("t") - F.col("_t0"), **{a: -F.col(a) * geo.G for a in ("ax", "ay", "az")},
        PHASE: F.when(whole, F.col(PHASE).cast("int")),
        **{c: F.when(F.col("_raw") > 0, F.col(c)) for c in DEAD},
    }).drop("_t0", "_phased", "_nan", "_raw", "_all", "line")
    return spacing(x, keys)


def save_logs(rows: DataFrame, path: str, key: str = "capture_id", order: str = "t") -> None:
    """One directory per capture, header row, nine significant digits."""
    text = rows.select(key, *[F.format_string("%.9g", F.col(c).cast("double")).alias(c) for c in CORE],
                       F.col(order).alias("_o"))
    (text.repartitionByRange(F.col(key), F.col("_o")).sortWithinPartitions(key, "_o").drop("_o")
     .write.mode("overwrite").partitionBy(key).option("header", True).csv(path))


def save_packed(rows: DataFrame, path: str, key: str = "capture_id") -> None:
    """The recordings of :func:`save_logs` in packed files; ``i`` is the row's position in its recording."""
    core = F.concat_ws(",", *[F.coalesce(F.format_string("%.9g", F.col(c).cast("double")), F.lit("")) for c in CORE])
    pack(with_head(rows.withColumn("file", F.col(key).cast("string")), "i", core, [F.lit(",".join(CORE))]), path)
