"""Labels, closed-form limits and the small dimension tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: limits and constants of the domain, stated as given ------
REP_LABEL = r"^(bench|squat|deadlift)(?:_[a-z]+)*_[\d.]+x(\d+)"
PLATE_M = {"bench": 0.425, "squat": 0.450, "deadlift": 0.445}
PLATE_SESSION_M = {"20260803": 0.450}
STICKER_SESSION_M = {"20260804": 0.425}
VERTICAL_ROM_M = {"bench": (0.20, 0.35), "squat": (0.45, 0.76), "deadlift": (0.40, 0.61)}
FORE_AFT_MAX = {"bench": 0.1475, "deadlift": 0.0402}
WRIST_OFFSET_M = {
    "bench": (-0.09, 0.0, 0.03), "deadlift": (-0.09, 0.0, 0.03), "squat": (-0.05, 0.0, -0.04),
}
CAMERA_SIDE = {"deadlift": "left", "bench": "right", "squat": "right"}
PLAUSIBLE = {
    "bias": 0.025, "tilt": math.radians(0.3), "scale": 0.02, "lever": 0.15,
    "gravref": math.radians(0.3) / 9.81,
}
MODEL_LADDER = (
    (), ("bias",), ("bias", "tilt"), ("bias", "tilt", "scale"),
    ("bias", "tilt", "scale", "lever"), ("bias", "tilt", "gravref"),
    ("bias", "tilt", "scale", "lever", "gravref"),
)
TERM_SIZE = {"bias": 3, "tilt": 3, "scale": 3, "lever": 3, "gravref": 3}
AXIS_TOLERANCE_DEG, EXCURSION_MIN_M, EXCURSION_MAX_M = 20.0, 0.05, 0.20
STICKER_RATIO = 0.858
# ------------------------------------------------------------------------------


def dim_lift(spark: SparkSession) -> DataFrame:
    """One row per known lift: range band, plate, fore-aft bound, wrist offset."""
    rows = [
        (
            lift, PLATE_M[lift], *VERTICAL_ROM_M[lift], FORE_AFT_MAX.get(lift),
            *WRIST_OFFSET_M[lift], CAMERA_SIDE[lift],
        )
        for lift in sorted(PLATE_M)
    ]
    return spark.createDataFrame(
        rows,
        "lift string, plate_m double, rom_lo double, rom_hi double, fore_aft_max double, "
        "off_x double, off_y double, off_z double, camera_side string",
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def expected_reps(path: Column) -> Column:
    """Rep count in a capture's file name, null when the name carries none."""
    got = F.regexp_extract(file_name(path), REP_LABEL, 2)
    return F.when(got != "", got.cast("int"))


def lift_of(path: Column) -> Column:
    """First name token, null when it is not a known lift."""
    token = F.split(file_name(path), "_")[0]
    return F.when(token.isin(*sorted(PLATE_M)), token)


def _session_override(path: Column, table: dict[str, float], default: Column) -> Column:
    out = default
    for tag, size in table.items():
        out = F.when(F.contains(stem(path), F.lit(tag)), F.lit(size)).otherwise(out)
    return out


def plate_diameter(path: Column) -> Column:
    """A session with its own plates decides, then the lift; null if neither is known
    (:func:`undecided` lists those files)."""
    lift = lift_of(path)
    base = F.lit(None).cast("double")
    for name, size in PLATE_M.items():
        base = F.when(lift == name, F.lit(size)).otherwise(base)
    return _session_override(path, PLATE_SESSION_M, base)


def undecided(paths: DataFrame, path: str) -> DataFrame:
    """Files whose name tells neither the lift nor a session with its own plates."""
    return paths.filter(plate_diameter(F.col(path)).isNull())


def sticker_plate_diameter(path: Column) -> Column:
    return _session_override(path, STICKER_SESSION_M, plate_diameter(path))


def min_ratio(n_reps: Column) -> Column:
    """Smallest axis ratio that fixes the axis to 20 degrees; n < 1 is an error."""
    k = F.lit(math.radians(AXIS_TOLERANCE_DEG)) * F.sqrt(n_reps.cast("double"))
    root = (F.lit(1.0) + F.sqrt(F.lit(1.0) + 4.0 * k * k)) / (2.0 * k)
    return F.when(n_reps >= 1, root * root).otherwise(
        F.raise_error(F.lit("n_reps must be at least 1")).cast("double")
    )


def confidence_reasons(ratio: Column, excursion: Column, n_reps: Column) -> Column:
    """Array of reasons the display axis is not trustworthy; empty = confident."""
    return F.array_compact(F.array(
        F.when(ratio < min_ratio(n_reps), F.lit("axis_ratio")),
        F.when(excursion < EXCURSION_MIN_M, F.lit("excursion_small")),
        F.when(excursion > EXCURSION_MAX_M, F.lit("excursion_large")),
    ))


def rom_flag(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value > hi, "above").when(value < lo, "below")


def parabola(tau: Column, duration: Column) -> Column:
    return tau * (tau - duration) / 2.0
