"""Views over the driver tables, and the same views as SQL.

``events`` plays every role a recording needs: the user is the capture, its
events in time order are the samples, odd events are the referee's frames.
One time unit is 50 hours, so that a user's month looks like a short recording.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.operators.motion import spacing, with_rate
from kinetrail.plans.blocks import block_rows, index_series, lookup, per_key

KEY = ["capture_id"]
CLIP = ["clip_id"]
UNIT_US = 180_000_000_000


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}
_PLACES = 4


def rounded(df: DataFrame, places: int = _PLACES) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0) so two engines can be compared."""
    return df.select(*[
        (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(name: str, columns: str = "", doubles: str = "", sql: str | None = None,
          ctes: str = "", places: int = _PLACES):
    """Register ``fn`` as query ``name``.

    ``columns`` and ``doubles`` list the output columns (exact and rounded);
    ``sql`` is the oracle's body, ``ctes`` the views it needs.
    """
    names, reals = columns.split(), doubles.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return rounded(df.select(*names, *reals) if names or reals else df, places)

        text = None
        if sql is not None:
            picked = [*names, *[f"round({c}::DOUBLE, {places}) + 0.0 AS {c}" for c in reals]]
            head = with_ctes(*ctes.split())
            text = f"{head}{',' if head else 'WITH'} answer AS ({sql}) SELECT {', '.join(picked)} FROM answer"
        CATALOG[name] = Query(run, text)
        return fn

    return wrap


# ------------------------------------------------------------- Spark views ---
_CACHE: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """One plan per session and directory: indexing checkpoints its rows."""
    key = (spark.sparkContext.applicationId, block_rows(spark), sf_dir, _version(spark, f"{sf_dir}/events.parquet"), name)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def _version(spark: SparkSession, path: str) -> tuple[int, int]:
    """Change time and size of a table, so that changed data under an old path is read anew."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(place).getModificationTime(), fs.getContentSummary(place).getLength()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        ev = table(spark, sf_dir, "events").select(
            F.col("user_id").alias("capture_id"), "event_id", "event_type", "value", micros("ts").alias("us"))
        return index_series(ev, KEY, ["us", "event_id"])

    return _once(spark, sf_dir, "events", build)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows with ``dt`` and ``fs``, derived once and kept as a table.

    Stored by (key, block), so window chains on it start without an exchange.
    """
    return _once(spark, sf_dir, "samples", lambda: _samples(spark, sf_dir).checkpoint())


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = indexed_events(spark, sf_dir)
    first = per_key(ev, KEY, F.min("us").alias("_us0"))
    e = F.col("event_id")
    x = lookup(ev, KEY, first).select(
        *KEY, "i", "n", "_blk", "event_id", "value",
        ((F.col("us") - F.col("_us0")) / UNIT_US).alias("t"),
        F.cos(e * 0.01).alias("qw"), (F.sin(e * 0.01) * 0.6).alias("qx"), F.lit(0.0).alias("qy"),
        (F.sin(e * 0.01) * 0.8).alias("qz"),
        ((F.col("value") - 245.0) / 50.0).alias("ax"),
        (((e * 7919) % 1000 - 500) / 200.0).alias("ay"),
        (((e * 104729) % 1000 - 500) / 100.0).alias("az"),
        (((e * 31) % 100 - 50) / 500.0).alias("gx"), (((e * 37) % 100 - 50) / 500.0).alias("gy"),
        (((e * 41) % 100 - 50) / 500.0).alias("gz"),
    ).withColumn("phase", F.when(F.col("t") < 2.0, 0).when(F.col("t") > 12.0, 2).otherwise(1))
    return with_rate(spacing(x, KEY), KEY)


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-row windows with two rows of rest between them: repetitions, as an operator finds them."""
    ev = indexed_events(spark, sf_dir)
    return ev.filter((F.col("i") % 12 == 1) & (F.col("i") + 10 <= F.col("n"))).select(
        *KEY, F.floor(F.col("i") / 12).alias("rep"), F.col("i").alias("start_i"),
        (F.col("i") + 10).alias("stop_i"), "n", "_blk")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events as referee frames on a clock shifted against the samples'."""
    def build():
        s = samples(spark, sf_dir).filter("event_id % 2 = 1")
        e = F.col("event_id")
        good = e % 10 != 1
        v = s.select(
            F.col("capture_id").alias("clip_id"), (F.col("t") * 1.001 + 0.3).alias("t"), "event_id",
            F.when(good, (F.col("value") - 245.0) / 1000.0).alias("x"),
            F.when(good, ((e * 7919) % 1000) / 1250.0).alias("height"),
            (((e * 13) % 100) / 100.0).alias("score"), (e % 4 + 2).cast("int").alias("n_markers"),
            F.when(good, ((e * 17) % 50) / 50.0).alias("residual_px"),
            (F.lit(0.001) + (e % 7) / 10000.0).alias("m_per_px_t"),
            (F.lit(50.0) + e % 9).alias("circumradius_px"), (F.lit(0.8) + (e % 5) / 50.0).alias("axis_ratio"),
            ((e % 628) / 100.0 - 3.14).alias("angle"),
        )
        return index_series(v, CLIP, ["t", "event_id"])

    return _once(spark, sf_dir, "track", build)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bright points: eight consecutive events make a frame."""
    ev = indexed_events(spark, sf_dir)
    e = F.col("event_id")
    return ev.select(
        F.col("capture_id").alias("clip_id"), F.floor(F.col("i") / 8).alias("f"), "event_id",
        ((e * 7919) % 160).cast("double").alias("y"), ((e * 104729) % 160).cast("double").alias("x"),
        (F.col("value") / 500.0).alias("strength"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as capture files, named the way recordings are."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lift = F.element_at(F.array(*[F.lit(x) for x in ("bench", "squat", "deadlift", "row")]), (k % 4 + 1).cast("int"))
    session = F.when(k % 3 == 0, "20260803").when(k % 3 == 1, "20260804").otherwise("20260727")
    name = F.concat(lift, F.when(k % 5 == 0, F.lit("_spoto")).otherwise(F.lit("")), F.lit("_"),
                    (k % 90 + 60).cast("string"), F.when(k % 7 == 0, F.lit(".5")).otherwise(F.lit("")), F.lit("x"),
                    (k % 6 + 1).cast("string"), F.lit("_"), (k % 2 + 1).cast("string"), F.lit("_"), session,
                    F.lit("_"), F.lpad(k.cast("string"), 6, "0"))
    return c.select(k.alias("capture_no"), (k % 2).alias("dataset"),
                    F.concat(F.lit("/data/raw/"), name, F.lit(".csv")).alias("path"))


# --------------------------------------------------------------- SQL views ---
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), """
      SELECT user_id AS capture_id, event_id, value, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        count(*) OVER (PARTITION BY user_id) AS n,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 180000000000.0::DOUBLE AS t,
        epoch_us(ts) AS us
      FROM events"""),
    "samples": (("base",), """
      SELECT capture_id, i, n, event_id, value, t,
        coalesce(t - lag(t) OVER w, lead(t) OVER w - t, 0.01) AS dt,
        cos(event_id * 0.01::DOUBLE) AS qw, sin(event_id * 0.01::DOUBLE) * 0.6::DOUBLE AS qx, 0.0::DOUBLE AS qy,
        sin(event_id * 0.01::DOUBLE) * 0.8::DOUBLE AS qz,
        (value - 245.0) / 50.0 AS ax,
        ((event_id * 7919) % 1000 - 500)::DOUBLE / 200.0 AS ay,
        ((event_id * 104729) % 1000 - 500)::DOUBLE / 100.0 AS az,
        ((event_id * 31) % 100 - 50)::DOUBLE / 500.0 AS gx, ((event_id * 37) % 100 - 50)::DOUBLE / 500.0 AS gy,
        ((event_id * 41) % 100 - 50)::DOUBLE / 500.0 AS gz,
        CASE WHEN t < 2.0 THEN 0 WHEN t > 12.0 THEN 2 ELSE 1 END AS phase
      FROM base WINDOW w AS (PARTITION BY capture_id ORDER BY i)"""),
    "rate": (("samples",), """
      SELECT capture_id, coalesce(1.0 / median(dt) FILTER (WHERE i > 0), 100.0) AS fs
      FROM samples GROUP BY capture_id"""),
    "rated": (("samples", "rate"), "SELECT samples.*, fs FROM samples JOIN rate USING (capture_id)"),
    "reps": (("base",), """
      SELECT capture_id, i // 12 AS rep, i AS start_i, i + 10 AS stop_i, n
      FROM base WHERE i % 12 = 1 AND i + 10 <= n"""),
    "track": (("samples",), """
      SELECT clip_id, t, event_id, x, height, score, n_markers, residual_px, m_per_px_t, circumradius_px,
        axis_ratio, angle, row_number() OVER (PARTITION BY clip_id ORDER BY t, event_id) - 1 AS i,
        count(*) OVER (PARTITION BY clip_id) AS n
      FROM (SELECT capture_id AS clip_id, t * 1.001 + 0.3 AS t, event_id,
        CASE WHEN event_id % 10 <> 1 THEN (value - 245.0) / 1000.0 END AS x,
        CASE WHEN event_id % 10 <> 1 THEN ((event_id * 7919) % 1000)::DOUBLE / 1250.0 END AS height,
        ((event_id * 13) % 100)::DOUBLE / 100.0 AS score, (event_id % 4 + 2)::INTEGER AS n_markers,
        CASE WHEN event_id % 10 <> 1 THEN ((event_id * 17) % 50)::DOUBLE / 50.0 END AS residual_px,
        0.001::DOUBLE + (event_id % 7)::DOUBLE / 10000.0 AS m_per_px_t,
        50.0::DOUBLE + event_id % 9 AS circumradius_px, 0.8::DOUBLE + (event_id % 5)::DOUBLE / 50.0 AS axis_ratio,
        (event_id % 628)::DOUBLE / 100.0 - 3.14 AS angle
        FROM samples WHERE event_id % 2 = 1)"""),
    "detections": (("base",), """
      SELECT capture_id AS clip_id, i // 8 AS f, event_id, ((event_id * 7919) % 160)::DOUBLE AS y,
        ((event_id * 104729) % 160)::DOUBLE AS x, value / 500.0 AS strength FROM base"""),
    "captures": ((), """
      SELECT c_custkey AS capture_no, c_custkey % 2 AS dataset, '/data/raw/' ||
        (['bench', 'squat', 'deadlift', 'row'])[c_custkey % 4 + 1] || CASE WHEN c_custkey % 5 = 0 THEN '_spoto' ELSE '' END
        || '_' || (c_custkey % 90 + 60) || CASE WHEN c_custkey % 7 = 0 THEN '.5' ELSE '' END || 'x' || (c_custkey % 6 + 1)
        || '_' || (c_custkey % 2 + 1) || '_' ||
        CASE WHEN c_custkey % 3 = 0 THEN '20260803' WHEN c_custkey % 3 = 1 THEN '20260804' ELSE '20260727' END
        || '_' || lpad(c_custkey::VARCHAR, 6, '0') || '.csv' AS path FROM customer"""),
}


def with_ctes(*names: str) -> str:
    """``WITH`` clause for the named views and what they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return ""
    body = ", ".join(f"{n} AS ({SQL[n][1]})" for n in order)
    return "WITH RECURSIVE " + body
