"""Incremental forms: file ingestion, event detection, quality windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from kinetrail.functions.rules import stem
from kinetrail.sources.logs import CORE, DEAD, PHASE, lines_of, place_lines, place_packed
from kinetrail.sources.packed import unpacked


def ingest_logs(spark: SparkSession, landing: str, table: str, checkpoint: str, header: Sequence[str] = (*CORE, PHASE),
                trigger: dict | None = None) -> StreamingQuery:
    """Append every file of a landing directory once, by header signature.

    One query per signature (Spark binds CSV by position); the checkpoint makes
    each file count once, ``foreachBatch`` writes keyed by the batch id.
    """
    schema = T.StructType([T.StructField(h, T.DoubleType()) for h in header])
    rows = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).csv(landing).withColumn(
        "capture_id", stem(F.col("_metadata.file_path")))

    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own directory, so nothing doubles
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


MANIFEST = "file string, part string"
ROWS = ", ".join([*(f"{c} double" for c in (*CORE, PHASE, *DEAD)), "capture_id string", "line struct<at: bigint, row: bigint>", "part string"])


def ingest_files(spark: SparkSession, landing: str, table: str, checkpoint: str, key: Column | None = None,
                 files_per_batch: int | None = None, trigger: dict | None = None, packed: bool = False) -> StreamingQuery:
    """Append the log files of a landing folder to a table, each file once, whatever its columns.

    One stream reads lines; every file's lines are placed through its own header
    (a file is never cut between batches), so files of any header mix.  A batch
    first writes its rows as a part of their own, then commits it by one manifest
    file that names the part and its files.  Readers (:func:`committed`) see
    committed parts only.  A batch that runs again, with the stream's checkpoint or
    without it, finds its files in the manifest and adds nothing; what a batch
    wrote before it failed is a part that nobody reads.  ``table`` has one writer.
    With ``packed`` a landed file holds many recordings, each whole, as :func:`~kinetrail.sources.packed.pack`
    writes them; files count once, and a recording's name is its capture.
    """
    none = spark.range(0).select(F.lit("").alias("file"), F.lit("").alias("part"))
    none.coalesce(1).write.mode("append").parquet(f"{table}/manifest")
    source = spark.readStream.option("recursiveFileLookup", True)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema(MANIFEST).parquet(f"{table}/manifest").select("file")
        fresh = batch.join(known.withColumnRenamed("file", unit), unit, "left_anti")
        if fresh.isEmpty():
            return
        part = F.lit(f"{batch_id}-{uuid.uuid4().hex}").alias("part")
        placed = place_packed(fresh, [unit]) if packed else place_lines(fresh, key)
        placed.withColumn("capture_id", F.col("capture_id").cast("string")).select("*", part).write.partitionBy(
            "part").mode("append").parquet(f"{table}/rows")
        # one task, one file: it appears whole or not at all
        fresh.select(F.col(unit).alias("file")).distinct().select("file", part).coalesce(1).write.mode("append").parquet(f"{table}/manifest")

    unit = "pack" if packed else "file"
    text = source.text(landing)
    lines = unpacked(text, F.col("_metadata.file_path").alias("pack")) if packed else lines_of(text)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all committed parts of :func:`ingest_files`, in the columns of :func:`~kinetrail.sources.logs.read_logs`."""
    parts = spark.read.schema(MANIFEST).parquet(f"{table}/manifest").select("part").distinct()
    return spark.read.schema(ROWS).parquet(f"{table}/rows").join(parts, "part", "left_semi").drop("part")


class _Refractory(StatefulProcessor):
    """Accept an event when it is more than ``gap`` after the last accepted.

    Arrivals wait in a list until the watermark passes them, so they are
    decided in time order whatever order they came in.
    """

    def __init__(self, gap_ms: int, fields: list[str]):
        self.gap_ms, self.fields = gap_ms, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))
        self.waiting = handle.getListState("waiting", T.StructType([
            T.StructField("ms", T.LongType()), T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        wake = None
        for pdf in rows:
            ms = pdf["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000
            fresh = ms > mark        # late rows are dropped
            for m, i, v in zip(ms[fresh], pdf["id"][fresh], pdf["value"][fresh]):
                self.waiting.appendValue((int(m), int(i), float(v)))
                wake = int(m) if wake is None else min(wake, int(m))
        if wake is not None:
            self.handle.registerTimer(wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        pending = sorted(self.waiting.get())
        ready = [p for p in pending if p[0] <= mark]
        later = [p for p in pending if p[0] > mark]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ms, ident, value in ready:
            if last is None or ms - last > self.gap_ms:
                last = ms
                out.append((*key, ms, ident, value))
        if last is not None:
            self.last.update((last,))
        self.waiting.clear()
        for p in later:
            self.waiting.appendValue(p)
        if later:
            self.handle.registerTimer(later[0][0])
        if out:
            yield pd.DataFrame(out, columns=self.fields)

    def close(self) -> None:
        pass


def stream_refractory(events: DataFrame, key: str, gap_ms: int, delay: str) -> DataFrame:
    """Streaming form of the refractory pick.

    ``events`` is a stream with ``key``, ``ts`` (timestamp), ``id`` and
    ``value``; candidates only.  A row later than ``delay`` behind the newest
    is dropped.  Needs the RocksDB state store.
    """
    out = T.StructType([events.schema[key], T.StructField("ms", T.LongType()), T.StructField("id", T.LongType()),
                        T.StructField("value", T.DoubleType())])
    return events.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Refractory(gap_ms, [key, "ms", "id", "value"]), outputStructType=out,
        outputMode="Append", timeMode="EventTime")


class _Slices(StatefulProcessor):
    """Folds the samples of one (bucket of keys, slice of time) to a row per key when the watermark passes the slice.

    Spacing and runs depend on the order, so a slice's samples wait in a list state
    until no earlier one can come: ``CHUNK`` of them at most in an entry, as arrays.
    A call to the state serves all keys of the bucket.
    """

    def __init__(self, width_us: int, fields: list[str]):
        self.width_us, self.fields = width_us, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(c, T.BinaryType()) for c in ("key", "us", "v")]))

    def _end(self, key) -> int:
        return (int(key[-1]) + 1) * self.width_us

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ms = -(-self._end(key) // 1000)
        if ms > timerValues.getCurrentWatermarkInMs():  # else the slice is closed: the rows come too late
            for pdf in rows:
                parts = [pdf.iloc[k:k + CHUNK] for k in range(0, len(pdf), CHUNK)]
                self.waiting.appendList([(
                    "\n".join(x["key"]).encode(), x["us"].to_numpy(np.int64).tobytes(), x["v"].to_numpy(np.float64).tobytes()) for x in parts])
            self.handle.registerTimer(ms)  # a timer of the slice that is there already stays one
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names, us, v = zip(*((bytes(k).decode().split("\n"), np.frombuffer(u, np.int64), np.frombuffer(x, np.float64)) for k, u, x in self.waiting.get()))
        self.waiting.clear()
        code, name = pd.factorize(np.array([n for part in names for n in part], object))
        folded = fold_slices(code, np.concatenate(us), np.concatenate(v))
        yield pd.DataFrame({"key": name, "at": pd.Timestamp(self._end(key) - 1, unit="us"), **folded})[self.fields]

    def close(self) -> None:
        pass


CHUNK = 4096  # samples in an entry of the state
SLICE = ("n long, n_v long, s double, m2 double, top double, bottom double, first_us long, last_us long, dt double, dt2 double, "
         "head_v double, head_n long, tail_v double, tail_n long, runs long, at_top long, at_bottom long")


def fold_slices(key: np.ndarray, us: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Samples (key from 0 without gaps, us, v; NaN: no value) of one slice to the values named in ``SLICE``, one row a key.

    Rows of a key can be chained in order of time.  ``at_top`` and ``at_bottom`` count
    the samples in runs of two or more at the slice's own extremes, without the first
    and the last run.  A sample without a value is a run of its own, at no extreme.
    """
    order = np.lexsort((np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf), ~np.isnan(v), us, key))
    key, us, v = key[order], us[order], v[order]
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(key)]
    known = ~np.isnan(v)
    n_v, s = np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(np.where(known, v, 0.0), at)
    mean = s / np.maximum(n_v, 1)
    top = np.where(n_v > 0, np.maximum.reduceat(np.where(known, v, -np.inf), at), np.nan)
    bottom = np.where(n_v > 0, np.minimum.reduceat(np.where(known, v, np.inf), at), np.nan)
    step = np.where(new, 0, np.diff(us, prepend=us[:1])).astype(float)
    run = np.flatnonzero(new | np.r_[True, v[1:] != v[:-1]])
    size, value, of = np.diff(np.r_[run, len(v)]), v[run], key[run]
    head = np.searchsorted(run, at)
    tail = np.r_[head[1:], len(run)] - 1
    long = size >= 2
    long[head] = long[tail] = False
    return {
        "n": end - at, "n_v": n_v, "s": s, "m2": np.add.reduceat(np.where(known, (v - mean[key]) ** 2, 0.0), at), "top": top, "bottom": bottom,
        "first_us": us[at], "last_us": us[end - 1], "dt": np.add.reduceat(step, at), "dt2": np.add.reduceat(step * step, at),
        "head_v": value[head], "head_n": size[head], "tail_v": value[tail], "tail_n": size[tail], "runs": tail - head + 1,
        "at_top": np.add.reduceat(np.where(long & (value == top[of]), size, 0), head),
        "at_bottom": np.add.reduceat(np.where(long & (value == bottom[of]), size, 0), head)}


def fold_slice(samples: list[tuple[int, float | None]]) -> tuple:
    """:func:`fold_slices` of one key's samples (us, value); None where there is no value."""
    us = np.array([x[0] for x in samples], np.int64)
    v = np.array([np.nan if x[1] is None else x[1] for x in samples])
    return tuple(None if x != x else x for x in (c[0].item() for c in fold_slices(np.zeros(len(us), np.int64), us, v).values()))


def stream_quality(samples: DataFrame, keys: Sequence[str], every: str, delay: str, ts: str = "ts",
                   value: str = "value", uneven: float = 0.2, slices: int = 24, buckets: int = 8) -> DataFrame:
    """Tumbling counts, spread, extremes, irregular sampling and clipped samples per key.

    A window is cut in ``slices`` and the keys are dealt to ``buckets``.  Spark state
    keeps the samples of a (bucket, slice) until the watermark has passed it and folds
    them to one row a key; a second aggregation chains a key's at most ``slices`` rows
    of a window in order of time.  So a key with very many samples is spread over its
    slices, no row grows with its samples, and calls between Python and the state go
    by bucket, not by key.  A stream that starts again must keep both numbers.  A
    row more than ``delay`` behind the newest comes too late.  Clipped are the samples
    in runs of two or more at the window's own extreme.  Needs the RocksDB state store.
    """
    width = int(pd.Timedelta(every) / pd.Timedelta(microseconds=1)) // slices
    if width * slices != int(pd.Timedelta(every) / pd.Timedelta(microseconds=1)):
        raise ValueError(f"{every} is not a multiple of {slices} slices in microseconds")
    us = F.unix_micros(ts)
    # as text a key goes through Python as it is: pandas makes doubles of longs where some are null
    named = T.StructType([samples.schema[k] for k in keys])
    exact = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    cut = samples.withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), F.floor(us / width).cast("long").alias("_slice"),
        F.to_json(F.struct(*keys), exact).alias("key"), us.alias("us"), F.col(value).cast("double").alias("v"), ts)
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.TimestampType()), *T.StructType.fromDDL(SLICE).fields])
    folded = cut.groupBy("_bucket", "_slice").transformWithStateInPandas(
        statefulProcessor=_Slices(width, out.names), outputStructType=out, outputMode="Append", timeMode="EventTime", eventTimeColumnName="at")
    folded = folded.withColumn("_key", F.from_json("key", named, exact)).select(
        *[F.col("_key")[k].alias(k) for k in keys], "at", *[f.name for f in T.StructType.fromDDL(SLICE)])
    window = folded.groupBy(*keys, F.window("at", every)).agg(
        F.sum("n").alias("rows"), F.sum("n_v").alias("n_v"), F.sum("s").alias("s"), F.max("top").alias("top"), F.min("bottom").alias("bottom"),
        F.array_sort(F.collect_list(F.struct("first_us", *[f.split()[0] for f in SLICE.split(", ") if f.split()[0] != "first_us"]))).alias("_s"))
    mean = F.col("s") / F.col("n_v")

    def clipped(v: Column, n: Column) -> Column:
        return F.when((n >= 2) & ((v == F.col("top")) | (v == F.col("bottom"))), n).otherwise(F.lit(0).cast("long"))

    def chain(acc: Column, x: Column) -> Column:
        joined = F.coalesce(acc["v"] == x["head_v"], F.lit(False))
        head = x["head_n"] + F.when(joined, acc["n"]).otherwise(F.lit(0))
        before = F.when(joined, F.lit(0)).otherwise(clipped(acc["v"], acc["n"]))
        gap = (x["first_us"] - acc["last"]).cast("double")
        inside = clipped(x["head_v"], head) + F.when(x["top"] == F.col("top"), x["at_top"]).otherwise(F.lit(0)) + F.when(
            x["bottom"] == F.col("bottom"), x["at_bottom"]).otherwise(F.lit(0))
        one = x["runs"] == 1
        return F.struct(
            x["last_us"].alias("last"), (acc["dt"] + x["dt"] + F.coalesce(gap, F.lit(0.0))).alias("dt"),
            (acc["dt2"] + x["dt2"] + F.coalesce(gap * gap, F.lit(0.0))).alias("dt2"),
            F.when(one, x["head_v"]).otherwise(x["tail_v"]).alias("v"), F.when(one, head).otherwise(x["tail_n"]).alias("n"),
            (acc["clipped"] + before + F.when(one, F.lit(0)).otherwise(inside)).alias("clipped"),
            (acc["m2"] + F.coalesce(x["m2"] + x["n_v"] * F.pow(x["s"] / F.nullif(x["n_v"], F.lit(0)) - mean, F.lit(2.0)), F.lit(0.0))).alias("m2"))

    none = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("dt"), F.lit(0.0).alias("dt2"), F.lit(None).cast("double").alias("v"),
                    F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("clipped"), F.lit(0.0).alias("m2"))
    d, n = F.col("_d"), F.col("rows")
    step = d["dt"] / (n - 1)
    uneven_by = F.sqrt(F.greatest(d["dt2"] / (n - 1) - step * step, F.lit(0.0))) / step
    return window.withColumn("_d", F.aggregate("_s", none, chain)).select(
        *keys, F.col("window.start").alias("start"), "rows", F.when(F.col("n_v") > 0, mean).alias("mean"),
        F.when(F.col("n_v") > 0, F.sqrt(d["m2"] / F.col("n_v"))).alias("spread"), "top", "bottom",
        F.coalesce(F.when((n > 1) & (d["dt"] > 0), uneven_by > uneven), F.lit(False)).alias("irregular"),
        (d["clipped"] + clipped(d["v"], d["n"])).alias("clipped"))
