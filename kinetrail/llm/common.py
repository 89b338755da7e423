"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold: long texts must not meet in one batch of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def utf8(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 ends of its rows; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into one table per key value."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = tuple(c[a].as_py() for c in cols)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def crc_of_id(col: str = "doc_id"):
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def bounded_sample(docs: DataFrame, labels: DataFrame, per_stratum: int, seed: int) -> list[tuple[str, object, int]]:
    """(text, label, size of the label's stratum) of a seeded sample of labelled documents.

    ``labels`` has (doc_id, label).  Ids are picked by a filter on a hash,
    ``per_stratum`` expected of each label and all if there are fewer, so no label
    meets in one task; the picked ids, at most twice the expected number, find
    their texts by a broadcast of known size.  Of rows that share a picked id, the
    least text counts.
    """
    spark = docs.sparkSession
    labels = labels.filter("label is not null and doc_id is not null").distinct()
    sizes = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    if not sizes:
        return []
    scale = 1 << 40
    chance = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(scale * min(1.0, per_stratum / n)))])
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(scale))
    ids = labels.filter(place < chance[F.col("label")]).orderBy(place, "doc_id", "label").limit(2 * per_stratum * len(sizes)).collect()
    picked = spark.createDataFrame([(r.doc_id, r.label, k) for k, r in enumerate(ids)], labels.select("doc_id", "label").withColumn(
        "_place", F.lit(0)).schema)
    # one row of a picked id, however many carry it
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy(
        "doc_id", "label", "_place").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["_place"])
    return [(r["text"] or "", r["label"], sizes[r["label"]]) for r in rows]


class Adam:
    """Adam on a dict of float32 arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)
