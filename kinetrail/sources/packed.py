"""Many small text files kept in few large ones.

A line of the large file is the small file's name, the line's number in it and
the line as it was, between tabs.  Opening, listing and committing then cost by
bytes, not by recordings, and a file may lie in any number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pack(lines: DataFrame, path: str) -> None:
    """Write (file, number, text) where the rows lie, without a shuffle; names hold no tab."""
    rows = lines.sortWithinPartitions("file", "number")
    rows.select(F.concat(F.col("file").cast("string"), F.lit("\t"), F.col("number").cast("string"), F.lit("\t"),
                         F.coalesce("text", F.lit(""))).alias("value")).write.text(path)


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text) of every line of every packed file."""
    return unpacked(spark.read.text(path))


def unpacked(text: DataFrame, *more: Column) -> DataFrame:
    """(file, number, text), after the columns ``more``, of lines of packed files read as text."""
    part = F.split("value", "\t", 3)
    return text.select(*more, part[0].alias("file"), part[1].cast("long").alias("number"), part[2].alias("text"))


def with_head(rows: DataFrame, first: str, text, head) -> DataFrame:
    """(file, number, text): each row's ``text`` and, before the row numbered 0 by ``first``, its file's ``head`` lines.

    ``head`` is a list of columns; they are numbered -1 and down.
    """
    top = F.array(*[F.struct(F.lit(k - len(head)).cast("long").alias("number"), h.alias("text")) for k, h in enumerate(head)])
    own = F.array(F.struct(F.col(first).cast("long").alias("number"), text.alias("text")))
    laid = F.when(F.col(first) == 0, F.concat(top, own)).otherwise(own)
    return rows.select("file", F.explode(laid).alias("_l")).select("file", "_l.*")
