"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm import langid, lines, middle, mixing, neighbours, packing, quality, repeats, sharding, simhash, topk, trie, warc
from kinetrail.llm.common import crc_of_id, table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_packing")
def _(spark, d):
    return packing.pack(table(spark, d, "documents"), tokenizer_path(), end_id=2)


@query("op4_mixing")
def _(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_simhash")
def _(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents")).select(
        "doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op10_near_vectors")
def _(spark, d):
    return neighbours.near_vectors(table(spark, d, "embeddings"))


@query("op3_line_dedup", "WITH " + lines.SQL_CTES.format(docs="documents") + " SELECT doc_id, text, n_removed FROM deduped")
def _(spark, d):
    return lines.dedup_lines(table(spark, d, "documents")).select("doc_id", "text", F.col("_n_removed").alias("n_removed"))


@query("op2_quality")
def _(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    held_out = crc_of_id() % 3 == 1
    w = quality.train(docs, labels.filter(~held_out))
    return quality.score_quality(docs, w).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_language")
def _(spark, d):
    docs = table(spark, d, "documents")
    held_out = crc_of_id() % 4 == 2
    languages, w = langid.train(docs.filter(~held_out))
    return langid.predict(docs, languages, w).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_warc", warc.SQL)
def _(spark, d):
    return warc.round_trip(table(spark, d, "pages"))


@query("op5_repeats")
def _(spark, d):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return repeats.remove_repeats(table(spark, d, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_top_products")
def _(spark, d):
    return topk.top_products(table(spark, d, "embeddings"))


@query("op13_fill_in_middle", middle.SQL)
def _(spark, d):
    return middle.fill_in_middle(table(spark, d, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op11_prefix_trie", trie.SQL)
def _(spark, d):
    made = trie.prefix_trie(trie.rebuild(trie.series(table(spark, d, "conversations"))))
    return made.nodes.join(trie.ends_digest(made.ends), ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent_rep").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


@query("op12_sharding", sharding.sql())
def _(spark, d):
    return sharding.shard(table(spark, d, "documents"), shards=8, law="rows")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
