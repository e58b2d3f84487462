"""The registered queries of this subpackage: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import quality

    scored = quality.score(table(spark, sf_dir, "documents"))
    votes = [f"vote_{r.name}" for r in quality.RULES]
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"), *votes)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commits over all documents: both tokenizers' counts, all but one row of each text deleted, words recounted as a second version; each tried twice."""
    import uuid

    from weftgraph.llm import common, tokens

    docs = table(spark, sf_dir, "documents")
    text = common.whole("text")
    counts = common.saved(tokens.counted(docs, copy=F.unhex(F.md5(text.cast("binary"))), words=common.n_words(F.col("text"))))
    words = counts.drop("n_tokens").withColumnRenamed("words", "n_tokens").withColumn("tokenizer", F.lit("words-1"))
    # all rows go and the first of each text comes back, which needs no join on texts with many copies
    firsts = counts.groupBy("copy").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *tokens.GROUP, "n_chars", "n_tokens")).alias("x")).select("x.*")
    rollup = tokens.Rollup(spark, f"{common.shared_dir(spark)}/rollup-{uuid.uuid4()}")
    for batch, delta in {
        "1-bpe": tokens.signed(counts, 1),
        "2-words": tokens.signed(words, 1),
        "3-copies": tokens.revised(counts, firsts),
        "4-recount": tokens.revised(words, words.withColumn("tokenizer", F.lit("words-2"))),
    }.items():
        rollup.commit(batch, delta)
        rollup.commit(batch, delta)
    rollup.compact()
    return rollup.totals()


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import licenses

    joined = {c: F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")}
    return licenses.licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined.values(), F.round("score", 6).alias("score"), F.size("detections").cast("long").alias("n_detections"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import pii

    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import suffix

    cut = suffix.repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import sketch

    rows = sketch.compared(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.written(F.col("sketch")).alias("fingerprint"), sketch.written(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import sharding

    placed = sharding.shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
