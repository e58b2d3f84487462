"""The corpus operators as stages of a pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import minhash, mixing, packing, pii, quality
from weftgraph.llm.common import saved


def _carried(docs: DataFrame, key: Column) -> DataFrame:
    """(doc, key): the rows in a struct, so that no column of theirs can clash with one of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), key.alias("key"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null and empty texts fail, very long ones are measured whole, repeated rows are each judged
    alike. A posterior of exactly the threshold keeps. An empty table gives no rows.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the least id, with all its columns.

    Near are texts with 0.8 of their five-word shingles in common, exactly checked. Operator 7's
    components propose pairs first, bands of MinHash the rest, see `minhash`. Rows are told apart by
    id and text, whatever ids repeat or are null; null ids come last; of rows that tie in both the
    first by its other columns, as JSON, stays. Null and empty texts are one group, very long ones
    are compared whole. An empty table gives no rows.
    """
    rows = _carried(docs, minhash.key(F.col("text")))
    parts = minhash.components(rows.select("key", F.col("doc.text").alias("text")))
    found = rows.select(F.col("doc.doc_id").alias("id"), "key").join(parts, "key")
    stays = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("x")).select(F.col("x.id").alias("id"), F.col("x.key").alias("k"))
    held = rows.join(stays, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left_semi")
    once = Window.partitionBy("key").orderBy(F.to_json("doc"))  # one id for each key is left
    return held.withColumn("n", F.row_number().over(once)).where("n = 1").select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced; n_chars follows the new text, all other columns stay.

    Null texts stay null, with null n_chars; empty ones and repeated rows are as any other; very long
    ones are searched whole; where spans overlap, the one that starts first is replaced whole. An
    empty table gives no rows.
    """
    return pii.sanitised(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never, with all its columns.

    Rows that share id and text are decided each by itself and told apart by their sources. Null and
    empty texts have no words, so they cost nothing, and are taken the whole part of the rate. A very
    long text is taken or not like others. An empty table gives no rows.
    """
    key = F.xxhash64("doc_id", "text")
    decided = saved(mixing.mix(docs.select(key.alias("doc_id"), "text", "source")).select(F.col("doc_id").alias("key"), "source", "size", "copies"))
    each = decided.groupBy("key").agg(F.count("*").alias("n"), F.min("copies").alias("copies"))
    joined = _carried(docs, key).join(each, "key")
    numbered = lambda order: F.row_number().over(Window.partitionBy("key").orderBy(*order))
    # only rows that share a key are numbered
    again = joined.where("n > 1").select("doc", "key", numbered([F.col("doc.source").asc_nulls_first(), mixing.n_words(F.col("doc.text"))]).alias("k"))
    kinds = decided.join(each.where("n > 1").select("key"), "key").select("key", "copies", numbered([F.col("source").asc_nulls_first(), "size", "copies"]).alias("k"))
    taken = joined.where("n = 1").select("doc", "copies").unionByName(again.join(kinds, ["key", "k"]).select("doc", "copies"))
    return taken.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bucket, batch and slot; a row for each, as `packing.pack` says for nulls, empty and long texts, ties and repeated rows."""
    return packing.pack(docs)
