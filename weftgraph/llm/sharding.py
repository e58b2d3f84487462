"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups of equal texts are the items: each is placed, largest first, where the dot product of its
vector (bytes, tokens, rows) with the shard's residual capacity is highest. As that must look at
one item after another, many groups are dealt into blocks by hash; each block packs its own into as
many bins as there are shards, side by side, and the bins, whose vectors are about equal by then,
are the next level's items, until few enough are left to be packed at once. A group with more than
an eighth of a shard - there are at most 24 * shards of them - meets the others at that last level.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import n_words, saved, whole

#: Items that one task, or the driver, packs.
BLOCK = 1 << 14
#: What bytes, tokens and rows weigh in the dot product: the law is that bytes are near equal.
WEIGHTS = (4.0, 1.0, 0.25)
#: Rows of a shard that one task ranks.
SPLIT = 50_000


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of `vectors`): largest first, to the highest weighted dot product with the residual capacity; of equal ones the first."""
    total = vectors.sum(axis=0)
    scaled = vectors * (shards / np.where(total > 0, total, 1))
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -scaled.sum(axis=1), -scaled.max(axis=1))):
        out[i] = best = int(np.argmax(residual @ (WEIGHTS * scaled[i])))
        residual[best] -= scaled[i]
    return out


def _binned(items: DataFrame, parts: int, bins: int) -> DataFrame:
    """(item, b, t, r, cell): each block of the items packed into bins of its own."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item").reset_index(drop=True)
        cell = group["part"] * bins + pack(group[["b", "t", "r"]].to_numpy(float), bins)
        return group.assign(cell=cell)[["item", "b", "t", "r", "cell"]]

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(run, "item long, b long, t long, r long, cell long")


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document: id, size (bytes + 1), n_tokens, text_crc32, shard, slot.

    Equal texts share a shard, unless their group has more than a whole shard's share of the bytes,
    tokens or rows: no placing could then balance it, so it is dealt by id in pieces of an eighth.
    Slots run from 0 without gaps in each shard. Null texts count as empty ones and group with
    them; a very long text is a group like others. Rows that repeat are members of one group. Equal
    groups go by the hash of their text. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = whole(text_col)
    rows = saved(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), n_words(text).alias("n_tokens"), F.xxhash64(text).alias("item"), F.crc32(text).alias("text_crc32")))
    sums = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r")]
    groups = saved(rows.groupBy("item").agg(*sums))
    all_ = groups.agg(*(F.sum(c).alias(c) for c in "btr"), F.count("*").alias("n")).first()
    share = F.greatest(*(F.col(c) * F.lit(8 * n_shards / all_[c]) if all_[c] else F.lit(0.0) for c in "btr"))  # in eighths of a shard
    heavy = sorted(tuple(r) for r in groups.where(share > 1).select("item", "b", "t", "r", share).collect())
    pieces = [math.ceil(s) if s > 8 else 1 for *_, s in heavy]
    first = np.cumsum([0, *pieces]).tolist()
    own = F.broadcast(spark.createDataFrame([(h[0], n, f) for h, n, f in zip(heavy, pieces, first)], "item long, pieces int, first int"))
    split = rows.join(own, "item").withColumn("item", (F.col("first") + F.pmod(F.xxhash64("item", "id"), F.col("pieces"))).cast("long")).drop("pieces", "first")

    items, n, cells = groups.where(share <= 1), all_["n"] - len(heavy), []
    while n > max(block, 4 * n_shards):  # each level leaves half of the items at most
        parts = math.ceil(n / max(block, 4 * n_shards))
        placed = saved(_binned(items, parts, n_shards))
        cells.append(placed.select("item", "cell"))
        items, n = placed.groupBy(F.col("cell").alias("item")).agg(*(F.sum(c).alias(c) for c in "btr")), parts * n_shards
    last = sorted(tuple(r) for r in items.select("item", "b", "t", "r").collect())
    last = [(False, *x) for x in last] + [(True, *x) for x in sorted(tuple(r) for r in split.groupBy("item").agg(*sums).collect())]
    where = pack(np.array([x[2:] for x in last], float).reshape(-1, 3), n_shards).tolist()
    at = spark.createDataFrame([(x[0], x[1], s) for x, s in zip(last, where)], "heavy boolean, item long, shard int")

    light = rows.join(own, "item", "left_anti")
    for cell in cells:
        light = light.join(cell, "item").drop("item").withColumnRenamed("cell", "item")
    both = light.withColumn("heavy", F.lit(False)).unionByName(split.withColumn("heavy", F.lit(True)))
    # slots: ranked in parts of a shard, with offsets
    parts = max(1, -(-all_["r"] // (n_shards * SPLIT))) if all_["r"] else 1
    dealt = saved(both.join(F.broadcast(at), ["heavy", "item"]).drop("heavy", "item").withColumn("part", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(parts))))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")))
    return ranked.join(offsets, ["shard", "part"]).select(F.col("id").alias(id_col), "size", "n_tokens", "text_crc32", "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"))
