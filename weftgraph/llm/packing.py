"""Packing: optimal length buckets from the global histogram, then token-budget batches in each.

The histogram has a bin for each length that occurs, so the choice of boundaries is optimal. It
comes to the driver: texts of n different lengths have at least n * n / 2 words in all, so W words
have at most sqrt(2 W) bins of two numbers - 6 million, under 100 MB, for the 2e13 words of 100 TB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import n_words, saved

#: More padding than any choice of boundaries has.
FAR = 2**61
#: Rows of a bucket that one task ranks.
SPLIT = 50_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most `buckets` buckets with the least total padding.

    `counts[i]` rows have `lengths[i]` words, ascending; the last bound is the greatest length. Of
    equally good choices the one with fewer buckets, then lower bounds, wins. The leftmost best cut
    never moves left as lengths grow (the cost of a bucket is concave Monge), so each layer is
    solved level by level, the middle of every open range at once, in n log n steps.
    """
    n = len(lengths)
    if not n:
        return []
    top = np.array(lengths, np.int64)
    c = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
    s = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) * top)))
    best = np.full(n + 1, FAR, np.int64)
    best[0] = 0
    cuts, least = [], []
    for _ in range(min(buckets, n)):
        best, cut = _layer(best, top, c, s)
        cuts.append(cut)
        least.append(int(best[n]))
    k, j, out = int(np.argmin(least)), n, []
    while j:
        out.append(int(top[j - 1]))
        j, k = int(cuts[k][j]), k - 1
    return out[::-1]


def _layer(best: np.ndarray, top: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With one bucket more: the least padding of the first j lengths for each j, and where its last bucket begins."""
    n = len(top)
    new, cut = np.full(n + 1, FAR, np.int64), np.zeros(n + 1, np.int64)
    low, high, left, right = (np.array([x], np.int64) for x in (1, n, 0, n - 1))  # j in low..high, begins in left..right
    while len(low):
        mid = (low + high) // 2
        end = np.minimum(right, mid - 1)
        size = end - left + 1
        starts = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(starts - left, size)
        j = np.repeat(mid, size)
        cost = np.minimum(best[i], FAR) + top[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
        least = np.minimum.reduceat(cost, starts)
        at = np.flatnonzero(cost == np.repeat(least, size))
        first = i[at[np.searchsorted(at, starts)]]
        new[mid], cut[mid] = np.minimum(least, FAR), first
        halves = [(low, mid - 1, left, first), (mid + 1, high, first, right)]
        low, high, left, right = (np.concatenate(x) for x in zip(*halves))
        open_ = low <= high
        low, high, left, right = low[open_], high[open_], left[open_], right[open_]
    return new, cut


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, bucket, boundary, batch, slot, padding.

    A batch holds budget // boundary documents of its bucket, padded to the boundary; a document
    longer than the budget is a batch of its own. Batches and slots run from 0 without gaps, the
    last batch of a bucket may be short. Rows of one length lie in order of their ids, null ids
    first; which of rows that tie in both comes first is not told. Null and empty texts have length
    0, very long ones their full length. Repeated rows each get a slot. An empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = saved(docs.select(F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("n_words")))
    hist = sorted(map(tuple, rows.groupBy("n_words").count().collect()))
    bounds = boundaries([x for x, _ in hist], [n for _, n in hist], buckets)
    held = np.add.reduceat([n for _, n in hist], np.searchsorted([x for x, _ in hist], [-1, *bounds[:-1]], "right")).tolist() if hist else []
    table = [(b, bound, max(1, token_budget // max(1, bound)), max(1, -(-n // SPLIT))) for b, (bound, n) in enumerate(zip(bounds, held))]
    found = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(found, lambda b: b < F.col("n_words")))
    spec = spark.createDataFrame(table, "bucket int, boundary long, room long, parts int")
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(spec), "bucket").withColumn("part", F.pmod(F.xxhash64("id", "n_words"), F.col("parts")).cast("int"))
    sizes = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("n_words", "id")))
    rank = F.col("offset") + F.col("n") - 1
    return ranked.join(offsets, ["bucket", "part"]).select(
        F.col("id").alias(id_col), "n_words", "bucket", "boundary", F.expr("cast((offset + n - 1) div room as long)").alias("batch"), (rank % F.col("room")).cast("long").alias("slot"), (F.col("boundary") - F.col("n_words")).alias("padding")
    )
