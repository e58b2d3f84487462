"""Document fingerprints: a threshold-scaled sketch of a text's shingle hashes.

Of the hashes of all five-word shingles the sketch keeps those below a fixed fraction of the hash
range, whatever the text: of a short one that may be none. What is kept doesn't depend on the size of the document, so sketches can be merged by union
and compared between documents of very unequal length: the share of one sketch found in another
estimates containment, intersection over union estimates resemblance. All of it is built-in
functions, evaluated in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import let, whole, words

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all shingles in order. Fewer words than a shingle: the whole sequence is one; no words: none."""

    def of(h: Column) -> Column:
        wide = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle))))
        short = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < shingle, short).otherwise(wide)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Struct of `kept`, the ascending distinct hashes below the threshold, and `least`, the least of all, null without words.

    `kept` is the sketch; it may be empty for a short text. `least` stands beside it, is no part of
    what is kept, and tells apart texts of which nothing is kept.
    """
    limit = F.lit(-(2**63) + 2**64 // scale)
    return let(shingle_hashes(text, shingle), lambda x: F.struct(F.array_sort(F.array_distinct(F.filter(x, lambda v: v < limit))).alias("kept"), F.array_min(x).alias("least")))


def resemblance(a: Column, b: Column) -> Column:
    """Intersection over union of two sketches. Where nothing is kept of either, 1 if their least hashes agree (two texts without words do), else 0."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    union = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(union == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Share of the first text found in the second: 1 if the first has no words, null (not known) if it has some, but nothing of it is kept."""
    return F.when(F.size(a["kept"]) > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"])).when(a["least"].isNull(), 1.0)


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of all texts of a group together, exactly that of their shingles' union."""
    return F.struct(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches["kept"])))).alias("kept"), F.min(sketches["least"]).alias("least"))


def written(s: Column) -> Column:
    """A sketch as text: 16 lower-case hex digits for each hash, joined by commas; the least after a tilde where nothing is kept."""
    digits = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.when(F.size(s["kept"]) > 0, F.array_join(F.transform(s["kept"], digits), ",")).when(s["least"].isNotNull(), F.concat(F.lit("~"), digits(s["least"]))).otherwise("")


def _part_of(cuts: list[int], key: Column) -> Column:
    """How many of the ascending cuts are no greater than the key, by two looks at about sqrt(n) of them."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    array = lambda x: F.array(*(F.lit(c).cast("long") for c in x))
    below = lambda a: F.size(F.filter(a, lambda c: c <= key))
    # all cuts of the blocks before the one in which the key lies are no greater
    return let(below(array(cuts[::width])), lambda block: F.when(block == 0, 0).otherwise((block - 1) * width + below(F.slice(array(cuts), (block - 1) * width + 1, F.lit(width)))))


def _labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash partitioning into n deals to a partition each."""
    tried = spark.range(0, 30 * n, 1, 1).select(F.col("id").cast("int").alias("i"))
    dealt = {r["p"]: r["i"] for r in tried.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).collect()}
    return [dealt.get(p, 30 * n + p) for p in range(n)]


def with_next(docs: DataFrame, id_col: str, cols: dict[str, Callable[[], Column]], parts: int | None = None) -> DataFrame:
    """Adds the `cols` of each row (made after rows are dealt, so not sent), and next, a struct of them of the following row by id, then text; after the last comes the first.

    Rows are dealt into ranges of ids; the first of each range also goes, marked, to the range
    before, so each range finds its followers by itself. Only range limits come to the driver, a
    few for each shuffle partition. Ids are integers; null ids come first.
    """
    n = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    keyed = docs.withColumn("__key", key).withColumn("__part", _part_of(sorted(set(cuts or [])), F.col("__key")))
    firsts = [(x["__part"], x["k"]) for x in keyed.groupBy("__part").agg(F.min("__key").alias("k")).orderBy("__part").collect()]
    # by part: its first key, and the part before, that of the first being the last
    first, before = [None] * (len(cuts or []) + 1), [None] * (len(cuts or []) + 1)
    for i, (p, k) in enumerate(firsts):
        first[p], before[p] = k, firsts[i - 1][0]
    at = lambda x, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in x)), F.col("__part"))
    own = F.struct(F.col("__part").alias("part"), F.lit(False).alias("extra"))
    places = F.when(F.col("__key") == at(first, "long"), F.array(own, F.struct(at(before, "int").alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    dealt = keyed.withColumn("__at", F.explode(places)).withColumn("__part", F.col("__at.part")).withColumn("__extra", F.col("__at.extra")).drop("__at")
    dealt = dealt.withColumn("__part", F.get(F.array(*map(F.lit, _labels(docs.sparkSession, len(first)))), F.col("__part")))
    dealt = dealt.repartition(len(first), "__part").withColumns({c: made() for c, made in cols.items()})
    order = Window.partitionBy("__part").orderBy("__extra", "__key", "text")
    return dealt.withColumn("next", F.lead(F.struct("text", *cols)).over(order)).where("not __extra").drop("__key", "__part", "__extra")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text (its last half replaced from the next document) and its next document.

    Rows: id, n_chars, edited, sketch, edited_sketch, next_sketch. Null texts count as empty ones.
    Repeated rows each have a row, and follow each other. A lone document is its own next. An
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    near = with_next(rows, "id", {"sketch": lambda: sketch(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    near = near.select(F.col("id").alias(id_col), n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    return near.withColumn("edited_sketch", sketch(F.col("edited")))
