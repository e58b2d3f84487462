"""What several of the corpus operators need: words, bindings, checkpoints, components."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts have it: the blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind `value` to a lambda variable, so that lambdas inside `use` read it and don't compute it again."""
    return F.transform(F.array(value), use)[0]


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(folder := tempfile.mkdtemp(prefix="weftgraph-checkpoints-"))
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and read from there, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Let the shuffle files go now of plans that nothing refers to any more.

    Spark drops them when the driver happens to collect its garbage, which on a large heap may be
    long after; an operator of several passes would hold those of all of them till then. What
    Python lets go of, a thread of py4j tells the driver, which looks for it once a second only.
    """
    gc.collect()
    time.sleep(1.2)
    for _ in range(2):  # what the first collection lets go of holds what the second does
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph with edges (a, b): rows (node, component), component being the least node.

    Large-star and small-star in turn until nothing changes, which takes a number of rounds
    logarithmic in the longest chain. A hub's minimum is aggregated before the shuffle and joined
    back, so no task has to hold all neighbours of a hub. Nodes without an edge to another node have no row.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")  # each node with its smaller neighbours
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = saved(small)
        if (new := _mark(now)) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new
