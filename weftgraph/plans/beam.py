"""Beam search over the graph of code blocks.

By default every block is adjacent to every other. A path's score is the sum of its blocks' scores
and any block not on it may follow, so to keep the best `width` extensions of a path only the best
`width` + its length blocks can matter: a frontier of a few paths meets a list of a few blocks, not
the square of all. With edges given, the frontier is joined to them instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Beam:
    """`best`: (position, uri, score); `levels`: (level, rank, uri, score, path_score); `paths`: (level, path, path_score, full)."""

    best: DataFrame
    levels: DataFrame
    paths: DataFrame


def search(scores: DataFrame, roots: DataFrame, steps: int, width: int = 3, edges: DataFrame | None = None) -> Beam:
    """`scores`: (uri, score) of all blocks; `roots`: (uri, rank) to begin with; `edges`: (src, dst), else all pairs.

    The first `width` roots in rank order begin. In each step all paths are extended; the best
    `width` (at least one) go on, by score, then by path. The best path is the best of full length,
    or the best at any level if none got there, the earlier level if equal.
    """
    spark = scores.sparkSession
    top = scores.orderBy(F.desc("score"), "uri").limit(max(width, 1) + steps + 1)
    begun = roots.orderBy("rank").limit(width).join(scores, "uri").select(F.array("uri").alias("path"), F.col("score").alias("path_score"))
    # a frontier is at most `width` rows: it is brought to the driver so that no step runs twice
    kind = "path array<string>, path_score double"
    frontier = spark.createDataFrame(sorted(begun.collect(), key=lambda r: (-r["path_score"], r["path"])), kind)
    few = spark.createDataFrame(top.collect(), "uri string, score double") if edges is None else None
    held, levels = [frontier.withColumn("level", F.lit(0))], []
    for level in range(1, steps + 1):
        if edges is None:
            grown = frontier.join(F.broadcast(few), ~F.array_contains("path", F.col("uri")))
        else:
            near = frontier.withColumn("src", F.element_at("path", -1)).join(edges.select("src", F.col("dst").alias("uri")).distinct(), "src")
            grown = near.where(~F.array_contains("path", F.col("uri"))).join(scores, "uri")
        grown = grown.select(F.concat("path", F.array("uri")).alias("path"), (F.col("path_score") + F.col("score")).alias("path_score"), "uri", "score")
        last = grown.groupBy("uri").agg(F.max("path_score").alias("path_score"), F.first("score").alias("score")).orderBy(F.desc("path_score"), "uri").limit(width)
        shown = [(level, i + 1, r["uri"], r["score"], r["path_score"]) for i, r in enumerate(last.collect())]
        if not shown:
            break
        levels += shown
        frontier = spark.createDataFrame(grown.select("path", "path_score").orderBy(F.desc("path_score"), "path").limit(max(width, 1)).collect(), kind)
        held.append(frontier.withColumn("level", F.lit(level)))
    paths = held[0]
    for h in held[1:]:
        paths = paths.unionByName(h)
    paths = paths.withColumn("full", F.col("level") == steps)
    best = paths.orderBy(F.desc("full"), F.desc("path_score"), "level", "path").limit(1)
    best = best.select(F.posexplode("path").alias("position", "uri")).join(scores, "uri").select("position", "uri", "score").orderBy("position")
    return Beam(best, spark.createDataFrame(levels, "level int, rank int, uri string, score double, path_score double"), paths)
