"""Communities by modularity.

On the complete graph, which is the default adjacency, each merge into the larger community gains,
so all nodes are one community. With edges given, nodes move between communities in rounds: every
node sees where it would gain most, and nodes of one colour, drawn by hash anew in each round, move
at once; then communities are contracted to the nodes of a smaller graph, and so on. All of it is
joins and aggregations; a community of any size is no single task's load, and neither is a node
with any number of neighbours: its row of sums is made in several parts.

Nodes go by numbers in the order of their URIs, so that ties are decided as by the URIs. A turn
moves the edges of its own colour only, twice: to the communities of the neighbours and back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import saved, stored

#: So many neighbours of one node are summed up in one part.
PART = 100_000


def single(nodes: DataFrame) -> DataFrame:
    """(uri, community): all in one, named by its least member."""
    return nodes.select("uri").crossJoin(F.broadcast(nodes.agg(F.min("uri").alias("community"))))


def louvain(edges: DataFrame, rounds: int = 10, seed: int = 42, colours: int = 2, levels: int = 10) -> DataFrame:
    """(uri, community) from (src, dst[, weight]): local moves, then communities become the nodes of the next level, until none join.

    A level ends after `rounds` sweeps, or before, when a sweep moves no node.
    """
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    named = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    with stored(edges.sparkSession) as keep:
        named = keep(named)
        uris = named.select(F.explode(F.array("a", "b")).alias("uri")).distinct()
        uris = keep(uris.orderBy("uri").select("uri", F.monotonically_increasing_id().alias("id")))
        half = named
        for end in ("a", "b"):
            half = half.join(uris.select(F.col("uri").alias(end), F.col("id").alias(f"id_{end}")), end)
        half = keep(half.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "w"))
        nodes = uris.join(_both(half).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"), F.count("*").alias("degree")), "id")
        nodes = saved(nodes)
        total, n = nodes.agg(F.sum("k"), F.count("*")).first()
        found = nodes.select("uri", F.col("id").alias("community"))
        for level in range(levels) if total else ():
            now = _moved(keep, half, nodes, float(total), rounds, seed + 1000 * level, colours)
            ends = now.groupBy("community").agg(F.min("id").alias("to"), F.sum("k").alias("k"))
            to = saved(now.join(ends.drop("k"), "community").select("id", "to"))
            found = saved(found.join(to, F.col("community") == F.col("id")).select("uri", F.col("to").alias("community")))
            nodes = saved(ends.select(F.col("to").alias("id"), "k"))
            before, n = n, nodes.count()
            if n in (1, before) or level == levels - 1:
                break
            a, b = (to.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
            least, most = F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
            half = keep(half.join(a, "a").join(b, "b").where("to_a <> to_b").groupBy(least, most).agg(F.sum("w").alias("w")))
            if half.isEmpty():
                break
            degrees = _both(half).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
            # a node without neighbours on this level stays
            nodes = saved(nodes.join(uris, "id").join(degrees, "id", "left"))
        return saved(found.join(uris.select(F.col("id").alias("community"), F.col("uri").alias("named")), "community").select("uri", F.col("named").alias("community")))


def _both(half: DataFrame) -> DataFrame:
    """(src, dst, w): each edge from either end, in one pass."""
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return half.select(F.inline(ways), "w")


def _moved(keep: Callable[[DataFrame], DataFrame], half: DataFrame, nodes: DataFrame, total: float, rounds: int, seed: int, colours: int) -> DataFrame:
    """(id, k, community) after the sweeps of one level, each node (id, uri, k, degree) beginning on its own."""
    turns = [F.pmod(F.xxhash64("uri", F.lit(seed + sweep)), F.lit(colours)).cast("int").alias(f"turn{sweep}") for sweep in range(rounds)]  # one turn in each sweep
    parts = F.ceil(F.coalesce("degree", F.lit(1)) / PART).alias("parts")
    nodes = saved(nodes.select("id", "k", parts, *turns))
    edges = keep(_both(half).join(nodes.withColumnRenamed("id", "src"), "src"))
    now = nodes.withColumn("community", F.col("id"))
    for sweep in range(rounds):
        moves = 0
        for n in range(colours):
            turn = F.col(f"turn{sweep}") == n
            at = now.join(now.groupBy("community").agg(F.sum("k").alias("mass")), "community").select("id", "community", "mass", "k", "parts", turn.alias("turn"))
            dst = at.select(F.col("id").alias("dst"), "community", "mass").hint("shuffle_hash")
            near = edges.where(turn).select("src", "dst", "w", "k", "parts").join(dst, "dst")
            near = near.select("src", "k", "community", "mass", "w", _part().alias("part"))
            # where a node is itself, without a weight
            own = at.where("turn").select(F.col("id").alias("src"), "k", "community", "mass", F.lit(None).cast("double").alias("w"), _part().alias("part"))
            seen = near.unionByName(own).repartition("src", "part").groupBy("src", "part", "community")
            seen = seen.agg(F.sum("w").alias("inside"), F.max("mass").alias("mass"), F.max("k").alias("k"), (F.count("*") > F.count("w")).alias("stays")).where("inside is not null")
            rest = F.col("mass") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)
            seen = seen.withColumn("gain", F.col("inside") - F.col("k") * rest / F.lit(total))
            best = seen.groupBy("src", "part").agg(F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"), F.max(F.struct("gain", F.col("community").alias("to"))).alias("best"))
            best = best.groupBy(F.col("src").alias("id")).agg(F.max("stay").alias("stay"), F.max("best").alias("best"))
            better = F.coalesce(F.col("best.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12, F.lit(False))
            step = now.withColumnRenamed("community", "own").join(best, "id", "left")
            step = saved(step.select(*nodes.columns, F.when(better, F.col("best.to")).otherwise(F.col("own")).alias("community"), better.alias("moved")))
            moves += step.where("moved").count()
            now = step.drop("moved")
        if not moves:
            break
    return now.select("id", "k", "community")


def _part() -> Column:
    """In which part of its node's neighbours a community is summed up."""
    return F.pmod(F.xxhash64("community"), F.col("parts"))
