"""Mining of query logs: which results are asked for one after another.

Records of a session are numbered by time; each is joined to the next `window` of its session by
number, an equi-join on session with a band on the number, written as one join for each offset so
that Spark never forms a session's square. The ordered pairs are counted and their share of all
pairs is the confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.operators.triples import missing, triples, union


def pairs(log: DataFrame, window: int = 5, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """(source_uri, target_uri, n) over a log of (session_id, result_uris, order columns).

    Each record's results count once; the n-th record is paired with the window after it, in this
    direction only. A URI never pairs with itself.
    """
    numbered = log.select("session_id", F.array_distinct("result_uris").alias("uris"), F.struct(*order).alias("at"))
    by_time = Window.partitionBy("session_id").orderBy("at")
    after = [F.lead("uris", k).over(by_time).alias(f"after_{k}") for k in range(1, window + 1)]
    followed = numbered.select("uris", *after).select("uris", F.explode(F.filter(F.array(*(f"after_{k}" for k in range(1, window + 1))), lambda x: x.isNotNull())).alias("next"))
    both = followed.select(F.explode("uris").alias("source_uri"), "next").select("source_uri", F.explode("next").alias("target_uri"))
    return both.where("source_uri <> target_uri").groupBy("source_uri", "target_uri").agg(F.count("*").alias("n"))


def suggestions(counted: DataFrame, least: int = 3, above: float = 0.05) -> DataFrame:
    """Pairs seen at least `least` times whose share of all pairs is above a limit, best first."""
    total = counted.agg(F.sum("n").alias("total"))  # one row
    shared = counted.crossJoin(F.broadcast(total)).withColumn("confidence", F.col("n") / F.col("total"))
    return shared.where((F.col("n") >= least) & (F.col("confidence") > above)).select("source_uri", "target_uri", "n", "confidence").orderBy(F.desc("confidence"), "source_uri", "target_uri")


def analyze(log: DataFrame, window: int = 5, least: int = 3, above: float = 0.05) -> DataFrame:
    """Suggested edges of a log; none if it has fewer than two records."""
    return suggestions(pairs(log, window), least, above)


def summary(log: DataFrame, window: int = 5, **options) -> DataFrame:
    """One row: sessions, queries, pairs, suggestions and the ten best of them; `options` are those of `pairs`."""
    counted = pairs(log, window, **options)
    best = suggestions(counted)
    top = best.limit(10).agg(F.sort_array(F.collect_list(F.struct("confidence", "source_uri", "target_uri")), False).alias("top"))
    of_log = log.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("queries"))
    # each side is one row
    return of_log.crossJoin(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))).crossJoin(best.agg(F.count("*").alias("suggestions"))).crossJoin(top)


def new_edges(suggested: DataFrame, graph: DataFrame, min_confidence: float = 0.1) -> DataFrame:
    """Suggestions confident enough that the graph doesn't have as related."""
    wanted = suggested.where(F.col("confidence") >= min_confidence).select(F.col("source_uri").alias("s"), F.lit(vocab.TW + "relatedTo").alias("p"), F.col("target_uri").alias("o"), "confidence")
    return missing(wanted, graph)


def apply(suggested: DataFrame, graph: DataFrame, min_confidence: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(graph with the new edges and their weights, edges added as vocab.EDGES)."""
    added = new_edges(suggested, graph, min_confidence)
    related = triples(added, F.col("s"), vocab.TW + "relatedTo", F.col("o"), "uri")
    weights = triples(added, F.col("s"), vocab.TW + "coOccurrenceWeight", F.col("confidence"), datatype=vocab.XSD + "double")
    edges = added.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit("coOccurrence").alias("kind"), F.col("confidence").alias("weight"))
    return union(graph, related, weights), edges
