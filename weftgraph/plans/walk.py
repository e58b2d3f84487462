"""The greedy walk: from each entry the best edge, again and again; all walkers take their steps together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.functions.scoring import EdgeScorer, heuristic
from weftgraph.operators import triples as t
from weftgraph.session import saved

STEP = "struct<`from`:string,from_label:string,predicate:string,predicate_uri:string,`to`:string,to_label:string,score:double>"


def walk(graph: DataFrame, entries: DataFrame, query: str, intention: str, max_depth: int = 4, min_score: float = -0.8, scorer: EdgeScorer = heuristic) -> DataFrame:
    """(entry_node, entry_label, path) for each row (uri, label) of `entries`.

    A walker stops without an edge, below the least score, at a literal, or at a node it has been
    to; in the last two cases the step still counts. Of equal edges the least target, then the
    least predicate is taken.
    """
    edges = t.labelled(t.edges(graph).select("s", "p", "o", "o_kind").distinct(), graph, "o", "to_label")
    edges = saved(edges.withColumn("text", F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(F.col("to_label"))).drop("to_label"))
    state = entries.select(F.col("uri").alias("entry_node"), F.col("label").alias("entry_label"), F.col("uri").alias("at"), F.col("label").alias("from_text"), F.array("uri").alias("visited"), F.array().cast(f"array<{STEP}>").alias("path"), F.lit(True).alias("open"))
    # the least of (score, negated, target, predicate): aggregated before the shuffle, so a hub's edges are not sorted
    order = F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("order")
    for _ in range(max_depth):
        # a walker's state rides on the rows of its edges, so the plan grows by one join a step
        ahead = state.join(edges, F.col("open") & (F.col("at") == F.col("s")), "left")
        ahead = ahead.withColumn("on_path", F.coalesce((F.col("o_kind") == "uri") & F.array_contains("visited", F.col("o")), F.lit(False)))
        scored = scorer(ahead, query, intention).withColumn("score", F.when(F.col("s").isNotNull(), F.col("score")))
        others = [c for c in scored.columns if c not in ("entry_node", "o", "p")]
        best = scored.groupBy("entry_node").agg(F.min(F.struct(order, "o", "p", F.struct(*others).alias("x"))).alias("best")).select("entry_node", "best.o", "best.p", "best.x.*").withColumn("goes", F.coalesce(F.col("score") >= min_score, F.lit(False)))
        step = F.struct(F.col("at").alias("from"), F.col("from_text").alias("from_label"), text.local_name(F.col("p")).alias("predicate"), F.col("p").alias("predicate_uri"), F.col("o").alias("to"), F.col("text").alias("to_label"), "score")
        further = F.col("goes") & (F.col("o_kind") == "uri") & ~F.col("on_path")
        then = lambda new, old: F.when(F.col("goes"), new).otherwise(old)
        state = best.select(
            "entry_node", "entry_label", then(F.col("o"), F.col("at")).alias("at"), then(F.col("text"), F.col("from_text")).alias("from_text"),
            F.when(further, F.concat("visited", F.array("o"))).otherwise(F.col("visited")).alias("visited"),
            then(F.concat("path", F.array(step)), F.col("path")).alias("path"), further.alias("open"),
        )
    return state.select("entry_node", "entry_label", "path")


def instruction(spark, query: str) -> DataFrame:
    """One row: acao, entradas, intencao, raw_query, metadata."""
    q = F.lit(query)
    found = text.entries(q)
    row = spark.range(1).select(text.action(q).alias("acao"), found.alias("entradas"), text.intention(q).alias("intencao"), q.alias("raw_query"))
    return row.withColumn("metadata", F.create_map(F.lit("detected_keywords"), F.array_join("entradas", ",")))


def entry_nodes(graph: DataFrame, entries: list[str]) -> DataFrame:
    """(uri, label) of all nodes found for the entries, each once, in order; an entry without any is a node of its own that is not stored."""
    known = t.nodes(graph)
    spark, out = graph.sparkSession, []
    for i, entry in enumerate(entries):
        hits = t.find(known, entry).select("uri", F.coalesce("label", text.local_name(F.col("uri"))).alias("label"), F.col("hits"), F.lit(i).alias("entry"))
        own = spark.range(1).select(text.to_uri(F.lit(entry)).alias("uri"), F.lit(entry).alias("label"), F.lit(0).alias("hits"), F.lit(i).alias("entry"))
        out.append(hits.unionByName(own.join(hits.limit(1).select(F.col("entry")), "entry", "left_anti").select(hits.columns)))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    order = Window.partitionBy("uri").orderBy("entry", F.desc("hits"))
    return every.withColumn("n", F.row_number().over(order)).where("n = 1").orderBy("entry", F.desc("hits"), "uri").select("uri", "label")


def retrieve(graph: DataFrame, query: str, max_depth: int = 4, min_score: float = -0.8, scorer: EdgeScorer = heuristic) -> DataFrame:
    """Paths from all entry nodes of a query, scored by its own intention."""
    told = instruction(graph.sparkSession, query).first()
    return walk(graph, entry_nodes(graph, told["entradas"]), query, told["intencao"], max_depth, min_score, scorer)


def handle(kg: t.KnowledgeGraph, told, label: str | None = None) -> str | None:
    """Carry out an instruction that stores or updates; None for anything else, or an update with fewer than two entries."""
    if told["acao"] == "guardar":
        return kg.store_concept(told["entradas"][0], label or told["entradas"][0])
    if told["acao"] == "atualizar" and len(told["entradas"]) >= 2:
        return kg.update_concept(told["entradas"][0], told["entradas"][1], label)
    return None
