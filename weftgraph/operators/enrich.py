"""Enrichment: a new block is placed among the clusters, its likely links are scored and stored."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions.text import slug_code
from weftgraph.functions.vectors import sigmoid
from weftgraph.operators import cluster, triples


def probabilities(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows with a score: adds `probability`, keeps those that reach the threshold, best first."""
    out = scored.withColumn("probability", sigmoid(F.col("score")))
    if threshold is not None:
        out = out.where(F.col("probability") >= threshold)
    return out.orderBy(F.desc("probability"), "uri")


def preview(vector: Sequence[float], vectors: DataFrame, clusters: DataFrame, score: Callable[[DataFrame], DataFrame], top_k: int = 10, threshold: float | None = None, exclude: str | None = None) -> DataFrame:
    """(uri, similarity, score, probability) of the links a new vector would get.

    `score` adds the column score to the few candidates that the clusters leave; it is the dear part.
    """
    means = cluster.centroids(vectors, clusters)
    own = cluster.assign(vector, means).first()[0]
    near = cluster.candidates(vector, vectors, clusters, cluster.borders(vectors, clusters, means), own, top_k, exclude)
    return probabilities(score(near), threshold)


def block_triples(spark: SparkSession, block: dict[str, str]) -> DataFrame:
    """The triples of a new block, and of its file, language and version."""
    tw = vocab.TW
    language = f"{vocab.BASE}language/{block['language'].lower()}"
    slug = spark.range(1).select(slug_code(F.lit(block["version"]))).first()[0]
    version = f"{vocab.BASE}version/{slug}"
    uri, file = block["uri"], block["file_uri"]
    out = [(uri, vocab.TYPE, tw + "CodeBlock", "uri"), *((uri, tw + k, block[k]) for k in ("name", "code", "kind")), (uri, tw + "belongsToFile", file, "uri"), (uri, tw + "belongsToLanguage", language, "uri"), (uri, tw + "belongsToVersion", version, "uri")]
    if block.get("description"):
        out.append((uri, tw + "description", block["description"]))
    return triples.rows(spark, out)


def side_triples(spark: SparkSession, graph: DataFrame, block: dict[str, str]) -> DataFrame:
    """Type and name of the file, language and version, where the graph doesn't know them as such."""
    tw = vocab.TW
    slug = spark.range(1).select(slug_code(F.lit(block["version"]))).first()[0]
    ends = [(block["file_uri"], "File", "path", block["file_path"]), (f"{vocab.BASE}language/{block['language'].lower()}", "Language", "label", block["language"]), (f"{vocab.BASE}version/{slug}", "Version", "label", block["version"])]
    wanted = triples.rows(spark, [x for s, kind, p, o in ends for x in ((s, vocab.TYPE, tw + kind, "uri"), (s, tw + p, o))])
    new = triples.missing(triples.rows(spark, [(s, vocab.TYPE, tw + kind, "uri") for s, kind, _, _ in ends]).select("s", "p", "o"), graph)
    return wanted.join(new.select("s"), "s", "left_semi").select(triples.COLUMNS)


def enrich(graph: DataFrame, block: dict[str, str], links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph with the block and its links, the links as vocab.EDGES). `links` are rows (uri, probability).

    A link to the block itself is left out. In the triples a weight is a property of the block, as
    the format has it; which link has which weight is in the edges.
    """
    spark = graph.sparkSession
    links = links.where(F.col("uri") != block["uri"])
    source = F.lit(block["uri"])
    related = triples.triples(links, source, vocab.TW + "relatedTo", F.col("uri"), "uri")
    weights = triples.triples(links, source, vocab.TW + "weight", F.col("probability"), datatype=vocab.XSD + "double")
    edges = links.select(source.alias("src"), F.col("uri").alias("dst"), F.lit("relatedTo").alias("kind"), F.col("probability").alias("weight"))
    return triples.union(graph, block_triples(spark, block), side_triples(spark, graph, block), related, weights), edges


def new_block_uris(spark: SparkSession, name: str, prefix: str = "java-derivatives/v1") -> tuple[str, str]:
    """(block URI, file URI) of a snippet that is added by name."""
    slug = spark.range(1).select(slug_code(F.lit(name), "new-node")).first()[0]
    return f"{vocab.BASE}codeblock/{prefix}/{slug}", f"{vocab.BASE}file/{prefix}/{slug}"
