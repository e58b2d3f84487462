"""The requests a client makes, each answered by a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import session_id
from weftgraph.operators import blocks, cluster, cooccur, enrich
from weftgraph.plans import beam, ranking
from weftgraph.session import saved
from weftgraph.sources import records, turtle


class Service:
    """A code graph (triples), its embeddings (uri, embedding), and the models that are at hand."""

    def __init__(self, graph: DataFrame, embeddings: DataFrame | None = None, log_path: str | None = None, model: ranking.Model | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None):
        self.graph, self.spark, self.log_path, self.model, self.encode = graph, graph.sparkSession, log_path, model, encode
        self._embeddings, self._told = embeddings, embeddings

    @property
    def blocks(self) -> DataFrame:
        return blocks.blocks(self.graph)

    @property
    def embeddings(self) -> DataFrame:
        if self._embeddings is None:
            if not self.encode:
                raise ValueError("there are neither embeddings nor an encoder")
            self._embeddings = ranking.embedded(self.blocks, self.encode)
        return self._embeddings

    def search_code(self, query: str, top_k: int = 5, steps: int = 0, beam_width: int = 3, doc_penalty: float = 0.0, enable_logging: bool = False, related: bool = False) -> tuple[DataFrame, beam.Beam | None]:
        """The best blocks, and a beam search from them if steps are asked for; logged whenever logging is on."""
        scored = saved(ranking.scored(self.blocks, query, self.model, doc_penalty))  # read several times; a model may be dear
        best = scored.orderBy(F.desc("score"), "uri").limit(top_k)
        found = None
        if steps > 0:
            roots = self.spark.createDataFrame([(r["uri"], i) for i, r in enumerate(best.collect())], "uri string, rank int")
            edges = self.graph.where(F.col("p").endswith("/relatedTo")).select(F.col("s").alias("src"), F.col("o").alias("dst")) if related else None
            found = beam.search(scored.select("uri", "score"), roots, steps, beam_width, edges)
        if enable_logging and self.log_path:
            records.append(self.spark, self.log_path, [records.record(query, session_id(), [r["uri"] for r in best.select("uri").collect()], top_k)])
        return best, found

    def preview_node_connections(self, vector: Sequence[float], query: str, top_k: int = 10, threshold: float | None = 0.5, exclude: str | None = None, doc_penalty: float = 0.0) -> DataFrame:
        """The links a new block with this vector and text would get."""
        clusters = cluster.hybrid(self.embeddings)

        def score(near: DataFrame) -> DataFrame:
            return ranking.scored(self.blocks.join(F.broadcast(near), "uri"), query, self.model, doc_penalty)  # near: at most top_k rows

        return enrich.preview(vector, self.embeddings, clusters, score, top_k, threshold, exclude)

    def add_node(self, block: dict[str, str], vector: Sequence[float], threshold: float = 0.9, top_k: int = 5, path: str | None = None) -> DataFrame:
        """The edges of the new block, which the graph has from now on; the graph is saved if a path is given."""
        text = "\n".join(filter(None, (block["name"], block.get("description"), block["code"])))
        links = self.preview_node_connections(vector, text, top_k, threshold, block["uri"])
        self.graph, edges = enrich.enrich(self.graph, block, links)
        if path:
            turtle.save(self.graph, path)
        return edges

    def analyze_query_patterns(self, min_confidence: float = 0.1, window: int = 5, apply: bool = False) -> DataFrame:
        """Suggested edges of the log. If they are applied the graph has them, and the log is archived where any was new."""
        found = cooccur.analyze(records.read_log(self.spark, self.log_path), window).where(F.col("confidence") >= min_confidence)
        if apply:
            graph, added = cooccur.apply(found, self.graph, min_confidence)
            rows = found.collect()  # at most 19: each has over a twentieth of all pairs
            found = self.spark.createDataFrame(rows, found.schema)
            if added.count():
                self.graph = graph
                records.archive(self.spark, self.log_path)
        return found

    def get_node_details(self, identifier: str) -> DataFrame:
        return blocks.by_identifier(self.graph, identifier)

    def list_graph_statistics(self) -> DataFrame:
        return blocks.statistics(self.graph)

    def search_by_name(self, name: str, exact: bool = False, limit: int = 10) -> DataFrame:
        return blocks.by_name(self.blocks, name, exact, limit)

    def search_by_vector(self, query: str | Sequence[float], top_k: int = 10) -> DataFrame:
        """The nearest blocks by the vectors that were handed in, else by those of name, description and code."""
        vector = self.encode([query])[0] if isinstance(query, str) else query
        if self._told is None:
            if not self.encode:
                raise ValueError("there are neither embeddings nor an encoder")
            self._told = ranking.embedded(self.blocks, self.encode, passages=False)
        return cluster.nearest(self._told, vector, top_k)

    def search_by_code_term(self, term: str, case_sensitive: bool = True, limit: int = 20) -> DataFrame:
        return blocks.by_term(self.blocks, term, not case_sensitive, limit)
