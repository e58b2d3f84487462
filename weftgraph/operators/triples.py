"""The triple store: DataFrames of triples with set semantics.

A graph is a DataFrame of vocab.TRIPLES. Nothing is changed in place: each operation gives a new
plan, unions and anti-joins that Spark can run over a graph of any size.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions.text import local_name, to_uri, token_hits

COLUMNS = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


def triples(df: DataFrame, s: Column, p: Column | str, o: Column, kind: str = "literal", datatype: str | None = None) -> DataFrame:
    """Rows of `df` as triples of one predicate."""
    predicate = F.lit(p) if isinstance(p, str) else p
    return df.select(s.alias("s"), predicate.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))


def rows(spark: SparkSession, values: list[tuple]) -> DataFrame:
    """Triples from (s, p, o) or (s, p, o, kind[, datatype[, lang]]) tuples."""
    return spark.createDataFrame([tuple([*v, *("literal", None, None)[len(v) - 3 :]]) for v in values], vocab.TRIPLES)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], vocab.TRIPLES)


def union(*graphs: DataFrame) -> DataFrame:
    """Insert: the union without repeated triples."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates(COLUMNS)


def match(graph: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the bound terms."""
    bound = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    return graph.where(reduce(lambda a, b: a & b, bound)) if bound else graph


def delete(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the triples of `gone`; terms with null parts are compared too."""
    same = reduce(lambda a, b: a & b, (graph[c].eqNullSafe(gone[c]) for c in COLUMNS))
    return graph.join(gone, same, "left_anti")


def put(graph: DataFrame, values: DataFrame) -> DataFrame:
    """Upsert of single-valued properties: new values replace all old ones of the same subject and predicate."""
    return union(graph.join(values.select("s", "p").distinct(), ["s", "p"], "left_anti").select(COLUMNS), values)


def missing(candidates: DataFrame, graph: DataFrame) -> DataFrame:
    """Candidates (s, p, o) that the graph doesn't have."""
    return candidates.join(graph.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def edges(graph: DataFrame) -> DataFrame:
    """All triples but types and labels."""
    return graph.where(~F.col("p").isin(vocab.TYPE, vocab.LABEL))


def neighbors(graph: DataFrame, node: str) -> DataFrame:
    """Outgoing (p, o, o_kind) of one node."""
    return edges(graph).where(F.col("s") == node).select("p", "o", "o_kind")


def labels(graph: DataFrame) -> DataFrame:
    """(uri, label); of several labels the least."""
    return graph.where((F.col("p") == vocab.LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label"))


def labelled(df: DataFrame, graph: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the label of the node in `column`, its local name where it has none."""
    named = labels(graph).withColumnsRenamed({"uri": "__uri", "label": "__label"})
    joined = df.join(named, F.col(column) == F.col("__uri"), "left")
    return joined.withColumn(out, F.coalesce("__label", local_name(F.col(column)))).drop("__uri", "__label")


def nodes(graph: DataFrame) -> DataFrame:
    """(uri, label) of the concepts."""
    return graph.where((F.col("p") == vocab.TYPE) & (F.col("o") == vocab.KG + "Concept")).select(F.col("s").alias("uri")).distinct().join(labels(graph), "uri", "left")


def find(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes (uri, label) with the number of query tokens in label or URI, best first; none without a hit."""
    return nodes.withColumn("hits", token_hits(F.col("label"), F.col("uri"), query)).where("hits > 0").orderBy(F.desc("hits"), "uri")


def properties(graph: DataFrame) -> DataFrame:
    """(s, key, value): one value for each predicate, keyed by what follows its last '/'."""
    key = F.substring_index("p", "/", -1)
    return graph.groupBy("s", key.alias("key")).agg(F.max("o").alias("value"))


def property_bag(graph: DataFrame) -> DataFrame:
    """(s, bag): the properties of each node as a map."""
    return properties(graph).groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("bag"))


class KnowledgeGraph:
    """A concept graph by name. Changes are collected and applied as one batch when the graph is next read."""

    def __init__(self, graph: DataFrame, base: str = vocab.KG):
        self.base, self.spark = base, graph.sparkSession
        self.graph = graph

    @property
    def graph(self) -> DataFrame:
        """The triples with all changes so far."""
        if self._put or self._gone or self._new:
            held = self._held
            if self._put:
                held = held.join(F.broadcast(self.spark.createDataFrame(sorted(self._put), "s string, p string")), ["s", "p"], "left_anti").select(COLUMNS)
            if self._gone:
                held = delete(held, rows(self.spark, sorted(self._gone)))
            self.graph = union(held, rows(self.spark, list(self._new)))
        return self._held

    @graph.setter
    def graph(self, value: DataFrame) -> None:
        self._held = value
        # subjects and predicates whose old values go, triples that go, triples that come (in order)
        self._put, self._gone, self._new = set(), set(), {}

    def _insert(self, *new: tuple) -> None:
        for t in new:
            self._gone.discard(t)
            self._new[t] = None

    def _uri(self, value: str) -> str:
        """As `to_uri`, for one name, without a Spark job."""
        if value.startswith(("http://", "https://")):
            return value
        return self.base + (re.sub("[^a-zA-Z0-9]+", "_", value).strip("_") or "resource").lower()

    def ensure_node(self, node: str, label: str | None = None) -> str:
        """The node's URI; it is a concept from now on, with this label if one is given."""
        uri = self._uri(node)
        self._insert((uri, vocab.TYPE, vocab.KG + "Concept", "uri"))
        if label:
            self.set_label(uri, label)
        return uri

    def set_label(self, node: str, label: str) -> None:
        s = self._uri(node)
        self._put.add((s, vocab.LABEL))
        self._new = {t: None for t in self._new if t[:2] != (s, vocab.LABEL)}
        self._insert((s, vocab.LABEL, label, "literal"))

    def get_label(self, node: str) -> str | None:
        found = labels(self.graph).where(F.col("uri") == self._uri(node)).first()
        return found["label"] if found else None

    def add_edge(self, subject: str, predicate: str, obj: str, obj_is_literal: bool = False) -> tuple[str, str, str]:
        """Both ends become nodes, but for a literal; predicates are slugs."""
        s, p = self.ensure_node(subject), self._uri(predicate)
        o = obj if obj_is_literal else self.ensure_node(obj)
        self._insert((s, p, o, "literal" if obj_is_literal else "uri"))
        return s, p, o

    def remove_edge(self, subject: str, predicate: str, obj: str, obj_is_literal: bool = True) -> None:
        """A plain object is a literal by default."""
        s, p = self._uri(subject), self._uri(predicate)
        o = obj if obj_is_literal else self._uri(obj)
        gone = (s, p, o, "literal" if obj_is_literal else "uri")
        self._new.pop(gone, None)
        self._gone.add(gone)

    def neighbors(self, node: str) -> DataFrame:
        return neighbors(self.graph, self._uri(node))

    def find_nodes(self, query: str) -> DataFrame:
        return find(nodes(self.graph), query)

    def get_triples(self) -> DataFrame:
        return self.graph

    def clear(self) -> None:
        self.graph = empty(self.spark)

    def query(self, sql: str, view: str = "triples") -> DataFrame:
        """A SPARQL SELECT, or SQL over the graph, which is the view `triples`."""
        from weftgraph.plans import sparql

        if sparql.is_sparql(sql):
            return sparql.select(self.graph, sql)
        self.graph.createOrReplaceTempView(view)
        return self.spark.sql(sql)

    def store_concept(self, concept: str, label: str, parent: str | None = None, relation: str = "IS_A_TYPE_OF", properties: dict[str, str] | None = None, link_direction: str = "child_to_parent") -> str:
        """A concept with its link to a parent, in either direction, and literal properties."""
        uri = self.ensure_node(concept, label)
        if parent:
            ends = (concept, parent) if link_direction == "child_to_parent" else (parent, concept)
            self.add_edge(ends[0], relation, ends[1])
        for key, value in (properties or {}).items():
            self.add_edge(concept, key, value, obj_is_literal=True)
        return uri

    def update_concept(self, old: str, new: str, label: str | None = None, relation: str = "REPLACED_BY") -> str:
        """The new concept replaces the old one, of which nothing is deleted."""
        uri = self.ensure_node(new, label)
        self.add_edge(old, relation, new)
        return uri


def ontology(spark: SparkSession) -> DataFrame:
    """The vocabulary that an empty code graph begins with: classes, properties, languages."""
    classes = {"CodeBlock": "Code Block", "Language": "Programming Language", "Version": "Project Version"}
    # Properties with their comments, and the languages known from the start.
    comments = {
        "name": "Name of the code block", "description": "Natural language description", "code": "Source code content",
        "kind": "Type of code block (class, method, function, etc.)", "language": "Programming language name", "filePath": "Source file path",
        "belongsToLanguage": "Language this code belongs to", "belongsToVersion": "Version/project this code belongs to",
        "relatedTo": "Semantic relationship to another code block", "weight": "Edge weight (similarity score)",
        "label": "Human-readable label", "coOccurrenceWeight": "Co-occurrence confidence from query logs",
    }
    languages = ["Java", "Python", "JavaScript", "TypeScript", "C++", "C#", "Go", "Rust"]
    tw = vocab.TW
    out = [(tw + c, vocab.TYPE, vocab.RDFS + "Class", "uri") for c in classes] + [(tw + c, vocab.LABEL, text) for c, text in classes.items()]
    out.append((tw + "CodeBlock", vocab.COMMENT, "A block of source code (class, method, function, etc.)"))
    for name, comment in comments.items():
        out += [(tw + name, vocab.TYPE, vocab.RDF + "Property", "uri"), (tw + name, vocab.COMMENT, comment)]
    for name in languages:
        out += [(f"{tw}language_{name.lower()}", vocab.TYPE, tw + "Language", "uri"), (f"{tw}language_{name.lower()}", tw + "label", name)]
    return rows(spark, out)


def ontology_counts(graph: DataFrame) -> DataFrame:
    """One row: classes, properties, triples."""
    of = lambda c: F.count_if((F.col("p") == vocab.TYPE) & (F.col("o") == c))
    return graph.agg(of(vocab.RDFS + "Class").alias("classes"), of(vocab.RDF + "Property").alias("properties"), F.count("*").alias("triples"))


def demo(spark: SparkSession) -> KnowledgeGraph:
    """The small API graph on which the walk can be watched."""
    kg = KnowledgeGraph(empty(spark))
    kg.store_concept("ApiFunction", "API Function")
    for version in ("v1", "v2"):
        kg.store_concept(f"API_{version}", f"API {version}", parent="ApiFunction")
    kg.update_concept("API_v1", "API_v2")
    kg.store_concept("route_session", "route /session", parent="API_v1", relation="HAS_ROUTE", properties={"documented_in": "doc_api_v1.md"}, link_direction="parent_to_child")
    return kg


