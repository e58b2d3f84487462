"""SPARQL over a small graph, the graph handle's batches, and the neural edge scorer."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions import scoring
from weftgraph.operators import triples
from weftgraph.plans import sparql

P = f"PREFIX k: <{vocab.KG}> PREFIX rdfs: <{vocab.RDFS}> "


@pytest.fixture(scope="module")
def kg(spark):
    kg = triples.demo(spark)
    return kg


@pytest.mark.parametrize(
    ("query", "rows"),
    [
        ("SELECT ?l WHERE { ?x rdfs:label ?l ; k:is_a_type_of k:apifunction . }", [("API v1",), ("API v2",)]),
        ('SELECT ?x WHERE { ?x rdfs:label "route /session" }', [(vocab.KG + "route_session",)]),
        ("SELECT ?a ?c WHERE { ?a k:replaced_by ?b . OPTIONAL { ?b k:has_route ?c } }", [(vocab.KG + "api_v1", None)]),
        ('SELECT DISTINCT ?l WHERE { ?x a k:Concept ; rdfs:label ?l FILTER(REGEX(?l, "^api", "i") && !CONTAINS(?l, "v1")) } ORDER BY DESC(?l)', [("API v2",), ("API Function",)]),
        ("SELECT ?l { ?x rdfs:label ?l } ORDER BY ?l LIMIT 1 OFFSET 1", [("API v1",)]),
        ("SELECT ?d WHERE { ?x k:documented_in ?d . ?y k:has_route ?x . ?y k:replaced_by ?z FILTER(?z != k:api_v1 || BOUND(?d)) }", [("doc_api_v1.md",)]),
        ("SELECT * WHERE { k:nothing k:at ?all }", []),
    ],
)
def test_select(kg, query, rows):
    got = [tuple(r) for r in kg.query(P + query).collect()]
    assert (got if "ORDER" in query else sorted(got, key=str)) == rows


@pytest.mark.parametrize("query", ["SELECT ?x WHERE { ?x z:y ?z }", "SELECT ?x WHERE { ?x a ", "SELECT ?x WHERE { }", "SELECT ?x WHERE { ?x a ?y } GROUP BY ?x"])
def test_what_is_not_understood_is_refused(kg, query):
    with pytest.raises(ValueError):
        kg.query(query)


def test_sql_still_works(kg):
    assert not sparql.is_sparql("SELECT p, count(*) FROM triples") and kg.query("SELECT count(*) AS n FROM triples").first()["n"] == 13


def test_changes_are_one_batch(spark):
    kg = triples.KnowledgeGraph(triples.rows(spark, [("http://a", vocab.LABEL, "old"), ("http://a", "http://p", "x")]))
    for i in range(30):
        kg.add_edge("http://a", "has", f"node {i}")
    kg.set_label("http://a", "first")
    kg.set_label("http://a", "second")
    kg.remove_edge("http://a", "http://p", "x")
    kg.remove_edge("http://a", "has", "node 3", obj_is_literal=False)
    kg.add_edge("http://a", "has", "node 3")
    assert kg.get_label("http://a") == "second"
    got = {(r["p"], r["o"]) for r in kg.get_triples().where("s = 'http://a'").collect()}
    assert got == {(vocab.LABEL, "second"), (vocab.TYPE, vocab.KG + "Concept")} | {(vocab.KG + "has", f"{vocab.KG}node_{i}") for i in range(30)}
    kg.remove_edge("http://a", "has", "node 4", obj_is_literal=False)
    assert kg.graph.where("s = 'http://a'").count() == 31


def test_the_penalty_is_inside_the_squashing(spark):
    edges = spark.createDataFrame([("p", "t", "f", b) for b in (True, False)], "p string, text string, from_text string, on_path boolean")
    got = {r["on_path"]: r["score"] for r in scoring.cross_encoder(lambda pairs: [0.7] * len(pairs))(edges, "q", "i").select("on_path", F.col("score")).collect()}
    assert abs(got[False] - math.tanh(0.7)) < 1e-9 and abs(got[True] - math.tanh(0.45)) < 1e-9
