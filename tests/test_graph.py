"""Graph operators against goldens and plain Python versions."""

import itertools
import random
from collections import Counter
from difflib import SequenceMatcher
from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions import scoring, text
from weftgraph.operators import blocks, cluster, community, cooccur, dataset, enrich, extract, triples
from weftgraph.plans import beam, ranking, walk
from weftgraph.plans.service import Service
from weftgraph.queries import queries
from weftgraph.sources import turtle

KG = vocab.KG


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# -- triples -----------------------------------------------------------------------------------------


def test_concepts_and_edges(spark):
    kg = triples.KnowledgeGraph(triples.empty(spark))
    kg.add_edge("API v1", "HAS_ROUTE", "/session")
    kg.add_edge("API v1", "HAS_ROUTE", "/session")
    kg.add_edge("API v1", "DOC", "file.md", obj_is_literal=True)
    assert kg.get_triples().count() == 4
    assert {tuple(r) for r in kg.neighbors("API v1").collect()} == {(KG + "has_route", KG + "session", "uri"), (KG + "doc", "file.md", "literal")}
    kg.set_label("API v1", "first")
    kg.set_label("API v1", "second")
    assert kg.get_label("API v1") == "second"
    kg.remove_edge("API v1", "HAS_ROUTE", KG + "session")  # a plain object is a literal: nothing goes
    assert kg.neighbors("API v1").count() == 2
    kg.remove_edge("API v1", "HAS_ROUTE", "/session", obj_is_literal=False)
    assert kg.neighbors("API v1").count() == 1
    kg.clear()
    assert kg.get_triples().count() == 0


def test_demo_graph_and_search(spark):
    kg = triples.demo(spark)
    assert kg.get_triples().count() == 13
    hits = [(r["uri"], r["hits"]) for r in kg.find_nodes("API v1").collect()]
    assert hits == [(KG + "api_v1", 2), (KG + "api_v2", 1), (KG + "apifunction", 1)]
    assert kg.query("SELECT count(*) AS n FROM triples").first()["n"] == 13


def test_demo_walk(spark):
    found = walk.retrieve(triples.demo(spark).graph, "Historical check: did API v1 include the /session route?").collect()
    paths = {r["entry_node"].removeprefix(KG): [(s["to"].removeprefix(KG), round(s["score"], 6)) for s in r["path"]] for r in found}
    assert paths["api_v1"] == [("route_session", 0.614286), ("doc_api_v1.md", 0.231884)]
    assert paths["route_session"] == [("doc_api_v1.md", 0.231884)]
    assert paths["api_v2"] == [("apifunction", 0.294118)] and paths["apifunction"] == []


def test_walk_stops_where_it_has_been(spark):
    g = triples.rows(spark, [("a", "p", "b", "uri"), ("b", "p", "a", "uri"), ("c", "q", "gone", "uri"), ("d", "q", "zz", "literal")])
    entries = spark.createDataFrame([(x, x) for x in "abcd"], "uri string, label string")
    flat = lambda e, q, i: e.withColumn("score", F.when(F.col("o") == "gone", -0.9).otherwise(0.5))
    got = {r["entry_node"]: [s["to"] for s in r["path"]] for r in walk.walk(g, entries, "", "", scorer=flat).collect()}
    assert got == {"a": ["b", "a"], "b": ["a", "b"], "c": [], "d": ["zz"]}


def test_instructions(spark):
    told = walk.instruction(spark, 'Store "API v3" and "API v4"').first()
    assert (told["acao"], told["entradas"], told["intencao"]) == ("guardar", ["API v3", "API v4"], "Desconhecida")
    told = walk.instruction(spark, "Historical check: did API v1 include the /session route?").first()
    assert (told["acao"], told["entradas"], told["intencao"]) == ("recuperar", ["/session", "API v1"], "Historica")
    assert one(spark, text.intention(F.lit("atualizar tudo"))) == "ImplementacaoAtual"
    kg = triples.demo(spark)
    assert walk.handle(kg, walk.instruction(spark, 'update "API v2" "API v3"').first()) == KG + "api_v3"
    assert walk.handle(kg, walk.instruction(spark, 'update "API v2"').first()) is None
    assert kg.get_triples().where(F.col("p").endswith("replaced_by")).count() == 2


def test_scores(spark):
    assert scoring.ratio("abc", "") == -0.5
    a, b = "Historical check", "API v1"
    assert scoring.ratio(a, b) == SequenceMatcher(a=a.lower(), b=b.lower()).ratio()
    adjust = lambda p, i, q: one(spark, scoring.predicate_adjustment(F.lit(KG + p), i, q))
    assert adjust("replaced_by", "Historica", "") == -0.9 and adjust("replaced_by", "ImplementacaoAtual", "") == 0.2
    assert adjust("has_route", "x", "a Route") == 0.3 and adjust("has_route", "x", "other") == 0.0
    assert scoring.scorer("cross-encoder") is scoring.heuristic
    judge = scoring.scorer("cross-encoder", lambda pairs: [float(len(b)) / 1000 for _, b in pairs])
    df = spark.createDataFrame([("from", "p", "to", True)], "from_text string, p string, text string, on_path boolean")
    assert judge(df, "q", "i").first()["score"] < 0


# -- names and texts ---------------------------------------------------------------------------------


def test_names(spark):
    assert one(spark, text.slug_concept(F.lit(" API v1! "))) == "api_v1" and one(spark, text.slug_concept(F.lit("é"))) == "resource"
    assert one(spark, text.slug_code(F.lit("Foo.Bar  baz"))) == "foo-bar-baz" and one(spark, text.slug_code(F.lit("!"), "new-node")) == "new-node"
    assert one(spark, text.slug_dataset(F.lit("Aé..b."))) == "aé--b"
    assert one(spark, text.local_name(F.lit("http://x/y#z/w"))) == "w"
    assert one(spark, text.file_uri("b/", F.lit("cobol"), F.lit("v1"), F.lit("cobol\\v1\\library-basic.cob"))) == "b/file/cobol/v1/e17ba39cb5fc5304b3a6ef36a4bcd82f5ea1c5a3"
    assert len(one(spark, text.clip(F.lit("x" * 901)))) == 900 and one(spark, text.clip(F.lit("x" * 900))) == "x" * 900
    assert one(spark, text.answer_language(F.lit("Block for x (f) located in a for Java / v1."))) == "x (f) located in a for java"
    assert one(spark, text.answer_language(F.lit("nothing"))) == "unknown"
    assert one(spark, F.regexp_count(F.lit("a.b aXb a.b."), F.lit(text.term_pattern("a.b")))) == 2


# -- extraction --------------------------------------------------------------------------------------

JAVA = """package x;
public class Shop {
    private int n;
    public int add(int a) { String s = "}"; if (a > 0) { n += a; } return n; }
    static void none() throws Exception { }
}
interface Other { }
"""
COBOL = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. LIB.\n       DATA DIVISION.\n       MAIN-LOOP.\n           PERFORM X.\n       ADD-BOOK.\n           STOP RUN.\n"
DELPHI = "unit U;\nprocedure T.Go(a: Integer);\nbegin\n  if a then begin\n  x;\n  end;\nend;\nfunction F: Integer;\nbegin\nend;\n"


def test_extractors():
    assert [b[:2] for b in extract.extract(JAVA, "a/Shop.java")] == [("Shop", "class"), ("add", "method"), ("none", "method")]
    assert extract.extract(JAVA, "Shop.java")[1][2].strip() == 'public int add(int a) { String s = "}"; if (a > 0) { n += a; } return n; }'
    assert extract.extract("interface Other { }", "a.java") == [("file", "file", "interface Other { }")]
    assert [b[0] for b in extract.extract(COBOL, "a.cob")] == ["PROGRAM-ID", "MAIN-LOOP", "ADD-BOOK"]
    assert [b[:2] for b in extract.extract(DELPHI, "a.pas")] == [("T.Go", "procedure"), ("F", "function")]
    assert extract.extract(DELPHI, "a.pas")[0][2].endswith("end;\nend;")
    assert extract.extract("one\n\n two \n \nthree", "a.txt") == [("section-1", "section", "one"), ("section-2", "section", "two"), ("section-3", "section", "three")]
    assert extract.extract("", "a.txt") == [("file", "file", "")]


def test_a_source_tree_becomes_a_graph(spark, tmp_path):
    from weftgraph.sources import tree

    for path, body in {"java/v1/a/Shop.java": JAVA.encode(), "cobol/v1/lib.cob": COBOL.encode(), "delphi/v2/u.txt": "caf\xe9\n\nx".encode("latin-1")}.items():
        (tmp_path / path).parent.mkdir(parents=True)
        (tmp_path / path).write_bytes(body)
    found = extract.blocks(tree.files(spark, str(tmp_path)))
    assert found.count() == 8
    g = extract.graph(found)
    view = blocks.blocks(g)
    assert view.count() == 8 and {r["version"] for r in view.collect()} == {"java v1", "cobol v1", "delphi v2"}
    assert view.where("name = 'section-1'").first()["code"] == "café"
    stats = blocks.statistics(g).first()
    assert stats["n_blocks"] == 8 and stats["languages"] == ["cobol", "delphi", "java"] and stats["kinds"][0]["n"] == 3
    back = turtle.read(spark, _written(g, tmp_path))
    assert back.exceptAll(g).count() == g.exceptAll(back).count() == 0


def _written(g, tmp_path):
    turtle.write(g, str(tmp_path / "ttl"))
    return str(tmp_path / "ttl")


TURTLE = '''@prefix kg: <http://example.org/kg/> . # comment
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
kg:a a kg:Concept ; kg:says "one", """two
"lines" \\\\ here"""@en ; kg:w "0.5"^^xsd:double, 3, 1.5 .
<http://x/b> kg:of kg:a ; .
'''


def test_turtle(spark, tmp_path):
    got = list(turtle.parse(TURTLE))
    assert len(got) == 7 and (KG + "a", KG + "says", 'two\n"lines" \\ here', "literal", None, "en") in got
    assert (KG + "a", KG + "w", "0.5", "literal", vocab.XSD + "double", None) in got
    (tmp_path / "bad.ttl").write_text("kg:a kg:b 'x")
    assert turtle.read(spark, str(tmp_path / "bad.ttl"), strict=False).count() == 0
    with pytest.raises(Exception, match="no Turtle"):
        turtle.read(spark, str(tmp_path / "bad.ttl")).count()
    turtle.save(triples.demo(spark).graph, str(tmp_path / "native"))
    assert turtle.load(spark, str(tmp_path / "native")).count() == 13
    assert triples.ontology_counts(triples.ontology(spark)).first()[:] == (3, 12, 47)


# -- searches ----------------------------------------------------------------------------------------


def code_graph(spark):
    files = spark.createDataFrame([("java", "v1", "Shop.java", JAVA), ("cobol", "v1", "lib.cob", COBOL)], "language string, version string, path string, text string")
    return extract.graph(extract.blocks(files))


def test_service(spark, tmp_path):
    g = code_graph(spark)
    encode = lambda texts: [[float(len(t) % 7), float(t.count("e")), 1.0] for t in texts]
    s = Service(g, log_path=str(tmp_path / "log"), encode=encode)
    best, found = s.search_code("class Shop", top_k=2, steps=2, beam_width=2, enable_logging=True)
    assert best.first()["name"] == "Shop" and found.best.count() == 3
    assert s.search_by_name("BOOK").first()["name"] == "ADD-BOOK" and s.search_by_name("add", exact=True).count() == 1
    assert s.search_by_code_term("perform").count() == 0 and s.search_by_code_term("perform", case_sensitive=False).first()["lines"][0]["line"] == 2
    assert s.search_by_vector("class", 3).count() == 3 and s.list_graph_statistics().first()["n_blocks"] == 6
    assert any(r["bag"].get("name") == "ADD-BOOK" for r in s.get_node_details("add-book").collect())
    uri, file = enrich.new_block_uris(spark, "New Block")
    block = {"uri": uri, "file_uri": file, "file_path": "new.java", "name": "New Block", "kind": "class", "language": "Java", "version": "Shop v1", "code": "class Shop", "description": ""}
    edges = s.add_node(block, encode(["class Shop"])[0], threshold=0.5, top_k=3, path=str(tmp_path / "saved"))
    assert 0 < edges.count() <= 3 and blocks.blocks(s.graph).count() == 7
    assert turtle.load(spark, str(tmp_path / "saved")).count() == s.graph.count()
    assert s.analyze_query_patterns().count() == 0


def test_blocks_need_all_their_links(spark):
    g = code_graph(spark)
    assert blocks.blocks(g.where(~F.col("p").endswith("belongsToLanguage"))).count() == 0
    empty = g.withColumn("o", F.when(F.col("p").endswith("/name"), "").otherwise(F.col("o")))
    assert blocks.blocks(empty).count() == 0


def test_ranking_with_a_model(spark):
    view = blocks.blocks(code_graph(spark))
    model = lambda pairs: [float(len(p)) for _, p in pairs]
    got = ranking.ranked(view, "q", 3, model)
    assert got.first()["name"] == "Shop" and ranking.ranked(view, "q", None, model).count() == 6
    assert ranking.embedded(view, lambda texts: [[1.0, 2.0] for _ in texts]).first()["embedding"] == [1.0, 2.0]
    told = view.limit(1).select(F.lit("u").alias("uri"), F.lit("n").alias("name"), F.explode(F.array(F.lit("d"), F.lit(""), F.lit(None))).alias("description"), F.lit("co").alias("code"))
    assert sorted(r["embedding"][0] for r in ranking.embedded(told, lambda texts: [[float(len(t))] for t in texts], passages=False).collect()) == [4.0, 4.0, 6.0]


def brute_beam(scores, roots, steps, width):
    paths = [([r], scores[r]) for r in roots[:width]]
    held, levels = [(0, *p) for p in paths], []
    for level in range(1, steps + 1):
        grown = [(p + [n], s + scores[n]) for p, s in paths for n in scores if n not in p]
        if not grown:
            break
        last = {}
        for p, s in grown:
            last[p[-1]] = max(s, last.get(p[-1], s))
        levels += [(level, i + 1, n, scores[n], s) for i, (n, s) in enumerate(sorted(last.items(), key=lambda x: (-x[1], x[0]))[:width])]
        paths = sorted(grown, key=lambda x: (-x[1], x[0]))[: max(width, 1)]
        held += [(level, *p) for p in paths]
    best = min(held, key=lambda x: (x[0] != steps, -x[2], x[0], x[1]), default=None)
    return [n for n in best[1]] if best else [], levels


@pytest.mark.parametrize("seed", range(4))
def test_beam_search(spark, seed):
    rng = random.Random(seed)
    scores = {f"n{i}": float(rng.randint(-3, 3)) for i in range(rng.randint(2, 9))}
    steps, width = rng.randint(1, 3), rng.randint(1, 3)
    roots = sorted(scores, key=lambda n: (-scores[n], n))[:3]
    df = spark.createDataFrame(list(scores.items()), "uri string, score double")
    found = beam.search(df, spark.createDataFrame([(r, i) for i, r in enumerate(roots)], "uri string, rank int"), steps, width)
    path, levels = brute_beam(scores, roots, steps, width)
    assert [r["uri"] for r in found.best.collect()] == path and sorted(map(tuple, found.levels.collect())) == sorted(levels)
    pairs = [(a, b) for a, b in itertools.permutations(scores, 2)]
    given = beam.search(df, spark.createDataFrame([(r, i) for i, r in enumerate(roots)], "uri string, rank int"), steps, width, spark.createDataFrame(pairs, "src string, dst string"))
    assert [r["uri"] for r in given.best.collect()] == path


# -- clusters ----------------------------------------------------------------------------------------


def test_clusters(spark):
    rows = [(f"a{i}", [1.0, i / 100]) for i in range(5)] + [(f"b{i}", [-1.0, i / 100]) for i in range(5)] + [(f"c{i}", [0.0, 5.0 + i / 100]) for i in range(5)]
    v = spark.createDataFrame(rows, "uri string, embedding array<double>")
    held = cluster.hybrid(v)
    groups = {}
    for r in held.collect():
        groups.setdefault(r["cluster"], set()).add(r["uri"][0])
    assert sorted(map(tuple, groups.values())) == [("a",), ("b",), ("c",)]
    means = cluster.centroids(v, held)
    own = cluster.assign([1.0, 0.0], means).first()[0]
    assert groups[own] == {"a"} and cluster.assign([1.0, 0.0], means.limit(0)).first()[0] == -1
    border = cluster.borders(v, held, means)
    assert border.groupBy("cluster").count().where("count <> 3").count() == 0
    near = cluster.candidates([1.0, 0.0], v, held, border, own, 20)
    assert near.where("uri like 'a%'").count() == 5 and near.count() == 5 + 6
    two = spark.createDataFrame([(u, u[0] < "b") for u, _ in rows], "uri string, community boolean")
    assert cluster.hybrid(v, two).select("cluster").distinct().count() == 6


def test_communities(spark):
    ring = [(f"{g}{i}", f"{g}{(i + 1) % 5}") for g in "ab" for i in range(5)] + [(f"{g}{i}", f"{g}{(i + 2) % 5}") for g in "ab" for i in range(5)] + [("a0", "b0")]
    got = {}
    for r in community.louvain(spark.createDataFrame(ring, "src string, dst string"), rounds=6).collect():
        got.setdefault(r["community"], set()).add(r["uri"][0])
    assert all(len(v) == 1 for v in got.values()) and len(got) <= 6
    nodes = spark.createDataFrame([("b",), ("a",)], "uri string")
    assert {r["community"] for r in community.single(nodes).collect()} == {"a"}


def test_a_node_of_many_neighbours_is_summed_up_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame([("hub", f"n{i}", 1.0) for i in range(20)] + [(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}", 2.0) for _ in range(25)], "src string, dst string, weight double")
    of = lambda: sorted(map(tuple, community.louvain(edges, rounds=2, levels=2).collect()))
    whole = of()
    assert len(whole) == 21 and {c for _, c in whole} <= {u for u, _ in whole} and all(c == min(u for u, d in whole if d == c) for _, c in whole)
    monkeypatch.setattr(community, "PART", 3)
    assert of() == whole
    kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert not list(kept.glob("stored-*"))  # what was written on the way is gone


# -- query logs --------------------------------------------------------------------------------------


def log(spark, sessions):
    return spark.createDataFrame([(float(i), "q", s, r, 5) for s, results in sessions.items() for i, r in enumerate(results)], vocab.QUERY_LOG)


def test_cooccurrence(spark):
    one_ = [["A"], ["B"], ["A"], ["B"], ["A", "A"]]
    assert cooccur.analyze(log(spark, {"s1": one_}), window=1).count() == 0
    got = cooccur.analyze(log(spark, {"s1": one_, "s2": one_}), window=1).collect()
    assert [(r["source_uri"], r["target_uri"], r["n"], r["confidence"]) for r in got] == [("A", "B", 4, 0.5), ("B", "A", 4, 0.5)]
    told = cooccur.summary(log(spark, {"s1": one_, "s2": one_}), 1).first()
    assert (told["sessions"], told["queries"], told["pairs"], told["suggestions"], len(told["top"])) == (2, 10, 8, 2, 2)
    g, added = cooccur.apply(cooccur.analyze(log(spark, {"s1": one_, "s2": one_}), 1), triples.rows(spark, [("A", vocab.TW + "relatedTo", "B", "uri")]))
    assert added.count() == 1 and g.count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_cooccurrence_of_random_logs(spark, seed):
    rng = random.Random(seed)
    sessions = {f"s{i}": [[rng.choice("ABCD") for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 7))] for i in range(5)}
    w, want = rng.randint(1, 4), Counter()
    for results in sessions.values():
        for i, a in enumerate(results):
            for b in results[i + 1 : i + 1 + w]:
                want.update((x, y) for x in set(a) for y in set(b) if x != y)
    got = {(r["source_uri"], r["target_uri"]): r["n"] for r in cooccur.pairs(log(spark, sessions), w).collect()}
    assert got == dict(want)


# -- training data -----------------------------------------------------------------------------------


def test_training_data(spark):
    view = blocks.blocks(code_graph(spark))
    pairs = dataset.pairs(view, 2)
    assert pairs.count() == 12 and pairs.where("query like '%add book%'").count() == 2
    assert dataset.pairs(view.withColumn("name", F.lit("**")), 4).first()["query"].startswith("Where is the ** block defined")
    got = dataset.triplets(view).collect()
    assert len(got) == 6 and all(r["negative"] != r["positive"] for r in got)
    language = lambda a: a.split(" for ")[1].split(" /")[0]
    assert all(language(r["negative"]) == language(r["positive"]) for r in got)
    alone = pairs.select("query", "answer").where("answer like '%cobol%' or answer like '%Block Shop%'").where("query like 'In the%'")
    got = dataset.triplets_from_pairs(alone).collect()
    assert len(got) == 4 and all(r["positive"] != r["negative"] for r in got)
    with pytest.raises(ValueError):
        dataset.triplets_from_pairs(alone.limit(1))


def test_negatives_of_a_large_language_are_no_single_task(spark):
    rows = [(f"u{i}", "many" if i < 600 else "few" if i < 602 else None if i < 605 else "one", f"code {i}") for i in range(606)]
    view = spark.createDataFrame(rows, "uri string, language string, code string").withColumns({"name": F.lit("n"), "kind": F.lit("k"), "file_path": F.lit("f"), "version": F.lit("v")})
    pairs = dataset.pairs(view.where("language is not null"), 1).select("query", "answer")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for got, seeded in ((dataset.triplets(view), lambda r: r["uri"]), (dataset.triplets_from_pairs(pairs), lambda r: f"{r['anchor']}/{r['positive']}")):
            held = got.withColumn("task", F.spark_partition_id()).collect()
            assert max(Counter(r["task"] for r in held).values()) < 400
            many = sorted((r for r in held if "for many /" in (r["positive"] or "")), key=lambda r: md5(f"13/{seeded(r)}".encode()).hexdigest())
            assert len(many) == 600 and [r["negative"] for r in many] == [r["positive"] for r in many[1:] + many[:1]]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    few = [r for r in dataset.triplets(view).collect() if "for few /" in (r["positive"] or "")]
    assert len(few) == 2 and few[0]["negative"] == few[1]["positive"] and few[1]["negative"] == few[0]["positive"]
    assert [r["negative"] for r in dataset.triplets_from_pairs(pairs).collect() if "for one /" in r["positive"]] != [None]


def test_documents_that_share_an_id_are_all_blocks(spark, tmp_path):
    rows = [(1, "one", "en", "a"), (1, "two", "en", "a"), (1, "two", "en", "a"), (1, "one", "fr", "a"), (2, "three", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["block_view_from_graph"](spark, str(tmp_path)).select("file_path", "language", "version", "code").collect()
    assert Counter(map(tuple, got)) == Counter((f"doc/{i}", lang, f"{lang} {source}", text_) for i, text_, lang, source in rows)
    assert queries()["graph_statistics"](spark, str(tmp_path)).first()["n_blocks"] == 5


def test_command_line(spark, tmp_path, capsys):
    from weftgraph import cli

    (tmp_path / "p/java/v1").mkdir(parents=True)
    (tmp_path / "p/java/v1/Shop.java").write_text(JAVA)
    run = lambda *args: cli.main([str(a) for a in args], spark)
    run("build", "--projects", tmp_path / "p", "--output", tmp_path / "g")
    run("search", "--graph", tmp_path / "g", "--query", "class shop", "--steps", 1)
    run("pairs", "--graph", tmp_path / "g", "--output", tmp_path / "pairs", "--per-block", 2)
    assert "Shop" in capsys.readouterr().out and spark.read.json(str(tmp_path / "pairs")).count() == 6
    run("init", "--output", tmp_path / "new")
    with pytest.raises(Exception, match="exist"):
        run("init", "--output", tmp_path / "new")
