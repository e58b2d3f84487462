"""The registered queries: each applies an operator to the tables at hand, with the SQL that says the same.

Analogues: documents are code blocks, embeddings their vectors, events a query log, the star schema
an entity graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions import scoring, text, vectors
from weftgraph.operators import blocks, cluster, community, cooccur, dataset, enrich, extract, triples
from weftgraph.plans import beam, ranking, walk

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        REGISTRY[name or f.__name__] = (f, sql)
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- the star schema as a graph --------------------------------------------------------------------


def star(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers and suppliers as typed, labelled nodes with links to where they are."""
    c = F.col
    out = []
    for name, key, label, up, upkey, link in (("region", "r_regionkey", "r_name", None, None, None), ("nation", "n_nationkey", "n_name", "region", "n_regionkey", "inRegion"), ("customer", "c_custkey", "c_name", "nation", "c_nationkey", "inNation"), ("supplier", "s_suppkey", "s_name", "nation", "s_nationkey", "inNation")):
        df = table(spark, d, name)
        s = F.concat(F.lit(f"{vocab.KG}{name}/"), c(key).cast("string"))
        out += [triples.triples(df, s, vocab.TYPE, F.lit(f"{vocab.KG}{name.title()}"), "uri"), triples.triples(df, s, vocab.LABEL, c(label))]
        if up:
            out.append(triples.triples(df, s, vocab.KG + link, F.concat(F.lit(f"{vocab.KG}{up}/"), c(upkey).cast("string")), "uri"))
    out.append(triples.triples(table(spark, d, "customer"), F.concat(F.lit(vocab.KG + "customer/"), c("c_custkey").cast("string")), vocab.KG + "segment", c("c_mktsegment")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def _star_sql() -> str:
    k, parts = vocab.KG, []
    for name, key, label, up, upkey, link in (("region", "r_regionkey", "r_name", "", "", ""), ("nation", "n_nationkey", "n_name", "region", "n_regionkey", "inRegion"), ("customer", "c_custkey", "c_name", "nation", "c_nationkey", "inNation"), ("supplier", "s_suppkey", "s_name", "nation", "s_nationkey", "inNation")):
        s = f"'{k}{name}/' || {key}"
        parts += [f"SELECT {s} AS s, '{vocab.TYPE}' AS p, '{k}{name.title()}' AS o, 'uri' AS o_kind FROM {name}", f"SELECT {s}, '{vocab.LABEL}', {label}, 'literal' FROM {name}"]
        if up:
            parts.append(f"SELECT {s}, '{k}{link}', '{k}{up}/' || {upkey}, 'uri' FROM {name}")
    parts.append(f"SELECT '{k}customer/' || c_custkey, '{k}segment', c_mktsegment, 'literal' FROM customer")
    return "star AS (" + " UNION ALL ".join(parts) + ")"


STAR = f"WITH {_star_sql()} "
KGN = vocab.KG


@register(STAR + "SELECT s, p, o, o_kind FROM star")
def triples_from_star(spark, d):
    return star(spark, d).select("s", "p", "o", "o_kind")


@register(STAR + f"SELECT s, o FROM star WHERE p = '{KGN}inNation' AND o = '{KGN}nation/3'")
def triple_pattern(spark, d):
    return triples.match(star(spark, d), p=KGN + "inNation", o=KGN + "nation/3").select("s", "o")


@register(STAR + f"SELECT p, o, o_kind FROM star WHERE s = '{KGN}customer/7' AND p NOT IN ('{vocab.TYPE}', '{vocab.LABEL}')")
def neighbors(spark, d):
    return triples.neighbors(star(spark, d), KGN + "customer/7")


@register(STAR + f"""SELECT n.s AS uri, n.label, n.region, r.o AS region_name FROM
 (SELECT s, min(o) FILTER (p = '{vocab.LABEL}') AS label, min(o) FILTER (p = '{KGN}inRegion') AS region FROM star GROUP BY s) n
 LEFT JOIN (SELECT s, o FROM star WHERE p = '{vocab.LABEL}') r ON r.s = n.region WHERE n.label <> '' AND n.region <> ''""")
def block_view_pivot(spark, d):
    g = star(spark, d)
    wide = blocks.complete(blocks.pivot(g, {"label": vocab.LABEL, "region": KGN + "inRegion"}), ["label", "region"])
    named = triples.labels(g).toDF("region", "region_name")
    return wide.join(named, "region", "left").select(F.col("s").alias("uri"), "label", "region", "region_name")


@register(STAR + f"""SELECT t.o, coalesce(l.label, regexp_extract(t.o, '[^/#]*$')) AS label, count(*) AS n FROM star t
 LEFT JOIN (SELECT s, min(o) AS label FROM star WHERE p = '{vocab.LABEL}' GROUP BY s) l ON l.s = t.o WHERE t.o_kind = 'uri' GROUP BY ALL""")
def label_fallback(spark, d):
    g = star(spark, d)
    return triples.labelled(g.where("o_kind = 'uri'"), g, "o", "label").groupBy("o", "label").agg(F.count("*").alias("n"))


@register(STAR + "SELECT s, regexp_extract(p, '[^/]*$') AS key, max(o) AS value FROM star GROUP BY ALL")
def node_property_bag(spark, d):
    return triples.properties(star(spark, d))


@register(STAR + f""", hit AS (SELECT DISTINCT s FROM star WHERE contains(s, 'GERM') OR (p = '{vocab.LABEL}' AND contains(lower(o), 'germ')) OR contains(s, 'customer/7') ORDER BY s LIMIT 40)
 SELECT s, CASE WHEN p = '{vocab.LABEL}' THEN 'name' ELSE regexp_extract(p, '[^/]*$') END AS key, max(o) AS value FROM star JOIN hit USING (s) GROUP BY ALL""")
def node_lookup(spark, d):
    g = star(spark, d).withColumn("p", F.when(F.col("p") == vocab.LABEL, vocab.TW + "name").otherwise(F.col("p")))
    return blocks.by_identifier(g, "customer/7", 40).select("s", F.explode("bag").alias("key", "value"))


@register("""SELECT 'n/' || n_nationkey AS uri, n_name AS label, (contains(lower(n_name), 'united')::INT + contains(lower(n_name), 'an')::INT + (contains('n/' || n_nationkey, '1'))::INT * 0) AS hits FROM nation
 WHERE contains(lower(n_name), 'united') OR contains(lower(n_name), 'an')
 UNION ALL SELECT 'p/' || p_partkey, p_name, contains(lower(p_name), 'united')::INT + contains(lower(p_name), 'an')::INT FROM part WHERE contains(lower(p_name), 'united') OR contains(lower(p_name), 'an')""")
def find_nodes_scored(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("uri"), F.col("n_name").alias("label"))
    p = table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("label"))
    return triples.find(n.unionByName(p), "United a an")


@register(STAR + f""", new AS (SELECT s, '{vocab.LABEL}' AS p, lower(o) AS o, 'literal' AS o_kind FROM star WHERE p = '{vocab.LABEL}' AND s LIKE '%/nation/%')
 SELECT s, p, o, o_kind FROM star WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.s = star.s AND new.p = star.p) UNION SELECT s, p, o, o_kind FROM new""")
def triple_upsert(spark, d):
    g = star(spark, d)
    new = g.where((F.col("p") == vocab.LABEL) & F.col("s").like("%/nation/%")).withColumn("o", F.lower("o"))
    return triples.put(g, new).select("s", "p", "o", "o_kind")


@register(STAR + f"SELECT s, p, o, o_kind FROM star EXCEPT SELECT s, p, o, o_kind FROM star WHERE p = '{KGN}segment' AND o = 'BUILDING'")
def triple_delete(spark, d):
    g = star(spark, d)
    return triples.delete(g, g.where((F.col("p") == KGN + "segment") & (F.col("o") == "BUILDING"))).select("s", "p", "o", "o_kind")


@register(STAR + "SELECT count(*) AS n FROM (SELECT s, p, o FROM star UNION SELECT s, p, o FROM star)")
def triple_insert_is_a_set(spark, d):
    g = star(spark, d)
    return triples.union(g, g).agg(F.count("*").alias("n"))


@register(STAR + """SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM star GROUP BY p""")
def sparql_style_query(spark, d):
    return triples.KnowledgeGraph(star(spark, d)).query("SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM triples GROUP BY p")


@register("SELECT 3::BIGINT AS classes, 12::BIGINT AS properties, 47::BIGINT AS triples")
def ontology_counts(spark, d):
    return triples.ontology_counts(triples.ontology(spark))


# -- blocks ----------------------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the columns of blocks."""
    c = F.col
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), c("doc_id").cast("string")).alias("uri"), F.concat(F.lit("file/"), c("source")).alias("file_path"), F.concat_ws(" ", c("lang"), c("source"), (c("doc_id") % 7).cast("string")).alias("name"),
        F.when(c("doc_id") % 10 == 0, "documentation").otherwise("section").alias("kind"), c("lang").alias("language"), c("source").alias("version"), F.lit("").alias("description"), c("text").alias("code"), "doc_id",
    )


DOCS = """WITH docs AS (SELECT 'doc/' || doc_id AS uri, 'file/' || source AS file_path, lang || ' ' || source || ' ' || (doc_id % 7) AS name,
 CASE WHEN doc_id % 10 = 0 THEN 'documentation' ELSE 'section' END AS kind, lang AS language, source AS version, '' AS description, text AS code, doc_id FROM documents) """
HEADER = "'Block ' || name || ' (' || kind || ') located in ' || file_path || ' for ' || language || ' / ' || version || '.'"


@register(DOCS + r"SELECT uri, len(regexp_extract_all(code, '\bthe\b'))::INT AS occurrences FROM docs WHERE len(regexp_extract_all(code, '\bthe\b')) > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def code_term_search(spark, d):
    return blocks.by_term(documents(spark, d), "the").select("uri", "occurrences")


@register(DOCS + r"""SELECT uri, i::INT AS line, trim(lines[i]) AS text FROM (SELECT uri, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT uri, string_split(code, chr(10)) AS lines FROM docs)) WHERE regexp_matches(lines[i], '\bde\b')""")
def code_term_lines(spark, d):
    return documents(spark, d).select("uri", F.explode(text.term_lines(F.col("code"), "de")).alias("x")).select("uri", "x.*")


@register("SELECT p_partkey, p_name FROM part WHERE lower(p_name) = lower((SELECT min(p_name) FROM part))")
def name_search_exact(spark, d):
    df = table(spark, d, "part")
    first = df.agg(F.min("p_name")).first()[0]
    return blocks.by_name(df, first, exact=True, limit=None, name="p_name", key="p_partkey").select("p_partkey", "p_name")


@register("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_name, p_partkey LIMIT 10")
def name_search_substring(spark, d):
    return blocks.by_name(table(spark, d, "part"), "An", name="p_name", key="p_partkey").select("p_partkey", "p_name")


@register(DOCS + "SELECT kind, count(*) AS n FROM docs GROUP BY kind")
def kind_histogram(spark, d):
    return blocks.kind_histogram(documents(spark, d))


def doc_graph(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a code graph; documents that share an id are the blocks of one file."""
    file = Window.partitionBy(text.slug_dataset(F.col("language")), text.slug_dataset(F.col("version")), "uri").orderBy("language", "version", F.xxhash64("code"))
    index = (F.row_number().over(file) - 1).alias("index")
    df = documents(spark, d).select("language", "version", F.col("uri").alias("path"), index, "name", "kind", "code")
    return extract.graph(df)


@register(DOCS + """SELECT count(*) AS n_blocks, 0::BIGINT AS n_related, count(DISTINCT language)::INT AS n_languages, count(DISTINCT language || '/' || version)::INT AS n_versions, count(DISTINCT kind)::INT AS n_kinds FROM docs""")
def graph_statistics(spark, d):
    s = blocks.statistics(doc_graph(spark, d))
    return s.select("n_blocks", "n_related", F.size("languages").alias("n_languages"), F.size("versions").alias("n_versions"), F.size("kinds").alias("n_kinds"))


@register(DOCS + "SELECT uri AS file_path, name, kind, language, language || ' ' || version AS version, code FROM docs")
def block_view_from_graph(spark, d):
    return blocks.blocks(doc_graph(spark, d)).select("file_path", "name", "kind", "language", "version", "code")


@register(DOCS + f"SELECT uri, sha1({HEADER} || chr(10) || chr(10) || 'Code:' || chr(10) || code) AS passage_sha1 FROM docs")
def passage_text(spark, d):
    return blocks.with_passage(documents(spark, d)).select("uri", F.sha1(F.col("passage").cast("binary")).alias("passage_sha1"))


@register(DOCS + """, s AS (SELECT uri, (contains(lower(p), 'the')::INT + contains(lower(p), 'section')::INT + contains(lower(p), 'une')::INT)::DOUBLE / 3 - CASE WHEN kind = 'documentation' THEN 1.5 ELSE 0 END AS score FROM
 (SELECT uri, kind, """ + HEADER + """ || chr(10) || chr(10) || 'Code:' || chr(10) || code AS p FROM docs)) SELECT uri, round(score, 6) AS score FROM s ORDER BY s.score DESC, uri LIMIT 25""")
def search_code(spark, d):
    return ranking.ranked(documents(spark, d), "une section the", 25, penalty=1.5).select("uri", F.round("score", 6).alias("score"))


@register("""SELECT doc_id, b.i::INT AS index, CASE WHEN b.n = 0 THEN 'file' ELSE 'section-' || (b.i + 1) END AS name, sha1(b.code) AS code_sha1 FROM
 (SELECT doc_id, len(parts) AS n, CASE WHEN len(parts) = 0 THEN [text] ELSE parts END AS codes, unnest(range(0, greatest(1, len(parts)))) AS i, codes[i + 1] AS code FROM
 (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)) b""".replace("\\\\", "\\"))
def generic_blocks(spark, d):
    return extract.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "index", "name", F.sha1(F.col("code").cast("binary")).alias("code_sha1"))


# -- scalar functions ------------------------------------------------------------------------------


@register("SELECT p_partkey, lower(coalesce(nullif(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g'), '_'), ''), 'resource')) AS slug FROM part")
def slug_concept(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug_concept(F.col("p_name")).alias("slug"))


@register("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'node') AS slug FROM part")
def slug_code(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug_code(F.col("p_type")).alias("slug"))


@register("SELECT p_partkey, lower(coalesce(nullif(trim(regexp_replace(p_brand || ' é/' || p_name, '[^\\p{L}\\p{N}]', '-', 'g'), '-'), ''), 'resource')) AS slug FROM part")
def slug_dataset(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug_dataset(F.concat_ws(" é/", "p_brand", "p_name")).alias("slug"))


@register(f"SELECT p_partkey, '{KGN}' || lower(regexp_replace(p_brand, '[^a-zA-Z0-9]+', '_', 'g')) AS uri, lower(regexp_replace(p_brand, '[^a-zA-Z0-9]+', '_', 'g')) AS local_name FROM part")
def to_uri(spark, d):
    uri = text.to_uri(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", uri.alias("uri"), text.local_name(uri).alias("local_name"))


@register("SELECT doc_id, 'b/file/' || lang || '/' || source || '/' || sha1(source || '/' || doc_id) AS file_uri, 'b/codeblock/' || lang || '/' || source || '/' || sha1(source || '/' || doc_id || '::3') AS block_uri FROM documents")
def uri_sha1(spark, d):
    path, c = F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col
    return table(spark, d, "documents").select("doc_id", text.file_uri("b/", c("lang"), c("source"), path).alias("file_uri"), text.block_uri("b/", c("lang"), c("source"), path, F.lit(3)).alias("block_uri"))


@register("SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE left(text, 897) || '...' END AS clipped FROM documents")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clip(F.col("text")).alias("clipped"))


@register("SELECT doc_id, round(n_chars / 1000.0::DOUBLE - CASE WHEN doc_id % 10 = 0 THEN 1.5 ELSE 0 END, 6) AS score FROM documents")
def doc_penalty(spark, d):
    df = documents(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return df.select("doc_id", F.round(scoring.penalised(F.col("n_chars") / 1000.0, F.col("kind"), F.col("name"), 1.5), 6).alias("score"))


def _cases(table_: tuple, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in tokens) + f" THEN '{value}'" for value, tokens in table_)
    return f"CASE {whens} ELSE '{default}' END"


#: What is put before and after the turns of conversations, by number, so that each action, intention and kind of entry is met.
BEFORE = ("Por favor SALVAR ", "Atualizar: ", "qual o estado Corrente de ", "Historical check of ", "planejar ", "", "Ingest the plan of ", "substituir ")
AFTER = (' de "API nova" e "rota/é 1"', " na rota /sessão_2/x-y e rota /ação", " da API versão2, api\tbeta e FuncaoÇa", " em Functional /a/b /a/b", "", " /ção", " route /über function_é", ' "" e " "')


def asked(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)).cast("int")
    of = lambda x: F.get(F.array(*map(F.lit, x)), n)
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(of(BEFORE), F.left("text", F.lit(60)), of(AFTER)).alias("text"))


def _asked_sql() -> str:
    of = lambda x: "[" + ", ".join("'" + y.replace("'", "''") + "'" for y in x) + "][((conv_id + turn) % 8)::INT + 1]"
    return f"WITH asked AS (SELECT conv_id, turn, {of(BEFORE)} || left(text, 60) || {of(AFTER)} AS text FROM conversations) "


@register(_asked_sql() + f"SELECT conv_id, turn, {_cases(text.ACTIONS, 'recuperar')} AS acao, {_cases(text.INTENTIONS, 'Desconhecida')} AS intencao FROM asked")
def intent_detect(spark, d):
    return asked(spark, d).select("conv_id", "turn", text.action(F.col("text")).alias("acao"), text.intention(F.col("text")).alias("intencao"))


@register(_asked_sql() + r"""SELECT conv_id, turn, array_to_string(CASE WHEN len(q) > 0 THEN q WHEN len(e) > 0 THEN e ELSE [text] END, '|') AS entries FROM
 (SELECT conv_id, turn, text, regexp_extract_all(text, '"([^"]+)"', 1) AS q, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(list_transform(list_concat(regexp_extract_all(text, '/[\pL\pM\pN_][\pL\pM\pN_\-/]*'), regexp_extract_all(text, '(?i)(?:API\s+[\pL\pM\pN_]+|Funcao[\pL\pM\pN_]*|Function[\pL\pM\pN_]*|rota\s+/[\pL\pM\pN_]+|route\s+/[\pL\pM\pN_]+)')), lambda x: trim(x)), lambda x: x <> ''), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS e FROM asked)""")
def entry_extract(spark, d):
    return asked(spark, d).select("conv_id", "turn", F.array_join(text.entries(F.col("text")), "|").alias("entries"))


@register("""WITH t AS (SELECT doc_id, 'x CAFÉ' || doc_id || ' café, Café. caféx ' || left(text, 40) || ' über' AS code FROM documents)
 SELECT doc_id, 2::BIGINT AS any_case, 1::BIGINT AS same_case, (regexp_matches(left(code, 0), '$'))::INT::BIGINT AS shown FROM t""")
def accented_term_search(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("x CAFÉ"), F.col("doc_id").cast("string"), F.lit(" café, Café. caféx "), F.left("text", F.lit(40)), F.lit(" über")).alias("code"))
    every = blocks.by_term(rows, "café", True, None, key="doc_id", shown=1).select("doc_id", F.col("occurrences").cast("long").alias("any_case"), F.size("lines").cast("long").alias("shown"))
    same = blocks.by_term(rows, "café", False, None, key="doc_id").select("doc_id", F.col("occurrences").cast("long").alias("same_case"))
    return every.join(same, "doc_id")


@register("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS intent FROM part")
def intent_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.intent_tokens(F.col("p_type")), " ").alias("intent"))


@register("SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS probability, round(tanh(value / 100), 9) AS squashed FROM events WHERE 1 / (1 + exp(-value / 100)) >= 0.55")
def link_probability(spark, d):
    scored = table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("uri"), (F.col("value") / 100).alias("score"))
    return enrich.probabilities(scored, 0.55).select("event_id", F.round("probability", 9).alias("probability"), F.round(F.tanh("score"), 9).alias("squashed"))


@register(STAR + f"""SELECT s, o, CASE p WHEN '{KGN}inRegion' THEN -0.9::DOUBLE WHEN '{KGN}inNation' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS historical,
 CASE p WHEN '{KGN}inRegion' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS current FROM star WHERE p NOT IN ('{vocab.TYPE}', '{vocab.LABEL}')""")
def predicate_adjustment(spark, d):
    told = F.when(F.col("p").endswith("/inRegion"), KGN + "replaced_by").when(F.col("p").endswith("/inNation"), KGN + "has_route_to").otherwise(F.col("p"))
    edges = triples.edges(star(spark, d)).withColumn("p", told)
    adjust = lambda intention, query: scoring.predicate_adjustment(F.col("p"), intention, query)
    return edges.select("s", "o", adjust("Historica", "which route").alias("historical"), adjust("ImplementacaoAtual", "which way").alias("current"))


@register()
def difflib_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(scoring.similarity(F.lit("small polished brass"), F.col("p_type")), 6).alias("ratio"))


# -- vectors ---------------------------------------------------------------------------------------


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("uri"), "embedding", F.col("label").alias("cluster"))


def first_vector(spark: SparkSession, d: str) -> list[float]:
    df = table(spark, d, "embeddings")
    return list(df.where(F.col("vec_id") == df.agg(F.min("vec_id")).first()[0]).first()["embedding"])


VQ = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1), e AS (SELECT vec_id::VARCHAR AS uri, embedding::DOUBLE[] AS v, label AS cluster FROM embeddings) "
MEANS = VQ + ", c AS (SELECT cluster, list(x ORDER BY i) AS m FROM (SELECT cluster, i, avg(v[i]) AS x FROM (SELECT cluster, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY cluster, i) GROUP BY cluster) "
BORDERS = MEANS + ", b AS (SELECT * FROM (SELECT e.cluster, uri, c.cluster AS other, list_cosine_similarity(v, m) AS sim, row_number() OVER (PARTITION BY e.cluster ORDER BY list_cosine_similarity(v, m), uri, c.cluster) AS rank FROM e JOIN c ON e.cluster <> c.cluster) WHERE rank <= 3) "


@register(VQ + "SELECT uri, round(list_cosine_similarity(e.v, q.v), 6) AS similarity FROM e, q ORDER BY list_cosine_similarity(e.v, q.v) DESC, uri LIMIT 10")
def vector_topk(spark, d):
    return cluster.nearest(vecs(spark, d), first_vector(spark, d)).select("uri", F.round("similarity", 6).alias("similarity"))


@register(MEANS + "SELECT cluster, i::INT AS pos, round(m[i + 1], 6) AS x FROM (SELECT cluster, m, unnest(range(0, len(m))) AS i FROM c)")
def centroid_mean(spark, d):
    v = vecs(spark, d)
    return cluster.centroids(v.drop("cluster"), v.select("uri", "cluster")).select("cluster", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@register(MEANS + "SELECT cluster FROM c, q ORDER BY list_cosine_similarity(m, v) DESC, cluster LIMIT 1")
def assign_cluster(spark, d):
    v = vecs(spark, d)
    return cluster.assign(first_vector(spark, d), cluster.centroids(v.drop("cluster"), v.select("uri", "cluster")))


def _borders(v: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    flat, held = v.drop("cluster"), v.select("uri", "cluster")
    return flat, held, cluster.borders(flat, held, cluster.centroids(flat, held))


@register(BORDERS + "SELECT cluster, rank::INT AS rank, uri, other, round(sim, 6) AS similarity FROM b")
def border_nodes(spark, d):
    return _borders(vecs(spark, d))[2].withColumn("similarity", F.round("similarity", 6))


@register(BORDERS + """, own AS (SELECT cluster FROM c, q ORDER BY list_cosine_similarity(m, v) DESC, cluster LIMIT 1), pool AS (SELECT uri FROM e WHERE cluster = (SELECT cluster FROM own) UNION ALL SELECT uri FROM b WHERE cluster <> (SELECT cluster FROM own))
 SELECT uri, round(s, 6) AS similarity FROM (SELECT pool.uri, list_cosine_similarity(e.v, q.v) AS s FROM pool JOIN e USING (uri), q) ORDER BY s DESC, uri LIMIT 10""")
def select_candidates(spark, d):
    flat, held, border = _borders(vecs(spark, d))
    q = first_vector(spark, d)
    own = cluster.assign(q, cluster.centroids(flat, held)).first()[0]
    return cluster.candidates(q, flat, held, border, own).withColumn("similarity", F.round("similarity", 6))


@register()
def kmeans_clusters(spark, d):
    return cluster.hybrid(vecs(spark, d).drop("cluster")).groupBy("cluster").agg(F.count("*").alias("n"))


# -- query logs ------------------------------------------------------------------------------------


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.array("event_type").alias("result_uris"), "ts", "event_id")


PAIRS = """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 pairs AS (SELECT a.event_type AS source_uri, b.event_type AS target_uri, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND b.n BETWEEN a.n + 1 AND a.n + 5 WHERE a.event_type <> b.event_type GROUP BY ALL),
 best AS (SELECT source_uri, target_uri, n, n::DOUBLE / (SELECT sum(n) FROM pairs) AS c FROM pairs) """
ORDER = ("ts", "event_id")


@register(PAIRS + "SELECT * FROM pairs")
def cooccurrence_pairs(spark, d):
    return cooccur.pairs(log(spark, d), order=ORDER)


@register(PAIRS + "SELECT source_uri, target_uri, n, round(c, 9) AS confidence FROM best WHERE n >= 3 AND c > 0.05")
def cooccurrence_suggestions(spark, d):
    return cooccur.suggestions(cooccur.pairs(log(spark, d), order=ORDER)).withColumn("confidence", F.round("confidence", 9))


@register(PAIRS + "SELECT (SELECT count(DISTINCT user_id) FROM events) AS sessions, (SELECT count(*) FROM events) AS queries, (SELECT sum(n) FROM pairs)::BIGINT AS pairs, (SELECT count(*) FROM best WHERE n >= 3 AND c > 0.05) AS suggestions")
def log_summary(spark, d):
    return cooccur.summary(log(spark, d), order=ORDER).select("sessions", "queries", "pairs", "suggestions")


@register(PAIRS + f"SELECT source_uri AS s, '{vocab.TW}relatedTo' AS p, target_uri AS o, round(c, 9) AS confidence FROM best WHERE n >= 3 AND c > 0.05 AND c >= 0.051 AND NOT (source_uri = 'view' AND target_uri = 'click')")
def new_edges_antijoin(spark, d):
    known = triples.rows(spark, [("view", vocab.TW + "relatedTo", "click", "uri")])
    found = cooccur.suggestions(cooccur.pairs(log(spark, d), order=ORDER))
    return cooccur.new_edges(found, known, 0.051).select("s", "p", "o", F.round("confidence", 9).alias("confidence"))


@register(PAIRS + f"SELECT count(*) AS n FROM (SELECT 1 FROM best WHERE n >= 3 AND c > 0.05 UNION ALL SELECT 1 FROM (SELECT DISTINCT source_uri, c FROM best WHERE n >= 3 AND c > 0.05))")
def apply_suggestions(spark, d):
    found = cooccur.suggestions(cooccur.pairs(log(spark, d), order=ORDER))
    return cooccur.apply(found, triples.empty(spark), 0.05)[0].agg(F.count("*").alias("n"))


# -- walks -----------------------------------------------------------------------------------------


def by_length(edges: DataFrame, query: str, intention: str) -> DataFrame:
    """An edge scorer that engines without difflib can follow."""
    return edges.withColumn("score", F.char_length("text") / 100.0 - F.when(F.col("on_path"), 0.25).otherwise(0.0))


@register(STAR + f""", l AS (SELECT s, min(o) AS label FROM star WHERE p = '{vocab.LABEL}' GROUP BY s),
 e AS (SELECT t.s, t.p, t.o, t.o_kind, CASE WHEN t.o_kind = 'literal' THEN t.o ELSE coalesce(l.label, regexp_extract(t.o, '[^/#]*$')) END AS text FROM star t LEFT JOIN l ON l.s = t.o WHERE t.p NOT IN ('{vocab.TYPE}', '{vocab.LABEL}')),
 b AS (SELECT * FROM (SELECT *, length(text) / 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY s ORDER BY length(text) DESC, o, p) AS n FROM e) WHERE n = 1),
 w1 AS (SELECT l.s AS entry_node, 0 AS step, b.p, b.o, b.o_kind, b.score FROM l JOIN b ON b.s = l.s),
 w2 AS (SELECT w1.entry_node, 1 AS step, b.p, b.o, b.o_kind, b.score FROM w1 JOIN b ON b.s = w1.o AND w1.o_kind = 'uri'),
 w3 AS (SELECT w2.entry_node, 2 AS step, b.p, b.o, b.o_kind, b.score FROM w2 JOIN b ON b.s = w2.o AND w2.o_kind = 'uri')
 SELECT entry_node, step, p AS predicate_uri, o AS "to", round(score, 6) AS score FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)""")
def greedy_walk(spark, d):
    g = star(spark, d)
    walked = walk.walk(g, triples.labels(g), "", "", scorer=by_length)
    return walked.select("entry_node", F.posexplode("path").alias("step", "x")).select("entry_node", "step", "x.predicate_uri", F.col("x.to").alias("to"), F.round("x.score", 6).alias("score"))


@register()
def heuristic_walk(spark, d):
    g = star(spark, d)
    return walk.walk(g, triples.labels(g), "which nation is the route to ASIA", "Historica").select("entry_node", F.size("path").alias("steps"), F.round(F.get("path", F.lit(0))["score"], 6).alias("first_score"))


BEAM = """WITH s AS (SELECT 'p/' || p_partkey AS uri, p_size::DOUBLE AS score FROM part), top AS (SELECT * FROM s ORDER BY score DESC, uri LIMIT 6),
 p0 AS (SELECT [uri] AS path, score AS ps FROM s ORDER BY uri LIMIT 3),
 x1 AS (SELECT list_append(path, uri) AS path, ps + score AS ps, uri, score FROM p0, top WHERE NOT list_contains(path, uri)), p1 AS (SELECT path, ps FROM x1 ORDER BY ps DESC, path LIMIT 3),
 x2 AS (SELECT list_append(path, uri) AS path, ps + score AS ps, uri, score FROM p1, top WHERE NOT list_contains(path, uri)), p2 AS (SELECT path, ps FROM x2 ORDER BY ps DESC, path LIMIT 3) """


def _beam(spark, d):
    scores = table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_size").cast("double").alias("score"))
    first = scores.orderBy("uri").limit(3).collect()
    roots = spark.createDataFrame([(r["uri"], i) for i, r in enumerate(first)], "uri string, rank int")
    return beam.search(scores, roots, 2, 3)


@register(BEAM + "SELECT level, array_to_string(path, ',') AS path, ps AS path_score FROM (SELECT 0 AS level, * FROM p0 UNION ALL SELECT 1, * FROM p1 UNION ALL SELECT 2, * FROM p2)")
def beam_search_paths(spark, d):
    return _beam(spark, d).paths.select("level", F.array_join("path", ",").alias("path"), "path_score")


@register(BEAM + """SELECT level, rank::INT AS rank, uri, score, path_score FROM (SELECT level, uri, score, path_score, row_number() OVER (PARTITION BY level ORDER BY path_score DESC, uri) AS rank FROM
 (SELECT 1 AS level, uri, score, max(ps) AS path_score FROM x1 GROUP BY uri, score UNION ALL SELECT 2, uri, score, max(ps) FROM x2 GROUP BY uri, score)) WHERE rank <= 3""")
def beam_levels(spark, d):
    return _beam(spark, d).levels


@register(BEAM + ", best AS (SELECT path FROM p2 ORDER BY ps DESC, path LIMIT 1) SELECT i::INT AS position, path[i + 1] AS uri, s.score FROM (SELECT path, unnest(range(0, len(path))) AS i FROM best) JOIN s ON s.uri = path[i + 1]")
def beam_best_path(spark, d):
    return _beam(spark, d).best


# -- training data ---------------------------------------------------------------------------------


def _clip_sql(x: str) -> str:
    return f"CASE WHEN length({x}) <= 900 THEN {x} ELSE left({x}, 897) || '...' END"


ANSWER = _clip_sql(f"({HEADER} || chr(10) || chr(10) || 'Code:' || chr(10) || code)")
INTENT = "array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''), ' ')"


@register(DOCS + f""", q AS (SELECT uri, {INTENT} AS intent, language, version, {ANSWER} AS answer FROM docs)
 SELECT uri, 0 AS n, 'In the ' || language || ' project (' || version || '), which code block handles ' || intent || '?' AS query, sha1(answer) AS answer_sha1 FROM q
 UNION ALL SELECT uri, 1, 'Which part of the ' || language || ' ' || version || ' project implements ' || intent || '?', sha1(answer) FROM q
 UNION ALL SELECT uri, 2, 'Where can I find the implementation of ' || intent || ' in the ' || language || ' project (' || version || ')?', sha1(answer) FROM q""")
def qa_pairs(spark, d):
    return dataset.pairs(documents(spark, d)).select("uri", "n", "query", F.sha1(F.col("answer").cast("binary")).alias("answer_sha1"))


@register(DOCS + f""", q AS (SELECT uri, language, {ANSWER} AS answer, md5('13/' || uri) AS draw FROM docs)
 SELECT uri, sha1(answer) AS positive_sha1, sha1(coalesce(lead(answer) OVER (PARTITION BY language ORDER BY draw, uri), first_value(answer) OVER (PARTITION BY language ORDER BY draw, uri))) AS negative_sha1 FROM q""")
def triplet_negatives(spark, d):
    sha = lambda c: F.sha1(F.col(c).cast("binary")).alias(f"{c}_sha1")
    return dataset.triplets(documents(spark, d)).select("uri", sha("positive"), sha("negative"))


@register()
def triplets_from_pairs(spark, d):
    pairs = dataset.pairs(documents(spark, d)).select("query", "answer")
    return dataset.triplets_from_pairs(pairs).select("anchor", (F.col("positive") == F.col("negative")).alias("same"))


@register(DOCS + "SELECT uri, lower(language) AS language FROM docs")
def answer_language(spark, d):
    return documents(spark, d).select("uri", text.answer_language(dataset.answer()).alias("language"))


#: A class with two methods, a program with three paragraphs, a unit with two routines, a text with two sections; # is the document's number.
SOURCES = (
    ("java", 'public class C# {\n  public int m#(int a) { return "}".length() + a; }\n  static void helper() { }\n}\n'),
    ("cob", "       IDENTIFICATION DIVISION.\nPROGRAM-ID. X#.\nMAIN-#.\n    DISPLAY 1.\nEND-#.\n    STOP RUN.\n"),
    ("pas", "unit U;\nprocedure P#;\nbegin\n  x := 1;\nend;\nfunction F#: Integer;\nbegin\n  if x then begin y; end;\nend;\n"),
    ("txt", "first #\n \n\nsecond\nline"),
)


def sources(spark: SparkSession, d: str) -> DataFrame:
    number, of = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(len(SOURCES))).cast("int")
    pick = lambda i: F.get(F.array(*(F.lit(x[i]) for x in SOURCES)), of)
    return table(spark, d, "documents").select(F.concat(F.lit("src/"), number, F.lit("."), pick(0)).alias("path"), F.concat(F.replace(pick(1), F.lit("#"), number)).alias("text"))


BLOCKS = (
    ("java", "C#", "class", 'public class C# {\n  public int m#(int a) { return "}".length() + a; }\n  static void helper() { }\n}'), ("java", "m#", "method", '  public int m#(int a) { return "}".length() + a; }'), ("java", "helper", "method", "  static void helper() { }"),
    ("cob", "PROGRAM-ID", "paragraph", "PROGRAM-ID. X#."), ("cob", "MAIN-#", "paragraph", "MAIN-#.\n    DISPLAY 1."), ("cob", "END-#", "paragraph", "END-#.\n    STOP RUN."),
    ("pas", "P#", "procedure", "procedure P#;\nbegin\n  x := 1;\nend;"), ("pas", "F#", "function", "function F#: Integer;\nbegin\n  if x then begin y; end;\nend;"),
    ("txt", "section-1", "section", "first #"), ("txt", "section-2", "section", "second\nline"),
)


def _blocks_sql() -> str:
    quoted = lambda x: "replace('" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '#', doc_id::VARCHAR)"
    parts, seen = [], {}
    for suffix, name, kind, code in BLOCKS:
        n = seen[suffix] = seen.get(suffix, -1) + 1
        of = [x[0] for x in SOURCES].index(suffix)
        parts.append(f"SELECT 'src/' || doc_id || '.{suffix}' AS path, {n} AS index, {quoted(name)} AS name, '{kind}' AS kind, sha1({quoted(code).replace('replace(', 'replace(', 1)}) AS code_sha1 FROM documents WHERE doc_id % {len(SOURCES)} = {of}")
    return " UNION ALL ".join(parts)


@register(_blocks_sql())
def source_blocks(spark, d):
    return extract.blocks(sources(spark, d)).select("path", "index", "name", "kind", F.sha1(F.col("code").cast("binary")).alias("code_sha1"))


@register()
def louvain(spark, d):
    """Communities of suppliers and parts by what is ordered of whom: two levels, three sweeps each."""
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return community.louvain(edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), rounds=3, levels=2)


@register(STAR + f"""SELECT n.o AS name, count(*) AS customers FROM star t JOIN star n ON n.s = t.o AND n.p = '{vocab.LABEL}' JOIN star r ON r.s = t.o AND r.p = '{KGN}inRegion'
 WHERE t.p = '{KGN}inNation' AND t.s LIKE '%/customer/%' AND n.o <> 'GERMANY' GROUP BY 1""")
def sparql_join(spark, d):
    found = triples.KnowledgeGraph(star(spark, d)).query(f"""PREFIX k: <{vocab.KG}> PREFIX rdfs: <{vocab.RDFS}>
 SELECT ?c ?name WHERE {{ ?c k:inNation ?n ; a k:Customer . ?n rdfs:label ?name ; k:inRegion ?r . FILTER(?name != "GERMANY") }}""")
    return found.groupBy("name").agg(F.count("*").alias("customers"))


@register(STAR + f"""SELECT DISTINCT t.s, g.o AS segment FROM (SELECT DISTINCT s FROM star WHERE p = '{vocab.LABEL}' AND (contains(lower(o), '00') OR regexp_matches(o, '^GER'))) t
 LEFT JOIN star g ON g.s = t.s AND g.p = '{KGN}segment'""")
def sparql_optional(spark, d):
    return triples.KnowledgeGraph(star(spark, d)).query(f"""PREFIX k: <{vocab.KG}> PREFIX rdfs: <{vocab.RDFS}>
 SELECT DISTINCT ?s ?segment WHERE {{ ?s rdfs:label ?l . OPTIONAL {{ ?s k:segment ?segment }} FILTER(CONTAINS(LCASE(?l), "00") || REGEX(?l, "^GER")) }}""")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
