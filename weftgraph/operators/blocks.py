"""Code blocks: the view over triples, its statistics, and the searches that need no model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions.text import passage, preview, term_lines, term_pattern

REQUIRED = ("name", "code", "belongsToFile", "belongsToVersion", "belongsToLanguage")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all there and not empty."""
    return df.where(" and ".join(f"`{c}` is not null and `{c}` <> ''" for c in columns))


def pivot(graph: DataFrame, predicates: dict[str, str], subjects: DataFrame | None = None) -> DataFrame:
    """(s, one column for each predicate): of several values the least. One aggregation, no joins."""
    picked = graph.where(F.col("p").isin(list(predicates.values())))
    if subjects is not None:
        picked = picked.join(subjects, "s", "left_semi")
    return picked.groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in predicates.items()))


def blocks(graph: DataFrame) -> DataFrame:
    """All code blocks that have a name, code, file, version and language; absent paths and labels are empty, the kind 'section'."""
    tw = vocab.TW
    typed = graph.where((F.col("p") == vocab.TYPE) & (F.col("o") == tw + "CodeBlock")).select("s")
    wide = pivot(graph, {c: tw + c for c in (*REQUIRED, "kind", "description")}, typed)
    wide = complete(wide, list(REQUIRED))
    named = lambda p, out: graph.where(F.col("p") == tw + p).groupBy("s").agg(F.min("o").alias(out))
    paths, langs, versions = named("path", "file_path"), named("label", "language"), named("label", "version")
    joined = (
        wide.withColumnRenamed("s", "uri")
        .join(paths.withColumnRenamed("s", "belongsToFile"), "belongsToFile", "left")
        .join(langs.withColumnRenamed("s", "belongsToLanguage"), "belongsToLanguage", "left")
        .join(versions.withColumnRenamed("s", "belongsToVersion"), "belongsToVersion", "left")
    )
    or_ = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return joined.select("uri", F.col("belongsToFile").alias("file_uri"), or_("file_path", ""), "name", or_("kind", "section"), or_("language", ""), or_("version", ""), "code", or_("description", ""))


def with_passage(df: DataFrame) -> DataFrame:
    cols = (F.col(c) for c in ("name", "kind", "file_path", "language", "version", "description", "code"))
    return df.withColumn("passage", passage(*cols))


def kind_histogram(df: DataFrame, kind: str = "kind") -> DataFrame:
    return df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def statistics(graph: DataFrame) -> DataFrame:
    """One row: blocks, related edges, languages, versions, and the kinds with their counts."""
    tw = vocab.TW
    block = graph.where((F.col("p") == vocab.TYPE) & (F.col("o") == tw + "CodeBlock")).select("s").distinct()
    label = graph.where(F.col("p") == tw + "label").select(F.col("s").alias("o"), F.col("o").alias("label"))

    def names(predicate: str, out: str) -> DataFrame:
        held = graph.where(F.col("p") == tw + predicate).join(block, "s", "left_semi").select("o").distinct()
        return held.join(label, "o", "left").agg(F.sort_array(F.collect_set("label")).alias(out))

    kinds = pivot(graph, {"kind": tw + "kind"}, block).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
    kinds = kinds.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "kind", "n"))).alias("k"))
    kinds = kinds.select(F.transform("k", lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("kinds"))
    counts = block.agg(F.count("*").alias("n_blocks")).crossJoin(graph.agg(F.count_if(F.col("p") == tw + "relatedTo").alias("n_related")))
    # each side is one row
    return counts.crossJoin(names("belongsToLanguage", "languages")).crossJoin(names("belongsToVersion", "versions")).crossJoin(kinds)


def by_name(df: DataFrame, query: str, exact: bool = False, limit: int | None = 10, name: str = "name", key: str = "uri") -> DataFrame:
    """Rows whose name is the query, or holds it, whatever the case."""
    low = F.lower(F.col(name))
    hit = df.where(low == query.lower() if exact else F.contains(low, F.lit(query.lower()))).orderBy(name, key)
    return hit if limit is None else hit.limit(max(limit, 1))


def by_identifier(graph: DataFrame, identifier: str, limit: int = 5) -> DataFrame:
    """(s, bag): nodes whose URI holds the identifier, or whose name does whatever the case, with their properties."""
    by_uri = F.contains("s", F.lit(identifier))
    name = (F.col("p") == vocab.TW + "name") & F.contains(F.lower("o"), F.lit(identifier.lower()))
    hit = graph.where(by_uri | name).select("s").distinct().orderBy("s").limit(limit)
    key = F.substring_index("p", "/", -1)
    held = graph.join(F.broadcast(hit), "s", "left_semi")  # at most `limit` rows
    return held.groupBy("s", key.alias("key")).agg(F.max("o").alias("value")).groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("bag"))


def by_term(df: DataFrame, term: str, ignore_case: bool = False, limit: int | None = 20, code: str = "code", key: str = "uri", shown: int = 5) -> DataFrame:
    """Rows whose code has the term as a whole word: occurrences, and the first lines with it."""
    found = F.regexp_count(F.col(code), F.lit(term_pattern(term, ignore_case)))
    hits = df.withColumn("occurrences", found).where("occurrences > 0")
    hits = hits.withColumn("lines", F.slice(term_lines(F.col(code), term, ignore_case), 1, shown)).orderBy(F.desc("occurrences"), key)
    return hits if limit is None else hits.limit(max(limit, 1))


def shown(df: DataFrame, column: str, n: int) -> DataFrame:
    """A column cut down for a report."""
    return df.withColumn(column, preview(F.col(column), n))
