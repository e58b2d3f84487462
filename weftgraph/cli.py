"""Command line: python -m weftgraph.cli COMMAND --graph PATH ...

Graphs are read from Turtle or from the native Parquet form, and written as Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators import blocks, dataset, extract, triples
from weftgraph.plans.service import Service
from weftgraph.session import session
from weftgraph.sources import records, tree, turtle


def graph(spark: SparkSession, path: str) -> DataFrame:
    return turtle.read(spark, path) if path.endswith((".ttl", ".rdf")) else turtle.load(spark, path)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftgraph")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, /, **options: tuple) -> None:
        c = commands.add_parser(name)
        for option, (kind, default) in options.items():
            flag = "--" + option.replace("_", "-")
            c.add_argument(flag, action="store_true") if kind is bool else c.add_argument(flag, type=kind, default=default, required=default is ...)

    here = {"graph": (str, ...)}
    command("search", **here, query=(str, ...), top_k=(int, 5), steps=(int, 0), beam_width=(int, 3), doc_penalty=(float, 1.5), enable_logging=(bool, False), log=(str, "queries.jsonl"))
    command("name", **here, name=(str, ...), exact=(bool, False), limit=(int, 10))
    command("term", **here, term=(str, ...), ignore_case=(bool, False), limit=(int, 20))
    command("node", **here, identifier=(str, ...))
    command("statistics", **here)
    command("analyze", **here, log=(str, ...), min_confidence=(float, 0.1), window=(int, 5), apply=(bool, False))
    command("init", output=(str, ...), overwrite=(bool, False))
    command("build", projects=(str, ...), output=(str, ...))
    command("pairs", **here, output=(str, ...), per_block=(int, 3), seed=(int, 13))
    command("triplets", **here, output=(str, ...), seed=(int, 13))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or session("weftgraph")
    show = lambda df: df.show(50, truncate=100)
    if a.command == "init":
        turtle.save(triples.ontology(spark), a.output, "overwrite" if a.overwrite else "errorifexists")
        return show(triples.ontology_counts(turtle.load(spark, a.output)))
    if a.command == "build":
        turtle.save(extract.graph(extract.blocks(tree.files(spark, a.projects))), a.output)
        return show(blocks.statistics(turtle.load(spark, a.output)))
    g = graph(spark, a.graph)
    service = Service(g, log_path=getattr(a, "log", None))
    if a.command == "search":
        best, found = service.search_code(a.query, a.top_k, a.steps, a.beam_width, a.doc_penalty, a.enable_logging)
        show(best.select("name", "kind", "file_path", "score"))
        if found:
            show(found.levels)
            show(found.best)
    elif a.command == "name":
        show(service.search_by_name(a.name, a.exact, a.limit).select("uri", "name", "kind", "language", "version"))
    elif a.command == "term":
        show(service.search_by_code_term(a.term, not a.ignore_case, a.limit).select("uri", "name", "occurrences", "lines"))
    elif a.command == "node":
        show(service.get_node_details(a.identifier))
    elif a.command == "statistics":
        show(service.list_graph_statistics())
    elif a.command == "analyze":
        show(service.analyze_query_patterns(a.min_confidence, a.window, a.apply))
        if a.apply:
            turtle.save(service.graph, a.graph.rstrip("/") + ".enriched")
    elif a.command == "pairs":
        pairs = dataset.pairs(blocks.blocks(g), a.per_block, a.seed)
        records.write_pairs(pairs.orderBy("order", "n"), a.output)
    elif a.command == "triplets":
        dataset.triplets(blocks.blocks(g), a.seed).drop("uri").write.mode("overwrite").json(a.output)


if __name__ == "__main__":
    main()
