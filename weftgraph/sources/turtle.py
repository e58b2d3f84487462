"""Turtle files as triples, and triples as Turtle.

A literal may run over lines, so a file is read whole and parsed in one piece, a file a row; many
files are parsed side by side. The writer groups by subject. Large graphs belong in Parquet, where
a filter on the predicate prunes files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import vocab

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>\s]*>)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d*\.\d+|\d+)(?![\w:]))
    |(?P<name>(?:[^\s<>"'{}|^`\\()\[\];,.\#:]|\.(?=[^\s;,.]))*:(?:[^\s<>"'{}|^`\\()\[\];,.\#]|\.(?=[\w:%-])|\\.)*)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)

Triple = tuple[str, str, str, str, str | None, str | None]


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text)


def parse(text: str) -> Iterator[Triple]:
    """Triples of a Turtle text in the shape of vocab.TRIPLES; ValueError where it isn't Turtle. Blank nodes and collections aren't taken."""
    prefixes: dict[str, str] = {}
    base, at, tokens = "", 0, []
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            raise ValueError(f"not Turtle at character {at}: {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def iri(kind: str, value: str) -> str:
        if kind == "iri":
            found = _plain(value[1:-1])
            return found if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", found) else base + found
        if kind == "name":
            prefix, _, rest = value.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)
        raise ValueError(f"a name was expected, not {value!r}")

    def expect(mark: str) -> None:
        nonlocal i
        if tokens[i][1] != mark:
            raise ValueError(f"{mark!r} was expected, not {tokens[i][1]!r}")
        i += 1

    while tokens[i][0] != "end":
        kind, value = tokens[i]
        directive = value.lower()
        if directive in ("@prefix", "prefix", "@base", "base"):
            if directive.endswith("prefix"):
                prefixes[tokens[i + 1][1][:-1]] = iri(*tokens[i + 2])
                i += 3
            else:
                base, i = tokens[i + 1][1][1:-1], i + 2
            if directive[0] == "@":
                expect(".")
            continue
        subject, i = iri(kind, value), i + 1
        while True:
            predicate = vocab.TYPE if tokens[i] == ("word", "a") else iri(*tokens[i])
            i += 1
            while True:
                kind, value = tokens[i]
                i += 1
                if kind in ("long", "short"):
                    body, datatype, lang = _plain(value[3:-3] if kind == "long" else value[1:-1]), None, None
                    if tokens[i][0] == "lang":
                        lang, i = tokens[i][1][1:], i + 1
                    elif tokens[i][0] == "type":
                        datatype, i = iri(*tokens[i + 1]), i + 2
                    yield subject, predicate, body, "literal", datatype, lang
                elif kind == "number":
                    of = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
                    yield subject, predicate, value, "literal", vocab.XSD + of, None
                elif kind == "word" and value in ("true", "false"):
                    yield subject, predicate, value, "literal", vocab.XSD + "boolean", None
                else:
                    yield subject, predicate, iri(kind, value), "uri", None, None
                if tokens[i][1] != ",":
                    break
                i += 1
            while tokens[i][1] == ";":
                i += 1
                more = tokens[i][1] not in (";", ".")
                if more:
                    break
            else:
                break
        expect(".")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The triples of one or more Turtle files, without repetitions. If not strict, a file that can't be parsed gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                try:
                    yield pd.DataFrame(list(parse(text)), columns=["s", "p", "o", "o_kind", "o_datatype", "o_lang"], dtype=object)
                except (ValueError, IndexError) as error:
                    if strict:
                        raise ValueError(f"no Turtle: {error}") from error

    return spark.read.text(path, wholetext=True).mapInPandas(run, vocab.TRIPLES).dropDuplicates()


def _term(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        body = F.replace(value if plain == "\\" else body, F.lit(plain), F.lit(escaped))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(F.concat(F.lit('"'), body, F.lit('"'), tail))


def lines(graph: DataFrame) -> DataFrame:
    """(value): Turtle, a line for each subject."""
    said = graph.select("s", F.concat(F.lit("<"), "p", F.lit("> "), _term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang"))).alias("said"))
    held = said.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("said")), " ; ").alias("all"))
    return held.select(F.concat(F.lit("<"), "s", F.lit("> "), "all", F.lit(" .")).alias("value"))


def write(graph: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of Turtle files, each of which can be read by itself."""
    lines(graph).write.mode(mode).text(path)


def save(graph: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The native form: Parquet, a folder for each predicate."""
    graph.write.mode(mode).partitionBy("p").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("s", "p", "o", "o_kind", "o_datatype", "o_lang")
