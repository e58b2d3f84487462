"""Extraction of code blocks from source text, and the triples of a source tree.

The three language extractors are table functions over whole texts: finding the end of a block
needs a scan with a state, which built-in functions don't have. Paragraphs do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions.text import block_uri, file_uri, slug_dataset
from weftgraph.operators.triples import COLUMNS

# What opens a block.
JAVA_CLASS = re.compile(r"^\s*(?:public\s+)?(?:final\s+)?class\s+(?P<name>[A-Za-z_][A-Za-z0-9_]*)[^\{]*\{", re.M)
JAVA_METHOD = re.compile(r"^\s*(?:public|protected|private)?\s*(?:static\s+)?[\w<>\[\]]+\s+(?P<name>[A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)\s*(?:throws[^\{]*)?\{", re.M)
COBOL_PARAGRAPH = re.compile(r"\s{0,7}([A-Z0-9-]+)\.")
DELPHI_ROUTINE = re.compile(r"\s*(procedure|function|constructor|destructor)\s+([A-Za-z0-9_.]+)", re.I)
SUFFIXES = {".java": "java", ".cob": "cobol", ".pas": "delphi"}

Block = tuple[str, str, str]
_TOKENS = re.compile(r"[{}\"']")


def _closing(text: str, at: int) -> int:
    """One past the brace that closes the one at `at`; braces in quotes don't count, a quote after a backslash doesn't end one."""
    depth, quote = 0, ""
    for m in _TOKENS.finditer(text, at):
        c, i = m[0], m.start()
        if quote:
            if c == quote and text[i - 1] != "\\":
                quote = ""
        elif c in "\"'":
            quote = c
        else:
            depth += 1 if c == "{" else -1
            if depth == 0:
                return i + 1
    return len(text)


def java(text: str) -> Iterator[Block]:
    """(name, kind, code): all classes, then all methods."""
    for pattern, kind in ((JAVA_CLASS, "class"), (JAVA_METHOD, "method")):
        for m in pattern.finditer(text):
            yield m["name"], kind, text[m.start() : _closing(text, m.end() - 1)]


def cobol(text: str) -> Iterator[Block]:
    """Paragraphs, each from its heading to the next; what stands before the first is left out."""
    lines = text.splitlines()
    heads = [(i, m[1]) for i, line in enumerate(lines) if (m := COBOL_PARAGRAPH.match(line))]
    for (i, name), (j, _) in zip(heads, [*heads[1:], (len(lines), "")]):
        yield name, "paragraph", "\n".join(lines[i:j])


def delphi(text: str) -> Iterator[Block]:
    """Routines, each up to the line whose 'end;' closes as many as 'begin' opened."""
    lines, i = text.splitlines(), 0
    while i < len(lines):
        if not (m := DELPHI_ROUTINE.match(lines[i])):
            i += 1
            continue
        first, depth, i = i, 0, i + 1
        for i in range(i, len(lines) + 1):  # noqa: B020
            if i == len(lines):
                break
            low = lines[i].lower()
            depth += low.count("begin") - low.count("end;")
            if depth <= 0 and "end;" in low:
                break
        yield m[2], m[1].lower(), "\n".join(lines[first : i + 1])


def generic(text: str) -> Iterator[Block]:
    """Paragraphs between blank lines."""
    parts = [p.strip() for p in re.split(r"\n\s*\n", text)]
    for n, part in enumerate(filter(None, parts), 1):
        yield f"section-{n}", "section", part


EXTRACTORS = {"java": java, "cobol": cobol, "delphi": delphi, "generic": generic}


def extract(text: str, path: str) -> list[Block]:
    """The blocks of one file by its suffix; the whole file where there are none."""
    suffix = re.search(r"\.[^./\\]*$", path.lower())
    found = list(EXTRACTORS[SUFFIXES.get(suffix[0] if suffix else "", "generic")](text))
    return found or [("file", "file", text)]


def blocks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The columns of `files` without the text, with index, name, kind and code of each block."""
    keep = [f for f in files.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["index int", "name string", "kind string", "code string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*row[:-2], i, *b) for row in batch[[f.name for f in keep] + [path, text]].set_axis(range(len(keep) + 2), axis=1).itertuples(index=False, name=None) for i, b in enumerate(extract(row[-1] or "", row[-2] or ""))]
            yield pd.DataFrame(out, columns=[f.name for f in keep] + ["index", "name", "kind", "code"])

    return files.mapInPandas(run, schema)


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, name, kind, code): the generic extractor with built-in functions; the whole text where it has no paragraph."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n", -1), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")
    whole = F.array(F.struct(F.lit("file").alias("name"), F.lit("file").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("code")))
    named = F.transform(parts, lambda x, i: F.struct(F.concat(F.lit("section-"), (i + 1).cast("string")).alias("name"), F.lit("section").alias("kind"), x.alias("code")))
    return df.select(key, F.posexplode(F.when(F.size(parts) > 0, named).otherwise(whole)).alias("index", "b")).select(key, "index", "b.*")


def graph(found: DataFrame, base: str = vocab.BASE) -> DataFrame:
    """Triples of blocks (language, version, path, index, name, kind, code): languages, versions, files, blocks and what belongs to what.

    A row for each block gives all its triples in one pass; those of its file come with its first
    block, and as a block's URI is its own, neither needs to be compared with others. Only languages
    and versions, which many files share, are.
    """
    tw, c = vocab.TW, F.col
    language, version = slug_dataset(c("language")), slug_dataset(c("version"))
    rows = found.select(
        "*", F.concat_ws(" ", "language", "version").alias("told"), F.concat(F.lit(base + "language/"), language).alias("l"), F.concat(F.lit(base + "version/"), language, F.lit("/"), version).alias("v"),
        file_uri(base, language, version, c("path")).alias("f"), block_uri(base, language, version, c("path"), c("index")).alias("b"),
    )
    made = lambda s, p, o, kind: F.struct(c(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    uri = lambda s, p, o: made(s, tw + p, c(o), "uri")
    typed = lambda s, kind: made(s, vocab.TYPE, F.lit(tw + kind), "uri")
    text = lambda s, p, o: made(s, tw + p, c(o), "literal")
    each = [uri("f", "containsBlock", "b"), typed("b", "CodeBlock"), *(text("b", k, k) for k in ("name", "kind", "code")), uri("b", "belongsToFile", "f"), uri("b", "belongsToVersion", "v"), uri("b", "belongsToLanguage", "l")]
    file = [typed("f", "File"), text("f", "path", "path"), uri("f", "belongsToVersion", "v")]
    shared = [typed("l", "Language"), text("l", "label", "language"), typed("v", "ProjectVersion"), text("v", "label", "told"), uri("v", "belongsToLanguage", "l")]
    of_blocks = rows.select(F.inline(F.when(c("index") == 0, F.array(*each, *file)).otherwise(F.array(*each))))
    known = rows.where("index = 0").select("l", "language", "v", "told").distinct()
    return of_blocks.unionByName(known.select(F.inline(F.array(*shared))).distinct()).select(*COLUMNS)
