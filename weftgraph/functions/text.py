"""Column functions over names, URIs, code and queries."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.vocab import KG


def _or(value: Column, default: str) -> Column:
    return F.when(value == "", F.lit(default)).otherwise(value)


def slug_concept(value: Column) -> Column:
    """ASCII runs joined by '_', lower case; 'resource' if nothing is left."""
    return F.lower(_or(F.btrim(F.regexp_replace(value, "[^a-zA-Z0-9]+", "_"), F.lit("_")), "resource"))


def slug_code(value: Column, default: str = "node") -> Column:
    """Lower case first, runs joined by '-'."""
    return _or(F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-")), default)


def slug_dataset(value: Column) -> Column:
    """Each character that is no letter or digit becomes '-'; runs are kept."""
    return F.lower(_or(F.btrim(F.regexp_replace(value, r"[^\p{L}\p{N}]", "-"), F.lit("-")), "resource"))


def to_uri(value: Column, base: str = KG) -> Column:
    """URIs pass, anything else becomes the base and its slug."""
    return F.when(value.startswith("http://") | value.startswith("https://"), value).otherwise(F.concat(F.lit(base), slug_concept(value)))


def local_name(uri: Column) -> Column:
    """What follows the last '#', then the last '/'."""
    return F.substring_index(F.substring_index(uri, "#", -1), "/", -1)


def file_uri(base: str, language: Column, version: Column, path: Column) -> Column:
    return F.concat(F.lit(base + "file/"), language, F.lit("/"), version, F.lit("/"), F.sha1(path.cast("binary")))


def block_uri(base: str, language: Column, version: Column, path: Column, index: Column) -> Column:
    token = F.concat(path, F.lit("::"), index.cast("string"))
    return F.concat(F.lit(base + "codeblock/"), language, F.lit("/"), version, F.lit("/"), F.sha1(token.cast("binary")))


def clip(value: Column, n: int = 900) -> Column:
    """At most n characters, the last three of them '...' if some were cut."""
    return F.when(F.char_length(value) <= n, value).otherwise(F.concat(F.left(value, F.lit(n - 3)), F.lit("...")))


def preview(value: Column, n: int) -> Column:
    """The first n characters, with '...' after them if some were cut."""
    return F.when(F.char_length(value) > n, F.concat(F.left(value, F.lit(n)), F.lit("..."))).otherwise(value)


# The words of a block's header and sections.
def header(name: Column, kind: Column, path: Column, language: Column, version: Column) -> Column:
    return F.concat(F.lit("Block "), name, F.lit(" ("), kind, F.lit(") located in "), path, F.lit(" for "), language, F.lit(" / "), version, F.lit("."))


def passage(name: Column, kind: Column, path: Column, language: Column, version: Column, description: Column, code: Column) -> Column:
    """Header, description if there is one, code."""
    told = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("Description:\n"), description))
    return F.concat_ws("\n\n", header(name, kind, path, language, version), told, F.concat(F.lit("Code:\n"), code))


def intent_tokens(name: Column) -> Column:
    """ASCII runs of the name as it stands, each in lower case."""
    return F.transform(F.array_remove(F.split(name, "[^a-zA-Z0-9]+"), ""), lambda x: F.lower(x))


def answer_language(answer: Column) -> Column:
    """From a rendered answer's first line: what stands between the first 'for ' and the '/' after it."""
    found = F.lower(F.trim(F.substring_index(F.regexp_extract(answer, r"\A[^\n]*?for ([^\n]*)", 1), "/", 1)))
    return _or(F.coalesce(found, F.lit("")), "unknown")


def is_documentation(kind: Column, name: Column) -> Column:
    return F.lower(kind).isin("documentation", "docstring", "comment") | F.contains(F.lower(name), F.lit("doc"))


def query_tokens(query: str) -> list[str]:
    return [t for t in query.lower().split() if len(t) > 1]


def token_hits(label: Column, uri: Column, query: str) -> Column:
    """How many tokens of the query occur in the label or the URI; a token that stands twice counts twice."""
    inside = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")))), F.lower(uri)
    hits = [(F.contains(inside[0], F.lit(t)) | F.contains(inside[1], F.lit(t))).cast("int") for t in query_tokens(query)]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def term_pattern(term: str, ignore_case: bool = False) -> str:
    """The term as a whole word, taken literally; words and cases are those of Unicode."""
    quoted = term.replace("\\E", "\\E\\\\E\\Q")
    return f"{'(?iuU)' if ignore_case else '(?U)'}\\b\\Q{quoted}\\E\\b"


def term_lines(code: Column, term: str, ignore_case: bool = False) -> Column:
    """array<struct<line, text>> of the lines that hold the term, trimmed, numbered from 1."""
    lines = F.transform(F.split(code, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("text"), x.alias("raw")))
    hit = F.filter(lines, lambda x: F.regexp_like(x["raw"], F.lit(term_pattern(term, ignore_case))))
    return F.transform(hit, lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text")))


# Words by which actions and intentions are told, first match wins.
ACTIONS = (("guardar", ("guardar", "salvar", "inserir", "store", "save", "ingest")), ("atualizar", ("atualizar", "substitu", "sufocar", "update", "replace")))
INTENTIONS = (("Historica", ("histor", "historic")), ("ImplementacaoAtual", ("atual", "corrente", "current")), ("Planejamento", ("planej", "plan", "planning")))


def _first_of(text: Column, table: tuple, default: str) -> Column:
    low, out = F.lower(text), None
    for value, tokens in table:
        hit = reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in tokens))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def action(query: Column) -> Column:
    return _first_of(query, ACTIONS, "recuperar")


def intention(query: Column) -> Column:
    return _first_of(query, INTENTIONS, "Desconhecida")


#: What counts as an entry of a query.
QUOTED = r'"([^"]+)"'
SLASHED = r"(?U)/\w[\w\-/]*"
NAMED = r"(?iuU)(?:API\s+\w+|Funcao\w*|Function\w*|rota\s+/\w+|route\s+/\w+)"


def entries(query: Column) -> Column:
    """Quoted strings if there are any; else paths and named things, each once, in order; else the query itself."""
    quoted = F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1))
    found = F.concat(F.regexp_extract_all(query, F.lit(SLASHED), F.lit(0)), F.regexp_extract_all(query, F.lit(NAMED), F.lit(0)))
    found = F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(quoted) > 0, quoted).when(F.size(found) > 0, found).otherwise(F.array(query))


def session_id(variable: str = "WEFTGRAPH_SESSION") -> str:
    """The session of this process: from the environment, else 8 random characters that are kept there."""
    return os.environ.setdefault(variable, uuid.uuid4().hex[:8])
