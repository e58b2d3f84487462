"""A part of SPARQL over a triple table: basic graph patterns, OPTIONAL, FILTER, ORDER BY, LIMIT, OFFSET.

Each pattern is a filtered scan of the triples, patterns meet in equi-joins on the variables they
share, so the optimizer orders, prunes and broadcasts them as it does any other join. A variable is
a column of strings: URIs in full, literals by their text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import vocab

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<t><[^<>\s]*>|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\?\w+|\w*:[\w\-.]*\w|\w*:|&&|\|\||!=|<=|>=|[\w.]*\w|[{}().;,*!=<>])""")
_SHORT = {"rdf": vocab.RDF, "rdfs": vocab.RDFS, "xsd": vocab.XSD}


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not understood: {text[at : at + 20]!r}")
            if m["t"]:
                self.tokens.append(m["t"])
            at = m.end()
        self.at, self.prefixes = 0, dict(_SHORT)

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def took(self, word: str) -> bool:
        if self.peek().lower() == word.lower():
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.took(word):
            raise ValueError(f"expected {word!r}, found {self.peek()!r}")

    def term(self) -> tuple[str, str]:
        """('var' | 'uri' | 'literal', text)."""
        t = self.next()
        if t.startswith("?"):
            return "var", t[1:]
        if t.startswith("<"):
            return "uri", t[1:-1]
        if t[:1] in "\"'" and t:
            return "literal", re.sub(r"\\(.)", r"\1", t[1:-1])
        if t == "a":
            return "uri", vocab.TYPE
        if ":" in t:
            short, _, name = t.partition(":")
            if short not in self.prefixes:
                raise ValueError(f"no prefix {short!r}")
            return "uri", self.prefixes[short] + name
        if re.fullmatch(r"[\w.]+", t):
            return "literal", t
        raise ValueError(f"no term: {t!r}")


def _pattern(graph: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """The triples that fit, a column for each variable."""
    rows, held = graph, {}
    for column, (kind, text) in zip("spo", terms):
        if kind != "var":
            rows = rows.where(F.col(column) == text)
            if column == "o":
                rows = rows.where(F.col("o_kind") != "literal" if kind == "uri" else F.col("o_kind") == "literal")
        elif text in held:
            rows = rows.where(F.col(column) == F.col(held[text]))
        else:
            held[text] = column
    if not held:  # only asks whether there is such a triple
        return rows.limit(1).select(F.lit(True).alias("__is"))
    return rows.select(*(F.col(c).alias(v) for v, c in held.items())).distinct()


def _joined(a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
    if a is None:
        return b
    shared = [c for c in a.columns if c in b.columns]
    if shared:
        return a.join(b, shared, how)
    return a.join(b, F.lit(True), how)


def _value(r: _Reader) -> Column:
    word = r.peek().lower()
    if word in ("str", "lcase", "ucase", "strlen"):
        r.next()
        r.need("(")
        inner = _value(r)
        r.need(")")
        return {"str": inner, "lcase": F.lower(inner), "ucase": F.upper(inner), "strlen": F.char_length(inner)}[word]
    kind, text = r.term()
    return F.col(f"`{text}`") if kind == "var" else F.lit(text)


def _condition(r: _Reader) -> Column:
    out = _both(r)
    while r.took("||"):
        out = out | _both(r)
    return out


def _both(r: _Reader) -> Column:
    out = _one(r)
    while r.took("&&"):
        out = out & _one(r)
    return out


def _one(r: _Reader) -> Column:
    if r.took("!"):
        return ~_one(r)
    if r.took("("):
        out = _condition(r)
        r.need(")")
        return out
    word = r.peek().lower()
    if word == "bound":
        r.next()
        r.need("(")
        out = _value(r).isNotNull()
        r.need(")")
        return out
    if word in ("contains", "strstarts", "strends", "regex"):
        r.next()
        r.need("(")
        a = _value(r)
        r.need(",")
        kind, text = r.term()
        flags = r.term()[1] if r.took(",") else ""
        r.need(")")
        return {"contains": lambda: F.contains(a, F.lit(text)), "strstarts": lambda: a.startswith(text), "strends": lambda: a.endswith(text), "regex": lambda: a.rlike(f"(?U{'i' if 'i' in flags else ''}){text}")}[word]()
    a, op, b = _value(r), r.next(), None
    number = re.fullmatch(r"-?\d+(\.\d+)?", r.peek())
    b = _value(r)
    if number:
        a, b = a.cast("double"), b.cast("double")
    ops = {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}
    if op not in ops:
        raise ValueError(f"no comparison: {op!r}")
    return ops[op]()


def _group(r: _Reader, graph: DataFrame) -> DataFrame:
    r.need("{")
    found, optional, filters = None, [], []
    while not r.took("}"):
        if not r.peek():
            raise ValueError("a group isn't closed")
        if r.took("optional"):
            optional.append(_group(r, graph))
        elif r.took("filter"):
            filters.append(_one(r))
        elif not r.took("."):
            s, more = r.term(), True
            while more:
                p, again = r.term(), True
                while again:
                    found = _joined(found, _pattern(graph, [s, p, r.term()]))
                    again = r.took(",")
                more = r.took(";") and r.peek() not in (".", "}")
    if found is None:
        raise ValueError("a group has no pattern")
    for x in optional:
        found = _joined(found, x, "left")
    return reduce(DataFrame.where, filters, found)


def select(graph: DataFrame, query: str) -> DataFrame:
    """The rows of a SELECT query, a column for each variable, in the order asked for."""
    r = _Reader(query)
    while r.took("prefix"):
        short = r.next().rstrip(":")
        r.prefixes[short] = r.next()[1:-1]
    r.need("select")
    distinct, names = r.took("distinct"), []
    while r.peek().startswith("?"):
        names.append(r.next()[1:])
    if not names:
        r.need("*")
    r.took("where")
    found = _group(r, graph)
    order = []
    if r.took("order"):
        r.need("by")
        while r.peek().startswith("?") or r.peek().lower() in ("asc", "desc"):
            way = r.next()
            if way.startswith("?"):
                order.append(F.col(f"`{way[1:]}`").asc())
                continue
            r.need("(")
            held = F.col(f"`{r.term()[1]}`")
            order.append(held.desc() if way.lower() == "desc" else held.asc())
            r.need(")")
    out = found.select(*(f"`{n}`" for n in names or [c for c in found.columns if c != "__is"])) if distinct or not order else found
    out = out.distinct() if distinct else out
    out = out.orderBy(*order) if order else out
    out = out.select(*(f"`{n}`" for n in names)) if names else out
    limit = offset = None
    while r.peek().lower() in ("limit", "offset"):
        if r.next().lower() == "limit":
            limit = int(r.next())
        else:
            offset = int(r.next())
    if r.peek():
        raise ValueError(f"not understood: {r.peek()!r}")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def is_sparql(query: str) -> bool:
    """SPARQL rather than SQL: it has prefixes, or selects variables or from a group."""
    return bool(re.match(r"\s*(?:prefix\s|select\s+(?:distinct\s+)?(?:\?|\*\s*(?:where\s*)?\{))", query, re.I))
