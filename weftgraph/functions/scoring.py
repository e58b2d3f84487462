"""Scores of edges and passages.

The walk and the ranking take any scorer of the protocols here. The heuristic ones need no model;
a neural one is a function over batches of text pairs that is handed in and runs as a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.text import is_documentation, local_name


def ratio(a: str | None, b: str | None) -> float:
    """Similarity of two lower-cased strings by matching blocks; -0.5 if the second is empty."""
    if not b:
        return -0.5
    return SequenceMatcher(a=(a or "").lower(), b=b.lower()).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """`ratio` over batches; no built-in function has its matching-blocks measure."""
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=float)


def predicate_adjustment(predicate: Column, intention: str, query: str) -> Column:
    """What the query's intention adds to or takes from an edge, by the edge's local name."""
    # Beginnings of predicates, parts of intentions and queries, and what they add.
    name, low = F.lower(local_name(predicate)), intention.lower()
    replaced = name.startswith("substituida_por") | name.startswith("replaced_by")
    route = name.startswith("tem_rota") | name.startswith("has_route")
    by_intent = -0.9 if "histor" in low else 0.2 if "implementacaoatual" in low else None
    asked = "rota" in query.lower() or "route" in query.lower()
    out = F.when(replaced & F.lit(by_intent is not None), F.lit(by_intent or 0.0))
    return out.when(route & F.lit(asked), 0.3).otherwise(0.0)


class EdgeScorer(Protocol):
    """Adds a column `score` to rows of edges: predicate, target text and whether the target is on the path already."""

    def __call__(self, edges: DataFrame, query: str, intention: str) -> DataFrame: ...


def heuristic(edges: DataFrame, query: str, intention: str) -> DataFrame:
    """Similarity of query and target text, adjusted for the predicate, less 0.25 on the path, within -1 and 1."""
    raw = similarity(F.lit(query.lower()), F.col("text")) + predicate_adjustment(F.col("p"), intention, query)
    raw = raw - F.when(F.col("on_path"), 0.25).otherwise(0.0)
    return edges.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def pair_text(current: Column, predicate: Column, target: Column, intention: str) -> Column:
    """An edge put into words for a model that judges relevance. The phrases are fixed values."""
    return F.concat(F.lit("Current: "), current, F.lit(". Relation: "), local_name(predicate), F.lit(". Target: "), target, F.lit(f". Intent: {intention}."))


def cross_encoder(model: Callable[[list[tuple[str, str]]], list[float]]) -> EdgeScorer:
    """An edge scorer from a function that scores pairs of texts: tanh of the score, which is 0.25 less on the path.

    The penalty stands outside whatever the model remembers, so it doesn't depend on the order of calls.
    """
    judge = F.pandas_udf(lambda a, b: pd.Series(model(list(zip(a, b))), dtype=float), "double")

    def score(edges: DataFrame, query: str, intention: str) -> DataFrame:
        raw = judge(F.lit(query), pair_text(F.col("from_text"), F.col("p"), F.col("text"), intention))
        return edges.withColumn("score", F.tanh(raw - F.when(F.col("on_path"), 0.25).otherwise(0.0)))

    return score


SCORERS: dict[str, EdgeScorer] = {"heuristic": heuristic}


def scorer(name: str = "heuristic", model: Callable | None = None) -> EdgeScorer:
    """A scorer by name; the heuristic where a model is asked for and there is none."""
    return cross_encoder(model) if name == "cross-encoder" and model else SCORERS.get(name, heuristic)


def overlap(query: str, passage: Column) -> Column:
    """Share of the query's distinct words that the passage has: the relevance of a passage where no model is given."""
    asked = sorted({w for w in query.lower().split() if w})
    if not asked:
        return F.lit(0.0)
    has = [F.contains(F.lower(passage), F.lit(w)).cast("double") for w in asked]
    return sum(has[1:], has[0]) / len(asked)


def penalised(score: Column, kind: Column, name: Column, penalty: float) -> Column:
    """Less for documentation."""
    return score - F.when(is_documentation(kind, name), penalty).otherwise(0.0) if penalty > 0 else score
