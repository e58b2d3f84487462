"""Ranking of code blocks against a query."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scoring import overlap, penalised
from weftgraph.operators.blocks import with_passage

Model = Callable[[list[tuple[str, str]]], list[float]]


def scored(blocks: DataFrame, query: str, model: Model | None = None, penalty: float = 0.0) -> DataFrame:
    """Blocks with a `score`: the model's for (query, passage) in Arrow batches, else word overlap; less for documentation."""
    rows = with_passage(blocks)
    if model:
        judge = F.pandas_udf(lambda passages: pd.Series(model([(query, p) for p in passages]), dtype=float), "double")
        raw = judge(F.col("passage"))
    else:
        raw = overlap(query, F.col("passage"))
    return rows.withColumn("score", penalised(raw, F.col("kind"), F.col("name"), penalty)).drop("passage")


def ranked(blocks: DataFrame, query: str, top_k: int | None = 5, model: Model | None = None, penalty: float = 0.0) -> DataFrame:
    """The best blocks; all of them in order if top_k is None."""
    out = scored(blocks, query, model, penalty).orderBy(F.desc("score"), "uri")
    return out if top_k is None else out.limit(top_k)


def embedded(blocks: DataFrame, encode: Callable[[list[str]], list[list[float]]], passages: bool = True) -> DataFrame:
    """(uri, embedding) from an encoder of passages, or of name, description if there is one, and code, in Arrow batches."""
    run = F.pandas_udf(lambda passages: pd.Series([list(map(float, v)) for v in encode(list(passages))]), "array<double>")
    texts = with_passage(blocks) if passages else blocks.withColumn("passage", F.concat_ws(" ", "name", F.nullif("description", F.lit("")), "code"))
    return texts.select("uri", run("passage").alias("embedding"))
