"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copy rate of its documents; every document gets the whole
part as copies, and the fractional parts are settled in pairs: mass, counted in words, moves at
random from one document of the pair to the other until one fraction is 0 or 1, so the words of
the pair stay as they are and each document's expectation too. Blocks of a source are settled side
by side, each leaving at most one fraction; those meet in blocks again, level after level, until
one is left for the source. It is drawn, and what the source is then off its target, less than that
one document, is made up by turning decisions of the last block round, where documents fit.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import n_words, saved

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that one block settles, and so what a task holds in memory.
BLOCK = 8192
#: Sources whose rates are broadcast, at under 200 bytes each; more are joined by shuffle.
BROADCAST = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """From (source, source_size): adds target, the share of all words by weight, at most `most` times the size.

    Weights go by the rank of the source by code point, null last, and repeat. What the limit cuts
    off is shared among the rest by weight until none is above. Only sums come to the driver.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), rank % len(weights))
    ranked = saved(sizes.withColumn("weight", weight))
    cap = F.col("source_size") * F.lit(most)
    total, level = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0
    free = ranked.agg(F.sum("weight")).first()[0]
    level = total / free if free else 0.0
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        capped, rest = ranked.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if not rest or (new := (total - (capped or 0.0)) / rest) <= level * (1 + 1e-12):
            return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).cast("double").alias("target"))
        level = new


def settle(items: list[int], p: list[float], size: list[int], rng: random.Random) -> int:
    """Make p 0 or 1 for all of `items` but at most one, whose index is returned, else -1; sum(p * size) stays."""
    held = -1
    for i in items:
        if held < 0:
            held = i
            continue
        a, b, wa, wb = p[held], p[i], size[held], size[i]
        up, down = min((1 - a) * wa, b * wb), min(a * wa, (1 - b) * wb)
        if rng.random() * (up + down) < down:  # the first gains
            full, p[held], p[i] = (1 - a) * wa <= b * wb, a + up / wa, b - up / wb
            done, other, value = (held, i, 1.0) if full else (i, held, 0.0)
        else:
            empty, p[held], p[i] = a * wa <= (1 - b) * wb, a - down / wa, b + down / wb
            done, other, value = (held, i, 0.0) if empty else (i, held, 1.0)
        p[done], held = value, other
        if p[other] <= 1e-12 or p[other] >= 1 - 1e-12:
            p[other], held = float(round(p[other])), -1
    return held


def settle_block(p: list[float], size: list[int], rng: random.Random) -> int:
    """As `settle` for all of a block, so that what is left open is a small document.

    The larger half is settled first. The one it leaves is drawn, and the smaller half takes the
    words this frees or needs, each document in proportion to its size, if their fractions allow
    it; then the larger half of those, and so on.
    """
    rest, held = sorted(range(len(p)), key=lambda i: -size[i]), -1
    while rest:
        half = len(rest) - len(rest) // 2
        held = settle(([held] if held >= 0 else []) + rest[:half], p, size, rng)
        rest = rest[half:]
        if held >= 0 and rest:
            drawn = float(rng.random() < p[held])
            shift = (p[held] - drawn) * size[held] / sum(size[i] for i in rest)
            if 0 <= min(p[i] for i in rest) + shift and max(p[i] for i in rest) + shift <= 1:
                for i in rest:
                    p[i] += shift
                p[held], held = drawn, -1
                rest = [i for i in rest if 0 < p[i] < 1]
    return held


def _error(p: list[float], before: list[float], size: list[int]) -> float:
    return float(((np.array(p) - np.array(before)) * np.array(size, float)).sum())


def repaired(p: list[float], before: list[float], size: list[int], stays: int = -1) -> list[float]:
    """Decisions with some turned round, not that of `stays`, where that brings the words nearer to what the fractions called for.

    First one at a time, larger documents first, then the pair that comes nearest, as long as it helps.
    """
    out, sizes = np.array(p), np.array(size, float)
    error = _error(p, before, size)
    for i in np.argsort(-sizes, kind="stable").tolist():
        turn = (1 - 2 * out[i]) * sizes[i]
        if i != stays and abs(error + turn) < abs(error) - 1e-9:
            out[i], error = 1 - out[i], error + turn
    while len(out) > 1:
        turns = (1 - 2 * out) * sizes
        order = np.argsort(turns, kind="stable")
        held = turns[order]
        other = np.searchsorted(held, -error - held)  # the partner that would settle it lies here or one before
        i, j = np.tile(np.arange(len(held)), 2), np.clip(np.concatenate((other, other - 1)), 0, len(held) - 1)
        left = np.where((i == j) | (order[i] == stays) | (order[j] == stays), np.inf, np.abs(error + held[i] + held[j]))
        best = int(np.argmin(left))
        if left[best] >= abs(error) - 1e-9:
            break
        pair = order[[i[best], j[best]]]
        error += float(turns[pair].sum())
        out[pair] = 1 - out[pair]
    return out.tolist()


def _level(rows: DataFrame, block: Column, seed: int, last: bool) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("open", T.BooleanType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "size"], kind="stable").reset_index(drop=True)
        p = group["p"].tolist()
        rng = random.Random(f"{seed}/{group['source'].iloc[0]}/{group['block'].iloc[0]}/{len(p)}")
        held = settle_block(p, group["size"].tolist(), rng)
        if last:
            if held >= 0:
                p[held], held = float(rng.random() < p[held]), -1
            # both decisions on the largest document are tried; what is drawn holds if the other leaves as much
            size, tried = group["size"].tolist(), []
            most = max(range(len(p)), key=lambda i: size[i])
            for x in (p[most], 1 - p[most]):
                tried.append(repaired([*p[:most], x, *p[most + 1 :]], group["p"].tolist(), size, most))
            p = min(tried, key=lambda x: abs(_error(x, group["p"], size)))
        return group.assign(p=p, open=[i == held for i in range(len(p))])

    rows = rows.withColumn("block", block)
    return rows.groupBy("source", "block").applyInPandas(run, schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """A row for each document: id, size (words), source, source_size, target, copies, taken.

    Copies never exceed `most`, taken is copies times size. Null texts have size 0 and, like empty
    ones, the whole part of the rate as copies; a null source is a source, the last. Repeated rows
    are settled each by itself. The same rows give the same copies, however they are partitioned.
    A very long text is drawn like others, and what it is off is made up by shorter ones. Of
    documents of a block that tie in id and size, which goes first is not told. An empty table gives
    no rows. Other columns are not read.
    """
    rows = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("order")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = saved(sizes)
    spec = targets(sizes.drop("n"), weights, most).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    spec = spec.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    if sizes.count() <= BROADCAST:
        spec = F.broadcast(spec)
    rows = rows.join(spec, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = F.floor(F.col("rate") + 1e-9)
    rows = rows.withColumn("base", base.cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).drop("rate")
    rows = rows.withColumn("block", F.pmod("order", "blocks"))
    still = (F.col("size") > 0) & (F.col("p") > 1e-9)
    done = rows.where(~still).withColumn("p", F.lit(0.0))
    now, blocks = rows.where(still), (sizes.agg(F.max("n")).first()[0] or 0) / block
    number, out = F.col("block"), [done.drop("block")]
    while True:
        settled = _level(now, number, seed, blocks <= 1)
        if blocks <= 1:
            out.append(settled.drop("block", "open"))
            break
        settled = saved(settled)
        out.append(settled.where("not open").drop("block", "open"))
        now, blocks, number = settled.where("open").drop("open"), blocks / block, F.expr(f"block div {block}")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    copies = (F.col("base") + F.round("p")).cast("long")
    return whole.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
