"""Near duplicates by the Jaccard similarity of their word shingles, exactly checked: the pipeline's use of operator 7.

Texts that operator 7's popcount grid links, by SimHash over the same shingles, are the first
candidates: each is compared with the least of its component, so large groups are joined at once.
But two texts of similarity 0.8 differ in about ten of 64 bits, far beyond the distance that the
grid finds, so the others are those that agree in a band of MinHash values: with 32 bands of 5
values two texts of similarity 0.8 share none with a probability of 3 in a million, and more alike
ones more rarely still. Each candidate pair is then decided by the shingles themselves. So that a
crowded band costs no square of comparisons, its texts are first compared with the one that meets
most others, which joins most; of what is not in one component by then all pairs are looked at, but
only those are compared whose shingles can be that much alike, by a lower bound on their difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import simhash
from weftgraph.llm.common import connected_components, freed, saved, whole

SHINGLE = 5
SIMILARITY = 0.8
BANDS, VALUES = 32, 5
#: Shingles hashed at once, which bounds the memory for a very long text.
BLOCK = 1 << 12
#: Comparisons with a single text of each band before the pairs of all that are left.
STARS = 1
#: Segments of the hash range for the lower bound on what two texts differ in.
SEGMENTS = 1024

_DRAWN = np.random.default_rng(42)
_FACTORS = _DRAWN.integers(0, 2**63, BANDS * VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _DRAWN.integers(0, 2**63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the shingles. Fewer words than a shingle: the whole sequence is one; no words: none."""
    tokens = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(t, 42) for t in tokens), np.uint64, len(tokens))
    k = min(shingle, len(tokens))
    if not k:
        return hashes
    n = len(tokens) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = _mixed(total * _STEP + hashes[i : i + n])
    return np.unique(total)


def bands(found: np.ndarray) -> np.ndarray:
    """A hash for each band; texts without words agree in all."""
    least = np.full(BANDS * VALUES, 2**64 - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (_FACTORS[:, None] * found[None, at : at + BLOCK]).min(axis=1))
    folded = (_mixed(least).reshape(BANDS, VALUES) * _FOLD).sum(axis=1, dtype=np.uint64)
    return _mixed(folded + np.arange(BANDS, dtype=np.uint64) * _STEP)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _signed(texts: DataFrame) -> DataFrame:
    """(key, n, fp, bands) from (key, text): how many shingles, SimHash, bands of MinHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in _bytes(batch.column(1))]
            found = [shingles(x) for x in raw]
            fps = np.fromiter((simhash.fingerprint(x, SHINGLE) for x in raw), np.uint64, len(raw)).view(np.int64)
            values = pa.array([bands(x).view(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(fps), values], names=["key", "n", "fp", "bands"])

    return texts.mapInArrow(run, "key binary, n long, fp long, bands array<bigint>")


def _seeds(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys, a < b: each text of a component of operator 7 and the least of them."""
    found = signed.select("fp", F.col("key").alias("b")).join(simhash.components(signed.select(F.col("key").alias("id"), "fp")), "fp")
    return found.where("b <> component_id").select(F.col("component_id").alias("a"), "b")


def _alike(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts are that similar; `texts` has (key, text), a row for each key that is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _bytes(batch.column(2)), _bytes(batch.column(3))
            kept = [similarity(shingles(x.as_py()), shingles(y.as_py())) >= least for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, T.StructType([T.StructField(c, T.BinaryType()) for c in "ab"]))


def parity(found: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of SEGMENTS segments of the hash range is odd, as bits of longs.

    Each shingle that only one of two texts holds turns one bit round, so the bits that differ are
    never more than these shingles, and seldom much fewer: the lower bound of operator 7, for sets.
    """
    odd = np.bincount((found & np.uint64(SEGMENTS - 1)).astype(np.int64), minlength=SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _with_parity(members: DataFrame, named: DataFrame) -> DataFrame:
    """`members` with the parity of their texts, in longs p0, p1, ..."""
    longs = [f"p{i}" for i in range(SEGMENTS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([parity(shingles(x.as_py())) for x in _bytes(batch.column(1))], np.int64).reshape(-1, len(longs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in table.T)], names=["key", *longs])

    held = named.join(members.select("key").distinct(), "key", "left_semi").mapInArrow(run, f"key binary, {', '.join(f'{x} long' for x in longs)}")
    return members.join(held, "key")


def _components(members: DataFrame, edges: DataFrame) -> DataFrame:
    """`members` with the component each key has over the edges. The shuffle files of the passes up to here go."""
    found = connected_components(edges).withColumnRenamed("node", "key")
    freed(members.sparkSession)
    return members.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))


def _mixed_cells(now: DataFrame) -> DataFrame:
    """Members of the cells that hold several components."""
    mixed = now.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("top")).where("low < top").select("cell")
    return now.join(mixed, "cell")


def _sides(now: DataFrame, side: str) -> DataFrame:
    short = {"key": "k", "n": "n", "component": "c"}
    return now.drop("met").withColumnsRenamed({c: f"{short.get(c, c)}_{side}" for c in now.columns if c not in ("cell", "met")})


def components(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(key, component) for each key of `texts`, which has (key binary, text), a key for each text, in any number of rows.

    The component is the least key reachable over pairs of similarity `least` or more.
    """
    signed = saved(_signed(_once(texts)))
    cells = signed.select("key", "n", F.explode("bands").alias("cell"))
    crowded = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    members = cells.join(crowded, "cell")
    met = members.groupBy("key").agg(F.sum("size").alias("met"))
    members = saved(members.drop("size").join(met, "key"))
    freed(texts.sparkSession)
    tested = saved(_seeds(signed))
    freed(texts.sparkSession)
    asked = members.select("key").union(tested.select("a")).union(tested.select("b")).distinct()
    named = saved(_once(texts.join(asked, "key", "left_semi")))
    fits = (F.col("n_a") >= least * F.col("n_b") - 1e-6) & (F.col("n_b") >= least * F.col("n_a") - 1e-6)
    edges = saved(_alike(tested, named, least))
    now = saved(_components(members, edges))
    for turn in range(STARS):
        # first the text that meets most others, as the one that a group was made of does, then any
        order = -F.col("met") if turn == 0 else F.xxhash64("key", F.lit(turn))
        mixed = _mixed_cells(now).groupBy("cell").agg(F.min(F.struct(order.alias("h"), F.struct("key", "n", "component").alias("x")))["x"].alias("x"))
        b = mixed.select("cell", F.col("x.key").alias("k_b"), F.col("x.n").alias("n_b"), F.col("x.component").alias("c_b"))
        near = _sides(now, "a").join(b, "cell").where((F.col("c_a") != F.col("c_b")) & fits)
        pairs = near.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b")).distinct()
        pairs = saved(pairs.join(tested, ["a", "b"], "left_anti"))
        edges, tested = edges.union(saved(_alike(pairs, named, least))), tested.union(pairs)
        now = saved(_components(members, edges))
    left = saved(_with_parity(_mixed_cells(now), named))
    differ = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(SEGMENTS // 64)), F.lit(0))
    near = _sides(left, "a").join(_sides(left, "b"), "cell").where((F.col("k_a") < F.col("k_b")) & (F.col("c_a") != F.col("c_b")) & fits & ((1 + least) * differ <= (1 - least) * (F.col("n_a") + F.col("n_b")) + 1e-6))
    pairs = saved(near.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    edges = edges.union(saved(_alike(pairs, named, least)))
    return _components(signed.select("key"), edges)


def _once(texts: DataFrame) -> DataFrame:
    """A row for each key. The limit of a window is taken in each task before the shuffle, so many copies are no task's load."""
    return texts.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("__n = 1").drop("__n")


def key(text: Column) -> Column:
    """The same for equal texts; a null text is as an empty one."""
    return F.unhex(F.md5(whole(text).cast("binary")))
