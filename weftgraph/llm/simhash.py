"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact verification.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the popcounts of the segments are a point
of an integer lattice, and the Manhattan distance of two points never exceeds the Hamming distance
of their fingerprints. Two points within distance 2 have a lattice point within distance 1 of both,
so every fingerprint registers in the at most 33 cells within distance 1 of its own, and only
fingerprints that meet in a cell can link. The exact check is of the same form one level down:
inside a cell that holds several fingerprints, each of them lists the fingerprints one flipped bit
away (or none) that have the cell as their point; two fingerprints list a common one exactly when
they differ in at most 2 bits, and all that list it link to each other. So a star to the least of
them loses no link, and no pairs of a group are ever made, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import connected_components, saved

SEGMENTS, BITS = 16, 4
#: Shingles whose bits are counted at once, which bounds the memory for a very long text.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half the shingle hashes; 0 without words."""
    tokens = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(tokens))
    total = np.zeros(64, np.int64)
    n = len(tokens) - k + 1
    h = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        hashes = np.fromiter((h(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())), np.uint64, to - at)
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp long) for every document, one for each row of `docs`; fp holds the 64 bits, a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in raw), np.uint64, len(raw)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _cells(fp: Column) -> Column:
    """Codes, in base 5, of the lattice points within Manhattan distance 1; position 2s+1 is one more in segment s, 2s+2 one less."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, BITS * s).bitwiseAND(F.lit(2**BITS - 1).cast("long"))) for s in range(SEGMENTS)]
    own = sum((c.cast("long") * (BITS + 1) ** s for s, c in enumerate(counts)), F.lit(0).cast("long"))
    near = [F.lit(0).cast("long")]
    for s, c in enumerate(counts):
        step = F.lit((BITS + 1) ** s).cast("long")
        near += [F.when(c < BITS, step), F.when(c > 0, -step)]
    return F.transform(F.array(F.struct(own.alias("own"), F.array(*near).alias("near"))), lambda x: F.transform(x["near"], lambda d: x["own"] + d))[0]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join distinct fingerprints (column fp) within 2 differing bits into the right components.

    Each edge is a link, and each link has its two ends joined through the star of a common midpoint.
    """
    at = fps.select("fp", F.posexplode(_cells(F.col("fp"))).alias("how", "cell")).where("cell is not null")
    crowded = at.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1")
    first = F.expr(f"{BITS} * ((how - 1) div 2)").cast("int")
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), first + b)
    flips = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when((F.col("fp").bitwiseAND(bit(b)) == 0) == (F.col("how") % 2 == 1), F.col("fp").bitwiseXOR(bit(b)))),
        lambda m: m.isNotNull(),
    )
    mids = crowded.select("fp", F.explode(F.when(F.col("how") == 0, F.array("fp")).otherwise(flips)).alias("mid"))
    least = mids.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    return mids.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components(fps: DataFrame) -> DataFrame:
    """From (id, fp) rows: (fp, component_id), the least id among all documents reachable over links; copies are never paired."""
    reps = saved(fps.groupBy("fp").agg(F.min("id").alias("first")))
    joined = reps.join(connected_components(links(reps.select("fp"))).withColumnRenamed("node", "fp"), "fp", "left")
    joined = joined.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    return joined.join(ids, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: its id, fp and component_id.

    Null and empty texts have fingerprint zero and link to each other like any others. Rows that
    repeat an id keep a row each; a null id is never a component's least unless all are null.
    An empty table gives no rows. Other columns of `docs` are not read.
    """
    fps = saved(fingerprints(docs, shingle, id_col, text_col))
    return fps.join(components(fps), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
