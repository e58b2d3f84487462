"""Suffix-array dedup: a depth-limited radix sort whose equal groups are the repeated windows.

A window is a suffix taken through its first 50 bytes. Sorting all of them would move many times
the corpus, so the passes, most significant digit first, go from coarse to fine and drop what can
no longer repeat:

1. Every window is filed under its anchor, the 24-byte gram in it with the least hash. Equal
   windows have equal anchors at equal places, and neighbouring windows share theirs, so about one
   gram in fourteen stands for all. First digit: the anchor. A second digit holds all the windows
   of the anchor at once (their bytes form one string). Where it equals that of a document with a
   smaller id, all these windows repeat. Where the anchor occurs in one document only, none does.
2. What is left are anchors met in several documents with different surroundings, mostly the two
   ends of a repeated passage. Their windows are sorted one by one, down to the last byte.

Digits are hashes of the bytes they stand for: 38 bits or more of the anchor, with 48 more of its
windows' string in the first pass, 64 in the second. A group's least document is found in each map
task before the shuffle, so what is sent for a passage doesn't grow with its copies in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import freed, saved

DEPTH, GRAM = 50, 24
#: Bytes hashed at once, and bytes of text after which a map task sends what it has.
PIECE, FLUSH = 1 << 19, 1 << 25
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_TABLE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64) | _U(1)


def _powers(n: int, base: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if len(known.get(base, ())) < n:
        out = np.full(max(n, PIECE + 4096), base, np.uint64)
        out[0] = 1
        known[base] = np.multiply.accumulate(out)
    return known[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


class Windows:
    """The windows of some documents put one after another: hashes of their bytes, and runs that share an anchor."""

    def __init__(self, data: np.ndarray, doc: np.ndarray, depth: int = DEPTH, gram: int = GRAM):
        """`data` are bytes, `doc` the number of the document of each, ascending."""
        n, self.depth = len(data), depth
        self.count = max(0, n - depth + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(n, _BASE), out=self.sums[1:])
        self.back = _powers(n + 1, pow(_BASE, -1, 2**64))
        self.starts = self.ends = self.anchors = np.zeros(0, np.int64)
        if not self.count:
            return
        grams = self.hashed(np.arange(n - gram + 1), gram)
        self.grams = grams
        order = (grams & ~_U(2**24 - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, have = depth - gram + 1, 1
        while 2 * have <= width:
            order = np.minimum(order[:-have], order[have:])
            have *= 2
        if have < width:
            order = np.minimum(order[: len(order) - (width - have)], order[width - have :])
        anchor = (order & _U(2**24 - 1)).astype(np.int64)
        inside = doc[: self.count] == doc[depth - 1 :]
        new = np.ones(self.count, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1 : self.count] != doc[: self.count - 1]) | (inside[1:] != inside[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], self.count)
        real = inside[at]
        self.starts, self.ends, self.anchors = at[real], end[real], anchor[at[real]]  # ends: one past the last window

    def hashed(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hash of the `length` bytes at each place."""
        return _mixed((self.sums[at + length] - self.sums[at]) * self.back[at] + np.asarray(length).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def anchored(self) -> np.ndarray:
        return self.grams[self.anchors] if len(self.anchors) else np.zeros(0, np.uint64)

    def strings(self) -> np.ndarray:
        """48-bit hash of the string that holds all windows of each run."""
        return self.hashed(self.starts, self.ends - self.starts + self.depth - 1) >> _U(16) if len(self.starts) else np.zeros(0, np.uint64)


def pieces(texts: list[bytes], depth: int = DEPTH, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, number of the text of each byte, place in its text of each byte), so that each window is whole in one piece."""
    held: list[tuple[int, int, int]] = []
    room = size

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in held), np.uint8)
        lengths = [b - a for _, a, b in held]
        return data, np.repeat([i for i, _, _ in held], lengths), np.concatenate([np.arange(a, b) for _, a, b in held])

    for i, text in enumerate(texts):
        if len(text) < depth:
            continue
        for a in range(0, len(text) - depth + 1, size):
            b = min(len(text), a + size + depth - 1)
            if held and b - a > room:
                yield made()
                held, room = [], size
            held.append((i, a, b))
            room -= b - a
    if held:
        yield made()


def _least(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first, least): rows sorted by keys then doc, where a new key begins, and its least doc for each row."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def _sent(part: np.ndarray, doc: np.ndarray, fields: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """A blob for each part: ids and how many rows follow for each, then the fields."""
    order = np.lexsort((doc, part))
    part, doc, fields = part[order], doc[order], [f[order] for f in fields]
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        a, b = edges[p], edges[p + 1]
        ids, counts = np.unique(doc[a:b], return_counts=True)
        yield int(p), b"".join([np.array([len(ids), b - a], np.int64).tobytes(), ids.tobytes(), counts.astype(np.int32).tobytes(), *(f[a:b].tobytes() for f in fields)])


def _received(blobs: list[bytes], kinds: list[type]) -> tuple[np.ndarray, list[np.ndarray]]:
    docs, fields = [], [[] for _ in kinds]
    for blob in blobs:
        m, n = np.frombuffer(blob, np.int64, 2).tolist()
        docs.append(np.repeat(np.frombuffer(blob, np.int64, m, 16), np.frombuffer(blob, np.int32, m, 16 + 8 * m)))
        at = 16 + 12 * m
        for f, kind in zip(fields, kinds):
            f.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(docs, np.int64), [join(f, kind) for f, kind in zip(fields, kinds)]


def _by_doc(doc: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    ids, at = np.unique(doc, return_index=True)
    for i, v in zip(ids.tolist(), np.split(values, at[1:])):
        yield i, v.astype(np.uint64).tobytes()


#: Rows that go from map to reduce, and those that come of it. What: a "part" blob, or for a document
#: the hashes of strings or windows that repeat, or of anchors to look into.
_SENT = "part int, doc long, what string, data binary"
_FOUND = "doc long, what string, data binary"


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _rows(rows: list[tuple], sent: bool) -> pa.RecordBatch:
    names, kinds = ["part", "doc", "what", "data"], [pa.int32(), pa.int64(), pa.string(), pa.binary()]
    return _table(rows, names, kinds) if sent else _table(rows, names[1:], kinds[1:])


def _sends(batches: Iterator[pa.RecordBatch], parts: int, read: Callable, pack: Callable, n: int) -> Iterator[pa.RecordBatch]:
    """The map side of both passes: `read` gives (doc, *keys) arrays of a batch, `pack` the fields to send of the keys."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        doc, *keys = (np.concatenate(x) for x in zip(*held))
        order, new = _least(keys, doc)
        doc, keys = doc[order], [k[order] for k in keys]
        first = np.flatnonzero(new)
        least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        here = doc > least  # a smaller document of this task has it
        rows = [(int(i) % parts, i, "repeats", data) for i, data in _by_doc(doc[here], keys[-1][here])]
        doc, keys = doc[first], [k[first] for k in keys]
        part, fields = pack(keys)
        rows += [(p, None, "part", blob) for p, blob in _sent(part, doc, fields, parts)]
        for at in range(0, len(rows), 256):
            yield _rows(rows[at : at + 256], True)

    for batch in batches:
        for at in range(0, batch.num_rows, n):
            some = batch.slice(at, n)
            for arrays in read(some):
                held.append(arrays)
                size += len(arrays[0]) * 14
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """A row for each document: id, n_bytes, n_removed, kept (binary) and spans, array<struct<start, end>> of the removed runs.

    A byte goes if a window that holds it also starts in a document with a smaller id; the first
    holder of a passage keeps it. Null texts count as empty ones. Rows with the same id count as
    one document and keep what they share; a null id is greater than all others. An empty table
    gives no rows. Other columns are not read. Ids are integers.
    """
    spark = docs.sparkSession
    parts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.col(text_col).alias("text"))
    made = lambda texts: ((Windows(data, doc, depth, gram), doc, at) for data, doc, at in pieces(texts, depth))

    def anchors(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = batch.column(0).to_numpy()
        for w, doc, _ in made(_texts(batch.column(1))):
            yield ids[doc[w.starts]], w.anchored(), w.strings()

    def anchor_fields(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        a, s = keys
        return ((a >> _U(32)) % _U(parts)).astype(np.int64), [a.astype(np.uint32), (s >> _U(16)).astype(np.uint32), s.astype(np.uint16)]

    def found_anchors(table: pa.Table) -> pa.Table:
        blobs, out = _split(table)
        doc, (a, s1, s2) = _received(blobs, [np.uint32, np.uint32, np.uint16])
        s = (s1.astype(np.uint64) << _U(16)) | s2
        order, new = _least([a, s], doc)
        doc, a, s = doc[order], a[order], s[order]
        first = np.flatnonzero(new)
        least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        out += [(i, "repeats", data) for i, data in _by_doc(doc[doc > least], s[doc > least])]
        # of each string its least holder; anchors with several of them, in several documents, are looked into
        doc, a, s = doc[first], a[first], s[first]
        edge = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        if len(edge):
            size = np.diff(np.append(edge, len(a)))
            several = np.repeat(np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), size)
            out += [(i, "open", data) for i, data in _by_doc(doc[several], s[several])]
        return pa.Table.from_batches([_rows(out, False)])

    found = saved(rows.select("doc", "text").mapInArrow(lambda b: _sends(b, parts, anchors, anchor_fields, 256), _SENT).groupBy("part").applyInArrow(found_anchors, _FOUND))
    freed(spark)
    of = lambda df, what: df.where(F.col("what") == what).groupBy("doc").agg(F.collect_list("data").alias(what))

    def windows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        looked = [np.frombuffer(b"".join(x), np.uint64) for x in wanted]
        for w, doc, _ in made(_texts(batch.column(1))):
            which = _places(w, doc, looked)
            at = _ranges(w.starts[which], w.ends[which])
            yield ids[doc[at]], w.hashed(at, depth)

    def window_fields(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        return (keys[0] % _U(parts)).astype(np.int64), [keys[0]]

    def found_windows(table: pa.Table) -> pa.Table:
        blobs, out = _split(table)
        doc, (h,) = _received(blobs, [np.uint64])
        order, new = _least([h], doc)
        doc, h = doc[order], h[order]
        first = np.flatnonzero(new)
        least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        out += [(i, "repeats", data) for i, data in _by_doc(doc[doc > least], h[doc > least])]
        return pa.Table.from_batches([_rows(out, False)])

    fine = saved(rows.select("doc", "text").join(of(found, "open"), "doc").select("doc", "text", "open").mapInArrow(lambda b: _sends(b, parts, windows, window_fields, 256), _SENT).groupBy("part").applyInArrow(found_windows, _FOUND))
    freed(spark)
    marks = found.where("what <> 'open'").unionByName(fine.withColumn("what", F.lit("windows")))
    both = marks.groupBy("doc").agg(F.collect_list(F.when(F.col("what") == "repeats", F.col("data"))).alias("strings"), F.collect_list(F.when(F.col("what") == "windows", F.col("data"))).alias("windows"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield _cut(batch.column(0), _texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), made, depth, id_col)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return rows.join(both, "doc", "left").select("id", "text", "strings", "windows").mapInArrow(cut, schema)


def _split(table: pa.Table) -> tuple[list[bytes], list[tuple]]:
    """The blobs of a part, and the rows about documents, which pass."""
    blobs, out = [], []
    for _, doc, what, data in zip(*(table.column(c).to_pylist() for c in ("part", "doc", "what", "data"))):
        if what == "part":
            blobs.append(data)
        else:
            out.append((doc, what, data))
    return blobs, out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges."""
    n = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else starts, n) + np.arange(n.sum())


def _places(w: Windows, doc: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """Runs whose string is wanted in their document."""
    of, strings, out = doc[w.starts], w.strings(), np.zeros(len(w.starts), bool)
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
    for a, b in zip(edges, [*edges[1:], len(of)]):
        if len(keys := wanted[of[a]]):
            out[a:b] = np.isin(strings[a:b], keys)
    return np.flatnonzero(out)


def _cut(ids: pa.Array, texts: list[bytes], strings: list, windows: list, made: Callable, depth: int, name: str) -> pa.RecordBatch:
    strings = [np.frombuffer(b"".join(x or []), np.uint64) for x in strings]
    windows = [np.frombuffer(b"".join(x or []), np.uint64) for x in windows]
    marked = [i for i in range(len(texts)) if len(strings[i]) or len(windows[i])]
    removed: list[list[tuple[int, int]]] = [[] for _ in texts]
    some = [texts[i] for i in marked]
    for w, doc, place in made(some):
        which = _places(w, doc, [strings[i] for i in marked])
        begin, end = w.starts[which], w.ends[which] + depth - 1
        found = [(begin, end)]
        edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist()
        for a, b in zip(edges, [*edges[1:], len(doc)]):
            if len(keys := windows[marked[doc[a]]]):
                at = np.arange(a, b - depth + 1)
                hit = at[np.isin(w.hashed(at, depth), keys)]
                found.append((hit, hit + depth))
        begin, end = (np.concatenate(x) for x in zip(*found))
        for b, e in zip(begin.tolist(), end.tolist()):
            removed[marked[doc[b]]].append((int(place[b]), int(place[e - 1]) + 1))
    spans, kept = [], []
    for text, runs in zip(texts, removed):
        merged: list[list[int]] = []
        for b, e in sorted(runs):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([b, e])
        edges = [0, *(x for m in merged for x in m), len(text)]
        spans.append([{"start": b, "end": e} for b, e in merged])
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
    n = [len(t) for t in texts]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept)], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[name, "n_bytes", "n_removed", "spans", "kept"])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
