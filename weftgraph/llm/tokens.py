"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A change of the corpus is a set of signed rows: an inserted document counts +1, a deleted one -1,
a revised count is the old row with -1 and the new one with +1. A batch is aggregated by group
before anything is written, so what a commit adds is as large as the list of groups, not as the
corpus. A batch is committed once and counts once: to retry it, after a lost driver too, is
harmless. Totals are additive, so batches are added up into a base from time to time.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import n_words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_chars", "n_tokens")


@lru_cache(4)
def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Code points after which a text may be cut without changing its tokens: before a blank that
#: follows a letter or digit. Cuts bound the time a very long text takes at once.
_CUT = re.compile(r"(?<=\w)(?= \w)")
LONG = 1 << 16


def count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; 0 for a null."""
    enc, total, at = encoder(vocabulary), 0, 0
    text = text or ""
    while len(text) - at > LONG and (cut := _CUT.search(text, at + LONG)):
        total += len(enc.encode_ordinary(text[at : cut.start()]))
        at = cut.start()
    return total + len(enc.encode_ordinary(text[at:]))


def counted(docs: DataFrame, tokenizer: str = "bpe-50k-1", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """A row for each document: id, source, lang, tokenizer, n_chars, n_tokens and `extra` columns over the document. Null texts count 0 characters and tokens."""
    more = docs.select(*(c.alias(n) for n, c in extra.items())).schema.fields
    names = [id_col, "source", "lang", "n_chars", "n_tokens", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(3).to_pylist()]
            numbers = [pa.array(list(map(len, texts)), pa.int64()), pa.array([count(x, vocabulary) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *numbers, *b.columns[4:]], names=names)

    rows = docs.select(F.col(id_col), "source", "lang", F.col(text_col), *(c.alias(n) for n, c in extra.items()))
    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, source string, lang string, n_chars long, n_tokens long", *(f"{f.name} {f.dataType.simpleString()}" for f in more)])
    return rows.mapInArrow(run, schema).withColumn("tokenizer", F.lit(tokenizer))


def counted_words(docs: DataFrame, tokenizer: str = "words-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `counted`, by the white-space tokenizer, with built-in functions."""
    return docs.select(F.col(id_col), "source", "lang", F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"), n_words(F.col(text_col)).alias("n_tokens"), F.lit(tokenizer).alias("tokenizer"))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Counted rows as a delta: 1 for inserts, -1 for deletes."""
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_chars")).alias("n_chars"), (sign * F.col("n_tokens")).alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta from the old counted rows of some documents to the new ones."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals in a folder that all executors share.

    A batch is written to a folder of its own in data/, whose name is then put into the file
    commits/<batch>, which can be made only once: of several writers of a batch, also at the same
    time, one commits. `compact` adds committed batches up into a base; bases/<n> names its folder
    and the batches that it holds, so a reader that comes in between counts none twice, and their
    marks go to merged/. Totals read the last base and the batches since.

    Groups with a null source or language are groups like others. A batch without rows commits
    nothing but its mark. Repeated rows of a batch each count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path, self._once = hadoop.Path, hadoop.FileContext
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = hadoop.Path(self.path).getFileSystem(self._conf)

    def _named(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"a batch id has letters, digits, '_', '.' and '-': {batch!r}")
        return batch

    def _exists(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.path}/{name}"))

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(n for s in (self._files.listStatus(at) if self._files.exists(at) else []) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _read(self, names: list[str]) -> list[str]:
        """The lines of small files."""
        return [r["value"] for r in self.spark.read.text([f"{self.path}/{n}" for n in names]).collect()] if names else []

    def _mark(self, name: str, lines: list[str]) -> bool:
        """Make a file with these lines; False if there is one of its name."""
        at, own = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/.{uuid.uuid4()}")
        out = self._files.create(own, False)
        out.write("\n".join(lines).encode())
        out.close()
        self._files.mkdirs(at.getParent())
        try:
            none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._once.getFileContext(at.toUri() if at.toUri().getScheme() else self._files.getUri(), self._conf).rename(own, at, none)
        except Py4JJavaError as e:
            self._files.delete(own, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def committed(self, batch: str) -> bool:
        return self._exists(f"commits/{self._named(batch)}") or self._exists(f"merged/{batch}")

    def _written(self, sums: DataFrame, name: str) -> str:
        folder = f"data/{name}-{uuid.uuid4()}"
        sums.coalesce(1).write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch of signed rows; False, and nothing changes, if it was committed before."""
        if self.committed(batch):
            return False
        folder = self._written(_summed(delta), batch)
        if self._mark(f"commits/{batch}", [folder]):
            return True
        self._files.delete(self._path(f"{self.path}/{folder}"), True)
        return False

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted({*self._list("commits"), *self._list("merged")})

    def _live(self) -> tuple[list[str], list[str], list[str]]:
        """Folder of the last base, if any; batches that it holds whose marks are not yet put away; batches since."""
        bases = sorted(self._list("bases"), key=int)
        base, *held = self._read([f"bases/{bases[-1]}"]) if bases else [None]
        commits = self._list("commits")
        return [base] if base else [], [b for b in commits if b in set(held)], [b for b in commits if b not in set(held)]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_chars, n_tokens) over the committed batches; groups left without documents are gone."""
        base, _, since = self._live()
        return self._sums(base + self._read([f"commits/{b}" for b in since])).where("n_docs <> 0")

    def _sums(self, folders: list[str]) -> DataFrame:
        kinds = f"{', '.join(f'{c} string' for c in GROUP)}, {', '.join(f'{c} long' for c in SUMS)}"
        if not folders:
            return self.spark.createDataFrame([], kinds)
        return _summed(self.spark.read.schema(kinds).parquet(*(f"{self.path}/{f}" for f in folders)))

    def compact(self) -> int:
        """Add the batches since the last base up into a new one; how many they were. Of several at the same time, one takes effect."""
        base, stale, since = self._live()
        for b in stale:  # a compaction that was cut off
            self._put_away(b)
        if not since:
            return 0
        number = max(map(int, self._list("bases")), default=0) + 1
        folder = self._written(self._sums(base + self._read([f"commits/{b}" for b in since])).where("n_docs <> 0 or n_chars <> 0 or n_tokens <> 0"), "base")
        if not self._mark(f"bases/{number}", [folder, *since]):
            self._files.delete(self._path(f"{self.path}/{folder}"), True)
            return 0
        for b in since:
            self._put_away(b)
        return len(since)

    def _put_away(self, batch: str) -> None:
        self._files.mkdirs(self._path(f"{self.path}/merged"))
        self._files.rename(self._path(f"{self.path}/commits/{batch}"), self._path(f"{self.path}/merged/{batch}"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))


def follow(stream: DataFrame, rollup: Rollup, checkpoint: str):
    """Commit each micro-batch of a stream of signed rows; a batch that is replayed after a failure counts once.

    Batches are named after an id that is kept in the checkpoint, so those of another stream, or of
    one begun anew with a new checkpoint, are batches of their own.
    """
    spark = rollup.spark
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/rollup/{uuid.uuid4()}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at.getParent()) or not files.listStatus(at.getParent()):
        files.create(at, False).close()
    own = min(s.getPath().getName() for s in files.listStatus(at.getParent()) if not s.getPath().getName().startswith("."))
    return stream.writeStream.foreachBatch(lambda df, n: rollup.commit(f"{own}-{n}", df)).option("checkpointLocation", checkpoint)
