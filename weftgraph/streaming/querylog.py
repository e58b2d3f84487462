"""The query log as a stream: records are appended, and what they suggest is kept up to date."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftgraph import vocab
from weftgraph.operators import cooccur
from weftgraph.sources import records


class QueryLogger:
    """Appends records; from `batch_size` on each new one is followed by an analysis, whose suggestions are returned."""

    def __init__(self, spark: SparkSession, path: str, batch_size: int = 100, window: int = 5):
        self.spark, self.path, self.batch_size, self.window = spark, path, batch_size, window

    def log(self, query: str, session_id: str, result_uris: list[str], top_k: int) -> DataFrame | None:
        records.append(self.spark, self.path, [records.record(query, session_id, result_uris, top_k)])
        return self.analyze() if records.count(self.spark, self.path) >= self.batch_size else None

    def analyze(self) -> DataFrame:
        return cooccur.analyze(records.read_log(self.spark, self.path), self.window)


class SearchStatistics:
    """Appends what was searched for; at `batch_size` lines the statistics are handed over and archived."""

    def __init__(self, spark: SparkSession, path: str, batch_size: int = 100):
        self.spark, self.path, self.batch_size = spark, path, batch_size

    def log(self, query_type: str, value: str, nodes: list[str], analyze: Callable[[], object] | None = None) -> str | None:
        now = datetime.now()
        records.append(self.spark, self.path, [(now.isoformat(), query_type, value, nodes)], vocab.SEARCH_STATS)
        if records.count(self.spark, self.path) < self.batch_size:
            return None
        if analyze:
            analyze()
        return records.archive(self.spark, self.path, now.strftime(".%Y%m%d_%H%M%S"))


def follow(spark: SparkSession, source: str, sink: Callable[[DataFrame, int], None], checkpoint: str, window: int = 5, every: int = 100) -> StreamingQuery:
    """A stream over a folder of JSON lines. When at least `every` new records have come, all are analysed again.

    The window runs over a session's records in order of time, so a late one changes pairs that
    were counted before; to count anew from the log is exact whatever comes late.
    """
    since = {"n": 0}

    def batch(df: DataFrame, number: int) -> None:
        since["n"] += df.count()
        if since["n"] >= every:
            since["n"] = 0
            sink(cooccur.analyze(records.read_log(spark, source), window), number)

    stream = spark.readStream.schema(vocab.QUERY_LOG).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
