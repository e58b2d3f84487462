"""JSON lines and arrays: query logs, search statistics, question/answer pairs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import vocab

LOG_KEYS = ["query", "result_uris", "session_id", "timestamp", "top_k"]


def append(spark: SparkSession, path: str, rows: list[tuple], schema: str = vocab.QUERY_LOG) -> None:
    """Append records as JSON lines."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def record(query: str, session_id: str, result_uris: list[str], top_k: int) -> tuple:
    return (time.time(), query, session_id, result_uris, top_k)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The well-formed records: blank and broken lines, and those with other keys, are left out."""
    text = spark.read.text(path).where(F.trim("value") != "")
    keys = F.sort_array(F.json_object_keys("value"))
    parsed = text.where(keys == F.array(*map(F.lit, LOG_KEYS))).select(F.from_json("value", vocab.QUERY_LOG, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where(F.col("r").isNotNull()).select("r.*")


def count(spark: SparkSession, path: str) -> int:
    """Lines, blank ones too."""
    return spark.read.text(path).count()


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    files, of = _files(spark, path)
    return files.exists(of(path))


def archive(spark: SparkSession, path: str, suffix: str = ".processed") -> str:
    """Rename a log, so that the next record begins a new one."""
    files, of = _files(spark, path)
    target = path.rstrip("/") + suffix
    if files.exists(of(target)):
        files.delete(of(target), True)
    files.rename(of(path), of(target))
    return target


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, answer) of a JSON array, or of JSON lines; entries without both as strings are left out, and an error if none is left.

    An array is one value and so one task's load; lines are read in splits, and what `write_pairs` makes.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.select(F.left(F.trim("value"), F.lit(1))).first()
    if not first or first[0] not in "[{":
        raise ValueError(f"{path} holds no list")
    if first[0] == "[":
        items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("x"))
    else:
        items = lines.select(F.col("value").alias("x"))
    # only a string keeps its quotes in the raw value
    field = lambda k: F.get_json_object("x", f"$.{k}")
    quoted = lambda k: F.regexp_like("x", F.lit(rf'"{k}"\s*:\s*"'))
    out = items.where(quoted("query") & quoted("answer")).select(field("query").alias("query"), field("answer").alias("answer"))
    if out.isEmpty():
        raise ValueError(f"{path} holds no pair of a query and an answer")
    return out


def write_pairs(pairs: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines in a folder, written in parallel; or one JSON array, for readers that want a single value, by one task that holds a row at a time."""
    if not array:
        pairs.select("query", "answer").write.mode("overwrite").json(path)
        return
    items = pairs.select(F.to_json(F.struct("query", "answer")).alias("value")).coalesce(1)
    items = items.select(F.concat(F.when(F.monotonically_increasing_id() == 0, F.lit("[")).otherwise(","), "value").alias("value"))
    end = pairs.sparkSession.createDataFrame([("]",)], "value string")
    items.union(end).coalesce(1).write.mode("overwrite").text(path)
