"""Source trees: <root>/<language>/<version>/... as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 if they aren't."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def files(spark: SparkSession, root: str, separator: str = "/") -> DataFrame:
    """(language, version, path, text) of all files under a tree; the path is relative to the root."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.substring_index("path", root.rstrip("/") + "/", -1)
    parts = F.split(inside, "/")
    rows = read.select(parts[0].alias("language"), parts[1].alias("version"), inside.alias("inside"), F.size(parts).alias("n"), "content")
    # a file directly under a language belongs to no version
    return rows.where("n > 2").select("language", "version", F.translate("inside", "/", separator).alias("path"), decoded(F.col("content")).alias("text"))


def snippet(spark: SparkSession, path: str, description: str) -> dict[str, str]:
    """A new block's file and description; an error if either is blank or the file is missing."""
    if not description.strip():
        raise ValueError("the description is empty")
    text = spark.read.text(path, wholetext=True).first()
    if text is None or not text[0].strip():
        raise ValueError(f"{path} is empty")
    return {"code": text[0], "description": description.strip(), "file_path": path}
