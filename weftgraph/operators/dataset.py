"""Training data from code blocks: question/answer pairs and triplets.

Random choices are made by hashing the seed with a row's key, so they don't depend on how rows lie
and need no global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import answer_language, clip, header, intent_tokens

# How questions are put. {} are language, version and intent or name.
QUESTIONS = (
    "In the {language} project ({version}), which code block handles {intent}?",
    "Which part of the {language} {version} project implements {intent}?",
    "Where can I find the implementation of {intent} in the {language} project ({version})?",
    "Show me the {intent} logic in the {language} {version} project.",
)
FALLBACKS = (
    "Where is the {name} block defined in the {language} project ({version})?",
    "Which file contains the {name} block for the {language} {version} project?",
)


def render(template: str, **columns: Column) -> Column:
    """A template with columns in its braces."""
    import string

    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] * bool(text) + ([columns[field]] if field else [])
    return F.concat(*parts)


def drawn(seed: int, *keys: Column) -> Column:
    """A number in place of a random one that every engine can compute."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *keys).cast("binary"))


def questions(limit: int) -> Column:
    """Questions about a block with columns name, language, version; the fallbacks for a name without letters or digits."""
    tokens = intent_tokens(F.col("name"))
    cols = {"language": F.col("language"), "version": F.col("version"), "intent": F.array_join(tokens, " "), "name": F.col("name")}
    of = lambda templates: F.array(*(render(t, **cols) for t in templates[:limit]))
    return F.when(F.size(tokens) > 0, of(QUESTIONS)).otherwise(of(FALLBACKS))


def answer() -> Column:
    told = header(F.col("name"), F.col("kind"), F.col("file_path"), F.col("language"), F.col("version"))
    return clip(F.concat(told, F.lit("\n\nCode:\n"), F.col("code")))


def pairs(blocks: DataFrame, per_block: int = 3, seed: int = 13) -> DataFrame:
    """(uri, n, query, answer), up to `per_block` for each block; `drawn(seed, uri)` is their random order."""
    out = blocks.select("uri", answer().alias("answer"), F.posexplode(questions(per_block)).alias("n", "query"))
    return out.withColumn("order", drawn(seed, F.col("uri"))).select("uri", "n", "query", "answer", "order")


#: Hexadecimal digits of a draw that part a group's ring: 256 arcs, as even as the draws are.
DIGITS = 2


def _other(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """For each row, with its `draw`, another row of its group: the next on a ring by draw and `order`, the first after the last.

    No square of a group, and no group in one task: the ring is cut into arcs by the draw's first
    digits, and the last row of an arc goes on with the first of the next, of which there is one
    row for each arc. Groups of one have no other; `others` tells how many there are.
    """
    arc = ["__group", "__arc"]
    rows = rows.withColumns({"__group": F.coalesce(F.concat(F.lit("="), group), F.lit("")), "__arc": F.left("draw", F.lit(DIGITS))})
    heads = rows.groupBy(*arc).agg(F.min(F.struct("draw", *order, F.col(value).alias("__value"))).alias("head"), F.count("*").alias("n"))
    ring = Window.partitionBy("__group").orderBy("__arc")  # at most 16 ** DIGITS rows of a group
    back = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("head.__value")
    heads = heads.select(*arc, F.lead(first).over(ring).alias("__after"), F.first(first).over(back).alias("__first"), (F.sum("n").over(back) - 1).alias("others"))
    within = F.lead(F.struct(value)).over(Window.partitionBy(*arc).orderBy("draw", *order))
    # dealt out as the rows are, or these would be dealt out by group to meet them
    out = rows.withColumn("__next", within).join(heads.repartition(*arc), arc)
    following = F.when(F.col("__next").isNull(), F.col("__after")).otherwise(F.col("__next")[value])
    return out.withColumn("negative", F.coalesce(following, "__first")).drop(*arc, "__next", "__after", "__first", "draw")


def triplets(blocks: DataFrame, seed: int = 13) -> DataFrame:
    """(uri, anchor, positive, negative): the negative is another block of the language; languages with one block have none."""
    rows = blocks.select("uri", "language", F.get(questions(1), F.lit(0)).alias("anchor"), answer().alias("positive"), drawn(seed, F.col("uri")).alias("draw"))
    return _other(rows, "language", ["uri"], "positive").where("others > 0").select("uri", "anchor", "positive", "negative")


def triplets_from_pairs(pairs: DataFrame, seed: int = 13) -> DataFrame:
    """(anchor, positive, negative) from (query, answer): an answer of the same language, of any other if it is alone."""
    if pairs.limit(2).count() < 2:
        raise ValueError("triplets need at least two pairs")
    draw = drawn(seed, F.concat_ws("/", "query", "answer"))
    rows = pairs.select("query", "answer", answer_language(F.col("answer")).alias("language"), draw.alias("draw"))
    same = _other(rows, "language", ["query", "answer"], "answer")
    # of the answers of other languages the least by draw; a lone row's own language has no other
    least = rows.groupBy("language").agg(F.min(F.struct(F.col("draw").alias("d"), "answer")).alias("best"))
    ends = F.sort_array(F.collect_list(F.struct("best", "language")))
    two = least.agg(F.slice(ends, 1, 2).alias("two"))  # one row
    alone = F.get(F.filter("two", lambda x: x["language"] != F.col("language")), F.lit(0))["best"]["answer"]
    out = same.crossJoin(F.broadcast(two)).withColumn("negative", F.when(F.col("others") > 0, F.col("negative")).otherwise(alone))
    return out.select(F.col("query").alias("anchor"), F.col("answer").alias("positive"), "negative")
