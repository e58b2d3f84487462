"""PII: found by form, then by what discloses it.

Addresses and numbers are found by their form. They are the protected entities. A term that is in
documents with an entity discloses it as far as knowing the term tells of the entity: with counts of
documents, the pointwise mutual information log(N n_et / (n_e n_t)) is set against the entity's
information log(N / n_e). From `generalise` of it on a term is replaced by a general one, and where
it reaches `remove` - the term tells the entity outright - it is removed, wherever it stands in any
document, whether or not that holds the entity.
All of it is built-in functions, evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import let, saved, whole

#: Kinds in the order of the contract. Each pattern finds the same places as the contract's; a
#: look-behind and possessive repeats keep long runs of letters or digits from costing their square.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must hold for a pattern to match.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
NO_TERM = r"[^\p{L}\p{M}\p{N}]+"
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Distinct texts that must hold both a term and an entity.
SUPPORT = 3
GENERALISE, REMOVE = 0.9, 1.0
#: Terms that may be broadcast, at under 100 bytes each; with more the counts are joined by shuffle.
BROADCAST = 200_000


def located(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of the leftmost non-overlapping matches, in code points."""
    kind = "array<struct<value:string,start:int,end:int>>"

    def of(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        step = lambda acc, x: let(
            acc["at"] + x["gap"],
            lambda s: F.struct((s + F.char_length(x["value"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["value"].alias("value"), s.alias("start"), (s + F.char_length(x["value"])).alias("end")))).alias("out")),
        )
        pairs = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.struct(v.alias("value"), F.char_length(g).alias("gap")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.when(F.size(values) > 0, F.aggregate(pairs, none, step)["out"]).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"),
        "card": F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (place in KINDS), end, value>> of all kinds, by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def of(i: int, kind: str) -> Column:
        kept = F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
        spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
        return F.when(F.contains(text, F.lit(HINTS[kind])), spans).otherwise(none) if kind in HINTS else spans

    found = [of(i, kind) for i, kind in enumerate(KINDS)]
    return F.sort_array(F.concat(*found))


def _entity(kind: Column, value: Column) -> Column:
    same = F.when(kind.isin(KINDS.index("card"), KINDS.index("phone")), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value))
    return F.concat_ws(":", kind.cast("string"), same)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, key, spans, terms) for all documents; key is the MD5 of the text, each span has its entity; terms, where there are spans, are those outside them."""
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("__text"))
    rows = rows.select("id", "__text", F.md5(text.cast("binary")).alias("key"), base_spans(text).alias("spans"))
    full = F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"], _entity(x["kind"], x["value"]).alias("entity")))
    outside = _rewritten(text, F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(" ").alias("put"))))
    terms = F.filter(F.array_distinct(F.split(F.lower(outside), NO_TERM)), lambda t: F.char_length(t) >= 3)
    held = F.size("spans") > 0
    kind = "array<struct<start:int,end:int,kind:int,entity:string>>"
    return saved(rows.select("id", "key", F.when(held, full).otherwise(F.array()).cast(kind).alias("spans"), F.when(held, terms).alias("terms")))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """Which terms disclose: (entity, term, disclosure).

    N and the counts are documents; a pair needs `support` different texts, so copies alone never make one.
    """
    held = found.where(F.size("spans") > 0).select("key", F.array_distinct("spans.entity").alias("entities"), "terms")
    texts = saved(held.groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    n = F.lit(found.count())
    # no pair has more texts than its entity
    entities = saved(texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_e")).where(F.col("texts") >= support).drop("texts"))
    # log(n / n_e) is 0 for an entity that all documents hold: then no term can tell more of it
    score = lambda n_et, n_t: F.log(n * n_et / (F.col("n_e") * n_t)) / F.nullif(F.log(n / F.col("n_e")), F.lit(0.0))
    # a term is in at least the documents that hold it and any entity, and with an entity in at most n_e:
    # what these bounds leave out can't disclose, and common words need no count over the corpus
    most = entities.agg(F.max(F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - generalise)))).first()[0] or 0.0
    each = texts.select("copies", "entities", F.explode("terms").alias("term"))
    near = each.groupBy("term").agg(F.count("*").alias("texts"), F.sum("copies").alias("least")).where((F.col("texts") >= support) & (F.col("least") <= most + 1e-6)).drop("texts")
    both = each.join(near, "term").select("copies", "term", "least", F.explode("entities").alias("entity")).join(entities, "entity").where(score(F.col("n_e"), F.col("least")) >= generalise - 1e-9)
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_et"), F.first("n_e").alias("n_e"), F.first("least").alias("least"))
    pairs = saved(pairs.where((F.col("texts") >= support) & (score(F.col("n_et"), F.col("least")) >= generalise)).drop("texts", "least"))
    wanted = saved(pairs.select("term").distinct())
    tokens = F.array_distinct(F.split(F.lower(whole(text_col)), NO_TERM))
    counted = docs.select(F.explode(tokens).alias("term")).join(_bounded(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    return saved(pairs.join(counted, "term").select("entity", "term", score(F.col("n_et"), F.col("n_t")).alias("disclosure")).where(F.col("disclosure") >= generalise))


def _bounded(terms: DataFrame) -> DataFrame:
    """Terms, one row each, broadcast if they may be."""
    return F.broadcast(terms) if terms.count() <= BROADCAST else terms


def marked(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, terms) for each text that holds any of `terms` (term, disclosure): all their places, with what they disclose."""
    text = whole(text_col)
    rows = docs.select(F.md5(text.cast("binary")).alias("key"), text.alias("__text"))
    told = F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))
    hits = rows.select("key", F.posexplode(F.transform(told, lambda t: F.lower(t))).alias("i", "term")).join(_bounded(terms), "term").groupBy("key").agg(F.collect_set(F.struct("i", "disclosure")).alias("hits"))
    # a word begins after all words before it and the gaps up to it
    sizes = F.zip_with(F.transform(told, lambda t: F.char_length(t)), F.transform(F.split("__text", WORD, -1), lambda g: F.char_length(g)), lambda w, g: F.struct(F.coalesce(w, F.lit(0)).alias("w"), g.alias("g")))

    def place(s: Column, x: Column) -> Column:
        before = F.aggregate(F.slice(s, F.lit(1), x["i"]), F.lit(0), lambda at, y: at + y["w"] + y["g"])
        return let(before + F.get(s, x["i"])["g"], lambda at: F.struct(at.alias("start"), (at + F.get(s, x["i"])["w"]).alias("end"), x["disclosure"].alias("disclosure")))

    places = let(F.struct(sizes.alias("s"), F.col("hits").alias("h")), lambda b: F.transform(b["h"], lambda x: place(b["s"], x)))
    return rows.join(hits, "key").select("key", F.sort_array(places).alias("terms")).dropDuplicates(["key"])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, key, base (spans of KINDS) and terms (spans of disclosing terms, with disclosure).

    Null texts count as empty ones and have no spans. Disclosing terms are marked in all documents,
    but not inside a span of KINDS, which has its own. Repeated rows each get a row; an
    empty table gives none. Other columns are not read.
    """
    found = detect(docs, id_col, text_col)
    terms = saved(disclosing(docs, found, text_col).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    marks = marked(docs, terms, text_col).withColumnRenamed("terms", "marks")
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    free = let(F.struct("base", "marks"), lambda b: F.filter(b["marks"], lambda t: ~F.exists(b["base"], lambda y: (t["start"] < y["end"]) & (t["end"] > y["start"]))))
    joined = found.select(F.col("id").alias(id_col), "key", base.alias("base")).join(marks, "key", "left")
    return joined.select(id_col, "key", "base", F.when(F.col("marks").isNotNull(), free).otherwise(none).alias("terms"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from `spans`."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    told = lambda k, x: F.concat_ws(":", k, x["start"].cast("string"), x["end"].cast("string"))
    base = F.transform("base", lambda x: told(name(x["kind"]), x))
    placed = lambda x, kind: F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"))
    merged = F.sort_array(F.concat(F.transform("base", lambda x: placed(x, x["kind"])), F.transform("terms", lambda x: placed(x, F.lit(len(KINDS))))))
    everything = F.transform(merged, lambda x: told(F.when(x["kind"] == len(KINDS), F.lit("term")).otherwise(name(F.least(x["kind"], F.lit(len(KINDS) - 1)))), x))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(everything, ",").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def _rewritten(text: Column, merged: Column) -> Column:
    """The text with its spans (start, end, put) replaced; where spans overlap, the later ones begin where the last ended."""
    step = lambda acc, x: F.when(
        x["end"] > acc["at"],
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"])), x["put"])).alias("out")),
    ).otherwise(acc)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return let(F.aggregate(merged, start, step), lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE) -> DataFrame:
    """`docs` with the spans of their texts replaced: entities by their kind, terms by [TERM] or nothing; other columns stay, whatever their names.

    Texts without a span, null ones too, are as they were. Repeated rows are each rewritten; an empty table gives none.
    """
    found = spans(docs, id_col, text_col).where("size(base) > 0 or size(terms) > 0").select("key", "base", "terms").dropDuplicates(["key"])
    put = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), x["kind"] + 1).alias("put")))
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["disclosure"] >= remove, F.lit("")).otherwise(F.lit("[TERM]")).alias("put")))
    found = found.select("key", F.sort_array(F.concat(put, terms)).alias("put"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    text = F.col("doc")[text_col]
    joined = rows.withColumn("key", F.md5(text.cast("binary"))).join(found, "key", "left")
    new = F.when(F.col("put").isNull(), text).otherwise(_rewritten(text, F.col("put")))
    return joined.select(*((new if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns))
