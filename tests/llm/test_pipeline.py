"""The stages one after another, each against a plain version of what it decides."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import base_spans, measures, shingles, targets, words
from weftgraph.llm import queries, stages


def rows(df):
    return [r.asDict() for r in df.collect()]


def first_of_each(kept):
    """(id, text) of the least id of each group by four fifths of the shingles."""
    texts = sorted({t for _, t in kept})
    parent = {t: t for t in texts}
    sets = {t: shingles((t or "").lower()) for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i, t in kept:
        groups[root(t)].append((i is None, i or 0, minhash_key(t), i, t))
    return [min(g)[3:] for g in groups.values()]


def minhash_key(t):
    return hashlib.md5((t or "").encode()).digest()


def test_stages(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    given = docs.select(columns)
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, "").write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        held[name] = rows(given)
        if name != "packing":
            assert given.columns == columns
    kept = held["quality_rules"]
    for r in kept:
        n, _, _, _, again, _ = measures(r["text"])
        assert n >= 20 and 100 * again <= 30 * n
    assert Counter((r["doc_id"], r["text"]) for r in held["near_dedup"]) == Counter(first_of_each([(r["doc_id"], r["text"]) for r in kept]))
    before = defaultdict(list)
    for r in held["near_dedup"]:
        before[r["doc_id"]].append(r["text"])
    for r in held["personal_data"]:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] in before[r["doc_id"]] or any(map(base_spans, before[r["doc_id"]]))
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in held["personal_data"]:
        sizes[r["source"]] += len(words(r["text"]))
        most[r["source"]] = max(most[r["source"]], len(words(r["text"])))
    for r in held["mix_sources"]:
        taken[r["source"]] += len(words(r["text"]))
    rows_of = Counter((r["doc_id"], r["text"]) for r in held["personal_data"])
    assert all(n <= 3 * rows_of[k] for k, n in Counter((r["doc_id"], r["text"]) for r in held["mix_sources"]).items())
    copies = Counter(r["doc_id"] for r in held["mix_sources"])
    for s, t in targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= most[s]
    assert Counter(r["doc_id"] for r in held["packing"]) == copies
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in held["packing"]}) == len(held["packing"])


def test_stages_take_no_rows(spark, none):
    given = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, given, "").count() == 0


def test_repeated_ids_are_decided_row_by_row(spark):
    rows_ = [(1, "alpha beta " * 30, "en", "a", 1), (1, "gamma delta " * 40, "en", "a", 1), (None, "epsilon " * 25, "en", None, 1), (None, "epsilon " * 25, "en", None, 1)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in stages.mix_sources(spark, df, "").collect()} <= {1, None}
    # the two texts of id 1 are unlike, so both stay; the copies without an id are one
    assert Counter((r["doc_id"], r["text"]) for r in stages.near_dedup(spark, df, "").collect()) == Counter((i, t) for i, t, *_ in rows_[:3])


def test_callers_columns_survive_every_stage(spark, docs):
    given = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in ("__k", "__id", "__d", "__n", "__text", "doc", "component", "copies", "size")))
    others = [c for c in given.columns if c not in ("text", "n_chars")]
    rows_ = Counter(map(str, given.select(others).collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, "")
        assert out.columns == given.columns, name
        held = Counter(map(str, out.select(others).collect()))
        assert held and (set(held) <= set(rows_) if name == "mix_sources" else held <= rows_), name


def test_repeated_rows_are_mixed_one_by_one(spark):
    rows_ = [(1, "alpha beta " * 30, "en", "a", 1)] * 3 + [(1, "alpha beta " * 30, "en", "b", 2)] * 2 + [(None, "gamma " * 9, "en", None, 1)] * 4 + [(i, f"text {i} " * (i % 7 + 1), "en", "ab"[i % 2], i) for i in range(2, 60)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = stages.mix_sources(spark, df, "").collect()
    sizes, taken = Counter(), Counter()
    for i, t, _, s, _ in rows_:
        sizes[s] += len(words(t))
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
    assert set(map(tuple, got)) <= set(rows_)
    assert all(abs(taken[s] - t) <= 30 for s, t in targets(dict(sizes)).items())


def test_queries_are_registered():
    named = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in named} == set(range(1, 11)) and len(named) == 10
