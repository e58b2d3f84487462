"""The near-dedup stage against all pairs by their shingles."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import shingles
from weftgraph.llm import common, minhash, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_near_means_four_fifths_of_the_shingles(spark):
    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for edits in (1, 3, 4, 5, 9):  # of 200 words; four leave 0.815, five 0.77
        base = draw(200)
        texts += [base, [f"e{i}" if i % 20 == 10 and i // 20 < edits else w for i, w in enumerate(base)]]
    chain = draw(200)  # each the next one's near copy, the ends not
    texts += [[f"c{i}" if i % 20 == 10 and i // 20 < edits else w for i, w in enumerate(chain)] for edits in (0, 3, 6, 9)]
    texts = [" ".join(t) for t in texts]
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = shingles(texts[a]), shingles(texts[b])
            if len(x & y) >= 0.8 * len(x | y):
                parent = [parent[b] if p == parent[a] else p for p in parent]
    first = {p: min(i for i, q in enumerate(parent) if q == p) for p in parent}
    got = stages.near_dedup(spark, frame(spark, list(enumerate(texts))), "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(first.values()) and len(first) == 8


def test_rows_not_ids_are_decided(spark):
    text = lambda w, n=30: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (None, text("f")), (None, text("f")), (None, text("b")), (None, None), (None, ""), (8, text("g")), (8, text("g"))]
    got = stages.near_dedup(spark, frame(spark, rows), "").collect()
    want = [(1, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (None, text("f")), (8, text("g"))]
    assert Counter((r["doc_id"], r["text"]) for r in got if r["text"]) == Counter(want)
    assert sum(not r["text"] for r in got) == 1


def test_a_crowd_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(1, 7)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
        texts.append(" ".join(t))
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent = [parent[b] if p == parent[a] else p for p in parent]
    got = stages.near_dedup(spark, frame(spark, list(enumerate(texts))), "").collect()
    want = {min(i for i, q in enumerate(parent) if q == p) for p in parent}
    assert {r["doc_id"] for r in got} == want and 1 < len(want) < len(texts)


def test_parity_is_a_lower_bound():
    rng = random.Random(4)
    for _ in range(50):
        a, b = (np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(0, 300))], np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate((a[: len(a) // 2], b)))
        differ = int(np.bitwise_count((minhash.parity(a) ^ minhash.parity(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (len(a) > 0 or differ <= len(b))


def test_passes_that_are_over_hold_no_shuffle_files(spark, monkeypatch):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"e{rng.randrange(400)}" if rng.random() < 0.02 else w for w in base) for _ in range(40)]
    docs = frame(spark, list(enumerate(texts))).select(minhash.key(F.col("text")).alias("key"), "text")
    common.freed(spark)
    before, counts = held(), []
    cut = minhash.saved
    monkeypatch.setattr(minhash, "saved", lambda df: (cut(df), counts.append(held() - before))[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # joins shuffle, as those of large tables do
    try:
        found = minhash.components(docs)
        left = held() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count() == len(set(texts))
    assert left <= 3 and max(counts) <= 60, (left, counts)
