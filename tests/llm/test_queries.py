"""Every registered query of the operators, whole, on the smallest tables, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from test_em import plain
from test_operators import FORMS, base_spans, classes, cut, fingerprint, likeness, lower, measures, plain_sketch, targets, told, words
from weftgraph.llm import licenses, quality, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


def test_op1(run, table):
    got = sorted(run("op1_quality"), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got] == [(d["doc_id"], *measures(d["text"])[:5]) for d in table]
    p = plain([[r[f"vote_{x.name}"] for x in quality.RULES] for r in got], quality.RULES)
    for r, q in zip(got, p):
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert abs(r["quality"] - q) < 1e-5 and r["kept"] == (not r["base_failed"] and q >= 0.5)


def test_op2(run, table):
    want, seen, encoder = defaultdict(lambda: [0, 0, 0]), set(), tokens.encoder()
    for d in table:
        t = d["text"] or ""
        rows = [("words-2", len(words(t)))] + ([("bpe-50k-1", len(encoder.encode_ordinary(t)))] if t not in seen else [])
        seen.add(t)
        for tokenizer, n in rows:
            g = want[d["source"], d["lang"], tokenizer]
            g[0], g[1], g[2] = g[0] + 1, g[1] + len(t), g[2] + n
    got = run("op2_tokens")
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_chars"], r["n_tokens"]] for r in got} == dict(want) and len(got) == len(want)


def test_op3(run, table):
    want = {}
    for d in table:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"]))
        places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        want[d["doc_id"]] = (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
    got = run("op3_licenses")
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == want and len(got) == len(table)
    for r in got:
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels) and 0 <= r["score"] <= 1


def test_op4(run, table):
    lengths = Counter(len(words(d["text"])) for d in table)
    at = sorted(lengths)
    c, s = [0], [0]
    for x in at:
        c.append(c[-1] + lengths[x])
        s.append(s[-1] + lengths[x] * x)
    best, least = [0] + [float("inf")] * len(at), float("inf")
    for _ in range(16):
        best = [float("inf")] + [min(best[i] + at[j - 1] * (c[j] - c[i]) - (s[j] - s[i]) for i in range(j)) for j in range(1, len(at) + 1)]
        least = min(least, best[-1])
    got = run("op4_packing")
    assert Counter(r["n_words"] for r in got) == lengths and len({r["doc_id"] for r in got}) == len(table)
    assert sum(r["padding"] for r in got) == least and len({r["bucket"] for r in got}) <= 16
    held = defaultdict(list)
    for r in got:
        assert r["padding"] == r["boundary"] - r["n_words"] >= 0
        held[r["bucket"], r["batch"]].append(r)
    assert all(sorted(r["slot"] for r in h) == list(range(len(h))) and (len(h) == 1 or len(h) * h[0]["boundary"] <= 65_536) for h in held.values())


def test_op5(run, table):
    names = list(FORMS)
    got = {r["doc_id"]: r for r in run("op5_pii")}
    assert len(got) == len(table)
    for d in table:
        spans, r = base_spans(d["text"]), got[d["doc_id"]]
        base = [f"{names[k]}:{s}:{e}" for s, k, e in spans]
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert [x for x in every if not x.startswith("term:")] == base and r["n_term"] == len(every) - len(base)
        order = [(int(x.split(":")[1]), [*names, "term"].index(x.split(":")[0])) for x in every]
        assert order == sorted(order)


def test_op6(run, table):
    want = {i: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, n, gone, runs, kept in cut([(d["doc_id"], (d["text"] or "").encode()) for d in table])}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op6_suffix")} == want


def test_op7(run, table):
    fps = [(d["doc_id"], fingerprint(d["text"])) for d in table]
    want = {(i, f"{fp:016x}", c) for (i, fp), c in zip(fps, classes(fps))}
    got = run("op7_simhash")
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == want and len(got) == len(table)


def test_op8(run, table):
    got = {r["doc_id"]: r for r in run("op8_fingerprints")}
    assert len(got) == len(table)
    for n, d in enumerate(table):
        t, after = d["text"] or "", table[(n + 1) % len(table)]["text"] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c, r = plain_sketch(t), plain_sketch(edited), plain_sketch(after), got[d["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (told(a), told(b))
        assert abs(r["near_edited"] - likeness(a, b)) < 1e-12 and abs(r["near_next"] - likeness(a, c)) < 1e-12
        held = len(set(a[0]) & set(b[0])) / len(a[0]) if a[0] else (1.0 if a[1] is None else None)
        assert r["contained_edited"] == held or abs(r["contained_edited"] - held) < 1e-12


def test_op9(run, table):
    got = run("op9_sharding")
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in table} and len(got) == len(table)
    where, total = defaultdict(set), sum(r["size"] for r in got)
    groups = Counter()
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
        groups[r["text_crc32"]] += 1
    rows_fit = len(got) / 16
    assert all(len(s) == 1 for c, s in where.items() if groups[c] <= rows_fit)
    for s in range(16):
        held = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        assert abs(sum(r["size"] for r in held) - total / 16) < 0.1 * total / 16
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_op10(run, table):
    got = {r["doc_id"]: r for r in run("op10_mixing")}
    sizes, taken, most = Counter(), Counter(), {}
    for d in table:
        sizes[d["source"]] += len(words(d["text"]))
    want = targets(dict(sizes))
    for d in table:
        r = got[d["doc_id"]]
        assert r["size"] == len(words(d["text"])) and r["source_size"] == sizes[d["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - want[d["source"]]) < 1e-6 * want[d["source"]]
        taken[d["source"]] += r["taken"]
        most.setdefault(d["source"], []).append(r["size"])
    # off by no more than half of the median document
    assert all(abs(taken[s] - t) <= sorted(most[s])[len(most[s]) // 2] / 2 + 1 for s, t in want.items())


def test_pipeline_runs_whole(spark, table):
    import corpus_pipeline

    got = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    clean = {d["doc_id"] for d in table if len(words(d["text"])) >= 20}
    assert got and {r["doc_id"] for r in got} <= clean
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == len(got) and max(Counter(r["doc_id"] for r in got).values()) <= 3
