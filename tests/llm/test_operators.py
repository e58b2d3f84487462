"""Each operator against a plain Python version, on documents with all that may go wrong, and on none."""

import functools
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import common, licenses, mixing, packing, pii, quality, sharding, simhash, sketch, suffix, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def source(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# -- quality -----------------------------------------------------------------------------------------


def measures(t):
    t = t or ""
    w = words(t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(w, w[1:])))


def test_quality_measures(docs):
    got = quality.score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echoes", "base_failed", "kept").collect()
    assert Counter((r[0], *r[1:7]) for r in got) == Counter((i, *measures(t)) for i, t in source(docs))
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_quality_verdicts(docs, none):
    kept = {r["doc_id"] for r in quality.keep(docs).collect()}
    texts = dict(source(docs))
    faults = {i for i, t in texts.items() if t and re.search(r"SHOUT!!|odd\*\*\*|\|", t)}
    assert faults and not faults & kept
    assert {i for i in range(30) if len(words(texts[i])) >= 40} <= kept
    assert quality.keep(docs).columns == docs.columns
    assert quality.score(none).count() == quality.keep(none).count() == 0


def test_em_learns_which_rule_to_believe(spark):
    rules = (quality.Rule("a", "false"), quality.Rule("b", "false"), quality.Rule("c", "false"))
    votes = [((0, 0, 0), 800), ((-1, 0, 0), 60), ((0, -1, 0), 60), ((-1, -1, 0), 10), ((0, 0, 1), 70)]
    df = spark.createDataFrame([v for v, n in votes for _ in range(n)], "vote_a int, vote_b int, vote_c int")
    model = quality.fit(df, rules)
    p = {tuple(r)[:3]: r["p"] for r in df.distinct().withColumn("p", model.posterior(rules)).collect()}
    assert p[0, 0, 0] > 0.9 and p[-1, 0, 0] < 0.5 and p[-1, -1, 0] < p[-1, 0, 0]
    assert abs(model.good + sum(model.kinds) - 1) < 1e-6


# -- token counts ------------------------------------------------------------------------------------


def test_token_rollup(spark, docs, none, tmp_path):
    encoder = tokens.encoder()
    counted = tokens.counted(docs, "t1")
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counted.collect()) == Counter((i, len(encoder.encode_ordinary(t or ""))) for i, t in source(docs))
    rollup = tokens.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("1", tokens.signed(counted, 1)) and not rollup.commit("1", tokens.signed(counted, 1))
    some = counted.where("doc_id < 10")
    rollup.commit("2", tokens.signed(some, -1))
    rollup.commit("3", tokens.revised(counted.where("doc_id >= 10 and doc_id < 20"), counted.where("doc_id >= 10 and doc_id < 20").withColumn("tokenizer", F.lit("t2"))))
    assert rollup.commit("4", tokens.signed(tokens.counted(none, "t1"), 1)) and rollup.batches() == ["1", "2", "3", "4"]
    tokens.signed(some, 1).write.parquet(str(tmp_path / "r/data/5-x"))  # a batch that was cut off
    assert rollup.batches() == ["1", "2", "3", "4"]
    before = Counter(map(tuple, rollup.totals().collect()))
    assert rollup.compact() == 4 and rollup.compact() == 0 and rollup.batches() == ["1", "2", "3", "4"] and rollup.committed("2")
    assert not rollup.commit("2", tokens.signed(some, -1)) and Counter(map(tuple, rollup.totals().collect())) == before
    rollup.commit("6", tokens.signed(some, 1))
    (tmp_path / "r/merged/3").rename(tmp_path / "r/commits/3")  # a compaction that was cut off
    rollup.commit("7", tokens.signed(some, -1))
    assert Counter(map(tuple, rollup.totals().collect())) == before and rollup.compact() == 2
    assert Counter(map(tuple, rollup.totals().collect())) == before and rollup.batches() == ["1", "2", "3", "4", "6", "7"]
    want = defaultdict(lambda: [0, 0, 0])
    for r in docs.collect():
        i, t = r["doc_id"], r["text"] or ""
        if i is None or i >= 10:
            g = want[r["source"], r["lang"], "t2" if i is not None and i < 20 else "t1"]
            g[0], g[1], g[2] = g[0] + 1, g[1] + len(t), g[2] + len(encoder.encode_ordinary(t))
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_chars"], r["n_tokens"]] for r in rollup.totals().collect()} == dict(want)
    with pytest.raises(ValueError):
        rollup.commit("../x", tokens.signed(some, 1))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    public = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    whole = tiktoken.Encoding("whole", pat_str=public, mergeable_ranks=tokens.encoder()._mergeable_ranks, special_tokens={})
    text = "it's 12 apples,  and_some\n\n more 3x  words... " * 50
    monkeypatch.setattr(tokens, "LONG", 37)
    assert tokens.count(text) == len(whole.encode_ordinary(text))


def test_of_two_writers_one_commits(spark, docs, tmp_path, monkeypatch):
    delta = tokens.signed(tokens.counted_words(docs), 1)
    a, b = (tokens.Rollup(spark, str(tmp_path / "r")) for _ in "ab")
    written = b._written
    monkeypatch.setattr(b, "_written", lambda sums, name: (written(sums, name), a.commit("x", delta))[0])  # a comes in between
    assert not b.commit("x", delta)
    assert a.totals().agg(F.sum("n_docs")).first()[0] == docs.count() and len(list((tmp_path / "r/data").iterdir())) == 1


def test_streams_do_not_share_batches(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, n_docs long, n_chars long, n_tokens long"
    rollup = tokens.Rollup(spark, str(tmp_path / "r"))
    for i in range(2):
        spark.createDataFrame([("s", "en", "t", 1, 1, 1)], schema).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}"))
        for _ in range(2):  # the second finds nothing new
            tokens.follow(stream, rollup, str(tmp_path / f"c{i}")).trigger(availableNow=True).start().awaitTermination()
    assert rollup.totals().first()["n_docs"] == 2


def test_stream_commits_once(spark, docs, tmp_path):
    tokens.signed(tokens.counted_words(docs), 1).write.parquet(str(tmp_path / "in"))
    rollup = tokens.Rollup(spark, str(tmp_path / "r"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    tokens.follow(stream, rollup, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == docs.count()


# -- licenses ----------------------------------------------------------------------------------------


def test_licenses(docs, none):
    got = licenses.licenses(docs).collect()
    want = []
    for i, t in source(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        want.append((i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, tuple(sorted({x for _, x in places}))))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], tuple(r["base_labels"])) for r in got) == Counter(want)
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert licenses.licenses(none).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the GNU Lesser General Public License v2.1", ["lgpl-2.1"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
        ("the Mozilla\n * Public License, version 2.0", ["mpl-2.0"]),
        ("Creative Commons Attribution-NonCommercial-ShareAlike", ["cc-by-nc-sa"]),
        ("distributed under the terms of the Apache License 2.0", ["apache", "apache-2.0"]),
        ("summit licenses; a mit licensed x", []),
        ("SPDX-License-Identifier: MIT", ["mit"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]),
        ("This code is licensed under the GPL.", ["gpl"]),
        ("It is released under an MIT license or so", ["mit"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal", ["mit"]),
        ("Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that", ["bsd"]),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived", ["bsd-3-clause"]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ["0bsd"]),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", ["isc"]),
        ("see https://www.apache.org/licenses/LICENSE-2.0.txt", ["apache-2.0"]),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
    ],
)
def test_license_rules(text, labels):
    assert licenses.scan(text)["labels"] == labels


def test_every_rule_is_reached_through_its_keywords():
    assert len(licenses.rules()) > 300 and all(all(k and len(k) > 2 or r.priority == 4 for k in r.keywords) for r in licenses.rules())
    plain = lambda x: re.sub(r" +", " ", re.sub(r"\\S[+*]?", "any", re.sub(r"\\d", "3", re.sub(r"(?<=.)\?", "", re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\(\?!.*?\)|\{[^}]*\}", "", x)))))).strip()
    first = lambda x: plain(re.sub(r"\(\?:([^()|]*)[^()]*\)[*?]?", r"\1", x).split("|")[0])
    for label, pattern in licenses.BODIES + licenses.ADDRESSES:
        assert label in licenses.scan(f"x {first(pattern)} y")["labels"], (label, first(pattern))


def test_many_places_cost_no_square():
    import time

    began = time.time()
    r = licenses.scan("mit license " * 90_000)
    assert r["n_base"] == 90_000 and r["last_word"] == 179_998 and time.time() - began < 4
    inner = [(1, 10, 20, "short"), (1, 5, 30, "long"), (3, 8, 12, "prior"), (1, 40, 50, "alone"), (2, 40, 50, "twin")]
    assert {x[3] for x in licenses._resolve(inner)} == {"prior", "long", "twin"}


# -- packing -----------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

        best = min(padding([*cut, lengths[-1]]) for m in range(min(k, len(lengths))) for cut in itertools.combinations(lengths[:-1], m))
        found = packing.boundaries(lengths, counts, k)
        assert len(found) <= k and padding(found) == best


def plain_padding(lengths, counts, buckets):
    """The least padding, by trying every begin of every bucket."""
    n, inf = len(lengths), float("inf")
    best = [0, *[inf] * n]
    tops = inf
    for _ in range(buckets):
        best = [inf, *(min(best[i] + sum(c * (lengths[j - 1] - x) for x, c in zip(lengths[i:j], counts[i:j])) for i in range(j)) for j in range(1, n + 1))]
        tops = min(tops, best[n])
    return tops


def test_boundaries_beyond_a_thousand_words_are_optimal():
    import random

    rng = random.Random(5)
    for _ in range(6):
        lengths = sorted(rng.sample(range(0, 20_000), 40))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 9)
        found = packing.boundaries(lengths, counts, k)
        assert sum(c * (min(b for b in found if b >= n) - n) for n, c in zip(lengths, counts)) == plain_padding(lengths, counts, k)


def test_packing(docs, none, monkeypatch):
    monkeypatch.setattr(packing, "SPLIT", 7)
    got = packing.pack(docs, buckets=4, token_budget=1000).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((i, len(words(t))) for i, t in source(docs))
    batches = defaultdict(list)
    for r in got:
        assert r["padding"] == r["boundary"] - r["n_words"] >= 0
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), held in batches.items():
        room = max(1, 1000 // held[0]["boundary"])
        assert sorted(r["slot"] for r in held) == list(range(len(held))) and len(held) <= room
        assert len(held) == room or batch == max(b for k, b in batches if k == bucket)
    lengths = sorted({r["n_words"] for r in got})
    counts = [sum(r["n_words"] == n for r in got) for n in lengths]
    assert sum(r["padding"] for r in got) == plain_padding(lengths, counts, 4) and lengths[-1] > 1024
    assert packing.pack(none).count() == 0


# -- personal data -----------------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def base_spans(t):
    return sorted((m.start(), k, m.end()) for k, (kind, form) in enumerate(FORMS.items()) for m in re.finditer(form, t or "") if valid(kind, m[0]))


HARD = ["write to 1.2.3.4@x.com now, +4111111111111111 or 1.2.3.4@5.6", "é a@b.c_d@e.f x@y", "a.b@c@d.e", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 1.2.3 9.9.9.9", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 12345678901234567890", "+1 (555) 555-1234... +12 +1--------2 +123456789012345678", "😀 +49 30 1234567 😀 q@r.st", "1-2-3-4-5-6-7-8-9-0-1-2-3-4 5"]


def test_personal_data_by_form(spark, docs, none):
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    got = pii.digest(pii.spans(every)).collect()

    def want(i, t):
        spans = base_spans(t)
        told = ",".join(f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in spans)
        return (i, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(told.encode()).hexdigest())

    assert Counter(tuple(r)[:6] for r in got) == Counter(want(i, t) for i, t in source(every))
    assert pii.digest(pii.spans(none)).count() == 0 and pii.sanitised(none).columns == none.columns


def test_long_runs_cost_no_square(spark):
    texts = ["a" * 200_000, "1" * 200_000, "a.b" * 60_000 + " x@y.zz", "+1" + "-" * 100_000]
    got = pii.digest(pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r["n_email"] for r in got] == [0, 0, 1, 0]


def test_terms_that_disclose(spark):
    filler = ["these common words stand in every text of the corpus number %d" % i for i in range(60)]
    told = [f"common words {i}: write to zanzibar holder ann@x.org common words {i}" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(told + filler)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.spans(df).collect()}
    terms = {told[i][t["start"] : t["end"]] for i in range(5) for t in found[i]["terms"]}
    assert {"zanzibar", "holder"} <= terms and not {"common", "words"} & terms
    assert not any(found[i]["terms"] for i in range(5, 65))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert "[EMAIL]" in clean[0] and "zanzibar" not in clean[0] and all(clean[5 + i] == t for i, t in enumerate(filler))


def test_sanitised_texts_hold_no_entity(docs):
    before, after = dict(source(docs.where("doc_id is not null"))), dict(source(pii.sanitised(docs.where("doc_id is not null"))))
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert not base_spans(after[i]) and (base_spans(t) or after[i] == t)


def test_spans_are_told_by_start_then_kind(spark):
    got = pii.digest(pii.spans(spark.createDataFrame([(1, "write to 1.2.3.4@x.com now")], "doc_id long, text string"))).first()
    assert got["spans"] == "email:9:22,ip:9:16" and got["base_sha256"] == hashlib.sha256(b"email:9:22,ip:9:16").hexdigest()


def test_sanitising_keeps_all_other_columns(docs):
    others = [c for c in docs.columns if c != "text"]
    assert "__key" in others and Counter(docs.select(others).collect()) == Counter(pii.sanitised(docs).select(others).collect())


def test_terms_against_plain_counts(spark):
    import math
    import random

    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(60)]
    entities = [f"n{i}@x.org" for i in range(4)]
    texts = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(3, 15))]
        if i % 6 < 4 and i < 72:  # each entity with a term that is seldom elsewhere
            body.insert(rng.randrange(len(body)), f"secret{i % 6}")
            body.insert(rng.randrange(len(body)), entities[i % 6])
        elif i % 17 == 0:
            body += [f"Secret{i % 4}"]
        texts.append(" ".join(body))
    texts += texts[:5] + [None, ""]
    outside = lambda t: re.sub(FORMS["email"], " ", (t or "").lower())
    terms = [{w for w in re.findall(r"[^\W_]+", outside(t)) if len(w) >= 3} for t in texts]
    held = [set(re.findall(r"n\d@x\.org", t or "")) for t in texts]
    n, found = len(texts), {}
    in_any = [set(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    for e in entities:
        n_e = sum(e in h for h in held)
        for t in set().union(*(x for x, h in zip(terms, held) if e in h)):
            both = [texts[i] for i in range(n) if e in held[i] and t in terms[i]]
            n_t = sum(t in x for x in in_any)
            if len(set(both)) >= pii.SUPPORT:
                score = math.log(n * len(both) / (n_e * n_t)) / math.log(n / n_e)
                if score >= pii.GENERALISE:
                    found[t] = max(score, found.get(t, 0))
    assert found and not set(found) & set(vocabulary)
    got = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        mails = [m.span() for m in re.finditer(FORMS["email"], t)]
        want = [(m.start(), m.end(), round(found[m[0].lower()], 6)) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in found and not any(m.start() < b and m.end() > a for a, b in mails)]
        assert [(x["start"], x["end"], round(x["disclosure"], 6)) for x in r["terms"]] == want


# -- repeated windows --------------------------------------------------------------------------------


def cut(rows_):
    first = {}
    for i, t in rows_:
        for x in range(len(t) - 49):
            first[t[x : x + 50]] = min(i, first.get(t[x : x + 50], i))
    for i, t in rows_:
        gone = bytearray(len(t))
        for x in range(len(t) - 49):
            if first[t[x : x + 50]] < i:
                gone[x : x + 50] = b"\1" * 50
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        yield i, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)


def removed(df):
    return df.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept").collect()


def test_repeated_windows(docs, none):
    big = 2**63 - 1
    want = Counter((None if i == big else i, *rest) for i, *rest in cut([(big if i is None else i, (t or "").encode()) for i, t in source(docs)]))
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in removed(suffix.repeats(docs))) == want
    assert suffix.repeats(none).count() == 0


def test_repeated_windows_of_few_letters(spark):
    import random

    rng = random.Random(8)
    pieces = ["".join(rng.choice("ab é") for _ in range(rng.randint(30, 160))) for _ in range(6)]
    some = lambda: "".join(rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choice("abcé \n") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6)))
    rows = [(i, some()) for i in range(60)] + [(100, "a" * 500), (101, "a" * 50), (102, "a" * 49), (103, "a" * 700 + "b"), (104, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in removed(suffix.repeats(df))) == Counter(cut([(i, t.encode()) for i, t in rows]))


def test_windows_of_long_texts_are_whole_in_some_piece(monkeypatch):
    texts = [bytes(range(97, 123)) * 20, b"x" * 10, b"yz" * 130]
    seen = Counter()
    for data, doc, place in suffix.pieces(texts, 50, 64):
        for x in range(len(data) - 49):
            if doc[x] == doc[x + 49]:
                assert bytes(data[x : x + 50]) == texts[doc[x]][place[x] : place[x] + 50]
                seen[int(doc[x]), int(place[x])] += 1
    assert seen == Counter({(i, x): 1 for i, t in enumerate(texts) for x in range(len(t) - 49)})


# -- near duplicates ---------------------------------------------------------------------------------


def fingerprint(t, k=3):
    w = words(lower(t))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """id of the least document reachable, for (id, fp) rows."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(fps):
        r = root(a)
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return [least[root(a)] for a in range(len(fps))]


def test_near_duplicates(docs, none):
    rows = [(i, fingerprint(t)) for i, t in source(docs)]
    want = Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, classes(rows)))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_crowded_fingerprints(spark):
    import random

    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)})
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    got = {r["fp"]: r["component_id"] for r in simhash.components(spark.createDataFrame(signed, "id long, fp long")).collect()}
    assert [got[f] for _, f in signed] == classes(list(enumerate(fps)))


def test_long_fingerprints_are_counted_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[i] for i in range(101, 160)} == {100} and got[300] == got[250] == 200
    assert common.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# -- sketches ----------------------------------------------------------------------------------------


def test_edited_texts_and_likeness(docs, none):
    rows = sorted(source(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sketch.compared(docs).withColumn("near", sketch.resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("next", sketch.resemblance(F.col("sketch"), F.col("next_sketch"))).collect()
    want, true = Counter(), []
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want[i, len(t), edited] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want
    by_text = defaultdict(set)
    texts = {(i, len(t or "")): t for i, t in rows}
    for r in got:
        by_text[texts.get((r["doc_id"], r["n_chars"]))].add(told(r["sketch"]))
        assert 0 <= r["near"] <= 1 and 0 <= r["next"] <= 1
        a, b = shingles(texts[r["doc_id"], r["n_chars"]]), shingles(r["edited"])
        if len(a) > 100:
            true.append(abs(r["near"] - len(a & b) / len(a | b)))
    assert all(len(s) == 1 for s in by_text.values()) and sum(true) / len(true) < 0.1
    assert sketch.compared(none).count() == 0


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def test_a_lone_document_follows_itself(spark):
    r = sketch.compared(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).first()
    assert r["edited"] == "abcabc" and r["next_sketch"] == r["sketch"]


def hashes(t):
    """Hashes of words, chained as Spark's xxhash64 does: the hash of one value is the seed for the next."""
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    chain = lambda *ws: signed(functools.reduce(lambda seed, w: xxhash.xxh64_intdigest(w.to_bytes(8, "little", signed=True), seed), ws, 42))
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in words(t)]
    return {chain(*w[i : i + 5]) for i in range(len(w) - 4)} or ({functools.reduce(chain, w, 42)} if w else set())


def plain_sketch(t):
    h = hashes(t)
    return sorted(x for x in h if x < -(2**63) + 2**64 // sketch.SCALE), min(h, default=None)


def likeness(a, b):
    union = set(a[0]) | set(b[0])
    return len(set(a[0]) & set(b[0])) / len(union) if union else float(a[1] == b[1])


def told(s):
    return ",".join(f"{x % 2**64:016x}" for x in s[0]) or ("" if s[1] is None else f"~{s[1] % 2**64:016x}")


def test_sketches_hash_by_hash(spark, docs):
    got = docs.select("text", sketch.sketch(common.whole("text")).alias("s")).select("text", "s", sketch.written(F.col("s")).alias("w")).collect()
    for r in got:
        assert (r["s"]["kept"], r["s"]["least"]) == plain_sketch(r["text"]) and r["w"] == told(plain_sketch(r["text"]))


def test_sketches_of_short_texts(spark):
    texts = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(12)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sketch.sketch(F.col("t")).alias("s"))
    assert all(r["s"]["kept"] == plain_sketch(r["t"])[0] for r in df.collect()) and df.where("size(s.kept) = 0").count() > 3
    whole = spark.createDataFrame([("\n".join(texts),)], "t string").select(sketch.sketch(F.col("t")).alias("w"))
    r = df.crossJoin(whole).select(F.sum(sketch.containment(F.col("s"), F.col("w"))).alias("held"), F.sum((F.size("s.kept") > 0).cast("int")).alias("known")).first()
    assert r["held"] == r["known"] > 0
    pairs = df.alias("a").crossJoin(df.alias("b")).select((F.col("a.t") == F.col("b.t")).alias("same"), sketch.resemblance(F.col("a.s"), F.col("b.s")).alias("x"))
    assert all(r["x"] == (1.0 if r["same"] else 0.0) for r in pairs.collect())
    union = df.agg(sketch.merged(F.col("s")).alias("m")).first()["m"]
    assert union["kept"] == sorted(x for t in texts for x in plain_sketch(t)[0])


def test_parts_by_cuts(spark):
    import bisect

    for n in (0, 1, 2, 7, 50):
        cuts = sorted({(i * 37) % 211 for i in range(n)})
        got = spark.range(0, 212).select("id", sketch._part_of(cuts, F.col("id")).alias("p")).collect()
        assert all(r["p"] == bisect.bisect_right(cuts, r["id"]) for r in got)


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(500)), " ".join(f"b{i}" for i in range(300))
    df = spark.createDataFrame([(a, b, a + "\n" + b)], "a string, b string, ab string").select(*(sketch.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")))
    joined = df.select(F.explode(F.array("a", "b")).alias("s")).agg(sketch.merged(F.col("s")).alias("m")).crossJoin(df.select("ab", "a"))
    r = joined.select(sketch.resemblance(F.col("m"), F.col("ab")).alias("same"), sketch.containment(F.col("a"), F.col("ab")).alias("held")).first()
    assert r["same"] > 0.95 and r["held"] == 1.0


# -- shards ------------------------------------------------------------------------------------------


def plain_shards(rows_, n):
    """Shard of each row, or None where the group is split: every group of equal texts, largest first, by the dot product."""
    groups = defaultdict(lambda: [0, 0, 0])
    for i, t in rows_:
        g = groups[t or ""]
        g[0], g[1], g[2] = g[0] + len((t or "").encode()) + 1, g[1] + len(words(t)), g[2] + 1
    total = [sum(g[k] for g in groups.values()) for k in range(3)]
    scaled = {t: [n * x / y if y else 0 for x, y in zip(g, total)] for t, g in groups.items()}
    return groups, scaled


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_shards(docs, none, block):
    got = sharding.shards(docs, 4, block=block).collect()
    assert Counter((r["doc_id"], r["size"], r["n_tokens"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, len(words(t)), zlib.crc32((t or "").encode())) for i, t in source(docs))
    for s in range(4):
        held = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    _, scaled = plain_shards(source(docs), 4)
    fits = {zlib.crc32(t.encode()) for t, v in scaled.items() if max(v) <= 1}
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(where[c]) == 1 for c in fits)
    assert Counter(map(tuple, got)) == Counter(map(tuple, sharding.shards(docs.repartition(3), 4, block=block).collect()))
    assert sharding.shards(none, 4).count() == 0


def test_groups_go_where_the_dot_product_is_highest(spark):
    rows = [(i, "w " * (1 + i % 90 * 7 % 23) + "x" * (i % 90 * 5 + 1)) for i in range(130)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    groups, scaled = plain_shards(rows, 4)
    residual, want = [[1.0] * 3 for _ in range(4)], {}
    sizes = lambda t: (-max(scaled[t]), -sum(scaled[t]))
    assert len(set(map(sizes, groups))) == len(groups)  # no ties
    for t in sorted(groups, key=sizes):
        want[t] = max(range(4), key=lambda s: (round(sum(w * a * b for w, a, b in zip(sharding.WEIGHTS, residual[s], scaled[t])), 9), -s))
        residual[want[t]] = [a - b for a, b in zip(residual[want[t]], scaled[t])]
    assert got == {i: want[t] for i, t in rows}


@pytest.mark.parametrize("block", [1 << 14, 100])
def test_a_group_with_a_third_of_the_rows_is_split(spark, block):
    rows = [(i, "the same text again " * 8) for i in range(700)] + [(1000 + i, f"text number {i} " * (5 + i % 9)) for i in range(1400)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 16, block=block)
    sums = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert len(sums) == 16 and max(r["b"] for r in sums) < 1.1 * min(r["b"] for r in sums)


# -- mixing ------------------------------------------------------------------------------------------


def targets(sizes):
    """The rule as the contract words it: shares by weight, what is above the limit shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.collect())
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(none).count() == 0


def test_many_blocks_meet_the_target(spark):
    rows = [(i, "w " * (1 + i * 37 % 200), f"s{i % 3}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=50)
    for r in got.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect():
        assert abs(r["k"] - r["t"]) <= 200
    assert got.count() == 3000


def test_settling_keeps_the_words():
    import random

    rng = random.Random(2)
    for _ in range(200):
        size = [rng.randint(1, 50) for _ in range(rng.randint(1, 40))]
        p = [rng.random() for _ in size]
        before = sum(a * b for a, b in zip(p, size))
        held = mixing.settle_block(p, size, rng)
        assert abs(before - sum(a * b for a, b in zip(p, size))) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != held) and (held < 0 or 0 < p[held] < 1)
