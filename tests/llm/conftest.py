import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, n string, key string, part string, item string, `__key` string"


def rows():
    """Documents with what must not upset an operator: nulls, empty and long texts, copies, near copies, repeated ids."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randint(1, 150)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1], f"{prose(20)}\n{passage}\n{prose(20)}", f"{passage} {prose(9)}", f"{prose(5)} {passage}"]
    long = prose(600)
    words = long.split()
    texts += [long, " ".join(words[:300] + ["changed"] + words[301:]), " ".join(words[:-1])]
    texts += ["", None, " \t\n ", "x", "a b c", prose(4000), "a" * 5000, "word " * 400, "Line one here\n" * 40, "\n".join([prose(12)] * 3)]
    texts += ["Mail me at Ann.Lee@mail.example.com or call +1 (555) 555-1234. " + prose(30), "4111 1111 1111 1111 or 1.2.3.4 and 300.1.1.1, 1.2.3.4.5.6.7.8", "Licensed under the Apache License, Version 2.0. MIT License. CC-BY-SA 4.0", "SPDX-License-Identifier: GPL-3.0\nGNU General\nPublic License v3"]
    texts += ["SHOUT!! " * 30, "odd*** words$$$ here### " * 20, " | ".join(prose(60).split())]
    out = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [(None, texts[2], None, "s1", None), (None, None, None, None, None), (5, texts[5], "en", "s1", 1), (7, prose(50), "en", "s3", 1)]
    return [(*r, 1, 2, "n", "k", "p", "i", "kk") for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
