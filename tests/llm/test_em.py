"""What EM believes of a rule that mostly speaks alone."""

import pytest

from weftgraph.llm import quality

RULES = tuple(quality.Rule(n, "false") for n in "abcd")


def posteriors(spark, table):
    df = spark.createDataFrame([(*v, n) for v, n in table], "vote_a int, vote_b int, vote_c int, vote_d int, n int")
    rows = df.selectExpr("vote_a", "vote_b", "vote_c", "vote_d", "explode(sequence(1, n)) AS i")
    model = quality.fit(rows, RULES)
    return {tuple(r)[:4]: r["p"] for r in df.withColumn("p", model.posterior(RULES)).collect()}


@pytest.mark.parametrize("alone", [100, 1000, 5000])
def test_a_rule_against_much_that_is_praised_loses_its_say(spark, alone):
    # b and c agree on documents without praise; a speaks alone against such as both others praise
    p = posteriors(spark, [((0, 0, 1, 1), 9600 - alone), ((0, 0, 1, 0), 100), ((-1, 0, 1, 1), alone), ((0, -1, -1, 0), 200), ((0, -1, 0, 0), 50), ((0, 0, -1, 0), 50)])
    assert p[-1, 0, 1, 1] > 0.5 and p[0, 0, 1, 1] > 0.9
    assert p[0, -1, -1, 0] < 0.1 and p[0, -1, 0, 0] < 0.5


def test_a_rule_against_what_nothing_praises_keeps_it(spark):
    p = posteriors(spark, [((0, 0, 1, 1), 9000), ((-1, 0, 0, 0), 500), ((0, -1, -1, 0), 200)])
    assert p[-1, 0, 0, 0] < 0.5 and p[0, 0, 1, 1] > 0.9


def plain(rows, rules, rounds=200):
    """Posterior of each row, by EM over rows and not patterns, straight from the docstring of `fit`."""
    import numpy as np

    v, prior = np.array(rows).reshape(-1, len(rules)), quality.PRIOR
    names = list(dict.fromkeys(r.kind or r.name for r in rules))
    kind = np.array([names.index(r.kind or r.name) for r in rules])
    against, n, fault = v == -1, len(v), 0.2 * prior / len(names)
    clean, agreed = ~against.any(1), against.sum(1) > 1
    doubt = np.ones(v.shape)
    for r in range(len(rules)):
        if (v[:, r] == 1).any():
            good = ((v[clean, r] == 1).sum() + 0.8) / (clean.sum() + 1)
            rest = agreed & ~against[:, r]
            bad = min(good, ((v[rest, r] == 1).sum() + 0.75 * good * prior / 5) / (rest.sum() + prior / 5))
            doubt[:, r] = np.select([against[:, r], v[:, r] == 1], [1, bad / good], (1 - bad) / (1 - good))
    good, share, caught, wrong = 0.8, np.full(len(names), 0.2 / len(names)), np.full(len(rules), 0.9), np.zeros(len(rules))
    for r in range(len(rules)):
        mates = [x for x in range(len(rules)) if kind[x] == kind[r] and x != r]
        wrong[r] = ((against[:, r] & ~against[:, mates].any(1)).sum() * bool(mates) + 0.002 * prior) / (n + prior)
    last = None
    for _ in range(rounds):
        told = np.where(against, caught / wrong, (1 - caught) / (1 - wrong))
        odds = np.stack([told[:, kind == k].prod(1) * s / good for k, s in enumerate(share)], 1) * doubt.prod(1)[:, None]
        p = 1 / (1 + odds.sum(1))
        if last is not None and abs(p - last).max() < 1e-9:
            break
        f, last = odds * p[:, None], p
        mass = f.sum(0)
        good, share = (p.sum() + 0.8 * prior) / (n + prior), (mass + fault) / (n + prior)
        caught = np.array([max(quality.SEEN, (f[against[:, r], kind[r]].sum() + 0.9 * fault) / (mass[kind[r]] + fault)) for r in range(len(rules))])
        wrong = np.array([((1 - f[against[:, r], kind[r]]).sum() + 0.1 * fault) / (n - mass[kind[r]] + prior - fault) for r in range(len(rules))])
    told = np.where(against, caught / wrong, (1 - caught) / (1 - wrong))
    odds = np.stack([told[:, kind == k].prod(1) * s / good for k, s in enumerate(share)], 1) * doubt.prod(1)[:, None]
    return 1 / (1 + odds.sum(1))


def test_em_by_patterns_is_em_by_rows(spark):
    import random

    rng = random.Random(5)
    rules = quality.RULES
    rows = []
    for _ in range(400):
        bad = rng.choice([None] * 8 + ["symbols", "repetition", "shouting"])
        rows.append([-1 if rng.random() < (0.8 if r.kind == bad else 0.03) else rng.choice([0, 0, 1]) if r.good != "false" else 0 for r in rules])
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "i int, " + ", ".join(f"vote_{r.name} int" for r in rules))
    model = quality.fit(df)
    got = [r["p"] for r in df.withColumn("p", model.posterior()).orderBy("i").collect()]
    assert max(abs(a - b) for a, b in zip(got, plain(rows, rules))) < 1e-6


def test_rules_of_a_kind_that_agree_are_believed(spark):
    rules = (*(quality.Rule(n, "false", kind="x") for n in "abe"), quality.Rule("c", "false", kind="y"), quality.Rule("d", "false", kind="y"))
    table = [((0, 0, 0, 0, 0), 9000), ((-1, -1, -1, 0, 0), 200), ((-1, 0, -1, 0, 0), 50), ((0, -1, 0, 0, 0), 400), ((0, 0, 0, -1, -1), 50)]
    names = "vote_a int, vote_b int, vote_e int, vote_c int, vote_d int"
    df = spark.createDataFrame([(*v, n) for v, n in table], f"{names}, n int")
    rows = df.selectExpr(*(f"vote_{n}" for n in "abecd"), "explode(sequence(1, n)) AS i")
    model = quality.fit(rows, rules)
    p = {tuple(r)[:5]: r["p"] for r in df.withColumn("p", model.posterior(rules)).collect()}
    assert p[-1, -1, -1, 0, 0] < 0.01 and p[-1, 0, -1, 0, 0] < 0.01 and p[0, 0, 0, -1, -1] < 0.01 and p[0, -1, 0, 0, 0] > 0.9


def test_a_corpus_without_full_stops_is_kept(spark):
    texts = [" ".join(f"word{i}x{j}" for j in range(30 + i % 40)) for i in range(300)] + ["### $$$ *** %%% word " * 12 for _ in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == (i < 300) for i in got)
