"""Quality rules as weak supervision: rules vote or abstain, EM learns how far each can be believed.

Every rule votes 1 (good), -1 (bad) or 0 (abstains), and several rules look for a fault of the same
kind, each in its own way. Documents with the same votes are alike to the model, so one distributed
count by vote pattern, whose number is bounded by the rules and not by the corpus, is all that the
expectation-maximisation reads. Where rules of a kind agree it learns how common the fault is and how
often each rule catches it; where a rule speaks without the others of its kind, how often it is
wrong. A document's posterior is then a product of odds, which is a plain column expression. All of
it is built-in functions, evaluated in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import let, saved, whole, words

WINDOW = 8
#: Documents that what is expected of the rules weighs as much as, and of the share of faulty ones.
PRIOR = 20
#: Share of the faults of its kind that a rule is held to see at least: what one rule alone sees, much or little, is no such fault.
SEEN = 0.5


def _covered(windows: Column) -> Column:
    """Words inside the windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alike = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = lambda s: F.filter(F.transform(s, lambda e, k: F.when(alike(e, F.get(s, k - 1)) | alike(e, F.get(s, k + 1)), e["i"])), lambda i: i.isNotNull())
    reach = lambda p: F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
    return F.aggregate(let(F.sort_array(let(pairs, twice)), reach), F.lit(0), lambda a, b: a + b)


def repeat_words(hashes: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, from the hashes of its words; sorts only where some window repeats."""

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_covered(x))))

    return of(hashes)


def echoes(hashes: Column) -> Column:
    """Words that equal the word before."""
    return F.size(F.filter(hashes, lambda x, i: F.coalesce(x == F.get(hashes, i - 1), F.lit(False))))


def measures(text: Column) -> Column:
    """Struct of the measures the rules read; a null text has the measures of an empty one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")
    counted = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    hashed = lambda h: F.struct(repeat_words(h).alias("again"), echoes(h).alias("echoes"), F.size(F.array_distinct(h)).alias("kinds"))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), let(F.transform(w, lambda x: F.xxhash64(x)), hashed).alias("h")))
    return let(
        F.struct(of_words.alias("w"), counted.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            x["w"]["chars"].cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (x["l"]["n"] - x["l"]["d"]).cast("long").alias("n_dup_lines"),
            x["w"]["h"]["again"].cast("long").alias("n_repeat_words"),
            x["w"]["h"]["echoes"].cast("long").alias("n_echoes"),
            x["w"]["h"]["kinds"].cast("long").alias("n_kinds"),
            x["l"]["n"].cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.char_length(F.regexp_replace(text, r"\P{L}++", "")).cast("long").alias("n_letters"),
            F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_shouts"),
            F.regexp_like(text, F.lit("[.!?…。؟।]")).alias("has_stop"),
            F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s]{2,}+|(?<!\S)[^\p{L}\p{M}\p{N}\s]++(?!\S)")).cast("long").alias("n_marks"),
        ),
    )


def base_failed() -> Column:
    """The base rule over the measure columns: under 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes -1 where `bad` holds, else 1 where `good` holds, else abstains; both are SQL over the measures. Rules of one `kind` look for the same fault; without one it is the rule's own."""

    name: str
    bad: str
    good: str = "false"
    kind: str = ""

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


#: Most rules know one fault and abstain where they don't see it.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 40", "fragment"),
    Rule("no_sentence", "not has_stop", kind="fragment"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)", "word_chars between 3 * n_words and 10 * n_words", "no_words"),
    Rule("letters", "2 * n_letters < word_chars", kind="no_words"),
    Rule("symbols", "10 * n_symbols > n_words", kind="symbols"),
    Rule("marks", "5 * n_marks > n_words", kind="symbols"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words", kind="repetition"),
    Rule("echoes", "100 * n_echoes > 30 * n_words", kind="repetition"),
    Rule("few_kinds", "5 * n_kinds < 2 * n_words", kind="repetition"),
    Rule("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines", kind="repetition"),
    Rule("upper", "2 * n_upper > n_letters and n_letters > 0", kind="shouting"),
    Rule("shouts", "5 * n_shouts > n_words", kind="shouting"),
)


def kinds_of(rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """The rules, by number, of each kind of fault."""
    out: dict[str, list[int]] = {}
    for r, rule in enumerate(rules):
        out.setdefault(rule.kind or rule.name, []).append(r)
    return out


@dataclass(frozen=True)
class Model:
    """A document is good or has a fault of one kind.

    `kinds` are the shares of the faults, by kind; `caught` is how often a rule speaks against a
    fault of its kind and `wrong` against anything else; `praise` is how often it votes 1, if not
    -1, for good and for bad documents. `right` is the share of a rule's votes against that were right.
    """

    good: float
    kinds: tuple[float, ...]
    caught: tuple[float, ...]
    wrong: tuple[float, ...]
    praise: tuple[tuple[float, float], ...]
    right: tuple[float, ...] = ()

    def told(self, r: int, vote: int) -> float:
        """How much more often rule r votes so on a fault of its kind than on anything else."""
        return self.caught[r] / self.wrong[r] if vote == -1 else (1 - self.caught[r]) / (1 - self.wrong[r])

    def doubt(self, r: int, vote: int) -> float:
        """How much more often bad documents than good ones get this vote where it isn't against them."""
        of_good, of_bad = self.praise[r]
        return {1: of_bad / of_good, 0: (1 - of_bad) / (1 - of_good), -1: 1.0}[vote]

    def posterior(self, rules: tuple[Rule, ...] | None = None) -> Column:
        """Probability that a document is good, over its vote columns."""
        rules = rules or RULES
        vote = lambda r: F.col(f"vote_{rules[r].name}")
        odds, factor = F.lit(0.0), F.lit(1.0)
        for share, held in zip(self.kinds, kinds_of(rules).values()):
            of_kind = F.lit(share / self.good)
            for r in held:
                of_kind = of_kind * F.when(vote(r) == -1, self.told(r, -1)).otherwise(self.told(r, 0))
            odds = odds + of_kind
        for r in range(len(rules)):
            factor = factor * F.when(vote(r) == -1, 1.0).when(vote(r) == 1, self.doubt(r, 1)).otherwise(self.doubt(r, 0))
        return 1 / (1 + odds * factor)


def votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds a column vote_<name> for each rule; `measured` has the measure columns."""
    return measured.withColumns({f"vote_{r.name}": r.vote() for r in rules})


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 200) -> Model:
    """EM over the counts of vote patterns, of which there are at most 3 ** len(rules).

    What is expected of any rule stands beside the data as a fixed number of documents, so with many
    documents the data decide: PRIOR of them, a fifth with a fault, of which a rule of its kind sees
    nine in ten, and nine in ten of a rule's votes against are right. How bad documents are praised
    is read where two rules agree, how good ones are where none speaks against. A rule is held to see
SEEN of the faults of its kind at least, or a habit of the whole corpus that one rule is against,
such as a script without full stops, would be a fault of that kind; and at the outset what it says
without the others of its kind is held to be wrong. So a rule that
    mostly speaks without the others of its kind, or against documents praised as good ones are,
    loses its say; where nothing tells, the expectation stands. No documents: it is the model.
    """
    names, kinds = [f"vote_{r.name}" for r in rules], kinds_of(rules)
    table = sorted((tuple(row[n] for n in names), row["count"]) for row in voted.groupBy(*names).count().collect())
    total, each = sum(n for _, n in table), range(len(rules))
    kind = {r: k for k, held in enumerate(kinds.values()) for r in held}
    bipolar = [any(p[r] == 1 for p, _ in table) for r in each]
    model = Model(0.8, (0.2 / len(kinds),) * len(kinds), (0.9,) * len(rules), (0.002,) * len(rules), tuple((0.8, 0.6) if b else (0.5, 0.5) for b in bipolar))
    praise = []
    for r in each:
        rate = lambda held, mean, weight: (sum(n for p, n in held if p[r] == 1) + mean * weight) / (sum(n for p, n in held if p[r] != -1) + weight)
        of_good = rate([x for x in table if -1 not in x[0]], 0.8, 1)
        of_bad = rate([x for x in table if x[0].count(-1) > 1], 0.75 * of_good, PRIOR / 5)
        praise.append((of_good, min(of_good, of_bad)) if bipolar[r] else (0.5, 0.5))  # praise never tells against
    mates = {r: [x for x in held if x != r] for held in kinds.values() for r in held}
    alone = [sum(n for p, n in table if p[r] == -1 and all(p[x] != -1 for x in mates[r])) if mates[r] else 0 for r in each]
    model = replace(model, praise=tuple(praise), wrong=tuple((a + 0.002 * PRIOR) / (total + PRIOR) for a in alone) if table else model.wrong)
    fault = 0.2 * PRIOR / len(kinds)
    before = None
    for _ in range(rounds if table else 0):
        post = []
        for p, _ in table:
            factor = math.prod(model.doubt(r, p[r]) for r in each)
            odds = [factor * share / model.good * math.prod(model.told(r, p[r]) for r in held) for share, held in zip(model.kinds, kinds.values())]
            post.append((1 / (1 + sum(odds)), [o / (1 + sum(odds)) for o in odds]))
        if before and max(abs(a[0] - b[0]) for a, b in zip(post, before)) < 1e-9:
            break
        before = post
        rows = [(p, n, g, k) for (p, n), (g, k) in zip(table, post)]
        mass = [sum(n * f[k] for _, n, _, f in rows) for k in range(len(kinds))]
        good = (sum(n * g for _, n, g, _ in rows) + 0.8 * PRIOR) / (total + PRIOR)
        shares = tuple((m + fault) / (total + PRIOR) for m in mass)
        caught = tuple(max(SEEN, (sum(n * f[kind[r]] for p, n, _, f in rows if p[r] == -1) + 0.9 * fault) / (mass[kind[r]] + fault)) for r in each)
        wrong = tuple((sum(n * (1 - f[kind[r]]) for p, n, _, f in rows if p[r] == -1) + 0.1 * fault) / (total - mass[kind[r]] + PRIOR - fault) for r in each)
        against = [sum(n for p, n, _, _ in rows if p[r] == -1) for r in each]
        right = tuple(sum(n * (1 - g) for p, n, g, _ in rows if p[r] == -1) / against[r] if against[r] else 1.0 for r in each)
        model = Model(good, shares, caught, wrong, model.praise, right)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each document: id, measures, votes, base_failed, quality (posterior) and kept.

    Null texts count as empty ones, which fail; very long ones are measured whole. Repeated rows each
    count and each get a row. A posterior of exactly the threshold keeps. An empty table gives no
    rows. Other columns of `docs` are not read, whatever their names.
    """
    measured = docs.select(F.col(id_col).alias("id"), measures(whole(text_col)).alias("m"))
    voted = saved(votes(measured.select("id", "m.*")))
    model = fit(voted)
    return voted.withColumn("base_failed", base_failed()).withColumn("quality", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns.

    One pass counts the vote patterns, a second filters: the verdict is an expression over the
    text, so no text is shuffled or stored.
    """
    measured = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), measures(whole(text_col)).alias("m"))
    model = fit(votes(measured.select("m.*")))
    voted = votes(measured.select("doc", "m.*"))
    return voted.where(~base_failed() & (model.posterior() >= threshold)).select("doc.*")
