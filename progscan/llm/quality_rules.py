"""Operator 4: quality rules under weak supervision.

Rules look at statistics of a whole text and vote +1 (good), -1 (junk) or 0
(abstain). How far each vote can be trusted is not set by hand: expectation
maximisation over the votes of all documents estimates it. Junk comes in kinds
(symbol noise, shouting, repetition, odd words) that hardly ever meet in one
text, so the hidden classes are good and one junk class per kind. Every kind of
junk has two rules that look at the same texts from two sides, so their votes are
not independent: within a class the rules of a kind vote together, with a rate for
each way in which they can dissent (their accuracies), and the kinds vote
independently. Rules that abstain say nothing. A
document's verdict is the posterior probability of good, and nothing else.

What is known beforehand weighs as much as the votes, whatever the size of the
corpus: both rules of a kind hardly ever dissent on good texts, one of them may.
So one dissenting rule does not reject a text, as common as such texts may be,
and several weak signs can.

Symbols that are markup (at line starts, in the rows of tables framed by bars,
in tags, around or before words) are no noise, and word lengths say nothing in
scripts that are written without spaces.

Documents with the same votes are alike to the model: the votes of the corpus
are aggregated to at most 3 ** rules patterns with counts (6,561 for the eight
rules here, whatever the input), and the driver iterates over that table.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.llm.common import SPACES, let, table, temp_names, text_or_empty, words, written
from progscan.llm.registry import job

NGRAM = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>"
#: Longer words, and words of one letter, are odd.
LONG_WORD = 30
#: Symbols that mean something: whole table rows, tags and entities, marks at line starts, emphasis, a single symbol
#: before a word (hashtag, variable, reference), arrows and comparisons, doubled operators alone, per cent.
MARKUP = ("(?m)^[ \\t]*\\|[^\\n]*\\|[ \\t\\r]*$|</?[\\p{L}!][^<>\\n]{0,300}+>|&#?[A-Za-z0-9]{1,10};"
          "|^[ \\t]*(?:#{1,6}(?![#*$%&|<>])|[*>$%]+(?=[ \\t]))"
          "|(?<![\\p{L}\\p{N}#*$%&|<>])[#*$%&](?=[\\p{L}\\p{N}_{(\\[])"
          "|(?<![\\p{L}\\p{N}*])\\*{1,3}(?=[\\p{L}\\p{N}])|(?<=[\\p{L}\\p{N}.,!?)])\\*{1,2}(?![\\p{L}\\p{N}*#$%&|<>])"
          "|[-=]>|[<>]=|(?<=[ ])(?:&&|\\|\\||<<|>>|[<>*&%#])(?=[ ])|(?<=[0-9])%(?![#*$%&|<>])")
UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}"


def repeat_words(w: Column, n: int = NGRAM) -> Column:
    """Words that lie in an n-word window found twice or more in the word array, the first one included."""
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))),
                        lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, n)]))

    def covered(g: Column) -> Column:
        def again(s: Column) -> Column:
            """Starts of repeated windows, from windows sorted by hash."""
            hit = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
                                                     x["i"]))
            return F.array_sort(F.filter(hit, lambda p: p.isNotNull()))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        by_hash = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint"))
                .otherwise(let(let(by_hash, again), union)))

    return let(grams, covered)


def statistics_of(text: Column) -> Column:
    """struct of the statistics of a whole text; null text: all 0."""
    t = text_or_empty(text)
    has_word = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    lines = let(F.filter(F.split(t, "\n"), has_word),
                lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                   (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    per_words = let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeated"),
        F.size(F.filter(w, lambda x: (F.char_length(x) > LONG_WORD) | x.rlike("^\\p{L}$"))).cast("long").alias("odd")))
    noise = F.when(t.rlike(f"[{SYMBOLS}]"), F.regexp_replace(t, MARKUP, " ")).otherwise(F.lit(""))
    noise_of = let(noise, lambda x: F.struct(
        F.char_length(F.regexp_replace(x, f"[^{SYMBOLS}]+", "")).cast("long").alias("n"),
        F.size(F.regexp_extract_all(x, F.lit(f"[{SYMBOLS}][^\\x20\\x09-\\x0D]*"), F.lit(0))).cast("long").alias("words")))
    count = lambda pattern: F.char_length(F.regexp_replace(t, pattern, "")).cast("long")
    return let(F.struct(lines.alias("l"), per_words.alias("w"), noise_of.alias("s")), lambda x: F.struct(
        x["w"]["n"].alias("n_words"), count(SPACES + "+").alias("word_chars"),
        count("[^#*$%&|<>]+").alias("n_symbols"), x["l"]["dup"].alias("n_dup_lines"),
        x["w"]["repeated"].alias("n_repeat_words"), x["l"]["n"].alias("n_lines"),
        count("[^\\p{Lu}]+").alias("n_upper"), count("[^!?]+").alias("n_shouts"),
        x["s"]["n"].alias("n_noise"), x["s"]["words"].alias("n_noise_words"), x["w"]["odd"].alias("n_odd_words"),
        count(f"[^{UNSPACED}]+").alias("n_unspaced")))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, statistics) of every document. Nothing is shuffled."""
    return docs.select(F.col(key).alias("k"), statistics_of(F.col(text)).alias("s")).select("k", "s.*")


def _vote(ratio: Column, junk_over: float, good_to: float | None) -> Column:
    v = F.when(ratio > junk_over, -1)
    return (v if good_to is None else v.when(ratio <= good_to, 1)).otherwise(0)


#: Rule -> the kind of junk it looks for.
KINDS = {"symbols": "symbols", "symbol_words": "symbols", "capitals": "shouting", "shouts": "shouting", "dup_lines": "repetition",
         "repeats": "repetition", "word_length": "words", "odd_words": "words"}


def default_rules(of=F.col) -> dict[str, Column]:
    """Vote columns over the statistics (``of(name)``), named as in ``KINDS``."""
    w = F.greatest(of("n_words"), F.lit(1))
    chars = F.greatest(of("word_chars"), F.lit(1))
    lines = F.greatest(of("n_lines"), F.lit(1))
    mean = chars / w
    spaced = 2 * of("n_unspaced") <= of("word_chars")
    return {
        "symbols": _vote(of("n_noise") / w, 0.1, 0.02),
        "symbol_words": _vote(of("n_noise_words") / w, 0.1, 0.02),
        "capitals": _vote(of("n_upper") / chars, 0.3, 0.15),
        "shouts": _vote(of("n_shouts") / w, 0.3, 0.1),
        "dup_lines": F.when(of("n_lines") >= 3, _vote(of("n_dup_lines") / lines, 0.4, 0.34)).otherwise(0),
        "repeats": _vote(of("n_repeat_words") / w, 0.2, 0.2),
        "word_length": (F.when(~spaced, 0).when((mean < 2.5) | (mean > 15), -1)
                        .when((mean > 3.5) & (mean < 10), 1).otherwise(0)),
        "odd_words": F.when(spaced, _vote(of("n_odd_words") / w, 0.3, 0.2)).otherwise(0),
    }


VOTES = (-1, 0, 1)
#: Before any data: how a rule votes (-1, 0, 1) on good texts, on its own kind of junk, on other junk.
PRIOR = {"good": (0.005, 0.145, 0.85), "own": (0.8, 0.15, 0.05), "other": (0.02, 0.18, 0.8)}
#: Before any data: how often none, one, or more rules of a kind dissent together.
PRIOR_DISSENT = {"good": (0.969, 0.03, 0.001), "own": (0.05, 0.15, 0.8), "other": (0.94, 0.05, 0.01)}
PRIOR_GOOD = 0.85
#: What the prior is worth, in documents for each one of the corpus.
STRENGTH = 1.0


def _outcomes(rules: tuple[str, ...]) -> list:
    """What a factor can say: the vote of a single rule, or which of its rules dissent."""
    return list(VOTES) if len(rules) == 1 else list(itertools.product((0, 1), repeat=len(rules)))


def _prior(role: str, rules: tuple[str, ...]) -> dict:
    """Rates of a factor before any data; those of several rules are rescaled to ``PRIOR_DISSENT``."""
    alone = dict(zip(VOTES, PRIOR[role]))
    if len(rules) == 1:
        return alone
    rate = {o: math.prod(alone[-1] if v else 1 - alone[-1] for v in o) for o in _outcomes(rules)}
    dissent = {o: min(sum(o), 2) for o in rate}
    mass = [sum(p for o, p in rate.items() if dissent[o] == d) for d in range(3)]
    return {o: p * PRIOR_DISSENT[role][dissent[o]] / mass[dissent[o]] for o, p in rate.items()}


class Model:
    """share[class], and rate[class][factor][votes]; the class "good" and the kinds of junk.

    factors names the rules that vote together. Where all of them abstain, they
    say nothing about any class; an abstaining rule beside a voting one does not
    dissent.
    """

    def __init__(self, factors: dict[str, tuple[str, ...]], share: dict[str, float], rate: dict[str, dict[str, dict]]):
        self.factors, self.share, self.rate = factors, share, rate

    def outcome(self, votes: dict[str, int]) -> dict:
        return {f: votes[rules[0]] if len(rules) == 1 else tuple(int(votes[r] == -1) for r in rules)
                for f, rules in self.factors.items() if len(rules) == 1 or any(votes[r] for r in rules)}

    def joint(self, outcome: dict) -> dict[str, float]:
        return {c: s * math.prod(self.rate[c][f][o] for f, o in outcome.items()) for c, s in self.share.items()}

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Posterior probability of good, as an expression over vote columns."""
        said = {}  # per factor: the place in the list of outcomes; null where all rules abstain
        for f, rules in self.factors.items():
            if len(rules) == 1:
                said[f] = votes[rules[0]].cast("int") + 1
                continue
            place = F.lit(0)
            for r in rules:
                place = place * 2 + (votes[r] == -1).cast("int")
            said[f] = F.when(F.greatest(*[F.abs(votes[r]) for r in rules]) > 0, place)
        logs = []
        for c in self.share:
            x = F.lit(math.log(self.share[c]))
            for f, rules in self.factors.items():
                rates = F.array(*[F.lit(math.log(self.rate[c][f][o])) for o in _outcomes(rules)])
                x = x + F.coalesce(F.get(rates, said[f]), F.lit(0.0))
            logs.append(x.alias(c))
        # 1 / sum of exp(log class - log good)
        return let(F.struct(*logs), lambda s: 1 / sum((F.exp(s[c] - s["good"]) for c in self.share if c != "good"),
                                                      F.lit(1.0)))


def expectation_maximisation(kinds: dict[str, str], patterns: list[tuple[dict[str, int], int]], rounds: int = 200,
                             strength: float = STRENGTH, together: bool = False) -> Model:
    """Fit the model to (votes by rule, count) patterns.

    The prior is worth ``strength`` imagined documents for each one of the
    corpus, and one more, divided by its shares of the classes: it names the
    classes and holds every rate above 0. Kinds of junk hardly ever meet, so
    the votes alone do not tell a rare kind from an uncommon sort of good text;
    a prior that fades with the input lets an idle junk class take over such
    texts. Without patterns the prior is the model. The rules of a kind vote
    together, or each for itself.
    """
    classes = ["good", *dict.fromkeys(kinds.values())]
    if together:
        factors = {k: tuple(r for r in kinds if kinds[r] == k) for k in classes[1:]}
    else:
        factors = {r: (r,) for r in kinds}
    prior = {c: {f: _prior("good" if c == "good" else "own" if kinds[rules[0]] == c else "other", rules)
                 for f, rules in factors.items()} for c in classes}
    prior_share = {c: PRIOR_GOOD if c == "good" else (1 - PRIOR_GOOD) / (len(classes) - 1) for c in classes}
    model, total = Model(factors, prior_share, prior), sum(n for _, n in patterns)
    imagined = {c: (1 + strength * total) * p for c, p in prior_share.items()}
    outcomes = [(model.outcome(votes), n) for votes, n in patterns]
    for _ in range(rounds):
        mass = dict.fromkeys(classes, 0.0)
        seen = {c: {f: dict.fromkeys(_outcomes(rules), 0.0) for f, rules in factors.items()} for c in classes}
        for outcome, n in outcomes:
            joint = model.joint(outcome)
            whole = sum(joint.values())
            for c, p in joint.items():
                mass[c] += n * p / whole
                for f, o in outcome.items():
                    seen[c][f][o] += n * p / whole
        share = {c: (mass[c] + imagined[c]) / (total + 1 + strength * total) for c in classes}
        rate = {c: {f: {o: (seen[c][f][o] + imagined[c] * p) / (sum(seen[c][f].values()) + imagined[c])
                        for o, p in prior[c][f].items()} for f in factors} for c in classes}
        moved = max(abs(p - model.rate[c][f][o]) for c in classes for f in factors for o, p in rate[c][f].items())
        model = Model(factors, share, rate)
        if moved < 1e-9:
            break
    return model


def fit(stats: DataFrame, rules: dict[str, Column] | None = None, kinds: dict[str, str] | None = None) -> Model:
    """Fit the rules' accuracies to the votes of all documents that have words."""
    rules, kinds = rules or default_rules(), kinds or KINDS
    rows = (stats.where("n_words > 0").select(*[v.cast("int").alias(n) for n, v in rules.items()])
            .groupBy(*rules).agg(F.count(F.lit(1)).alias("documents")).collect())
    patterns = [({r: row[r] for r in rules}, row["documents"]) for row in rows]
    return expectation_maximisation({r: kinds[r] for r in rules}, sorted(patterns, key=str), together=True)


def base_failed(of=F.col) -> Column:
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEAT_PERCENT * of("n_words"))


def judge(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The statistics with base_failed, quality (posterior of good) and kept."""
    return (stats.withColumn("base_failed", base_failed())
            .withColumn("quality", model.posterior(default_rules()))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, statistics, base_failed, quality, kept) for every document.

    Null, empty and blank texts have no words and fail the base rules. Repeated
    rows are judged alike, each for itself. An empty table gives an empty
    result. Only key and text are read. The statistics are written once, to the
    shared folder, and read for the fit and for the verdicts.
    """
    stats = written(statistics(docs, key, text), "quality-statistics")
    return judge(stats, fit(stats))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that ``quality`` keeps, with all their columns.

    The statistics are computed once and written beside each row, to the shared
    folder; the model is fitted to them and the verdicts read them. Nothing is
    shuffled or joined, so keys may be null or repeat. Null, empty and blank
    texts are rejected, repeated rows judged alike; an empty table gives an
    empty result, and a column named like ours keeps its name.
    """
    (beside,) = temp_names(docs, "quality_statistics")
    marked = written(docs.withColumn(beside, statistics_of(F.col(text))), "quality-marked")
    model = fit(marked.select(f"{beside}.*"))
    of = lambda n: F.col(beside)[n]
    return marked.where(~base_failed(of) & (model.posterior(default_rules(of)) >= threshold)).drop(beside)


@job("op4_weak_supervision")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        F.col("k").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality")
