import itertools
from collections import Counter

from progscan.llm import quality_rules as Q
from tests.llm.helpers import ODD, documents, words


def brute(text):
    t = text or ""
    w = words(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_statistics_are_brute_force(spark):
    rows = ODD + [(50, "a b c d e f a b c d e g a b c d e"), (51, "x\nx\n x\nx\n\n\n"), (52, "#a $b <c> | d"),
                  (53, "1 2 3 4 5 6 7 8 9 0 " * 3), (54, "p " * 12), (55, "a b c d e\nq a b\tc d e\n")]
    got = Q.statistics(documents(spark, rows)).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r.k), tuple(r[c] for c in cols)) for r in got) == sorted((str(i), brute(t)) for i, t in rows)


def test_em_finds_hidden_accuracies():
    """Three independent rules for one kind of junk, right 9, 8 and 7 times of 10; 80 % of the corpus is good."""
    acc = {"a": 0.9, "b": 0.8, "c": 0.7}
    patterns = []
    for votes in itertools.product((-1, 1), repeat=3):
        good, junk = 0.8e6, 0.2e6
        for q, v in zip(acc.values(), votes):
            good *= q if v == 1 else 1 - q
            junk *= q if v == -1 else 1 - q
        patterns.append((dict(zip(acc, votes)), round(good + junk)))
    m = Q.expectation_maximisation(dict.fromkeys(acc, "k"), patterns, rounds=5000, strength=0.0)
    assert abs(m.share["good"] - 0.8) < 0.03
    for r, q in acc.items():
        assert abs(m.rate["good"][r][1] - q) < 0.02 and abs(m.rate["k"][r][-1] - q) < 0.05


def test_em_without_patterns_is_the_prior():
    m = Q.expectation_maximisation(Q.KINDS, [])
    assert abs(m.share["good"] - Q.PRIOR_GOOD) < 1e-9 and abs(m.rate["good"]["symbols"][-1] - 0.005) < 1e-9


def test_verdicts(spark):
    clean = [(i, f"The river {i} runs through valley {i * 7} and past the mill of {i * 3}.\nNobody came by today.") for i in range(300)]
    junk = ([(1000 + i, " ".join(f"w{i}x{j}$$$" for j in range(40))) for i in range(20)]
            + [(2000 + i, " ".join(f"SHOUT{i}N{j}!!" for j in range(40))) for i in range(20)]
            + [(3000 + i, "again again again again again again " * 5) for i in range(20)])
    got = {r.k: r for r in Q.quality(documents(spark, clean + junk + [(9000 + i, t) for i, t in ODD[:4]])).collect() if r.k is not None}
    assert all(got[i].kept for i, _ in clean)
    assert not any(got[i].kept for i, _ in junk)
    assert not any(got[9000 + i].kept for i in (1, 2, 3, 4)) and got[9001].base_failed


def test_empty(spark):
    assert Q.quality(documents(spark, ODD).where("false")).count() == 0


THAI = " ".join("ภาษาไทยเขียนติดกันโดยไม่เว้นวรรค" + str(j) for j in range(14))
CLEAN = {
    "list": "# Shopping for {i}\n" + "\n".join(f"* **item** {{i}}x{j} and more" for j in range(7)),
    "table": "| name | size |\n|------|------|\n" + "\n".join(f"| row{j} of {{i}} | {j} |" for j in range(8)),
    "html": "\n".join(f"<p class=\"c{j}\">Paragraph{j} tells{j} page{{i}} &amp; <b>others{j}</b></p>" for j in range(5)),
    "shell": "\n".join(f"export PATH{j}=$HOME/{{i}}/{j} && cd $PATH{j} # step {j}" for j in range(5)),
    "thai": THAI + " {i}"}


def test_clean_markup_code_and_thai_are_kept(spark):
    """At 5 % of the corpus, beside junk whose symbols are noise."""
    prose = [(i, f"The river {i} runs through valley {i * 7} and past the mill of {i * 3}.\nNobody came by today.") for i in range(475)]
    odd = [(1000 + 100 * k + i, t.replace("{i}", f"{i}")) for k, t in enumerate(CLEAN.values()) for i in range(5)]
    junk = [(5000 + i, " ".join(f"w{i}x{j}$$$" for j in range(40))) for i in range(10)]
    junk += [(6000 + i, " | ".join(f"m{i}x{j}" for j in range(40))) for i in range(10)]
    rows = {r.k: r for r in Q.quality(documents(spark, prose + odd + junk)).collect()}
    assert [(i, rows[i]) for i, _ in prose + odd if not rows[i].kept] == []
    assert not any(rows[i].kept for i, _ in junk)
    kept = {r.doc_id for r in Q.keep_good(documents(spark, prose + odd + junk)).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}


def test_one_dissenting_rule_does_not_reject(spark):
    """5 % of the corpus: a line of signs in otherwise clean prose."""
    prose = "The river {i} runs through valley {j} and past the mill.\nNobody came by today, and all was well at {i}."
    rows = [(i, prose.format(i=i, j=i * 7) + ("\nend &&&&&&&" if i % 20 == 0 else "")) for i in range(400)]
    got = Q.quality(documents(spark, rows)).collect()
    assert all(r.kept for r in got) and min(r.n_noise for r in got if r.k % 20 == 0) == 7


def test_posterior_column_is_the_model(spark):
    """All vote patterns of the rules; the verdict is the posterior and nothing else."""
    names = list(Q.KINDS)
    patterns = [dict(zip(names, v)) for v in itertools.product((-1, 0, 1), repeat=len(names))]
    counts = [(v, 1 + 5 * sum(x == 1 for x in v.values()) ** 3) for v in patterns]
    m = Q.expectation_maximisation(Q.KINDS, counts, together=True)
    rows = spark.createDataFrame([tuple(v.values()) for v in patterns], ", ".join(f"{n} int" for n in names))
    got = rows.select(*names, m.posterior({n: rows[n] for n in names}).alias("q")).collect()
    for r in got:
        joint = m.joint(m.outcome({n: r[n] for n in names}))
        assert abs(r["q"] - joint["good"] / sum(joint.values())) < 1e-9
    text = [(i, t) for i, t in ODD] + [(50, "A B! C $$ " * 9), (51, "clean words stand here in one line of ten words only")]
    assert all(r.kept == (not r.base_failed and r.quality >= Q.THRESHOLD) for r in Q.quality(documents(spark, text)).collect())


def test_kinds_at_every_share_and_size():
    """Whatever their share: one dissenting rule or abstentions do not reject, both rules of a kind do."""
    names, fine = list(Q.KINDS), (1,) * 8
    for share, scale in itertools.product((0.01, 0.05, 0.33), (1, 10 ** 6)):
        def verdict(votes):
            n = 10000 * scale
            counts = [(fine, round(n * (1 - share))), (votes, round(n * share)), ((-1, -1, 1, 1, 1, 1, 1, 1), n // 50)]
            m = Q.expectation_maximisation(Q.KINDS, [(dict(zip(names, v)), k) for v, k in counts], together=True)
            joint = m.joint(m.outcome(dict(zip(names, votes))))
            return joint["good"] / sum(joint.values())

        for i in range(8):
            assert verdict(fine[:i] + (-1,) + fine[i + 1:]) > 0.5
        assert verdict((1, 1, 0, 0, 1, 1, 0, 0)) > 0.9
        for i in (0, 2, 4, 6):
            assert verdict(fine[:i] + (-1, -1) + fine[i + 2:]) < 0.5
