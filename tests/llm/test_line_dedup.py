import random

from progscan.llm import line_dedup as L
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, documents, words


def brute(rows, min_run=L.MIN_RUN, long_line=L.LONG_LINE):
    """rows: (doc_id, text) with distinct ids; returns {id: (text, removed)}"""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (t or "").split("\n")
        own = [n for n, x in enumerate(lines) if words(x)]
        gone = set()
        spans = [(s, min_run) for s in range(len(own) - min_run + 1)]
        spans += [(s, 1) for s in range(len(own)) if len(words(lines[own[s]])) >= long_line]
        for s, n in dict.fromkeys(spans):
            k = (n, tuple(lines[own[j]] for j in range(s, s + n)))
            if k in seen:
                gone |= {own[j] for j in range(s, s + n)}
            seen.add(k)
        out[i] = ("\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else t, len(gone))
    return out


def test_is_brute_force(spark):
    rng = random.Random(5)
    long = [" ".join(f"l{k}w{j}" for j in range(25)) for k in range(3)]
    rows = []
    for i in range(120):
        lines = [rng.choice(["a", "b", "c", " c", "", "  ", f"own {i}", *long]) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(1000, None), (None, "a\nb\nc"), (1001, "a\n" * 30), (1002, "z z\n" * 9)]
    for run in (1, 2, 3):
        got = {r.doc_id: (r.text, r.n_removed) for r in L.dedup_lines(documents(spark, rows), min_run=run).collect()}
        assert got == brute(rows, run)


def test_hot_lines(spark):
    """Every document holds the same two lines: the first keeps them, nothing else is lost."""
    rows = [(i, f"start {i}\nthe common line\nand its neighbour\nend {i}") for i in range(2000)]
    got = L.dedup_lines(documents(spark, rows, 7)).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(i, 0 if i == 0 else 2) for i in range(2000)}
    assert all(r.text == f"start {r.doc_id}\nend {r.doc_id}" for r in got if r.doc_id)


def test_odd(spark):
    d = documents(spark, ODD).withColumn("removed", F.lit("clash")).withColumn("o", F.lit(1))
    got = L.dedup_lines(d)
    assert got.columns == [*d.columns, "n_removed"] and got.count() == len(ODD)
    twins = [r for r in got.collect() if r.doc_id == 7]
    assert len(twins) == 2 and twins[0] == twins[1]
    # equal keys, other texts: each is judged on its own lines
    got = L.dedup_lines(documents(spark, [(1, "a\nb\nc"), (1, "x\na\nb")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 2]
    assert L.dedup_lines(d.where("false")).count() == 0
