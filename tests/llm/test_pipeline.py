from collections import Counter

import corpus_pipeline as C
from progscan.llm import lsh_forest, mixing
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, documents, stored, words
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_lsh_forest import brute as brute_classes
from tests.llm.test_pieces import LIBRARY


def clean(i):
    return "\n".join(f"In chapter {i * 31 + j} the walker{i * 7 + j} finds{j} stone{j} near gate{i + j} and rests{j} a while."
                     for j in range(4))


ROWS = ([(i, clean(i), f"s{i % 3}") for i in range(60)]
        + [(100 + i, clean(i), "s1") for i in range(5)]  # copies
        + [(200 + i, clean(i + 20).replace("finds0", "sees", 1).replace("\n", " "), "s2") for i in range(5)]
        + [(250 + i, clean(i + 20).replace("\n", " "), "s2") for i in range(5)]  # near each other
        + [(300 + i, "buy $$$ now ### " * 20, "s0") for i in range(3)])


def test_stages(spark):
    docs = documents(spark, ROWS)
    good = C.quality(spark, docs, "").cache()
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {i for i, _, _ in ROWS if i < 300}
    lines = C.line_dedup(spark, good, "").cache()
    want = brute_lines([(r[0], r[1]) for r in ROWS if r[0] < 300])
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and {i: r.text for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    one = C.near_duplicates(spark, lines, "").cache()
    classes = brute_classes(sorted((i, r.text) for i, r in got.items()))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {c for _, c, _, _ in classes}
    mix = C.mixing(spark, one, "").cache()
    taken = Counter(r.doc_id for r in mix.collect())
    plan = {r.doc_id: r.copies for r in mixing.mix(one, mixing.n_words(F.col("text"))).collect() if r.copies}
    assert mix.columns == docs.columns and taken == plan
    ids = C.encoding(spark, mix, "").collect()
    assert Counter(r.doc_id for r in ids) == taken
    assert all(list(r.ids) == LIBRARY.encode(got[r.doc_id].text) for r in ids)


def test_run(spark, tmp_path):
    rows = C.run(spark, stored(spark, tmp_path, ROWS)).collect()
    assert rows and {r.doc_id for r in rows} <= {i for i, _, _ in ROWS if i < 300}


def test_odd(spark):
    """Null and repeated keys, null texts, an empty table: every stage keeps its columns and does not fail."""
    for rows in (documents(spark, ODD + ODD), documents(spark, ODD).where("false")):
        docs = rows.withColumn("n", F.lit("clash"))
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
        C.encoding(spark, docs, "").count()


def test_one_of_each_with_twins(spark):
    rows = [(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, "x y"), (None, "x y"), (2, "x z")]
    got = lsh_forest.one_of_each(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a b c d e f"), (None, "x y"), (2, "x z")], key=str)


def test_mixed_twins(spark):
    rows = [(1, "a b c", "s")] * 4 + [(2, "d e f", "s")] * 2 + [(3, "g", "t")] * 9
    got = Counter((r.doc_id, r.text) for r in mixing.mixed(documents(spark, rows)).collect())
    plan = Counter()
    for r in mixing.mix(documents(spark, rows), mixing.n_words(F.col("text"))).collect():
        plan[r.doc_id] += r.copies
    assert {k: n for (k, _), n in got.items()} == {k: n for k, n in plan.items() if n}
    assert all(len(words(t)) for _, t in got)
