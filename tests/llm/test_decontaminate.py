import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from progscan.llm import decontaminate as D
from tests.llm.helpers import ODD, documents

ITEM = "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            size = min(len(iw), window)
            wins = {tuple(iw[j:j + size]) for j in range(len(iw) - size + 1)} if iw else set()
            for j in range(len(w) - size + 1):
                if size and tuple(w[j:j + size]) in wins:
                    hit.update(range(j, j + size))
                    if item is not None:
                        ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids), bool(hit)))
    return out


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ab", "É", "漢字", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([14, 25, 60]))) for i in range(12)]
    items += [(20, "Short item, here!"), (21, "one"), (22, ""), (23, None), (24, " -- "), (None, text(15)),
              (3, text(12)), (100, items[2][1]), (101, items[2][1] + " tail"), (102, "w1 " * 30)]
    docs = [(i, text(rng.choice([3, 40, 200]))) for i in range(30)]
    for i in range(30):
        it = rng.choice(items)[1] or ""
        cut = it.split()[rng.randrange(3):]
        docs.append((100 + i, text(8) + ". " + "-".join(cut).upper() + "\n" + text(5) + " " + it))
    docs += [(500, "w1 " * 500), (501, items[4][1]), (501, items[4][1]), (501, "other"), (None, items[5][1]),
             (None, None), (502, "a short ITEM; here"), (503, "Short-item\x00HERE"), (504, "ONE")]
    return docs + list(ODD), items


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST, 0])
def test_equals_brute_force(spark, limit):
    docs, items = made()
    got = D.contamination(documents(spark, docs), spark.createDataFrame(items, ITEM), max_broadcast=limit).collect()
    rows = [(r.k, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got]
    assert sorted(rows, key=str) == sorted(brute(docs, items), key=str)


def test_spans_are_the_hit_words(spark):
    docs, items = made(2)
    for r in D.marked(documents(spark, docs), spark.createDataFrame(items, ITEM)).collect():
        spans = [(s["at"], s["until"]) for s in r.spans]
        assert spans == sorted(spans) and all(a < b for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert sum(b - a for a, b in spans) == r.n_hit


def test_removal(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], ITEM)
    long = " ".join(f"t{i}" for i in range(4000))
    rows = [(1, "Start: A b-c d e f g h i j; K... end!"), (2, "a b c d e f g h i"), (3, None), (4, ""),
            (5, "a b c d e f g h i j"), (6, long + " a b c d e f g h i j k " + long), (6, "x"), (None, "b c d e f g h i j k\n")]
    # names of our own columns stand in the input already
    docs = documents(spark, rows).withColumn("mark_k", F.lit(7))
    out = D.decontaminate(docs, items)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert got == {(1, "Start... end!"), (2, "a b c d e f g h i"), (3, None), (4, ""), (5, ""),
                   (6, long + " " + long), (6, "x"), (None, "\n")}
    left = D.decontaminate(docs, items, remove="documents")
    assert {r.doc_id for r in left.collect()} == {2, 3, 4, 6} and left.columns == docs.columns
    with pytest.raises(ValueError):
        D.decontaminate(docs, items, remove="all")


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, "a b")], ITEM)
    assert D.contamination(docs.where("false"), items).count() == 0
    got = D.contamination(docs, items.where("false")).collect()
    assert sorted((r.k, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert [r.text for r in D.decontaminate(docs, items.where("false")).orderBy("doc_id").collect()] == ["a b", None]


def test_query_sql_and_brute_force(spark, tmp_path):
    docs, items = made(3)
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = D.op11(spark, str(tmp_path))
    want = sorted(((i, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), c)
                   for i, n, h, ids, c in brute(docs, items)), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(con.sql(D.ORACLE).fetchall(), key=str) == want
    con.close()


def test_plan_broadcasts_hashes_and_uses_no_python(spark, sf_small):
    items = D.written(D.item_windows(spark.read.parquet(f"{sf_small}/benchmark.parquet")), "t")
    plan = D.hits(spark.read.parquet(f"{sf_small}/documents.parquet"), items)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    assert "Exchange hashpartitioning" not in plan
