import zlib
from collections import Counter, defaultdict

from progscan.llm import mixing as M
from progscan.llm import sharding as S
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, documents, words


def test_shards(spark):
    rows = ODD + [(100 + i, f"t{i}") for i in range(3000)]
    d = documents(spark, rows).withColumn("shard", F.lit("clash")).withColumn("block", F.lit(1))
    even = {s: 1.0 for s in range(8)}
    got = S.shard_records(d, even).collect()
    assert len(got) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert min(Counter(r.shard for r in got).values()) > 300
    # equal keys share a shard; one more shard only takes into itself
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in by_id.values())
    grown = S.shard_records(d, even | {8: 1.0}).collect()
    moved = [r for r in grown if by_id[r.doc_id] != {r.shard}]
    assert moved and {r.shard for r in moved} == {8} and len(moved) < len(rows) / 6


def test_slots_do_not_depend_on_blocks(spark):
    d = documents(spark, [(i, f"t{i}") for i in range(500)]).select("doc_id", "text")
    d = d.withColumn("shard", S.rendezvous(F.col("doc_id"), {0: 1.0, 1: 1.0}))
    a = {r.doc_id: r.slot for r in S.with_slots(d, "shard", "doc_id", [], block_rows=7).collect()}
    b = {r.doc_id: r.slot for r in S.with_slots(d, "shard", "doc_id", []).collect()}
    assert a == b


def test_weights(spark):
    got = Counter(r.s for r in spark.range(20000).select(S.rendezvous(F.col("id"), {0: 1.0, 1: 3.0}).alias("s")).collect())
    assert abs(got[1] / 20000 - 0.75) < 0.02


def brute_targets(sizes):
    """Share by weight; stop at three times the size; share the excess anew until none is above."""
    keys = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: i % 3 + 1 for i, k in enumerate(keys)}
    target, free, left = {}, set(keys), float(sum(sizes.values()))
    while free:
        level = left / sum(w[k] for k in free)
        over = {k for k in free if w[k] * level > 3 * sizes[k]}
        if not over:
            return target | {k: w[k] * level for k in free}
        for k in over:
            target[k] = 3.0 * sizes[k]
        left -= sum(target[k] for k in over)
        free -= over
    return target


def test_mix(spark):
    rows = [(i, "w " * (i % 13), f"s{i % 7}" if i % 7 else None) for i in range(2000)]
    rows += [(5000 + i, "x y z", "tiny") for i in range(3)] + [(6000, None, "empty"), (6001, "lone", "")]
    d = documents(spark, rows).withColumn("target", F.lit(0))
    got = M.mix(d, M.n_words(M.text_or_empty())).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    src = {r[0]: r[2] for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.copies <= 3
        taken[s] += r.copies * r.size
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = M.mix(d.repartition(11), M.n_words(M.text_or_empty())).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mix_odd(spark):
    assert M.mix(documents(spark, ODD), M.n_words(M.text_or_empty())).count() == len(ODD)
    assert M.mix(documents(spark, ODD[:3]), M.n_words(M.text_or_empty())).select("copies").distinct().count() == 1
    assert M.mix(documents(spark, ODD).where("false"), M.n_words(M.text_or_empty())).count() == 0


def test_importance_orders_the_sample(spark):
    rows = [(i, "w", "a" if i < 3000 else "b") for i in range(4000)]
    d = documents(spark, rows)
    got = M.mix(d, F.lit(1), importance=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("doc_id < 3000")
    by = {r.odd: r.c for r in got.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("c")).collect()}
    assert by[0] > 1.4 * by[1]
