"""Operator 7: mix sources to target weights by Pareto order sampling.

A source whose target is f times its size is taken f times on average: floor(f)
certain whole copies of every document, and one more copy of a sample with
inclusion probability p = f - floor(f). The sample is drawn in Pareto order: a
document with the random number u has the rank value

    q = (u / (1 - u)) / (p / (1 - p))

and documents are taken in the order of q until the source's remaining size is
filled, to the nearest whole document. With a column of relative importance the
inclusion probabilities differ inside a source; the order makes the sizes fixed
all the same. The random numbers are hashes of the document key, so reruns agree.

No source is ordered by one task: the order is cut into cells of even numbers, sizes are
summed per (source, cell), a running sum over the cells of a source says where
the sample ends, and exact order only matters inside a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from progscan.llm.common import hash_unit, n_words, table, temp_names, text_or_empty
from progscan.llm.registry import job

MAX_COPIES = 3
WEIGHT_CYCLE = (1, 2, 3)


def source_targets(sizes: DataFrame, cycle=WEIGHT_CYCLE, max_copies: int = MAX_COPIES) -> DataFrame:
    """(sk, source_size, target) from one row (sk, source_size) per source.

    Weights repeat ``cycle`` in the order of sk; the total size is shared by
    weight; a target stops at ``max_copies`` times its source's size and the
    excess is shared anew by weight. The end of that process is one level L
    with target = min(cap, L * weight): sources in the order of cap / weight are
    capped as long as the level that the rest would get is not below their own.
    The frame has one row per source, not per document.
    """
    by_name = Window.orderBy("sk")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("cap_level", "sk")
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in cycle]),
                     ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    s = sizes.select("sk", "source_size", w.alias("w"), (F.col("source_size") * max_copies).alias("cap"))
    s = s.withColumn("cap_level", F.col("cap") / F.col("w"))
    s = s.withColumn("left", F.sum("source_size").over(everything)
                     - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.when(F.col("cap_level") * F.col("w_left") > F.col("left"),
                                     F.col("left") / F.col("w_left")))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("sk", "source_size",
                    F.when(F.col("cap_level") <= F.coalesce("level", "cap_level"), F.col("cap").cast("double"))
                    .otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", importance: Column | None = None,
        max_copies: int = MAX_COPIES, cycle=WEIGHT_CYCLE, seed: str = "mix", tie: Column | None = None) -> DataFrame:
    """(key, size, source_size, target, copies, tie) of every document.

    ``importance`` (default 1 everywhere) scales a document's odds inside its
    source. Null sources form a source of their own, ordered last; documents of
    size 0 are never needed and get no sampled copy. Repeated rows are ranked
    one after the other. An empty table gives an empty result.
    """
    sk = F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")).alias("sk")
    imp = (F.lit(1.0) if importance is None else importance.cast("double")).alias("imp")
    tie = (F.lit(0).cast("long") if tie is None else tie).alias("tie")
    rows = docs.select(F.col(key).alias("k"), sk, size.cast("long").alias("size"), imp, tie)
    targets = source_targets(rows.groupBy("sk").agg(F.sum("size").alias("source_size")), cycle, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = (targets.withColumn("whole", F.floor(rate))
               .withColumn("p", rate - F.col("whole"))
               .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    cells = max(1, math.ceil(math.sqrt(rows.count())))
    u = hash_unit(F.lit(seed), F.coalesce(F.col("k").cast("string"), F.lit("null")))
    odds = (F.col("p") / (1 - F.col("p"))) * F.col("imp")
    r = rows.join(targets, "sk").withColumn(
        "q", F.when((F.col("p") > 0) & (F.col("size") > 0) & (odds > 0), (u / (1 - u)) / odds))
    # within a source, q orders like v = (u / (1 - u)) / importance, whose v / (1 + v) fills the cells evenly;
    # documents that cannot be drawn need no order and are spread over cells behind the others
    v = (u / (1 - u)) / F.col("imp")
    r = r.withColumn("cell", F.when(F.col("q").isNotNull(), F.floor(v / (1 + v) * cells))
                     .otherwise(cells + F.floor(u * cells)))
    start = Window.partitionBy("sk").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = (r.groupBy("sk", "cell").agg(F.sum("size").alias("cell_size"))
              .select("sk", "cell", F.coalesce(F.sum("cell_size").over(start), F.lit(0)).alias("start")))
    inside = (Window.partitionBy("sk", "cell").orderBy("q", "k", "size", "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    taken = r.join(before, ["sk", "cell"]).withColumn(
        "at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # twice the distance to the end: whichever of "with" and "without" the document is nearer
    extra = F.col("q").isNotNull() & (2 * F.col("at") + F.col("size") <= 2 * F.col("rest"))
    return taken.select(F.col("k").alias(key), "size", "source_size", "target",
                        (F.col("whole") + extra.cast("long")).alias("copies"), "tie")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: every row of docs as often as ``mix`` takes it, with all its columns; sizes are words.

    The decisions are made on narrow rows and joined back by key, text and, for
    repeated rows, their number among their equals.
    """
    tie, rn, copies, k = temp_names(docs, "tie", "rn", "copies", "k")
    t = F.xxhash64(text_or_empty(text))
    twins = lambda a, b: Window.partitionBy(a, b).orderBy(b)
    m = mix(docs.select(key, source, text), n_words(text_or_empty(text)), key, source, tie=t, **options)
    m = m.select(F.col(key).alias(k), F.col("tie").alias(tie), F.col("copies").alias(copies))
    m = m.withColumn(rn, F.row_number().over(twins(k, tie))).where(F.col(copies) > 0)
    d = docs.withColumn(tie, t)
    d = d.withColumn(rn, F.row_number().over(twins(key, tie)))
    on = d[key].eqNullSafe(m[k]) & (d[tie] == m[tie]) & (d[rn] == m[rn])
    return (d.join(m.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), copies))), on)
            .select(*[d[c] for c in docs.columns]))


_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


def _oracle() -> str:
    u = ("((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5)"
         " / 4503599627370496.0")
    return f"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS sk, {_WORDS}::BIGINT AS size, {u} AS u FROM documents),
s0 AS (SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, cap::DOUBLE / w AS cap_level FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER
         (ORDER BY cap_level, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_all,
         (sum(w) OVER (ORDER BY cap_level, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left
       FROM s2),
s4 AS (SELECT *, max(CASE WHEN cap_level * w_left > rest_all THEN rest_all::DOUBLE / w_left END) OVER () AS lv FROM s3),
s5 AS (SELECT sk, source_size, CASE WHEN cap_level <= coalesce(lv, cap_level) THEN cap::DOUBLE ELSE lv * w END AS target
       FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM s5),
r AS (SELECT d.doc_id, d.size, s6.*, floor(rate) AS whole, rate - floor(rate) AS p, u FROM d JOIN s6 USING (sk)),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM r),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sk ORDER BY q NULLS LAST, doc_id NULLS FIRST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q)
SELECT doc_id, size, source_size, target,
       (whole::BIGINT + CASE WHEN q IS NOT NULL AND 2 * start + size <= 2 * (target - whole * source_size)
                        THEN 1 ELSE 0 END) * size AS taken
FROM a"""


@job("op7_pareto_mix", _oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mix(docs, n_words(text_or_empty()))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
