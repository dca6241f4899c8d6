"""Operator 8: document fingerprints by winnowing.

Hashes of all k-grams of words are rolled over the text; of every ``window``
consecutive hashes the minimum is selected, the rightmost one on ties, and a
position selected by several windows is kept once. Guarantee: two texts that
share a run of ``window + k - 1`` words share a fingerprint there, and nothing
shorter than k words ever matches. A text of 1 to k - 1 words has one hash over
all its words; one with fewer than ``window`` hashes has one window.

Everything is array functions over one row, so a text never leaves its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from progscan.llm.common import let, table, text_or_empty, words
from progscan.llm.registry import job

K = 5
WINDOW = 4


def gram_hashes(w: Column, k: int = K) -> Column:
    """64-bit hashes of the k-grams of a word array; one hash of all words if they are fewer than k; [] for none."""
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))),
                        lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
    return (F.when(F.size(w) >= k, grams)
            .when(F.size(w) > 0, F.array(F.xxhash64(w)))
            .otherwise(F.array().cast("array<bigint>")))


def winnow(g: Column, window: int = WINDOW) -> Column:
    """array<struct<pos int, hash bigint>>: the minimum of every window, rightmost on ties, each position once."""
    def pick(m: Column, i: Column) -> Column:
        """The rightmost place of the minimum m in the window that starts at i."""
        at = F.coalesce(*[F.when(F.get(g, i + j) == m, i + j) for j in reversed(range(window))])
        return F.struct(at.cast("int").alias("pos"), m.alias("hash"))

    starts = F.slice(g, 1, F.greatest(F.size(g) - (window - 1), F.least(F.size(g), F.lit(1))))
    picked = F.transform(starts, lambda x, i: let(F.array_min(F.slice(g, i + 1, window)), lambda m: pick(m, i)))
    # positions never fall from one window to the next, so a repeated one stands beside its equal
    return let(picked, lambda p: F.filter(p, lambda x, i: (i == 0) | (x["pos"] != F.get(p, i - 1)["pos"])))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Selected (pos, hash) pairs of a text; pos is the first word of the k-gram, from 0. Null: empty."""
    return let(words(text_or_empty(text)), lambda w: let(gram_hashes(w, k), lambda g: winnow(g, window)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hash sets; two empty fingerprints are alike (1.0)."""
    def of(x, y):
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(
            let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n)))

    return let(F.array_distinct(a["hash"]), lambda x: let(F.array_distinct(b["hash"]), lambda y: of(x, y)))


def rendered(fp: Column) -> Column:
    """A fingerprint as text: position:hash (in hex), in order of position."""
    return F.array_join(F.transform(fp, lambda x: F.concat_ws(":", x["pos"].cast("string"), F.hex(x["hash"]))), " ")


#: Rows in a range bucket of the document order, about.
BUCKET_ROWS = 200
#: Most range buckets; beyond it the buckets grow. The boundaries are a literal of the plan.
MAX_BUCKETS = 1 << 16


def range_bucket(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= x: binary search in a literal array."""
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
    arr = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    halves = F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)])
    return F.aggregate(halves, F.lit(0),
                       lambda lo, h: F.when(F.get(arr, lo + h - 1) <= x, lo + h).otherwise(lo))


def with_next(docs: DataFrame, columns: dict[str, Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the next one in descending order of the key; after the last comes the first.

    Returns (k, t, next, and for each of ``columns``, computed from t, its value
    and next_<name>); null texts are empty. Null keys come last, equal keys in
    descending order of their texts. A single document follows itself.

    The order is never made by one task: approximate quantiles of the keys (a
    driver-side list of at most MAX_BUCKETS numbers) cut it into range buckets,
    a window inside each bucket finds the next row, and the first row of each
    bucket also stands, as a guard, at the end of the bucket above it.
    """
    o = F.coalesce(F.col("k"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(key).cast("bigint").alias("k"), text_or_empty(text).alias("t"))
    keys = rows.select("k", o.alias("o"))
    buckets = min(MAX_BUCKETS, max(1, math.ceil(keys.count() / BUCKET_ROWS)))
    bounds: list[int] = []
    if buckets > 1:
        qs = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(keys.select(F.percentile_approx("o", qs, 4 * buckets)).first()[0]))
    cut = range_bucket(o, bounds) if bounds else F.lit(0)
    # the largest key of each bucket that has rows, and the bucket above: at most MAX_BUCKETS small rows
    ring = Window.orderBy("bucket")
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = (keys.withColumn("bucket", cut).groupBy("bucket").agg(F.max("o").alias("head"))
             .withColumn("above", F.coalesce(F.lead("bucket").over(ring), F.first("bucket").over(every))))
    places = F.array(F.struct(F.col("bucket"), F.lit(0).alias("guard")))
    guards = F.array(F.struct(F.col("above").alias("bucket"), F.lit(1).alias("guard")))
    placed = (rows.withColumn("bucket", cut).join(F.broadcast(heads), "bucket")
              .withColumn("place", F.explode(F.when(o == F.col("head"), F.concat(places, guards)).otherwise(places)))
              .select("k", "t", "place.bucket", "place.guard")
              .repartition("bucket")
              .select("k", "t", "bucket", "guard", *[c.alias(n) for n, c in columns.items()]))
    down = Window.partitionBy("bucket").orderBy("guard", o.desc(), F.desc("t"))
    return (placed.select("k", "t", "guard", F.lead("t").over(down).alias("next"), *columns,
                          *[F.lead(n).over(down).alias(f"next_{n}") for n in columns])
            .where("guard = 0").drop("guard"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K,
                 window: int = WINDOW) -> DataFrame:
    """(key, fingerprint) of every document; nothing is shuffled.

    Null and empty texts have an empty fingerprint, equal texts equal ones, an
    empty table gives an empty result; other columns are ignored.
    """
    return docs.select(F.col(key), fingerprint(F.col(text), k, window).alias("fingerprint"))


@job("op8_winnow_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = with_next(docs, {"fp": fingerprint(F.col("t"))})
    half = F.floor(F.char_length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.char_length("t") - half), F.substring("next", F.lit(1), half))
    d = d.withColumn("edited", edited)
    d = d.withColumn("edited_fp", fingerprint(F.col("edited")))
    return d.select(F.col("k").alias("doc_id"), F.char_length("t").cast("long").alias("n_chars"),
                    F.sha2("edited", 256).alias("edited_sha256"),
                    rendered(F.col("fp")).alias("fingerprint"), rendered(F.col("edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
