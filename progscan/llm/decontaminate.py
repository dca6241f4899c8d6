"""Operator 11: benchmark decontamination.

The words of both sides are normalised (A-Z lower-cased, everything in ASCII
but letters and digits separates). Every window of ten consecutive words of a
benchmark item, or all words of a shorter item, is looked for in every window
of the training texts by a 64-bit hash: the hashes of the items are one
broadcast hash table, checked for its size first, and the texts are read once.
Hits are verified word by word. Beyond the checked size the same hashes meet in
a shuffled join, and the words are verified after the hits have met their text.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.llm.common import let, table, temp_names, text_or_empty, written
from progscan.llm.registry import job

WINDOW = 10
#: Largest broadcast hash table, in bytes of window words plus 64 a window; beyond it the join is shuffled.
MAX_BROADCAST = 64 << 20

#: ASCII separators of words once A-Z are lower-cased; a piece of a text is a word with the separators before it.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PIECE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def normalised_words(text: Column) -> Column:
    """The lower-cased words of a text; [] for null and for a text without words."""
    lower = F.translate(text_or_empty(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def window_hashes(w: Column, size: int) -> Column:
    """One 64-bit hash per window of ``size`` words, in order: that of its two (overlapping) halves' hashes."""
    half = (size + 1) // 2
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (half - 1), F.lit(0))),
                        lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, half)]))
    return let(grams, lambda g: F.transform(F.slice(g, 1, F.greatest(F.size(g) - (size - half), F.lit(0))),
                                            lambda x, i: F.xxhash64(F.lit(size), x, F.get(g, i + (size - half)))))


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(h, size, words, items): each distinct window of the items once, with the sorted ids of the items that hold it.

    Items without words have no window. An item without an id is matched, but
    stands in no list.
    """
    w = items.select(F.col(item).cast("string").alias("item"), normalised_words(F.col(text)).alias("w"))
    w = w.withColumn("size", F.least(F.size("w"), F.lit(window)))
    hashed = reduce(lambda other, n: F.when(F.col("size") == n, window_hashes(F.col("w"), n)).otherwise(other),
                    range(2, window + 1), window_hashes(F.col("w"), 1))
    rows = w.select("item", "size", "w", F.posexplode_outer(hashed).alias("at", "h")).where(F.col("h").isNotNull())
    words = F.array_compact(F.array(*[F.when(F.lit(j) < F.col("size"), F.get("w", F.col("at") + j))
                                      for j in range(window)]))
    return (rows.select("item", "size", "h", words.alias("words"))
            .groupBy("h", "size", "words").agg(F.array_sort(F.collect_set("item")).alias("items")))


def _same_words(at: Column, size: Column, words: Column, window: int) -> Column:
    return reduce(lambda a, b: a & b, [(F.lit(j) >= size) | (F.get("w", at + j) == F.get(words, F.lit(j)))
                                       for j in range(window)])


def hits(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(k, fp, at, size, list_id): each occurrence of an item's window in a text, at its first word.

    ``fp`` tells rows of one key apart by their text.
    """
    spark = docs.sparkSession
    of_size = windows.groupBy("size").agg(
        F.sum(F.lit(64) + F.octet_length(F.array_join("words", " "))).alias("bytes")).orderBy("size").collect()
    known = windows.select("h", "size", "words", F.xxhash64("items").alias("list_id"))
    if not of_size:
        return spark.createDataFrame([], "k string, fp long, at int, size int, list_id long").withColumn(
            "k", F.lit(None).cast(docs.schema[key].dataType))
    source = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("fp"),
                         normalised_words(F.col(text)).alias("w"))
    hashes = F.concat(*[window_hashes(F.col("w"), r["size"]) for r in of_size])
    # outer: the plain one filters on the size of the list first, and computes words and hashes a second time for it
    rows = source.select("k", "fp", "w", hashes.alias("hs")).select("k", "fp", "w", F.posexplode_outer("hs").alias("i", "h"))
    # windows of the shorter sizes come first; a size's part is as long as the text has windows of it
    first, at = F.lit(0), F.col("i")
    for r in of_size:
        at = F.when(F.col("size") == r["size"], F.col("i") - first).otherwise(at)
        first = first + F.greatest(F.size("w") - (r["size"] - 1), F.lit(0))
    if sum(r["bytes"] for r in of_size) <= max_broadcast:
        met = rows.join(F.broadcast(known), "h").withColumn("at", at)
        return (met.where((F.col("at") >= 0) & _same_words(F.col("at"), F.col("size"), F.col("words"), window))
                .select("k", "fp", "at", "size", "list_id"))
    # the positions alone are shuffled; the words join the hits of their text afterwards
    thin = rows.select("k", "fp", F.size("w").alias("n"), "i", "h").join(known, "h")
    first, at = F.lit(0), F.col("i")
    for r in of_size:
        at = F.when(F.col("size") == r["size"], F.col("i") - first).otherwise(at)
        first = first + F.greatest(F.col("n") - (r["size"] - 1), F.lit(0))
    found = (thin.groupBy("k", "fp")
             .agg(F.collect_set(F.struct(at.alias("at"), "size", "words", "list_id")).alias("c")))
    back = source.alias("s").join(found.alias("f"), F.col("s.k").eqNullSafe(F.col("f.k"))
                                  & (F.col("s.fp") == F.col("f.fp"))).select("s.k", "s.fp", "w", F.explode("c").alias("c"))
    return (back.where((F.col("c.at") >= 0) & _same_words(F.col("c.at"), F.col("c.size"), F.col("c.words"), window))
            .select("k", "fp", "c.at", "c.size", "c.list_id"))


def disjoint(spans: Column, window: int = WINDOW) -> Column:
    """Spans sorted by start, one a start and none longer than the window, cut to what no earlier one covers."""
    cut = F.transform(spans, lambda x, i: F.struct(
        F.greatest(x["at"], *[F.get(spans, i - j)["until"] for j in range(1, window)]).alias("at"),
        x["until"].alias("until")))
    return F.filter(cut, lambda x: x["at"] < x["until"])


def marked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(k, fp, spans, n_hit, items): the texts that hold windows of the items, one row per key and text.

    spans: disjoint [at, until) word ranges, sorted; items: the sorted ids of
    the items found. Texts without a hit have no row.
    """
    windows = written(item_windows(items, item, item_text, window), "benchmark-windows")
    found = hits(docs, windows, key, text, window, max_broadcast)
    per_place = found.groupBy("k", "fp", "at").agg(F.max(F.col("at") + F.col("size")).alias("until"),
                                                   F.collect_set("list_id").alias("lists"))
    per_text = (per_place.groupBy("k", "fp")
                .agg(F.array_sort(F.collect_list(F.struct("at", "until"))).alias("spans"),
                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists")))
    per_text = written(per_text.withColumn("spans", disjoint(F.col("spans"), window)), "benchmark-hits")
    # equal sets of lists are opened once, however many texts share them
    lists = windows.select("items", F.xxhash64("items").alias("list_id")).distinct()
    opened = (per_text.select("lists").distinct().withColumn("list_id", F.explode("lists")).join(lists, "list_id")
              .groupBy("lists").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["until"] - x["at"]))
    return per_text.join(opened, "lists").select("k", "fp", "spans", n_hit.alias("n_hit"), "items")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(k, n_words, spans, n_hit, items, contaminated) for every row of docs.

    Null, empty and wordless texts have no words, hence no hit. Repeated rows
    and null keys are ordinary. An empty table gives an empty result, an empty
    benchmark no hit. Only key and text are read, so other columns may have any
    name; see ``item_windows`` for items without id or words.
    """
    base = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("fp"),
                       F.size(normalised_words(F.col(text))).cast("long").alias("n_words"))
    m = marked(docs, items, key, text, **options)
    return (base.alias("d").join(m.alias("m"), F.col("d.k").eqNullSafe(F.col("m.k")) & (F.col("d.fp") == F.col("m.fp")),
                                 "left")
            .select("d.k", "n_words", "spans", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


def without_words(text: Column, spans: Column) -> Column:
    """The text without the words of the spans (and the separators before each of them)."""
    def drop(pieces: Column) -> Column:
        flags = F.flatten(F.transform(spans, lambda x, i: F.concat(
            F.array_repeat(F.lit(True), x["at"] - F.coalesce(F.get(spans, i - 1)["until"], F.lit(0))),
            F.array_repeat(F.lit(False), x["until"] - x["at"]))))
        kept = F.zip_with(pieces, flags, lambda p, f: F.when(F.coalesce(f, F.lit(True)), p).otherwise(""))
        read = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.char_length(p))
        return F.concat(F.array_join(kept, ""), F.substring(text, read + 1, F.char_length(text)))

    return let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), drop)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", remove: str = "spans",
                  **options) -> DataFrame:
    """docs without what the benchmark holds: the hit words of each text, or (``remove="documents"``) hit documents.

    All columns stay as they are but the text. Texts without a hit are
    untouched, null texts stay null; repeated rows and null keys are ordinary.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    k, fp, spans = temp_names(docs, "mark_k", "mark_fp", "mark_spans")
    m = marked(docs, items, key, text, **options).select(F.col("k").alias(k), F.col("fp").alias(fp),
                                                         F.col("spans").alias(spans))
    same = docs[key].eqNullSafe(m[k]) & (F.xxhash64(docs[text]) == m[fp])
    if remove == "documents":
        return docs.join(m, same, "left_anti")
    return (docs.join(m, same, "left")
            .withColumn(text, F.when(F.col(spans).isNull(), F.col(text))
                        .otherwise(without_words(F.col(text), F.col(spans)))).drop(k, fp, spans))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, size, i, list_slice(w, i, i + size - 1) AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
hit AS (SELECT DISTINCT r, i, size, item FROM dw JOIN win USING (size, words)),
hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit_words.n, 0)::BIGINT AS n_hit,
       coalesce(hit_items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit_words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""


@job("op11_decontaminate", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("k").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
