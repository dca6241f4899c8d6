"""Operator 6: line dedup by winnowing over line hashes.

The lines of a text that hold a word are hashed. Of every ``min_run``
consecutive line hashes the minimum (rightmost on ties) is selected as the
fingerprint of that window, so equal runs of ``min_run`` lines always select
the same line; a line of ``long_line`` words or more is a window of its own and
selects itself. Only selected positions are emitted, one row each. They are
joined to the fingerprints that stand more than once in the corpus; all others
end there. From each position that is left the match is extended both ways, as
far as the windows that selected it reach: a window is matched if the same
fingerprint stands at an earlier position with the same lines to its left and
right. Neighbouring windows of a longer run are matched from their own
fingerprints and overlap, so their union is the maximal run. What is deleted is
exactly: every line in a run of at least ``min_run`` lines (or a long line) that
also stands at an earlier position of the corpus. Earlier means: smaller
document key, or the same document further up.

Fingerprints and windows are counted with map-side aggregation, and both joins
are plain equi-joins with one row per key on the small side, so the large side
of a hot line may be split. Positions are only gathered per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.llm.common import WORD, let, table, temp_names, text_or_empty, words
from progscan.llm.registry import job

MIN_RUN = 2
LONG_LINE = 2

_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD))


def selected(text: Column, min_run: int, long_line: int) -> Column:
    """array<struct<fp, i, wins array<struct<k1, k2, left, len>>>>: the selected lines of a text.

    fp is the line's hash and i its number. wins are the windows that selected it: the line is the left-th of len
    lines, and k1, k2 name them all, with its place among them.
    """
    def position(h: Column, x: Column, i: Column) -> Column:
        own = F.get(h, i)
        wins = [F.when(F.size(words(x)) >= long_line, F.struct(
            F.xxhash64(F.lit("line"), x).alias("k1"), F.hash(x).alias("k2"), F.lit(0).alias("left"), F.lit(1).alias("len")))]
        for left in range(min_run):
            run = [F.get(h, i + d) for d in range(-left, min_run - left)]
            least = F.lit(True)
            for j, other in enumerate(run):  # null beyond the text: no such window
                least = least & (own <= other if j <= left else own < other)
            wins.append(F.when((i >= left) & least, F.struct(
                F.xxhash64(F.lit(left), *run).alias("k1"), F.hash(*run).alias("k2"), F.lit(left).alias("left"),
                F.lit(min_run).alias("len"))))
        return F.struct(own.alias("fp"), i.cast("int").alias("i"),
                        F.filter(F.array(*wins), lambda w: w.isNotNull()).alias("wins"))

    return let(lines_with_words(text), lambda ls: let(F.transform(ls, lambda x: F.xxhash64(x)), lambda h: F.filter(
        F.transform(ls, lambda x, i: position(h, x, i)), lambda p: F.size(p["wins"]) > 0)))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN,
                   long_line: int = LONG_LINE) -> DataFrame:
    """(o, tid, removed array<int>): per document that loses lines, which of its lines with words go, ascending.

    A document is named by o, its key (null: the largest number), and tid, a
    hash of its text; documents with equal keys and other texts are ordered by tid.
    """
    positions = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1)).alias("o"),
                            F.xxhash64(text_or_empty(text)).alias("tid"),
                            F.explode(selected(text_or_empty(text), min_run, long_line)).alias("p")).select("o", "tid", "p.*")
    again = positions.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    matches = (positions.join(again, "fp").select("o", "tid", "i", F.explode("wins").alias("w"))
               .select("w.k1", "w.k2", "w.len", "o", "tid", (F.col("i") - F.col("w.left")).alias("start")))
    # the first place of each window that stands more than once; one row per window
    at = F.struct("o", "tid", "start")
    firsts = (matches.groupBy("k1", "k2", "len").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    gone = F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)
    return (matches.join(firsts, ["k1", "k2", "len"]).where(at > F.col("first"))
            .select("o", "tid", F.explode(gone).alias("line"))
            .groupBy("o", "tid").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without its removed-th lines with words (ascending, from 0); other lines stay as they are."""
    def kept(ls: Column) -> Column:
        marks = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(_HAS_WORD), i)), lambda i: i.isNotNull())
        # -1, the places of removed lines, the end: lines between two neighbours stay
        cuts = let(marks, lambda m: F.concat(F.array(F.lit(-1)), F.transform(removed, lambda r: F.get(m, r)),
                                             F.array(F.size(ls))))
        return let(cuts, lambda c: F.flatten(F.transform(
            F.slice(c, 1, F.size(c) - 1), lambda x, i: F.slice(ls, x + 2, F.get(c, i + 1) - x - 1))))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN,
                long_line: int = LONG_LINE, n_removed: str = "n_removed") -> DataFrame:
    """All rows and columns of docs with the repeated lines cut out of the text, and their number as n_removed.

    A text that loses nothing is returned as it is (null stays null). Lines
    without words never match and stay. A document may lose all its lines; its
    row stays. Rows that are wholly repeated (same key, same text) are one
    document and lose the same lines. A clashing column n_removed is replaced;
    an empty table gives an empty result.
    """
    o, tid, removed = temp_names(docs, "o", "tid", "removed")
    gone = (repeated_lines(docs, key, text, min_run, long_line)
            .withColumnsRenamed({"o": o, "tid": tid, "removed": removed}))
    d = docs.withColumns({o: F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1)),
                          tid: F.xxhash64(text_or_empty(text))})
    r = F.col(removed)
    return (d.join(gone, [o, tid], "left")
            .withColumn(text, F.when(r.isNotNull(), without_lines(text_or_empty(text), r)).otherwise(F.col(text)))
            .withColumn(n_removed, F.coalesce(F.size(r), F.lit(0)).cast("long"))
            .select(*[c for c in docs.columns if c != n_removed], n_removed))


def _oracle() -> str:
    run = ", ".join(f"ls[i + {j}]" for j in range(MIN_RUN))
    return f"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
numbered AS (
  SELECT *, regexp_matches(line, '{_HAS_WORD}') AS has,
         (sum(regexp_matches(line, '{_HAS_WORD}')::INT) OVER (PARTITION BY doc_id ORDER BY p))::BIGINT AS i FROM raw),
lists AS (SELECT doc_id, list(line ORDER BY p) AS ls FROM numbered WHERE has GROUP BY doc_id),
runs AS (SELECT doc_id, ls, unnest(range(1, len(ls) - {MIN_RUN} + 2)) AS i FROM lists),
windows AS (
  SELECT doc_id, i, {MIN_RUN} AS n, [{run}] AS k FROM runs
  UNION ALL
  SELECT doc_id, i, 1, [line] FROM numbered WHERE has AND len(regexp_extract_all(line, '{WORD}')) >= {LONG_LINE}),
later AS (
  SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS rn FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later WHERE rn > 1),
marked AS (
  SELECT m.*, g.i IS NOT NULL AS cut FROM numbered m LEFT JOIN gone g ON m.has AND m.doc_id = g.doc_id AND m.i = g.i),
texts AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT cut), '') AS kept,
         count(*) FILTER (WHERE cut) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN kept ELSE d.text END AS text, n_removed
FROM documents d JOIN texts t USING (doc_id)"""


@job("op6_winnow_lines", _oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
