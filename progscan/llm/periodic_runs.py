"""Operator 12: periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q that no neighbouring word
extends, at least four periods (and six words) long.

At every dyadic scale t a text's synchronising set holds the positions whose
t-word name is the smallest of the t + 1 names from there on, or stands t words
before that smallest one: whether a position belongs depends on its next 2t
words alone, so the two copies of a repeated stretch are cut alike. Neighbouring
members with equal 2t-word contexts propose their distance as a period in
[t, 2t). Positions inside stretches of period at most t / 4 have no name at that
scale; those periods come from the smaller scales, and the smallest, below 16,
from comparing the text with itself shifted. Each proposal is then extended word
by word, so a name shared by chance proposes nothing that stays.

Why none is missed: in a run of period q in [t, 2t), if no member stood in a
stretch of t positions, all its names would be left out, so the stretch had a
period of at most t / 4, and a run all of such stretches would have that period
itself. So a member stands early enough for its context and the context's copy q
words on to lie in the run. A context has at least q words, hence no equal
context stands nearer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from progscan.llm.common import SPACES, let, table, text_or_empty, words
from progscan.llm.registry import job

#: A run has at least so many periods and words.
LEAST_PERIODS = 4
LEAST_WORDS = 6
#: Periods below it are found by shifting; the first synchronising scale.
FIRST_SCALE = 16
#: Texts are searched together up to so many bytes; a longer text is searched alone.
CHUNK_BYTES = 4 << 20

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit names of pairs of names."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _doubled(names: np.ndarray, t: int) -> np.ndarray:
    """Names of 2t-word stretches from those of t words; the last t positions get names of their own."""
    own = np.arange(1, min(t, len(names)) + 1, dtype=np.uint64) + np.uint64(1 << 62)
    return _mix(names, np.concatenate([names[t:], own]))


def _stretches(codes: np.ndarray, p: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """[a, b) of the stretches of at least ``least`` positions where the codes equal those p further on."""
    at = np.flatnonzero(codes[:-p] == codes[p:])
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    a, b = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
    long = b - a >= least
    return a[long], b[long]


def _reach(codes: np.ndarray, i: int, d: int, block: int) -> tuple[int, int]:
    """The largest [a, b) around i where the codes equal those d further on; a separator ends it at the latest."""
    b, step = i, block
    while True:
        differ = codes[b:b + step][:len(codes) - b - d] != codes[b + d:b + d + step]
        if differ.any():
            b += int(differ.argmax())
            break
        b, step = b + len(differ), 2 * step
    a, step = i, block
    while a > 0:
        low = max(0, a - step)
        differ = codes[low:a] != codes[low + d:a + d]
        if differ.any():
            return a - int(differ[::-1].argmax()), b
        a, step = low, 2 * step
    return a, b


def _synchronising(names: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The positions of the synchronising set of scale t."""
    ids = names.copy()
    ids[periodic] = _NONE
    low, w = ids, 1
    while w < t:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[:-1], low[1:])
    n = len(low)
    return np.flatnonzero((low != _NONE) & ((low == ids[:n]) | (low == ids[t:t + n])))


def _inside(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges [first, last]."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return np.cumsum(edge[:n]) > 0


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs, by start and period.

    ``codes``: the word numbers of several texts, with a separator (a code of its
    own) before each and one at the end; ``bounds``: the separators' positions.
    """
    found = []
    for p in range(1, min(FIRST_SCALE, len(codes) - 1)):
        a, b = _stretches(codes, p, max((LEAST_PERIODS - 1) * p, LEAST_WORDS - p))
        if len(a):
            found.append(np.stack([a, b + p, np.full(len(a), p)]))
    names, t = _mix(codes.astype(np.uint64), np.zeros(len(codes), dtype=np.uint64)), 1
    while t < FIRST_SCALE:
        names, t = _doubled(names, t), 2 * t
    place = np.arange(len(codes))
    lengths = np.diff(bounds) - 1
    here = codes
    while True:
        # texts too short for a run of this scale are left out from here on
        keep = lengths >= LEAST_PERIODS * t
        if not keep.any():
            break
        if not keep.all():
            chosen = np.repeat(keep, lengths + 1)
            chosen = np.concatenate([chosen, np.zeros(len(here) - len(chosen), dtype=bool)])
            last = here[-1:]
            place, names = np.append(place[chosen], place[-1]), np.append(names[chosen], names[-1])
            here, lengths = np.append(here[chosen], last), lengths[keep]
        periodic = np.zeros(len(here), dtype=bool)
        if found:
            start, end, period = np.concatenate(found, axis=1)
            of = (LEAST_PERIODS * period <= t) & (end - start >= t)
            first = np.searchsorted(place, start[of])
            known = place[np.minimum(first, len(place) - 1)] == start[of]
            if known.any():
                first = first[known]
                periodic = _inside(len(here), first, first + (end - start)[of][known] - t)
        contexts = _doubled(names, t)
        at = _synchronising(names, t, periodic)
        order = np.argsort(contexts[at], kind="stable")
        c, s = contexts[at][order], at[order]
        d = s[1:] - s[:-1]
        pair = (c[1:] == c[:-1]) & (d >= t) & (d < 2 * t)
        i, d = s[:-1][pair], d[pair]
        done_d, done = 0, 0
        for x, q in zip(*(v[np.lexsort((i, d))].tolist() for v in (i, d)), strict=True):
            if q == done_d and x < done:
                continue
            a, b = _reach(here, x, q, 2 * t)
            done_d, done = q, b
            if b - a >= (LEAST_PERIODS - 1) * q:
                found.append(np.array([[place[a]], [place[a] + b - a + q], [q]]))
        names, t = contexts, 2 * t
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # one stretch has one smallest period; its multiples stretch as far
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _analysed(texts: pa.Array) -> list[pa.Array]:
    """n_words, runs and the collapsed text of each text."""
    lists = pc.split_pattern_regex(texts.cast(pa.large_string()), SPACES + "+")
    n = len(lists)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    flat = flat.filter(pa.array(full))
    counts = np.diff(before)
    numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    # a separator before each text and after the last: codes that no word has
    bounds = before + np.arange(n + 1)
    codes = np.empty(len(numbers) + n + 1, dtype=np.int64)
    is_word = np.ones(len(codes), dtype=bool)
    is_word[bounds] = False
    codes[is_word] = numbers
    codes[bounds] = -1 - np.arange(n + 1)
    start, length, period = find_runs(codes, bounds)
    doc = np.searchsorted(bounds, start, side="right") - 1
    dropped = _inside(len(codes), start + period, start + length - 1)[is_word] if len(start) else np.zeros(len(flat), bool)
    left = np.concatenate([[0], np.cumsum(~dropped)])[before]
    kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), flat.filter(pa.array(~dropped)))
    in_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(in_doc, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(v.astype(np.int64)) for v in (start - bounds[doc] - 1, length, period)], ["start", "length", "period"]))
    return [pa.array(counts.astype(np.int64)), runs, pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())]


def _batches(source):
    for batch in source:
        done = 0
        while done < batch.num_rows:
            sizes = pc.binary_length(batch.column(1).slice(done)).to_numpy(zero_copy_only=False)
            rows = max(1, int(np.searchsorted(np.cumsum(sizes), CHUNK_BYTES, side="right")))
            part = batch.slice(done, rows)
            yield pa.RecordBatch.from_arrays([part.column(0), *_analysed(part.column(1))],
                                             ["k", "n_words", "runs", "collapsed"])
            done += rows


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, n_words, runs, collapsed) of every row of docs.

    runs: array of (start, length, period) in words from 0, by start and
    period. collapsed: the words that no run repeats (those outside all runs or
    within a run's first period), one space apart.

    A row is searched where it is read, together with its neighbours up to
    ``CHUNK_BYTES``; nothing is shuffled. Null, empty and blank texts have no
    word and no run. Repeated rows and null keys are ordinary, an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    schema = StructType([StructField("k", source.schema["k"].dataType), *StructType.fromDDL(
        "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")])
    return source.mapInArrow(_batches, schema)


def planted(docs: DataFrame) -> DataFrame:
    """documents with the words of every tenth text (by the CRC of its id) made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(w, g):
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    changed = let(words(text_or_empty("text")), lambda w: F.when(
        F.size(w) > 0, F.array_join(repeat(w, F.floor(h / 10)), " ")).otherwise(F.col("text")))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


@job("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))

    def better(a, b):
        """The run of two with the larger length / period; the earlier one on ties, then the shorter period."""
        more, less = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(a.isNull() | (more > less), b).otherwise(a)

    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("k", "runs", "collapsed", best.alias("best"), F.array_join(lines, "").alias("listing"))
    return out.select(F.col("k").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
                      F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                      F.col("best.period").alias("period"),
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.col("listing").cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
