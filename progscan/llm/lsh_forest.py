"""Operator 3: n-gram Jaccard join with a MinHash LSH forest and exact verification.

Documents are sets of word 5-grams. The forest has ``trees`` prefix tries over
MinHash signatures: texts meet in a trie node if their signatures agree in its
first values. Two texts of similarity s share the prefix of length d in some
trie with probability 1 - (1 - s^d)^trees. From the full depth, matched prefixes
are shortened until that reaches the target recall at the threshold, where it
is lowest; the nodes at that depth are the candidate groups. Nodes of several
tries with the same members are one candidate group.

Equal texts are one class throughout, so a group of copies is one row. The
members of a candidate group are compared exactly, by their whole shingle sets,
in one task; a group of more than ``BLOCK`` classes is cut into blocks, and
every pair of blocks is a task, so no group is too large for a task and none is
cut short. A pair is counted in the first trie in which it meets. Out come, for
each class, the number of its links, and a spanning forest of the links of each
task; alternating stars make the similarity classes from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from progscan.llm.common import table, temp_names, text_or_empty, written
from progscan.llm.components import components
from progscan.llm.registry import job

NGRAM = 5
THRESHOLD = 0.8
TREES = 10
DEPTH = 8
TARGET_RECALL = 0.999
#: Classes in a block of a candidate group.
BLOCK = 512
#: Shared shingles that one matrix product takes.
COLUMNS = 8192

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GRAM = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(256, _STEP, dtype=np.uint64))
_MUL = _RNG.integers(1, 1 << 63, (TREES * DEPTH,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, (TREES * DEPTH,), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = ~_SPACE[b]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each word, in at
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    most = int(lengths.max())
    powers = _POWERS if most <= len(_POWERS) else np.cumprod(np.full(most, _STEP, dtype=np.uint64))
    return _mix(np.add.reduceat(_BYTE[b[at]] * powers[place], first) + lengths.astype(np.uint64))


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word n-grams; of all words if they are fewer than n; none for none."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(n, len(w))
    grams = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        grams += w[j:len(w) - k + 1 + j] * _GRAM[j]
    return np.unique(_mix(grams + np.uint64(k)))


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that meets the target recall at the threshold: shortened from the full depth on."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= target:
            return d
    return 1


def prefixes(grams: np.ndarray, d: int, trees: int = TREES) -> np.ndarray:
    """The trie node (a hash of the first d signature values) of a shingle set in each tree."""
    rows = (np.arange(trees)[:, None] * DEPTH + np.arange(d)[None, :]).ravel()
    low = np.full(len(rows), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 4096):
        part = grams[i:i + 4096]
        low = np.minimum(low, (part[None, :] * _MUL[rows, None] + _ADD[rows, None]).min(axis=1))
    node = np.zeros(trees, dtype=np.uint64)
    for j in range(d):
        node = _mix(node * _STEP + low.reshape(trees, d)[:, j])
    return node.view(np.int64)


def _signatures(d: int, trees: int, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sets = [shingles(t, n) for t in x["t"]]
            yield pd.DataFrame({"k": x["k"], "c": x["c"],
                                "nodes": [prefixes(g, d, trees) if len(g) else None for g in sets]})

    return run


def _members(n: int):
    """Rows of candidate classes -> one row per candidate group and block pair that the class takes part in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for c, weight, nodes, groups, text in zip(x["c"], x["weight"], x["nodes"], x["groups"], x["t"]):
                grams = shingles(text, n).tobytes()
                for g in groups:
                    blocks = -(-g["size"] // BLOCK)
                    own = int.from_bytes(c[:6], "big") % blocks
                    for other in range(blocks):
                        out.append((g["tree"], g["node"], min(own, other), max(own, other), own, c, weight, nodes, grams))
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=_MEMBER)
                        out = []
            yield pd.DataFrame(out, columns=_MEMBER)

    return run


_MEMBER = ["tree", "node", "i", "j", "block", "c", "weight", "nodes", "grams"]
_MEMBER_TYPE = ("tree int, node long, i int, j int, block int, c binary, weight long, nodes array<long>, "
                "grams binary")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles every set of a shares with every set of b; whole sets, in column blocks."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    va, ia = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    vb, ib = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(va, vb)
    if not len(both):
        return out
    pa, pb = np.searchsorted(both, va), np.searchsorted(both, vb)
    ok_a, ok_b = both[np.minimum(pa, len(both) - 1)] == va, both[np.minimum(pb, len(both) - 1)] == vb
    pa, ia, pb, ib = pa[ok_a], ia[ok_a], pb[ok_b], ib[ok_b]
    sa, sb = np.argsort(pa, kind="stable"), np.argsort(pb, kind="stable")
    pa, ia, pb, ib = pa[sa], ia[sa], pb[sb], ib[sb]
    for lo in range(0, len(both), COLUMNS):
        hi = min(lo + COLUMNS, len(both))
        x = np.zeros((len(a), hi - lo), dtype=np.float32)
        y = np.zeros((len(b), hi - lo), dtype=np.float32)
        fa, fb = slice(*np.searchsorted(pa, [lo, hi])), slice(*np.searchsorted(pb, [lo, hi]))
        x[ia[fa], pa[fa] - lo] = 1
        y[ib[fb], pb[fb] - lo] = 1
        out += x @ y.T
    return out


def _verify(group: list[tuple], tree: int, threshold: float) -> list[tuple]:
    """Links between the two blocks of a group (or within one): (class, root of its tree of links, links, copies)."""
    left = [r for r in group if r[0] == group[0][1]]
    right = [r for r in group if r[0] == group[0][2]]
    within = group[0][1] == group[0][2]
    if not left or not right or (within and len(left) < 2):
        return []
    a = [np.frombuffer(r[6], dtype=np.uint64) for r in left]
    b = a if within else [np.frombuffer(r[6], dtype=np.uint64) for r in right]
    common = _shared(a, b)
    sizes_a, sizes_b = np.array([len(x) for x in a], float), np.array([len(x) for x in b], float)
    union = sizes_a[:, None] + sizes_b[None, :] - common
    link = common >= threshold * union - 1e-9
    if within:
        link = np.triu(link, 1)
    x, y = np.nonzero(link)
    if not len(x):
        return []
    na = np.array([r[5] for r in left], dtype=np.int64).reshape(len(left), -1)
    nb = na if within else np.array([r[5] for r in right], dtype=np.int64).reshape(len(right), -1)
    new = np.ones(len(x), dtype=bool)
    for t in range(tree):  # met before, in an earlier trie
        new &= na[x, t] != nb[y, t]
    rows = left if within else left + right
    y_at = y if within else y + len(left)
    weight = np.array([r[4] for r in rows], dtype=np.int64)
    links, copies = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for p, q in ((x[new], y_at[new]), (y_at[new], x[new])):
        np.add.at(links, p, 1)
        np.add.at(copies, p, weight[q])
    # spanning forest: smallest index reachable, by pointer jumping over the links
    root = np.arange(len(rows))
    while True:
        low = np.minimum(root[x], root[y_at])
        was = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y_at, low)
        np.minimum.at(root, was[x], low)
        np.minimum.at(root, was[y_at], low)
        root = root[root]
        if (root == was).all():
            break
    return [(rows[i][3], rows[root[i]][3], int(links[i]), int(copies[i]))
            for i in range(len(rows)) if links[i] or root[i] != i]


def _verified(threshold: float):
    """Streams the sorted members; one group (of at most two blocks) is held at a time."""
    cols = ["a", "b", "links", "copies"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, out = None, [], []
        for x in batches:
            for tree, node, i, j, block, c, weight, nodes, grams in zip(*(x[m] for m in _MEMBER)):
                if (tree, node, i, j) != key:
                    if group:
                        out += _verify(group, key[0], threshold)
                    key, group = (tree, node, i, j), []
                if not group or group[-1][3] != c:  # a repeated row brings its class twice
                    group.append((block, i, j, c, weight, nodes, grams))
            yield pd.DataFrame(out, columns=cols)
            out = []
        if group:
            yield pd.DataFrame(_verify(group, key[0], threshold), columns=cols)

    return run


def _text_id(text: str):
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                 n: int = NGRAM, trees: int = TREES, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """(k, c) of every row of docs, and (c, rep, root, weight, links, copies) of every text c.

    See ``near_duplicates``; rep is the text's smallest key, root names its
    similarity class.
    """
    d = prefix_length(threshold, trees, DEPTH, target)
    base = docs.select(F.col(key).alias("k"), _text_id(text).alias("c"),
                       text_or_empty(text).alias("t"))
    k_type = base.schema["k"].dataType.simpleString()
    signed = written(base.mapInPandas(_signatures(d, trees, n), f"k {k_type}, c binary, nodes array<long>"), "signatures")
    classes = signed.groupBy("c").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("weight"),
                                      F.first("nodes").alias("nodes"))
    classes = written(classes, "classes")
    places = classes.select("c", F.posexplode("nodes").alias("tree", "node"))
    h = F.xxhash64("c")
    nodes = (places.groupBy("tree", "node")
             .agg(F.count(F.lit(1)).alias("size"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y"))
             .where("size > 1"))
    # nodes with the same members are one candidate group, that of the first tree
    nodes = (nodes.groupBy("size", "x", "y").agg(F.min(F.struct("tree", "node")).alias("first"))
             .select("first.tree", "first.node", "size"))
    groups = (places.join(nodes, ["tree", "node"])
              .groupBy("c").agg(F.collect_list(F.struct("tree", "node", "size")).alias("groups")))
    candidates = classes.join(groups, "c").select("c", "rep", "weight", "nodes", "groups")
    # one text of each candidate class: that of its smallest key (repeated rows are the same text and key)
    rows = (base.join(candidates, (base.c == candidates.c) & base.k.eqNullSafe(F.col("rep")))
            .select(candidates.c, "weight", "nodes", "groups", "t"))
    members = rows.mapInPandas(_members(n), _MEMBER_TYPE)
    members = (members.repartition("tree", "node", "i", "j")
               .sortWithinPartitions("tree", "node", "i", "j", "c"))
    found = written(members.mapInPandas(_verified(threshold), "a binary, b binary, links long, copies long"), "links")
    stars = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    labelled = (classes.select("c", "rep", "weight").join(stars.select(F.col("a").alias("c"), F.col("b").alias("root")),
                                                          "c", "left")
                .join(counts, "c", "left").withColumn("root", F.coalesce("root", "c")))
    return signed.select("k", "c"), labelled


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(k, c, class_id, n_links, n_text_links, n_copies) of every row of docs.

    c names the text (equal texts: equal c). class_id is the smallest key of
    the similarity class: texts connected by links of Jaccard similarity >=
    threshold over word n-grams. n_links counts the other rows that are linked
    directly, copies included; n_text_links the other texts; n_copies the rows
    with the same text. Texts of fewer than n words have one shingle, all their
    words. A text without words has no links but to its copies; null counts as
    empty. Null keys are never the smallest unless a class has no other
    (class_id null). An empty table gives an empty result.
    """
    signed, labelled = text_classes(docs, key, text, **options)
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("class_id"))
    labelled = labelled.join(smallest, "root").select(
        "c", "class_id", (F.coalesce("copies", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_text_links"), F.col("weight").alias("n_copies"))
    return signed.join(labelled, "c")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without near duplicates: of each similarity class the row with the smallest key stays.

    Null keys count as the largest; among equal keys the text decides, and of
    rows equal in both one stays. All columns are kept.
    """
    _, texts = text_classes(docs, key, text, **options)
    c, rep, rn = temp_names(docs, "c", "rep", "rn")
    stay = (texts.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "c")).alias("s"))
            .select(F.col("s.c").alias(c), F.col("s.rep").alias(rep)))
    named = docs.withColumn(c, _text_id(text))
    found = named.join(stay, (named[c] == stay[c]) & named[key].eqNullSafe(stay[rep]), "left_semi")
    twins = Window.partitionBy(c, key).orderBy(*[x for x in docs.columns if x not in (key, text)] or [c])
    return found.withColumn(rn, F.row_number().over(twins)).where(F.col(rn) == 1).select(*docs.columns)


@job("op3_lsh_forest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("k").alias("doc_id"), "class_id", "n_links", "n_text_links", "n_copies")
