import random

from progscan.llm import lsh_forest as N
from progscan.llm.components import components
from tests.llm.helpers import ODD, documents, words


def sets(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Per row: (key, class_id, n_links, n_text_links)."""
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, texts = [0] * len(rows), [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])):
                root[find(i)] = find(j)
                for p, q in ((i, j), (j, i)):
                    links[p] += 1
                    if not same:
                        texts[p].add(rows[q][1])
    small = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            small[find(i)] = min(k, small.get(find(i), k))
    return sorted(((k, small.get(find(i)), links[i], len(texts[i])) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed, groups, size):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)  # several blocks to a group
    rows = corpus(1, 40, 12) + [(10000 + i if i else None, t) for i, (_, t) in enumerate(ODD[:9])]
    got = N.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.k, r.class_id, r.n_links, r.n_text_links) for r in got), key=str) == brute(rows)


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 to 0.83 share a trie node nearly always."""
    rng = random.Random(2)
    d = N.prefix_length(0.8)
    met = 0
    for i in range(400):
        a = [f"{i}a{j}" for j in range(220)]
        b = list(a)
        for p in rng.sample(range(10, 210), 4):
            b[p] = "changed"
        x, y = N.shingles(" ".join(a)), N.shingles(" ".join(b))
        assert 0.8 <= len(set(x) & set(y)) / len(set(x) | set(y)) < 0.9
        met += bool((N.prefixes(x, d) == N.prefixes(y, d)).any())
    assert met >= 0.99 * 400
    assert N.prefix_length(0.8, 10, 8, 0.999) == 3 and N.prefix_length(0.8, 1, 8, 0.999) == 1


def test_odd(spark):
    assert N.near_duplicates(documents(spark, ODD).withColumnRenamed("lang", "class_id")).count() == len(ODD)
    assert N.near_duplicates(documents(spark, ODD).where("false")).count() == 0
    # a row that is there three times, and a text like it
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t")] * 3 + [(2, "a b c d e f g h i j k l m n o p q r s x")]
    got = N.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.k, r.class_id, r.n_links, r.n_text_links, r.n_copies) for r in got) == \
        [(1, 1, 3, 1, 3)] * 3 + [(2, 1, 3, 1, 1)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(50)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root if find(n) != n}
