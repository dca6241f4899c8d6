import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from progscan.llm import periodic_runs as R
from tests.llm.helpers import ODD, documents, stored, words


def brute(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            if w[x] != w[x + q]:
                x += 1
                continue
            y = x
            while y + q < n and w[y] == w[y + q]:
                y += 1
            if y + q - x >= max(6, 4 * q):
                found.setdefault((x, y + q - x), q)
            x = y + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def spelled(numbers):
    return " ".join(f"w{x}" for x in numbers)


def some_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 6])
        out.append([rng.randrange(letters) for _ in range(rng.randrange(80))])
    for _ in range(60):
        # a root (periodic itself at times) several times, then broken, in random surroundings
        root = [rng.randrange(3) for _ in range(rng.choice([1, 2, 5, 15, 16, 17, 31, 32, 33, 63, 70]))]
        if rng.random() < 0.4:
            root = [rng.randrange(2)] * rng.randrange(1, 70) + root
        if rng.random() < 0.3:
            root = root * 5 + [7]
        body = root * rng.choice([3, 4, 5, 9]) + root[:rng.randrange(len(root))]
        body = body[:4 * len(root) - rng.choice([0, 0, 1])] if rng.random() < 0.4 else body
        out.append([rng.randrange(3) for _ in range(rng.randrange(40))] + body + [rng.randrange(3) for _ in range(rng.randrange(40))])
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    out += [fibonacci[-1], thue, thue[:100] * 8, fibonacci[8] * 6 + [9] + fibonacci[8] * 6, [0] * 700, [0, 0, 0, 1] * 300,
            ([0] * 40 + [1]) * 6, ([0] * 200 + [1]) * 5, (([0] * 20 + [1]) * 5 + [2]) * 5, [], [1], [0, 0, 0, 0, 0, 0]]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_finder_is_brute_force(seed):
    """All texts of a chunk together, so that texts of all lengths leave the search at their scale."""
    texts = some_texts(seed)
    random.Random(seed).shuffle(texts)
    codes, bounds = [], []
    for i, t in enumerate(texts):
        bounds.append(len(codes))
        codes += [-1 - i, *t]
    bounds.append(len(codes))
    codes.append(-1 - len(texts))
    start, length, period = R.find_runs(np.array(codes), np.array(bounds))
    of = np.searchsorted(bounds, start, side="right") - 1
    got = [[] for _ in texts]
    for i, s, n, q in zip(of, start, length, period, strict=True):
        got[i].append((int(s) - bounds[i] - 1, int(n), int(q)))
    assert got == [brute(t) for t in texts]


def test_operator_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 3000)
    rows = [(1000 + i, spelled(t)) for i, t in enumerate(some_texts(9))] + list(ODD) + [(None, "a b " * 9), (None, "a b " * 9)]
    got = R.periodic_runs(documents(spark, rows)).collect()
    want = []
    for i, t in rows:
        runs = brute(words(t))
        want.append((str(i), len(words(t)), runs, collapsed(words(t), runs)))
    assert sorted((str(r.k), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)


def test_query_is_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab cd\te f g\n").strip() or "z" for _ in range(rng.randrange(300)))) for i in range(200)]
    rows += [r for r in ODD if r[0] is not None] + [(-7, spelled([1, 2, 3] * 50)), (None, spelled([1, 2] * 50))]
    seen = 0
    got = sorted((tuple(r) for r in R.op12(spark, stored(spark, tmp_path, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
            seen += 1
        runs = brute(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
                     hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    assert seen > 5 and got == sorted(want, key=str)


def test_empty_table(spark):
    assert R.periodic_runs(documents(spark, [(1, "a")]).where("false")).count() == 0


def test_long_text_is_linear(spark):
    """Two million words: a repeated page, then words that never repeat."""
    page = " ".join(f"p{i}" for i in range(5000))
    text = " ".join([page] * 200) + " " + " ".join(f"u{i}" for i in range(1_000_000))
    r = R.periodic_runs(documents(spark, [(1, text)])).first()
    assert [tuple(x) for x in r.runs] == [(0, 1_000_000, 5000)]
    assert len(words(r.collapsed)) == 1_005_000
