import hashlib

import xxhash

from progscan.llm import fingerprints as P
from tests.llm.helpers import ODD, documents, stored, words


def _hash(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(text, k=P.K, window=P.WINDOW):
    w = words(text)
    g = [_hash(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [_hash(w)] if w else []
    out = []
    for i in range(max(len(g) - window + 1, min(len(g), 1))):
        cut = g[i:i + window]
        at = i + max(j for j, x in enumerate(cut) if x == min(cut))
        if (at, g[at]) not in out:
            out.append((at, g[at]))
    return out


def like(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprint_is_brute_force(spark):
    got = P.fingerprints(documents(spark, ODD)).collect()
    want = sorted((str(i), brute(t)) for i, t in ODD)
    assert sorted((str(r[0]), [tuple(x) for x in r[1]]) for r in got) == want


def test_guarantee(spark):
    """A shared run of window + k - 1 words is found, wherever it stands."""
    shared = " ".join(f"s{i}" for i in range(P.K + P.WINDOW - 1))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i)) + " " + shared + " " + f"end{i}") for i in range(9)]
    fps = [set(h for _, h in r[1]) for r in P.fingerprints(documents(spark, rows)).collect()]
    assert set.intersection(*fps)


def test_query_is_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 3)
    rows = [r for r in ODD if r[0] != 7] + [(100 + i, f"line {i} of many\n" * (i % 5)) for i in range(20)] + [(-5, "neg")]
    d = stored(spark, tmp_path, rows)
    got = {r.doc_id: r for r in P.op8(spark, d).collect()}
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(brute(t), brute(edited))) < 1e-12
        assert abs(r.near_next - like(brute(t), brute(nxt))) < 1e-12
        assert len(r.edited_fingerprint.split()) == len(brute(edited))


def test_equal_keys_and_empty(spark):
    d = documents(spark, [(1, "b"), (1, "a"), (2, "c")])
    got = {(r.k, r.t): r.next for r in P.with_next(d, {}).collect()}
    assert got == {(2, "c"): "b", (1, "b"): "a", (1, "a"): "c"}
    assert P.with_next(d.where("false"), {}).count() == 0
    assert P.fingerprints(d.where("false")).count() == 0
