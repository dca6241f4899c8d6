import math

import numpy as np
import pytest

from progscan.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """numpy's own eigenvectors over the distinct fixed-point vectors."""
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
              if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in usable}), dtype=float)
    n, s = len(x), [sum(c) for c in zip(*({tuple(v) for _, v in usable}), strict=True)]
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in usable:
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        for c in range(4):
            out[i, c + 1] = (n, deviation, float((np.array(v) - x.mean(axis=0)) @ vectors[:, c] / math.sqrt(values[c])),
                             values[c] / values.sum())
    return out


def made(n=400, d=12, offset=0.0, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.geomspace(4, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + offset
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)] + [(2000 + i, rows[7][1]) for i in range(200)]
    rows += [(9000, None), (9001, [None] * d), (9002, [math.nan] * d), (9003, [math.inf] + [0.0] * (d - 1)),
             (9004, [1.0] * (d - 1) + [None])]
    return rows


@pytest.mark.parametrize("offset", [0.0, 1000.0])
def test_query_is_numpy(spark, tmp_path, offset):
    rows = made(offset=offset)
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op13(spark, str(tmp_path)).collect()
    want = brute(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    sign = {c: math.copysign(1, next(r.whitened * want[r.vec_id, c][2] for r in got if r.component == c)) for c in range(1, 5)}
    for r in got:
        n, deviation, value, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened * sign[r.component] - value) < 1e-7
        assert abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9


def test_components_of_hard_matrices():
    rng = np.random.default_rng(3)
    for d, scale in ((1, 1.0), (2, 1.0), (7, 1e9), (64, 1e-9), (65, 1.0)):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        e = np.geomspace(1, 1e-8, d) * scale
        values, vectors = W.components((q * e) @ q.T)
        assert np.allclose(values, e, rtol=1e-6) and np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-12)
        assert np.allclose(np.abs(vectors @ q), np.eye(d), atol=1e-6)
    # equal eigenvalues: any orthonormal basis of them
    values, vectors = W.components(np.eye(5))
    assert np.allclose(values, 1) and np.allclose(vectors @ vectors.T, np.eye(5))
    # graded diagonal: small eigenvalues keep their relative accuracy
    g = np.diag(np.geomspace(1e-9, 1, 6))
    a = g @ (np.eye(6) + 0.1) @ g
    values, _ = W.components(a)
    assert np.isclose(np.prod(values), np.prod(np.diag(g) ** 2) * np.linalg.det(np.eye(6) + 0.1), rtol=1e-9)


def test_rank_below_four(spark):
    v = [[i / 8, 2 * i / 8, 3.0] for i in range(9)]
    got = W.whitened(spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9
    assert abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-12


def test_defined_for_odd_tables(spark):
    def of(rows):
        return W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()

    assert of([]) == [] and of([(1, None, 1), (2, [], 1)]) == []
    assert of([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]) == []
    # another length is left out; null and repeated keys keep their rows
    got = of([(None, [1.0, 2.0], 1), (None, [1.5, 0.0], 1), (3, [0.0, 0.25], 1), (3, [0.0, 0.25], 1), (4, [1.0], 1)])
    assert sorted(str(r.k) for r in got) == ["3"] * 4 + ["None"] * 4


def test_deviation_beyond_63_bits():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert W.deviations(x, 10, np.array([0, 0])) == [None, 2500]
    assert W.deviations(x[1:], 10, np.array([1, 2])) == [29 ** 2 + 38 ** 2]
