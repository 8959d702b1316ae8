import math
import os

import numpy as np
import pytest

from reportloom.llm import embedding_whitening as ew
from reportloom.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def dense(vectors, components=32):
    """x, n, deviations, eigenvalues and eigenvectors by numpy's own solver."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    far = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    c = (x - 1_000_000).astype(float)
    c -= c.mean(axis=0)
    cov = c.T @ c / n
    values, axes = np.linalg.eigh(cov)
    return c, n, far, values[::-1][:components], axes[:, ::-1][:, :components], cov


def check(rows, ids, vectors, components=32):
    c, n, far, values, axes, cov = dense(vectors, components)
    k = len(values)
    assert len(rows) == len(ids) * k
    at = {}
    for r in rows:
        at.setdefault(r["vec_id"], {})[r["component"]] = r
    z = np.array([[at[i][j]["whitened"] for j in range(1, k + 1)] for i in ids])
    turn = np.linalg.lstsq(c, z, rcond=None)[0] if n > c.shape[1] else None
    for i, f in zip(ids, far, strict=True):
        assert {(r["n"], r["deviation"]) for r in at[i].values()} == {(n, f)}
    explained = np.array([at[ids[0]][j]["explained"] for j in range(1, k + 1)])
    assert np.allclose(explained, values / np.trace(cov), rtol=1e-10)
    error = {r["identity_error"] for r in rows}
    off = np.abs(z.T @ z / n - np.eye(k)).max()
    assert len(error) == 1 and off < 1e-9 and abs(error.pop() - off) < 1e-9
    if turn is not None:
        u = turn * np.sqrt(values)
        residual = np.abs(cov @ u - u * values).max() / values[0]
        assert residual < 1e-11 and np.allclose(u.T @ u, np.eye(k), atol=1e-10)
    gap = np.abs(values[:, None] - values[None, :]) + np.eye(k) * values[0]
    clear = np.flatnonzero(gap.min(axis=1) > 1e-3 * values[0])
    plain = c @ axes / np.sqrt(values)
    assert np.allclose(np.abs(z[:, clear]), np.abs(plain[:, clear]), atol=1e-8)


def test_whole_table(spark):
    rows = table(spark, SF, "embeddings").collect()
    got = ew.query(spark, SF).collect()
    check(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("case", ["spread", "clustered", "low rank", "many"])
def test_jacobi_davidson(case):
    rng = np.random.default_rng(5)
    d, k = 300, 12
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {
        "spread": np.geomspace(1e4, 1e-3, d), "clustered": np.r_[[5.0] * 6, [4.999999] * 10, rng.uniform(0, 4.9, d - 16)],
        "low rank": np.r_[np.arange(1, 8), np.zeros(d - 7)], "many": np.linspace(1, 2, d),
    }[case]
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    passes = []
    got, axes = ew.jacobi_davidson(lambda w: passes.append(w.shape[1]) or matrix @ w, d, k)
    want = np.sort(values)[::-1][:k]
    assert np.allclose(got, want, atol=1e-11 * want[0])
    assert np.abs(matrix @ axes - axes * got).max() <= 2e-13 * want[0] and np.allclose(axes.T @ axes, np.eye(k), atol=1e-13)
    assert len(passes) < 400


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    b = np.c_[rng.standard_normal((40, 3)), np.zeros(40)]
    x = ew.minres(lambda v: a @ v, b, 200, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-8 and not x[:, 3].any()


def test_odd_rows(spark):
    """Nulls, non-finite entries, other lengths, repeated rows, null ids and clashing names."""
    rng = np.random.default_rng(3)
    good = rng.standard_normal((30, 5)).tolist()
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [0.0, float("inf"), 0.0, 0.0, 0.0], [1e300] * 5, [1.0, 2.0]]
    rows = [(k, v, 1, "x", 0.0) for k, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, id string, whitened double")
    check(ew.embedding_whitening(df).collect(), list(range(30)), good)
    twice = df.unionByName(df).select(*("vec_id", "embedding"))
    got = ew.embedding_whitening(twice).collect()
    assert len(got) == 300 and {r["n"] for r in got} == {60}
    nulls = df.selectExpr("cast(null as long) vec_id", "embedding")
    assert ew.embedding_whitening(nulls).where("vec_id IS NULL").count() == 150
    assert ew.embedding_whitening(df.where("false")).count() == 0
    assert ew.embedding_whitening(df.where("vec_id = 3")).count() == 0  # no variance, no component
    assert ew.embedding_whitening(df.where("vec_id < 4")).count() == 4 * 3  # rank 3


def test_large_entries(spark):
    """Deviations that pass a long are null, the others exact."""
    rows = [(k, [float(x), 0.0]) for k, x in enumerate([2**38, 2**38 + 1, 2**38 + 3, -(2**40)])]
    got = ew.embedding_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, _, far, *_ = dense([r[1] for r in rows], 1)
    assert {r["vec_id"]: r["deviation"] for r in got} == {k: f if f < 1 << 63 else None for k, f in enumerate(far)}
