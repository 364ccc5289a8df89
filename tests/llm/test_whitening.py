import math
from fractions import Fraction

import numpy as np
import pytest

from quillmart.llm import queries, whitening


def brute(rows):
    """n, S, x by row and the covariance of x, from Fractions alone."""
    kept = [(i, e) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    xs = [[math.floor(Fraction(c) * 1024) + 100_000 for c in e] for _, e in kept]
    n, d = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(d)]
    centred = [[Fraction(x[j]) - Fraction(s[j], n) for j in range(d)] for x in xs]
    v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    return [i for i, _ in kept], xs, s, v


def check(rows, got, components=8):
    """Whitened rows are projections on unit eigenvectors of the covariance, and everything counted is exact."""
    ids, xs, s, v = brute(rows)
    n, e = len(xs), np.linalg.eigvalsh(v)[::-1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    k = min(components, int((e > e[0] * 1e-12).sum()))
    assert sorted(by) == sorted(ids) and all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    w = np.zeros((n, k))
    for a, (i, x) in enumerate(zip(ids, xs, strict=True)):
        assert {r.n for r in by[i].values()} == {n}
        assert {r.deviation for r in by[i].values()} == {sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))}
        w[a] = [by[i][c].whitened for c in range(1, k + 1)]
    for c in range(1, k + 1):
        assert by[ids[0]][c].explained == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)
    assert np.abs(w.mean(0)).max() < 1e-9
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    # each whitened column is a projection on an eigenvector: w sqrt(e) = centred . u with V u = e u
    centred = np.array([[float(Fraction(x[j]) - Fraction(s[j], n)) for j in range(len(s))] for x in xs])
    for c in range(k):
        u = centred.T @ w[:, c] / n / math.sqrt(e[c])
        assert np.linalg.norm(u) == pytest.approx(1, abs=1e-9)
        assert np.abs(v @ u - e[c] * u).max() < 1e-8 * e[0]
        assert np.abs(centred @ u / math.sqrt(e[c]) - w[:, c]).max() < 1e-9 * max(1, np.abs(centred).max() / math.sqrt(e[c]))


def test_op13_against_fractions(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    check(rows, queries.op13_residue_whitening(spark, sf).collect())


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e and [c if c is None else float(c) for c in e], "x", 7) for i, e in rows], f"vec_id long, embedding array<{kind}>, component string, n int")


def test_op13_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 3, 5).tolist()) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0, 0, 0]), (62, [1.0, math.nan, 0, 0, 0]), (63, [math.inf, 0.0, 0, 0, 0]), (64, [0.0] * 5), (65, [1e4, -1e4, 0, 0, 0.5])]
    check(rows, whitening.whiten(frame(spark, rows, "double").repartition(4)).collect())
    both = whitening.whiten(frame(spark, [(i, e) for i, e in rows[:60]] + [(i + 100, e[:3]) for i, e in rows[:60]] + [(500, [])], "double")).collect()
    check(rows[:60], [r for r in both if r.vec_id < 100])
    check([(i + 100, e[:3]) for i, e in rows[:60]], [r for r in both if r.vec_id >= 100])
    copies = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0]), (2, [0.5, 5.5])]
    got = whitening.whiten(frame(spark, copies)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1"] * 4 + ["2"] * 2 + ["None"] * 2 and {r.n for r in got} == {4}
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    assert whitening.whiten(frame(spark, [])).count() == 0


def test_exact_beyond_double_and_long(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0, 1, 3) * 2.0**40).tolist()) for i in range(40)]
    got = whitening.whiten(frame(spark, rows, "double")).collect()
    assert all(r.deviation is None for r in got) and got[0].identity_error < 1e-9
    assert whitening.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 2.0])], "double")).select("n").first().n == 2


def test_scatter_by_residues():
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**9), 10**9, (20_000, 4))
    sums = [int(v) for v in x.sum(0)]
    n, bound = len(x), len(x) * int(x.max() - x.min())
    moduli = whitening.primes(2 * n * bound * bound)
    got = whitening.reconstructed({p: whitening.residue_scatter(x, n, sums, p) for p in moduli})
    y = x.astype(object) * n - np.array(sums, dtype=object)
    assert got == (y.T @ y).tolist()
    assert all(all(p % q for q in range(2, 1025)) and p < 1 << 20 for p in moduli)
