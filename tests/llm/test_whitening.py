"""Whitening against numpy over all rows."""

import numpy as np
import pytest

from ledgerline.llm import whitening as W
from ledgerline.llm.queries import QUERIES


def expected(vectors, components=32, fit=None):
    x = (np.floor(np.array(vectors, float) * 64) + 1_000_000).astype(np.int64)
    fit = x if fit is None else (np.floor(np.array(fit, float) * 64) + 1_000_000).astype(np.int64)
    n, s = len(fit), fit.sum(0)
    centred = lambda a: (a - s // n) - (s % n) / n
    values, axes = np.linalg.eigh(centred(fit).T @ centred(fit) / n)
    values, axes = values[::-1], axes[:, ::-1]
    z = centred(x) @ axes[:, :components] / np.sqrt(values[:components])
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, z, deviation, values[:components] / values.sum()


def check(rows, ids, n, z, deviation, explained):
    by = {(r["vec_id"] if "vec_id" in r else r["id"], r.component): r for r in rows}
    assert len(rows) == len(by) == z.size
    got = np.array([[by[i, k + 1].whitened for k in range(z.shape[1])] for i in ids])
    sign = np.sign((got * z).sum(0))
    assert np.abs(got * sign - z).max() < 1e-8
    assert [by[i, 1].deviation for i in ids] == deviation
    assert np.allclose([by[ids[0], k + 1].explained for k in range(z.shape[1])], explained, rtol=1e-9)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = QUERIES["op12_whitening"](spark, sf).collect()
    check(rows, [r.vec_id for r in table], *expected([r.embedding for r in table]))
    assert rows[0].identity_error < 1e-9


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_multiplicity(spark, weights):
    """A third of the rows share one vector; the fit counts it often or once."""
    rng = np.random.default_rng(4)
    vectors = [[0.25, -0.5, 0.125, 3.0, 0.0] if k % 3 == 0 else rng.normal(size=5).round(2).tolist() for k in range(400)]
    once = [list(v) for v in dict.fromkeys(tuple(np.floor(np.array(v) * 64) / 64) for v in vectors)]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = W.whiten(frame, weights=weights, components=4).collect()
    check(rows, list(range(400)), *expected(vectors, 4, None if weights == "counts" else once))
    assert rows[0].identity_error < 1e-9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (2, None), (3, [None, 1.0]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, [1.0]), (7, [1e30, 0.0])]
    frame = spark.createDataFrame([(*r, "?", 1) for r in rows], "vec_id long, embedding array<double>, key string, n int")
    got = W.whiten(frame).collect()
    assert sorted(repr(r.id) for r in got) == sorted(map(repr, [1, 1, 1, 1, None, None, 6, 6, 7, 7]))
    assert all(np.isfinite(r.whitened) and r.n == 5 for r in got) and got[0].identity_error < 1e-4
    assert W.whiten(frame.limit(0)).count() == 0
    same = W.whiten(frame.where("vec_id = 1")).collect()  # no variance at all
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(0.0, 0.0, 0.0, 0)] * 4
    with pytest.raises(ValueError):
        W.fit(frame, weights="two")


def test_large_deviation_is_exact(spark):
    vectors = [[30_000_000.0, 0.0], [-30_000_000.0, 0.5], [1.0, 2.0]] * 20
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.id: int(r.deviation) for r in W.whiten(frame, components=1).collect()}
    assert list(dict(sorted(got.items())).values()) == expected(vectors, 1)[2]
