"""Vector codes against plain k-means over all points."""

import hashlib

import numpy as np
import pytest

from ledgerline.llm import vector_codes as V
from ledgerline.llm.queries import QUERIES


def brute(rows, entries=256, rounds=4):
    """{vec_id: (code, error, label_error)} and the codebooks' digest."""
    rows = [(i, v, g) for i, v, g in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(float(c) * 1024)) for c in v] for _, v, _ in rows])
    size = x.shape[1] // 4
    first = sorted(range(len(rows)), key=lambda k: rows[k][0])[:entries]
    codes, errors, books = [], np.zeros(len(rows), int), []
    for p in range(4):
        points = x[:, p * size : (p + 1) * size]
        book = points[first].copy()

        def nearest(points=points):
            d = np.stack([((points - e) ** 2).sum(1) for e in book], 1)  # noqa: B023
            return d.argmin(1), d.min(1)

        for _ in range(rounds):
            at, _ = nearest()
            book = np.array([points[at == e].sum(0) // (at == e).sum() if (at == e).any() else book[e] for e in range(len(book))])
        at, error = nearest()
        codes.append(at)
        errors += error
        books.append(book)
    sums = {}
    for (_, _, g), e in zip(rows, errors, strict=True):
        sums[g] = sums.get(g, 0) + int(e)
    out = {i: ("".join(f"{c[k]:02x}" for c in codes), int(errors[k]), sums[g]) for k, (i, _, g) in enumerate(rows)}
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, digest = brute([(r.vec_id, r.embedding, r.label) for r in table])
    got = QUERIES["op11_vector_codes"](spark, sf).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want
    assert len(got) == len(want) and {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("shape", ["one hot vector", "ties", "large"])
def test_shapes(spark, tmp_path, shape):
    rng = np.random.default_rng(2)
    if shape == "one hot vector":
        vectors = [[0.5] * 8 if k % 3 else rng.normal(size=8).tolist() for k in range(1500)]
    elif shape == "ties":
        vectors = (rng.integers(-2, 3, (1200, 8)) / 1024).tolist()
    else:
        vectors = (rng.normal(size=(600, 8)).clip(-4, 4) * 16_000).tolist()
    rows = [(int(i), v, None if k % 4 == 0 else k % 3) for k, (i, v) in enumerate(zip(rng.permutation(len(vectors)), vectors, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, digest = brute(rows)
    got = V.query(spark, str(tmp_path)).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_odd_rows(spark):
    """Nulls, non-finite components, repeated and null ids, few rows, clashing
    names, an empty table, and a width that four does not divide."""
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.1, 0.2, 0.3, 0.4], 1), (None, [0.5, 0.0, 0.1, -0.4], None), (2, None, 1), (3, [0.1, None, 0.0, 0.0], 2),
        (4, [inf, 0.0, 0.0, 0.0], 2), (5, [nan, 0.0, 0.0, 0.0], 2), (6, [1.0, 1.0, 1.0, 1.0], None), (7, [1e30, 0.0, 0.0, -1e30], 3),
    ]
    frame = spark.createDataFrame([(*r, "?", "?", 0) for r in rows], "vec_id long, embedding array<double>, label int, row string, x string, part int")
    found = V.fit(frame)
    got = found.codes.collect()
    assert sorted(repr(r.vec_id) for r in got) == sorted(map(repr, [1, 1, None, 6, 7]))
    assert all(r.error == 0 for r in got)  # every row is an entry
    assert len({tuple(r.codes) for r in got if r.vec_id == 1}) == 1
    empty = V.fit(frame.limit(0))
    assert empty.codes.count() == 0 and empty.codebooks == []
    assert V.with_label_errors(empty.codes).count() == 0
    narrow = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 1), (2, [0.1], 1), (3, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [r.error for r in V.fit(narrow).codes.collect()] == [0, 0, 0]


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(7)
    kept = 0
    for _ in range(40):
        centre = rng.integers(-50, 50, 6)
        points = centre + rng.integers(-4, 5, (30, 6))
        book = rng.integers(-60, 60, (40, 6))
        may = V.shortlists(points.min(0)[None], points.max(0)[None], book)[0]
        at = ((points[:, None] - book) ** 2).sum(2).argmin(1)
        assert may[at].all()
        kept += may.sum()
        some, error = V.nearest(points, np.flatnonzero(may), book)
        assert (some == at).all() and (error == ((points - book[at]) ** 2).sum(1)).all()
    assert kept < 40 * 20  # the boxes do leave most entries out


def test_hilbert_neighbours_touch():
    """On a full grid each place is one step from the next along the curve."""
    side = np.arange(16)
    grid = np.stack(np.meshgrid(side, side, indexing="ij"), -1).reshape(-1, 2)
    keys = [k.tobytes() for k in V.hilbert_key(grid, bits=4)]
    walk = grid[sorted(range(len(grid)), key=keys.__getitem__)]
    assert len(set(keys)) == 256 and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
