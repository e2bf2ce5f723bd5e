"""Distributed non-negative matrix factorisation (Frobenius loss,
multiplicative updates, NNDSVDa start) of a sparse document-term matrix.

Layout: the state is a stored table of one row per document, its terms and
weights and its row of W; tasks read it in blocks of documents (CSR arrays).  The
small factor H (k x p, k <= 6, p <= max_features) lives on the driver and goes
out with each iteration's job, which updates W in every block and adds up the
k x p and k x k statistics that update H:

    W <- W * (X H^T) / (W H H^T)        (block-local)
    H <- H * (W^T X) / (W^T W H)        (driver, from aggregated sums)

Given the factors H so far, a row of W follows from the stored one, so an
iteration writes nothing: the table is written anew every ``checkpoint_every``
iterations, and between them tasks repeat the updates since.  The start is
NNDSVDa on a randomised SVD computed the same way (power iterations with
Cholesky-QR, one aggregation per step) of random numbers computed by hash.  Convergence is tested every 10
iterations on the relative error decrease.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import shared_table, ship_package

EPS = float(np.finfo(np.float32).eps)
#: Documents that a task multiplies at once.
BLOCK_DOCS = 500
STATE = "doc_id string, indices array<int>, data array<double>, w array<double>"


@dataclass
class NmfResult:
    topics: DataFrame  # doc_id, topic, weight
    components: np.ndarray  # k x p
    iterations: int
    error: float
    errors: list[float]  # Frobenius distance of X and WH before each update and at the end


def _xdot(b, m: np.ndarray) -> np.ndarray:
    """X_b @ m for a CSR block and a dense p x c matrix."""
    n = len(b["ids"])
    contrib = b["data"][:, None] * m[b["indices"]]
    return np.stack([np.bincount(b["rows"], weights=contrib[:, c], minlength=n) for c in range(m.shape[1])], axis=1) if n else np.zeros((0, m.shape[1]))


def _xtdot(b, a: np.ndarray, p: int) -> np.ndarray:
    """X_b^T @ a for a CSR block and a dense n_b x c matrix -> p x c."""
    if not len(b["ids"]):
        return np.zeros((p, a.shape[1]))
    vals = b["data"][:, None] * a[b["rows"]]
    return np.stack([np.bincount(b["indices"], weights=vals[:, c], minlength=p) for c in range(a.shape[1])], axis=1)


def _rows(weights: DataFrame) -> DataFrame:
    """``doc_id, indices, data``: one row per document, as given or from one row
    per document and term."""
    if "indices" not in weights.columns:
        cells = F.sort_array(F.collect_list(F.struct("term_index", "weight")))
        grouped = weights.groupBy("doc_id").agg(cells.alias("cells"))
        weights = grouped.select("doc_id", F.col("cells.term_index").alias("indices"), F.col("cells.weight").alias("data"))
    return weights.select(F.col("doc_id").cast("string"), "indices", "data", F.array().cast("array<double>").alias("w"))


def _blocks(batches):
    """CSR blocks of at most ``BLOCK_DOCS`` documents with their rows of W."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(at, BLOCK_DOCS)
            n = part.num_rows
            yield {
                "part": part,
                "ids": part["doc_id"].to_pylist(),
                "indices": part["indices"].flatten().to_numpy(zero_copy_only=False),
                "data": part["data"].flatten().to_numpy(zero_copy_only=False),
                "rows": np.repeat(np.arange(n), pc.list_value_length(part["indices"]).to_numpy(zero_copy_only=False)),
                "W": part["w"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1),
            }


def _total(state: DataFrame, measure: Callable):
    """The sum of ``measure(block)``, a tuple, over all blocks."""

    def run(batches):
        total = None
        for b in _blocks(batches):
            found = measure(b)
            total = found if total is None else _add(total, found)
        yield pa.RecordBatch.from_pydict({"total": [] if total is None else [pickle.dumps(total)]}, pa.schema([("total", pa.binary())]))

    return state.mapInArrow(run, "total binary").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(_add)


def _with_w(state: DataFrame, w: Callable) -> DataFrame:
    """The state with the rows of W that ``w(block)`` gives, stored."""

    def run(batches):
        for b in _blocks(batches):
            rows = np.asarray(w(b), dtype=np.float64)
            offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
            part = b["part"]
            columns = [part["doc_id"], part["indices"], part["data"], pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "indices", "data", "w"])

    return shared_table(state.mapInArrow(run, STATE), "nmf-state")


def _add(a, b):
    return tuple(x + y for x, y in zip(a, b))


def fit(
    weights: DataFrame,
    n_docs: int,
    n_features: int,
    k: int,
    max_iter: int = 300,
    tol: float = 1e-4,
    seed: int = 42,
    oversamples: int = 10,
    checkpoint_every: int = 10,
) -> NmfResult:
    """Factorise from the NNDSVDa start until the error rests."""
    ship_package(weights.sparkSession)
    p = n_features
    matrix = shared_table(_rows(weights), "nmf-matrix")

    # --- randomised SVD: X ~ U S V^T with power iterations ---------------
    l = min(k + oversamples, p)
    z = np.array([[hash_normal(f"z{seed}", j, t) for j in range(l)] for t in range(p)]).reshape(p, l)
    n_iter = 7 if k < 0.1 * min(n_docs, p) else 4
    x_sum = x_sq = None
    for _ in range(n_iter + 1):
        first = x_sum is None  # the first pass also sums X and its squares

        def power(b, z=z, first=first):
            y = _xdot(b, z)
            sums = (float(b["data"].sum()), float(b["data"] @ b["data"])) if first else (0.0, 0.0)
            return (y.T @ y, _xtdot(b, y, p), *sums)

        gram, xty, xs, xq = _total(matrix, power)
        if first:
            x_sum, x_sq = xs, xq
        r = np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(l)).T  # Y = Q R
        r_inv = np.linalg.inv(r)
        q_t_x = (xty @ r_inv).T  # l x p  (= Q^T X)
        last = _ == n_iter
        if not last:
            z, _r = np.linalg.qr(q_t_x.T)
    u_hat, s, vt = np.linalg.svd(q_t_x, full_matrices=False)
    # U = Y R^-1 U_hat, with Y = X z (z is the last power-iteration basis)
    proj = r_inv @ u_hat[:, :k]
    s, vt = s[:k], vt[:k]

    # --- NNDSVDa initialisation -----------------------------------------
    def u_rows(b):
        return _xdot(b, z) @ proj

    def squares(b):
        u = u_rows(b)
        return np.sum(np.maximum(u, 0) ** 2, axis=0), np.sum(np.minimum(u, 0) ** 2, axis=0)

    norms = _total(matrix, squares)
    xp_norm, xn_norm = np.sqrt(norms[0]), np.sqrt(norms[1])
    h = np.zeros((k, p))
    scale_pos = np.zeros(k)
    use_pos = np.ones(k, dtype=bool)
    lbd = np.zeros(k)
    h[0] = math.sqrt(s[0]) * np.abs(vt[0])
    for j in range(1, k):
        y = vt[j]
        yp, yn = np.maximum(y, 0), np.abs(np.minimum(y, 0))
        ypn, ynn = np.linalg.norm(yp), np.linalg.norm(yn)
        mp, mn = xp_norm[j] * ypn, xn_norm[j] * ynn
        use_pos[j] = mp > mn
        sigma = mp if use_pos[j] else mn
        lbd[j] = math.sqrt(s[j] * sigma)
        ynorm, xnorm = (ypn, xp_norm[j]) if use_pos[j] else (ynn, xn_norm[j])
        if sigma > 0:
            scale_pos[j] = lbd[j] / xnorm
            h[j] = lbd[j] * (yp if use_pos[j] else yn) / ynorm
    avg = x_sum / (n_docs * p)
    h[h < EPS] = 0
    h[h == 0] = avg
    first_scale = math.sqrt(s[0])

    def init_w(b):
        u = u_rows(b)
        w = np.zeros_like(u)
        w[:, 0] = first_scale * np.abs(u[:, 0])
        for j in range(1, u.shape[1]):
            part = np.maximum(u[:, j], 0) if use_pos[j] else np.abs(np.minimum(u[:, j], 0))
            w[:, j] = scale_pos[j] * part
        w[w < EPS] = 0
        w[w == 0] = avg
        return w

    return _updates(_with_w(matrix, init_w), h, x_sq, max_iter, tol, checkpoint_every)


def hash_normal(kind: str, column: int, name) -> float:
    """A normally distributed number (Box-Muller) from 48 bits of an md5, the
    same on any machine and in SQL."""
    digits = hashlib.md5(f"{kind}:{column}:{name}".encode()).hexdigest()
    a, b = ((int(digits[at : at + 6], 16) + 1) / 2**24 for at in (0, 6))
    return math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b)


def hash_start(kind: str, topic: int, name) -> float:
    """A number above 0 and at most 1 from the first 24 bits of an md5, the
    same on any machine and in SQL."""
    return (int(hashlib.md5(f"{kind}:{topic}:{name}".encode()).hexdigest()[:6], 16) + 1) / 2**24


def steps(weights: DataFrame, n_docs: int, n_features: int, k: int, updates: int, checkpoint_every: int = 10) -> NmfResult:
    """A fixed number of updates from a start computed by hash: W from topic
    and document id, H from topic and term index.  Nothing is random and
    nothing depends on the data's order, so the result can be checked against
    plain matrix algebra; ``errors`` is the certificate that each update
    lowers the objective."""
    ship_package(weights.sparkSession)

    def begin(b):
        return np.array([[hash_start("w", j, doc) for j in range(k)] for doc in b["ids"]]).reshape(-1, k)

    state = _with_w(_rows(weights), begin)
    h = np.array([[hash_start("h", j, t) for t in range(n_features)] for j in range(k)]).reshape(k, n_features)
    (x_sq,) = _total(state, lambda b: (float(b["data"] @ b["data"]),))
    return _updates(state, h, x_sq, updates, None, checkpoint_every)


def _moved(b, hs) -> np.ndarray:
    """The block's rows of W after one update for each factor in ``hs``."""
    w = b["W"]
    for h in hs:
        denom = w @ (h @ h.T)
        denom[denom == 0] = EPS
        w = w * (_xdot(b, h.T) / denom)
    return w


def _updates(state: DataFrame, h: np.ndarray, x_sq: float, max_iter: int, tol: float | None, checkpoint_every: int) -> NmfResult:
    """Multiplicative updates of the state's rows of W, until ``max_iter`` or,
    with ``tol``, until the relative decrease over 10 updates falls below it."""
    p = h.shape[1]

    def step(b, hs):
        w, hh = _moved(b, hs[:-1]), hs[-1]
        xht = _xdot(b, hh.T)
        denom = w @ (hh @ hh.T)
        denom[denom == 0] = EPS
        w_new = w * (xht / denom)
        return float(np.sum(w * xht)), w.T @ w, _xtdot(b, w_new, p).T, w_new.T @ w_new

    def error(cross, wtw, hh):
        return math.sqrt(max(x_sq - 2.0 * cross + float(np.sum((wtw @ hh) * hh)), 0.0))

    error_at_init = previous = err = None
    errors: list[float] = []
    hs: list[np.ndarray] = []  # the factors since the state was stored, the present one last
    it = 0
    while True:
        hs.append(h)
        cross, wtw_old, wtx, wtw = _total(state, lambda b, hs=tuple(hs): step(b, hs))
        err = error(cross, wtw_old, h)  # error of the state entering this step
        errors.append(err)
        stop = False
        if error_at_init is None:
            error_at_init = previous = err
            stop = tol is not None and err == 0.0  # already exact
        elif tol is not None and it % 10 == 0:
            stop = (previous - err) / error_at_init < tol
            previous = err
        if stop or it == max_iter:
            break
        denom = wtw @ h
        denom[denom == 0] = EPS
        h = h * (wtx / denom)
        it += 1
        if len(hs) == checkpoint_every:
            state, hs = _with_w(state, lambda b, hs=tuple(hs): _moved(b, hs)), []
    entered = tuple(hs[:-1])

    def assign(batches):
        for b in _blocks(batches):
            w = _moved(b, entered)
            topic = np.where(w.sum(axis=1) > 0, w.argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays([b["part"]["doc_id"], pa.array(topic, pa.int32()), pa.array(w.max(axis=1))], names=["doc_id", "topic", "weight"])

    topics = shared_table(state.mapInArrow(assign, "doc_id string, topic int, weight double"), "nmf-topics")
    return NmfResult(topics, h, it, err, errors)
