"""Whitening of vectors through a covariance weighted by multiplicity.

Equal vectors are grouped first.  Sums and the covariance are taken over the
distinct vectors, weighted by their counts (or by one), as centred matrix
products inside tasks whose small results Spark adds up.  The eigenvectors of
that matrix whiten each distinct vector once; rows join their vector's result.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ready, stored

#: Components returned.
COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
#: Largest magnitude of a scaled entry before the offset.
BOUND = (1 << 31) - 1 - OFFSET
#: Rows of one vector are dealt over so many groups.
SALTS = 1024
#: Vectors of a matrix product.
BATCH = 8_192
#: An eigenvalue below this share of the largest one is taken for zero.
FLAT = 1e-12


def _matrix(column: pa.Array) -> np.ndarray:
    """Integers of a binary column whose values have equal lengths."""
    joined = b"".join(v.as_py() for v in column)
    return np.frombuffer(joined, "<i4").reshape(len(column), -1).astype(np.int64)


class Whitening:
    """Result of :func:`fit`: ``rows`` (``vec_id`` as ``id``, ``key``, ``salt``),
    ``distinct`` (``key, x, n, weight, salts``), and the numbers of the fit."""

    def __init__(self, rows: DataFrame, distinct: DataFrame, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray) -> None:
        self.rows, self.distinct, self.n, self.sums, self.values, self.axes = rows, distinct, n, sums, values, axes

    @property
    def trace(self) -> float:
        return float(self.values.sum())

    def _axes(self, components: int) -> tuple[np.ndarray, np.ndarray]:
        """Axes divided by the root of their eigenvalue (zero where that is
        zero), and the shares of the trace."""
        values, axes = self.values[:components], self.axes[:, :components]
        varies = values > FLAT * max(self.values.max(initial=0.0), 0.0)
        scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
        share = np.where(varies, values, 0.0) / self.trace if self.trace > 0 else np.zeros(len(values))
        return axes * scale, share

    def _centred(self):
        """A function that gives exact integer distances to the floor of the
        mean, and doubles centred on the mean itself."""
        floor = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])

        def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y = x - floor
            return y, y - rest

        return centred

    def whitened(self, components: int = COMPONENTS) -> DataFrame:
        """``key, n, weight, salts, deviation decimal(38,0), whitened
        array<double>``: once per distinct vector."""
        scaled, _ = self._axes(components)
        centred, n, rest = self._centred(), self.n, [s % self.n for s in self.sums]

        def whiten(batches):
            with decimal.localcontext(prec=60):
                for batch in batches:
                    if not len(batch):
                        continue
                    y, c = centred(_matrix(batch["x"]))
                    size = int(np.abs(y).max(initial=0))
                    exact = y if size * size * y.shape[1] < 1 << 62 else y.astype(object)
                    squares = (exact * exact).sum(1).tolist()
                    cross = (y.astype(object) * np.array(rest, object)).sum(1).tolist()
                    constant = sum(r * r for r in rest)
                    deviation = [decimal.Decimal(n * n * a - 2 * n * b + constant) for a, b in zip(squares, cross, strict=True)]
                    deviation = [d if d < 10**38 else None for d in deviation]
                    z = c @ scaled
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                    arrays = [*(batch[k] for k in ("key", "weight", "salts")), pa.array(deviation, pa.decimal128(38, 0)), lists]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "weight", "salts", "deviation", "whitened"])

        return self.distinct.mapInArrow(whiten, "key binary, weight long, salts array<int>, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, whitened: DataFrame, components: int = COMPONENTS) -> float:
        """Largest absolute entry of the whitened vectors' weighted covariance
        minus the identity, over the components that vary."""

        def product(batches):
            total = None
            for batch in batches:
                if len(batch):
                    z = np.asarray(batch["whitened"].flatten()).reshape(len(batch), -1)
                    part = (z * np.asarray(batch["weight"])[:, None]).T @ z
                    total = part if total is None else total + part
            yield from _entries(total)

        scaled, _ = self._axes(components)
        found = _summed(whitened.select("weight", "whitened").mapInArrow(product, ENTRY), scaled.shape[1]) / self.n
        varies = np.abs(scaled).sum(0) > 0
        return float(np.abs(found[varies][:, varies] - np.eye(int(varies.sum()))).max(initial=0.0))


ENTRY = "i int, j int, value double"


def _entries(matrix: np.ndarray | None):
    if matrix is not None:
        i, j = np.indices(matrix.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(matrix.ravel())], names=["i", "j", "value"])


def _summed(entries: DataFrame, size: int) -> np.ndarray:
    """The square matrix of summed entries (dimensions squared, not rows)."""
    out = np.zeros((size, size))
    for i, j, value in entries.groupBy("i", "j").agg(F.sum("value")).collect():
        out[i, j] = value
    return out


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "counts") -> Whitening | None:
    """Group equal vectors and fit the whitening; None without any vector.

    ``weights`` is ``counts`` (the fit is over all rows) or ``one`` (over the
    distinct vectors).  Rows whose vector is null or holds null or non-finite
    entries are dropped; the others keep their ids, repeated and null ones
    too.  Shorter vectors are filled up with the integer of zero.  Entries
    beyond 2**31 - 1 after scaling and offset count as that.  Other columns
    are not read.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"weights {weights!r}: counts or one")
    spark = rows.sparkSession
    ready(spark)
    v = F.col(vector_col).cast("array<double>")
    good = F.col(vector_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: (F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c * SCALE))))) + OFFSET).cast("int")
    kept = rows.where(good).select(F.col(id_col).alias("id"), F.transform(v, whole).alias("x"))
    id_type = kept.schema["id"].dataType.simpleString()
    width = kept.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return None
    width = max(1, width)

    def packed(batches):
        for batch in batches:
            lengths = np.diff(np.asarray(batch["x"].offsets))
            x = np.full((len(batch), width), OFFSET, "<i4")
            x[np.arange(width) < lengths[:, None]] = np.asarray(batch["x"].flatten())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    held = stored(kept.mapInArrow(packed, f"id {id_type}, x binary").withColumn("key", F.unhex(F.sha2("x", 256))).withColumn("salt", salt), "whitening-rows")
    distinct = (
        held.groupBy("x", "key", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("x", "key")
        .agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))  # at most SALTS numbers
        .withColumn("weight", F.col("n") if weights == "counts" else F.lit(1).cast("long"))
    )
    distinct = stored(distinct, "whitening-distinct")

    def totals(batches):
        n, sums = 0, np.zeros(width, object)
        for batch in batches:
            if len(batch):
                x, w = _matrix(batch["x"]), np.asarray(batch["weight"])
                n += int(w.sum())
                big = int(w.max()) * len(w) >= 1 << 31
                sums = sums + ((x.astype(object) * w.astype(object)[:, None]).sum(0) if big else (x * w[:, None]).sum(0).astype(object))
        text = pa.array([*map(str, sums), str(n)], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), text], names=["dim", "total"])

    found = (
        distinct.select("x", "weight").mapInArrow(totals, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    by_dim = {r.dim: int(r.total) for r in found.collect()}  # one row per dimension
    n, sums = by_dim.pop(width), [by_dim[k] for k in range(width)]
    model = Whitening(held.select("id", "key", "salt"), distinct, n, sums, np.zeros(width), np.eye(width))
    centred = model._centred()

    def products(batches):
        total = None
        for batch in batches:
            for k in range(0, len(batch), BATCH):
                some = batch.slice(k, BATCH)
                _, c = centred(_matrix(some["x"]))
                part = (c * np.asarray(some["weight"])[:, None]).T @ c
                total = part if total is None else total + part
        yield from _entries(total)

    covariance = _summed(distinct.select("x", "weight").mapInArrow(products, ENTRY), width) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    model.values, model.axes = np.maximum(values[::-1], 0.0), axes[:, ::-1].copy()
    return model


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "counts", components: int = COMPONENTS
) -> DataFrame:
    """One row per kept row and component: ``id, component, n, deviation
    decimal(38,0), whitened, explained, identity_error``.

    A component without variance (all vectors equal, or fewer of them than
    dimensions) has whitened and explained 0 and is left out of the identity
    error.  No vector gives no rows.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    model = fit(rows, id_col, vector_col, weights)
    if model is None:
        schema = f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    once = stored(model.whitened(components), "whitened")
    error = model.identity_error(once, components)
    shares = F.array(*[F.lit(float(s)) for s in model._axes(components)[1]])
    results = once.select("key", F.explode("salts").alias("salt"), "deviation", "whitened")
    joined = model.rows.join(results, ["key", "salt"])
    return joined.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


# --- registered query ---------------------------------------------------------------


def query(spark, sf_dir):
    """A deviation beyond the range of a long is null here (the operator's own
    column is a decimal)."""
    ready(spark)
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
