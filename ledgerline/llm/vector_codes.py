"""Compression of vectors to one small code per part (product quantisation).

Vectors become integers and are cut into four parts.  For each part position
the parts are sorted along a Hilbert curve and laid down in flat blocks, each
with its box (least and greatest value per dimension), sums and count.  A
round of fitting first compares boxes with the codebook: an entry whose least
distance to a box exceeds another's greatest, or that is farther than the box
centre's nearest entry from every place of the box, cannot be nearest there.
A block with one entry left is settled by its stored sums; others are
evaluated against their shortlist in exact integer arithmetic.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ready, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts of a block.
BLOCK = 256
#: Largest magnitude of an integer component: distances of vectors of up to
#: 256 dimensions then fit in a long.
BOUND = (1 << 26) - 1
#: Bits of a dimension that the Hilbert order looks at, and bytes of its key.
BITS = 8
KEY_BYTES = 16
#: Salts of equal parts (sorting) and of equal labels (their sums).
SALTS = 256


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of ``bits``-bit coordinates, most
    significant byte first (Skilling's transformation of axes to the curve)."""
    axes = x.astype(np.uint32).T.copy()
    n = len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(high, low, swap).astype(np.uint32)
            axes[i] ^= swap.astype(np.uint32)
        q >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(axes[n - 1] & q, np.uint32(q - 1), np.uint32(0)).astype(np.uint32)
        q >>= 1
    axes ^= turn
    planes = [(axes[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def shortlists(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """``[block, entry]``: whether the entry may be nearest to some place of
    the block's box, ties going to the lower entry."""
    lo, hi, book = (a.astype(np.int64) for a in (lo, hi, book))
    below, above = lo[:, None, :] - book, book - hi[:, None, :]
    least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(2)
    greatest = (np.maximum(hi[:, None, :] - book, book - lo[:, None, :]) ** 2).sum(2)
    may = least <= greatest.min(1)[:, None]
    best = greatest.argmin(1)
    # |x-e|^2 - |x-b|^2 is linear in x, so its least value over the box is at a corner
    step = book[best][:, None, :] - book
    corner = np.where(step > 0, lo[:, None, :], hi[:, None, :])
    norms = (book**2).sum(1)
    worse = norms - norms[best][:, None] + 2 * (corner * step).sum(2)
    entries = np.arange(len(book))
    return may & ((worse < 0) | (worse == 0) & (entries <= best[:, None]))


def nearest(points: np.ndarray, entries: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest of the listed entries (ascending) and the
    squared distance.  Products in doubles are exact while they stay under
    2**53; beyond that, in 64-bit integers."""
    chosen = book[entries]
    size = max(int(np.abs(points).max(initial=0)), int(np.abs(chosen).max(initial=0)))
    kind = np.float64 if 4 * size * size * points.shape[1] < 1 << 53 else np.int64
    p, c = points.astype(kind), chosen.astype(kind)
    distance = (c * c).sum(1) - 2 * (p @ c.T)
    at = distance.argmin(1)
    return entries[at], (distance[np.arange(len(p)), at] + (p * p).sum(1)).astype(np.int64)


def _listed(flat: np.ndarray, size: int, kind: pa.DataType) -> pa.ListArray:
    """A list column of equal lengths."""
    rows = len(flat) // size if size else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * size, pa.int32()), pa.array(flat, kind))


def _flat(column) -> np.ndarray:
    return np.asarray(column.flatten())


class VectorCodes:
    """Result of :func:`fit`.  ``codes``: one row per kept row with ``vec_id,
    label, codes array<int>, error``; ``codebooks``: a list of integer arrays."""

    def __init__(self, codes: DataFrame, codebooks: list[np.ndarray]) -> None:
        self.codes, self.codebooks = codes, codebooks

    @property
    def digest(self) -> str:
        text = ",".join(str(v) for book in self.codebooks for entry in book.tolist() for v in entry)
        return hashlib.sha256(text.encode()).hexdigest()


def fit(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES
) -> VectorCodes:
    """Fit a codebook per part position and code every kept row.

    Rows whose vector is null or holds null or non-finite components are
    dropped.  The codebooks start from the rows with the smallest ids (null
    ids last, equal ids by vector); fewer rows give smaller codebooks.  Rows
    are independent, so repeated ones get equal codes.  Shorter vectors, and a
    width that four does not divide, are filled up with zeros.  Components
    beyond 2**26 after scaling count as 2**26 - 1.  An empty table gives no
    rows and no codebooks.  Only the three named columns are read.
    """
    spark = rows.sparkSession
    ready(spark)
    v = F.col(vector_col).cast("array<double>")
    good = F.col(vector_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c * SCALE))))).cast("int")
    kept = stored(
        rows.where(good).select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, whole).alias("x")
        ),
        "vector-rows",
    )
    none = kept.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0)
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return VectorCodes(none, [])
    size = max(1, -(-longest // PARTS))
    width = size * PARTS

    def matrix(column) -> np.ndarray:
        lengths = np.diff(np.asarray(column.offsets))
        if (lengths == width).all():
            return _flat(column).reshape(-1, width).astype(np.int64)
        out = np.zeros((len(column), width), np.int64)
        out[np.arange(width) < lengths[:, None]] = _flat(column)
        return out

    def ranges(batches):
        lo = hi = None
        for batch in batches:
            if len(batch):
                x = matrix(batch["x"])
                lo = x.min(0) if lo is None else np.minimum(lo, x.min(0))
                hi = x.max(0) if hi is None else np.maximum(hi, x.max(0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(lo), pa.array(hi)], names=["dim", "lo", "hi"])

    extent = kept.select("x").mapInArrow(ranges, "dim int, lo long, hi long").groupBy("dim").agg(F.min("lo"), F.max("hi")).collect()
    low, high = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for dim, lo, hi in extent:
        low[dim], high[dim] = lo, hi
    span = np.maximum(1, high - low + 1)

    def parts(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["x"])
            cells = ((x - low) * (1 << BITS)) // span
            for p in range(PARTS):
                here = slice(p * size, (p + 1) * size)
                keys = hilbert_key(cells[:, here])[:, :KEY_BYTES]
                keys = pa.array([k.tobytes() for k in np.ascontiguousarray(keys)], pa.binary())
                part = _listed(np.ascontiguousarray(x[:, here]).ravel().astype(np.int32), size, pa.int32())
                position = pa.array(np.full(len(x), p, np.int32))
                yield pa.RecordBatch.from_arrays([position, keys, batch["row"], part], names=["p", "key", "row", "part"])

    def lay(batches):
        for batch in batches:
            if not len(batch):
                continue
            position = np.asarray(batch["p"])
            x = _flat(batch["part"]).reshape(-1, size)
            starts = np.flatnonzero(np.diff(position, prepend=-1))
            cuts = [range(a, b, BLOCK) for a, b in zip(starts, [*starts[1:], len(x)], strict=True)]
            begin = np.array([k for cut in cuts for k in cut])
            counts = np.diff([*begin, len(x)])
            wide = x.astype(np.int64)
            ends = pa.array(np.append(begin, len(x)).astype(np.int32))
            points = pa.ListArray.from_arrays(pa.array(np.append(begin, len(x)).astype(np.int32) * size), pa.array(x.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(position[begin]),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(ends, batch["row"]),
                    points,
                    _listed(np.minimum.reduceat(x, begin).ravel(), size, pa.int32()),
                    _listed(np.maximum.reduceat(x, begin).ravel(), size, pa.int32()),
                    _listed(np.add.reduceat(wide, begin).ravel(), size, pa.int64()),
                ],
                names=["p", "n", "rows", "points", "lo", "hi", "sums"],
            )

    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    ordered = kept.select("row", "x").mapInArrow(parts, "p int, key binary, row long, part array<int>").withColumn("salt", salt)
    ordered = ordered.repartitionByRange("p", "key", "salt").sortWithinPartitions("p", "key", "salt").select("p", "row", "part")
    blocks = stored(ordered.mapInArrow(lay, "p int, n long, rows array<long>, points array<int>, lo array<int>, hi array<int>, sums array<long>"), "vector-blocks")

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    start = np.zeros((len(first), width), np.int64)
    for k, (x,) in enumerate(first):
        start[k, : len(x)] = x
    books = [start[:, p * size : (p + 1) * size].copy() for p in range(PARTS)]

    def lists(batch):
        """Position, box rows and shortlist of each block of a batch."""
        position = np.asarray(batch["p"])
        lo, hi = (_flat(batch[c]).reshape(-1, size) for c in ("lo", "hi"))
        may = np.zeros((len(position), len(books[0])), bool)
        for p in range(PARTS):
            at = np.flatnonzero(position == p)
            for k in range(0, len(at), 32):  # 32 blocks x 256 entries x dimensions at a time
                some = at[k : k + 32]
                may[some] = shortlists(lo[some], hi[some], books[p])
        return position, may

    def assign(batches):
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        sums = np.zeros((PARTS, len(books[0]), size), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            position, may = lists(batch)
            alone, best = may.sum(1) == 1, may.argmax(1)
            n, stored_sums = np.asarray(batch["n"]), _flat(batch["sums"]).reshape(-1, size)
            np.add.at(counts, (position[alone], best[alone]), n[alone])
            np.add.at(sums, (position[alone], best[alone]), stored_sums[alone])
            for b in np.flatnonzero(~alone):
                p = position[b]
                points = np.asarray(batch["points"][int(b)].values).reshape(-1, size)
                at, _ = nearest(points, np.flatnonzero(may[b]), books[p])
                counts[p] += np.bincount(at, minlength=len(books[p]))
                np.add.at(sums[p], at, points)
        p, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[p, entry]), _listed(sums[p, entry].ravel(), size, pa.int64())],
            names=["p", "entry", "n", "sums"],
        )

    for _ in range(rounds):
        moved = (
            blocks.select("p", "n", "points", "lo", "hi", "sums")
            .mapInArrow(assign, "p int, entry int, n long, sums array<long>")
            .select("p", "entry", "n", F.posexplode("sums").alias("dim", "value"))
            .groupBy("p", "entry", "dim")
            .agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        )
        after = [b.copy() for b in books]
        for p, entry, dim, n, value in moved.collect():  # entries x width rows at most
            after[p][entry, dim] = int(value) // n
        books = after

    def code(batches):
        for batch in batches:
            if not len(batch):
                continue
            position, may = lists(batch)
            rows, places, codes, errors = [], [], [], []
            for b, p in enumerate(position):
                points = np.asarray(batch["points"][b].values).reshape(-1, size)
                at, error = nearest(points, np.flatnonzero(may[b]), books[p])
                rows.append(np.asarray(batch["rows"][b].values))
                places.append(np.full(len(at), p, np.int32))
                codes.append(at.astype(np.int32))
                errors.append(error)
            arrays = [pa.array(np.concatenate(a)) for a in (rows, places, codes, errors)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "p", "entry", "error"])

    coded = blocks.select("p", "rows", "points", "lo", "hi").mapInArrow(code, "row long, p int, entry int, error long")
    at = [F.max(F.when(F.col("p") == p, F.col("entry"))) for p in range(PARTS)]
    by_row = coded.groupBy("row").agg(F.array(*at).alias("codes"), F.sum("error").alias("error"))
    return VectorCodes(kept.select("row", "vec_id", "label").join(by_row, "row").drop("row"), books)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error``: the error summed over equal labels (nulls are one
    label).  Sums are kept once per label and salt, so the rows of a frequent
    label meet them in many tasks."""
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes", "error"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("label", "salt").agg(F.sum("error").alias("part"))
    sums = parts.groupBy("label").agg(F.sum("part").alias("label_error"), F.collect_set("salt").alias("salts"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode("salts").alias("salt"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (salted["salt"] == sums["salt"])).drop("of", "salt")


# --- registered query ---------------------------------------------------------------


def query(spark, sf_dir):
    ready(spark)
    found = fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(stored(found.codes, "vector-codes")).select(
        "vec_id",
        F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))).alias("code"),
        "error",
        "label_error",
        F.lit(found.digest).alias("codebooks_sha256"),
    )
