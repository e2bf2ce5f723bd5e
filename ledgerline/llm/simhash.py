"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distance.

64 bits are split into six blocks.  Two fingerprints that differ in at most
three bits agree on at least three whole blocks, so for one of the 20 choices
of three blocks they share a key.  Rows meet by key; inside a key's group
links are verified bit by bit and reduced to one edge per fingerprint (a
star), never to all pairs.

A group with more than ``GROUP`` distinct fingerprints is keyed a second time
by the same rule on its 32 free bits; then at most 16 bits are free, so no
group can exceed 65,536 members whatever the data are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ready
from ledgerline.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCKS = 6
GROUP = 65_536
#: Groups up to this size are compared pair by pair inside the task.
PAIRWISE = 256
#: Shingles hashed at a time.
STEP = 50_000


# --- fingerprints ---------------------------------------------------------------


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles, as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + width - 1]
        shingles = zip(*(part[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
        bits = np.frombuffer(b"".join([digest(join(s), SEED) for s in shingles]), np.uint8)
        ones += np.unpackbits(bits.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id, digest, fp`` per row; a null text counts as empty (zero)."""

    def of(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], pa.array(fp)], names=["doc_id", "digest", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, fp long")


# --- links ----------------------------------------------------------------------


def block_masks(bits: int = 64, blocks: int = BLOCKS, free: int = MAX_BITS) -> list[int]:
    """One mask (of ``bits`` bits) for each choice of ``blocks - free`` blocks."""
    edges = [bits * k // blocks for k in range(blocks + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - free)]


def _split(mask: int, free: int = MAX_BITS) -> list[int]:
    """The second keys of a group keyed by ``mask``: ``mask`` and each choice
    of half of six blocks of the bits it leaves free."""
    open_bits = [k for k in range(64) if not mask >> k & 1]
    return [mask | sum(1 << open_bits[k] for k in range(len(open_bits)) if m >> k & 1) for m in block_masks(len(open_bits), BLOCKS, free)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(masks: list[int], first: int = 0) -> Column:
    """Array of (mask number, masked fingerprint)."""
    return F.array(*[F.struct(F.lit(first + k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("key")) for k, x in enumerate(masks)])


def _roots(fps: np.ndarray, limit: int) -> np.ndarray:
    """Index of the least member that each member reaches by links of at most
    ``limit`` bits, for distinct fingerprints."""
    n = len(fps)
    label = np.arange(n)
    if n <= PAIRWISE:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            if (new == label).all():
                return label
            label = new
    # Two texts within a + b bits have a point within a bits of one and b of
    # the other, so every link is a path over the owner of such a point, and
    # an owner is within a + b bits of all who find it.
    a, b = limit // 2, limit - limit // 2
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << k for k in range(64) if varying >> k & 1]
    ball = lambda r: np.array([sum(c) for k in range(r + 1) for c in combinations(bits, k)], np.uint64)
    points = (fps[:, None] ^ ball(a)[None, :]).ravel()
    points, first = np.unique(points, return_index=True)
    owner = first // (len(ball(a)))
    while True:
        before = label.copy()
        for mask in ball(b):
            at = np.searchsorted(points, fps ^ mask)
            at[at == len(points)] = 0
            me = np.flatnonzero(points[at] == fps ^ mask)
            other = owner[at[me]]
            low = np.minimum(label[me], label[other])
            np.minimum.at(label, me, low)
            np.minimum.at(label, other, low)
            label = label[label]
        if (label == before).all():
            return label


def _stars(limit: int):
    def stars(batches):
        """Edges (member, least member) of the linked parts of each key's
        rows, which arrive together."""
        key, held = None, []

        def close():
            fps = np.array(held, np.int64).view(np.uint64)
            root = _roots(fps, limit)
            moved = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[root[moved]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            for m, k, fp in zip(*(batch[c].to_pylist() for c in ("m", "key", "fp")), strict=True):
                if (m, k) != key:
                    if len(held) > 1:
                        yield close()
                    key, held = (m, k), []
                held.append(fp)
        if len(held) > 1:
            yield close()

    return stars


def _meet(keyed: DataFrame, limit: int) -> DataFrame:
    """Edges inside the groups of equal (m, key)."""
    together = Window.partitionBy("m", "key")
    groups = keyed.withColumn("n", F.count(F.lit(1)).over(together)).where("n > 1").select("m", "key", "fp")
    return groups.sortWithinPartitions("m", "key", "fp").mapInArrow(_stars(limit), "a long, b long")


def links(distinct_fps: DataFrame, limit: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Edges between distinct fingerprints ``fp`` that connect all pairs of at
    most ``limit`` differing bits, and no others."""
    if limit != MAX_BITS:
        raise ValueError("the blocks are laid out for three differing bits")
    masks = block_masks()
    keyed = distinct_fps.select("fp", F.explode(_keys(masks)).alias("k")).select("fp", "k.m", "k.key")
    large = cut(keyed.groupBy("m", "key").count().where(F.col("count") > group).select("m", "key"))
    edges = _meet(keyed.join(large, ["m", "key"], "left_anti"), limit)
    if large.isEmpty():
        return edges
    again = F.coalesce(*[F.when(F.col("m") == k, _keys(_split(mask), 100 * (k + 1))) for k, mask in enumerate(masks)])
    finer = keyed.join(large, ["m", "key"]).select("fp", F.explode(again).alias("k")).select("fp", "k.m", "k.key")
    return edges.union(_meet(finer, limit))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, limit: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, digest, fp, component_id, rep_digest``.

    Documents are linked when their fingerprints differ in at most ``limit``
    bits; ``component_id`` is the smallest id reachable (null ids count last;
    null only if no document of the component has an id).  Null and empty
    texts have fingerprint zero and are linked like any others; repeated rows
    get a row each; other columns are not read.  ``digest`` is a hash of the
    row's text and ``rep_digest`` that of the component's representative.
    """
    ready(docs.sparkSession)
    rows = cut(fingerprints(docs, id_col, text_col, width))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    distinct = cut(rows.groupBy("fp").agg(best))
    found = components(links(distinct.select("fp"), limit))
    by_fp = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")
    least = by_fp.groupBy(F.col("root").alias("r")).agg(F.min("best").alias("rep"))
    of_fp = by_fp.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "rep")
    return rows.join(of_fp, F.col("fp") == F.col("f")).select(
        "doc_id", "digest", "fp", F.col("rep.doc_id").alias("component_id"), F.col("rep.digest").alias("rep_digest")
    )


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of ``docs``, with all columns: the one
    with the smallest id (of rows that share it, the one with the smallest
    text hash; of equal rows, any one)."""
    found = simhash_dedup(docs, id_col, text_col)
    kept = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("rep_digest")))
        .select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
        .distinct()
    )
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.col(f"doc.{id_col}").alias("id"), F.xxhash64(F.coalesce(F.col(f"doc.{text_col}").cast("string"), F.lit(""))).alias("digest")
    )
    on = rows["id"].eqNullSafe(kept["k_id"]) & (rows["digest"] == kept["k_digest"])
    return rows.join(kept, on, "left_semi").dropDuplicates(["id", "digest"]).select("doc.*")


# --- registered query -------------------------------------------------------------


def query(spark, sf_dir):
    from ledgerline.llm.common import documents

    found = simhash_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
