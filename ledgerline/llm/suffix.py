"""Suffix-array deduplication with a difference cover, distributed.

Bytes covered by a string of 200 bytes that also starts elsewhere are found
by ordering suffixes to a depth of 200, as a suffix array would, in the steps
of the difference-cover algorithm:

1. *Sampled tuples.*  Positions of a document in a difference cover modulo
   133 are sampled (12 of 133).  Any two positions meet sampled ones after
   the same step of at most 132, so two equal strings of 200 bytes hold an
   equal sampled tuple of 200 - 132 = 68 bytes.  The tuples' names are
   sorted; sampled suffixes with a name of their own are done.
2. *Names of names.*  A remaining sample is named again by the triple (132
   bytes before it, its tuple, 132 bytes after it).  Samples that share this
   name repeat everything in that zone, which is settled; samples that share
   only the tuple are where repeats begin or end.
3. *Remaining suffixes.*  Only there, all positions within reach are merged
   into one order by their 200-byte prefix, one representative for each
   settled zone, and
4. *adjacent prefixes* are compared: equal ones repeat.

Names are 64- and 128-bit polynomial fingerprints, not ranks: equal prefixes
must only become neighbours, and a fingerprint needs no second pass to name.
Rows that travel are blocks of names, sent once per chunk of documents
however often the chunk holds them (so a hot name is at most one entry per
chunk), and the answers are flags in the order of the names sent.  Texts are
written once, as chunks bucketed by their number; no step shuffles them.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bucket_count, cut, ready
from ledgerline.session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------------
# A perfect difference set: every residue modulo 133 is a difference of two members.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
# --- end of fixed values ------------------------------------------------------------

LENGTH = 200
#: Bytes of text in a chunk (one document at least).
CHUNK = 2_000_000
#: Names that are sorted together, about.
SORTED = 4_000_000
#: Chunk bytes read by one task, about.
BUCKET = 32_000_000
LOW = np.uint64((1 << 40) - 1)

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=2)
def _letters(base: int) -> np.ndarray:
    return np.random.default_rng(base & 0xFFFF).integers(0, 2**64, 256, np.uint64)


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    return np.concatenate([one, np.cumprod(up)]), np.concatenate([one, np.cumprod(down)])


class Prefix:
    """Fingerprints of any substrings of a byte array in constant time each:
    a polynomial over random letter values, modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]) -> None:
        size = 1 << max(21, len(data)).bit_length() if len(data) >= 1 << 21 else 1 << 21
        self.up, down = _powers(base, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters(base)[data] * down[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """One chunk's documents and, step by step, what is known of them."""

    def __init__(self, data: bytes, ends: np.ndarray, buckets: int, length: int = LENGTH) -> None:
        self.data, self.ends, self.buckets, self.length = np.frombuffer(data, np.uint8), ends, buckets, length
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.prefix = Prefix(self.data)
        self.reach = length - (PERIOD - 1)  # bytes of a tuple

    # -- step 1

    def tuples(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the sampled tuples, each once and sorted; whether repeated."""
        at, lo, hi = [], [], []
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if e - s >= self.length:
                k = (np.arange(s, e, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
                at.append(k[k + self.reach <= e])
                lo.append(np.full(len(at[-1]), s))
                hi.append(np.full(len(at[-1]), e))
        empty = [np.empty(0, np.int64)]
        self.at, self.lo, self.hi = (np.concatenate(x or empty) for x in (at, lo, hi))
        names, self.which, times = np.unique(_mix(self.prefix(self.at, self.at + self.reach)), return_inverse=True, return_counts=True)
        self.names = names
        return names, times > 1

    # -- step 2

    def zones(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the samples whose tuple is repeated: tuple name and zone name,
        each pair once and sorted; whether the pair is repeated here."""
        on = repeated[self.which]
        at, lo, hi = self.at[on], self.lo[on], self.hi[on]
        self.from_, self.to = np.maximum(at - (PERIOD - 1), lo), np.minimum(at + self.length, hi)
        shape = ((at - self.from_) * 4096 + (self.to - at)).astype(np.uint64)
        zone = _mix(self.prefix(self.from_, self.to) ^ _mix(shape + np.uint64(1)))
        name = self.names[self.which[on]]
        order = np.lexsort((zone, name))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (np.diff(name[order]) != 0) | (np.diff(zone[order]) != 0)
        first = np.flatnonzero(new)
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.first = order[first]  # lexsort is stable: the leftmost sample of each pair
        return name[self.first], zone[self.first], np.diff(np.append(first, len(order))) > 1

    # -- step 3

    def windows(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128-bit names of the 200-byte prefixes within reach of the samples
        that stand for their zone where repeats begin or end; sorted."""
        edge = np.zeros(len(self.data) + 1, np.int64)
        chosen = self.first[open_]
        np.add.at(edge, self.from_[chosen], 1)
        np.add.at(edge, self.to[chosen] - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        one = _mix(self.prefix(at, at + self.length))
        two = _mix(Prefix(self.data, _BASES[1])(at, at + self.length)) if len(at) else one
        order = np.lexsort((two, one))
        self.window_at, one, two = at[order], one[order], two[order]
        same = np.zeros(len(order), bool)
        if len(order):
            equal = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            same[1:] |= equal
            same[:-1] |= equal
        return one, two, same

    # -- end

    def spans(self, settled: np.ndarray, repeated_windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal covered runs; none crosses documents."""
        edge = np.zeros(len(self.data) + 1, np.int64)
        on = settled[self.pair]
        for start, end in ((self.from_[on], self.to[on]), (self.window_at[repeated_windows], self.window_at[repeated_windows] + self.length)):
            np.add.at(edge, start, 1)
            np.add.at(edge, end, -1)
        covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        borders = np.unique(self.starts[1:])  # runs of neighbouring documents stay apart
        change = covered[1:] != covered[:-1]
        start = np.flatnonzero(change & covered[1:])
        end = np.flatnonzero(change & covered[:-1])
        inner = borders[covered[borders] & covered[borders + 1]] if len(borders) else borders
        return np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))


# --- messages -----------------------------------------------------------------------


def _bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _bytes(names: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


MESSAGE = "bucket int, chunk long, n int, name binary, more binary, twice binary"
ANSWER = "chunk long, step int, bucket int, flags binary"


def _messages(chunk: int, buckets: int, names, more, twice):
    """A row for each bucket: names sorted, so a bucket's are neighbours.  The
    bucket holds the upper bits, the low 40 travel."""
    bucket = _bucket_of(names, buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
        if b > a:
            yield int(bucket[a]), chunk, b - a, _bytes(names[a:b] & LOW, 5), None if more is None else _bytes(more[a:b], 8), np.packbits(twice[a:b]).tobytes()


def _sorted_names(table: pa.Table):
    """The names of one bucket in order, with where each came from."""
    n = table["n"].to_numpy()
    name = np.concatenate([_numbers(x.as_py(), 5) for x in table["name"]])
    more = None if table["more"][0].as_py() is None else np.concatenate([_numbers(x.as_py(), 8) for x in table["more"]])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k).astype(bool) for x, k in zip(table["twice"], n.tolist(), strict=True)])
    chunk = np.repeat(table["chunk"].to_numpy(), n)  # ties in chunk order: the same answer whatever came first
    order = np.lexsort((chunk, name) if more is None else (chunk, more, name))
    return n, name, more, twice, order


def _answers(table: pa.Table, step: int, n: np.ndarray, flags: np.ndarray) -> pa.Table:
    parts = [x.tobytes() if x.any() else None for x in np.split(flags, np.cumsum(n)[:-1])]
    keep = [k for k, x in enumerate(parts) if x is not None]
    return pa.table(
        {
            "chunk": table["chunk"].take(keep),
            "step": pa.array([step] * len(keep), pa.int32()),
            "bucket": table["bucket"].take(keep),
            "flags": pa.array([parts[k] for k in keep], pa.binary()),
        }
    )


def _repeated(step: int):
    """Flag 1: an equal name (and more) is adjacent in the order, or was twice in its chunk."""

    def answer(table: pa.Table) -> pa.Table:
        n, name, more, twice, order = _sorted_names(table)
        equal = name[order][1:] == name[order][:-1]
        if more is not None:
            equal &= more[order][1:] == more[order][:-1]
        flags = twice.astype(np.uint8)
        flags[order[1:][equal]] = 1
        flags[order[:-1][equal]] = 1
        return _answers(table, step, n, flags)

    return answer


def _settle(table: pa.Table) -> pa.Table:
    """Flag 1: the zone occurs again, so it is settled.  Flag 2: its tuple has
    other zones too, and this entry stands for its zone among them."""
    n, name, more, twice, order = _sorted_names(table)
    tuple_, zone = name[order], more[order]
    new_tuple = np.concatenate([[True], tuple_[1:] != tuple_[:-1]])
    new_zone = new_tuple | np.concatenate([[True], zone[1:] != zone[:-1]])
    zone_of, tuple_of = np.cumsum(new_zone) - 1, np.cumsum(new_tuple) - 1
    zone_size = np.bincount(zone_of, 1 + twice[order])
    zones_in = np.bincount(tuple_of[new_zone])
    flags = np.zeros(len(order), np.uint8)
    flags[order] = (zone_size[zone_of] > 1) | (2 * (new_zone & (zones_in[tuple_of] > 1)))
    return _answers(table, 2, n, flags)


def _flags(answers: list, step: int, names: np.ndarray, buckets: int) -> np.ndarray:
    """The flags of a chunk's names, from the answers of one step."""
    out = np.zeros(len(names), np.uint8)
    bucket = _bucket_of(names, buckets)
    for x in answers:
        if x["step"] == step:
            a = np.searchsorted(bucket, x["bucket"])
            flags = np.frombuffer(x["flags"], np.uint8)
            out[a : a + len(flags)] = flags
    return out


def _replay(row: dict, buckets: int, length: int, steps: int):
    """A chunk carried to the names of step ``steps`` (1 to 3), or through to
    its spans (4)."""
    c = Chunk(row["data"], np.array(row["ends"], np.int64), buckets, length)
    answers = row.get("answers") or []
    names, twice = c.tuples()
    if steps == 1:
        return c, (names, None, twice)
    name, zone, twice = c.zones(_flags(answers, 1, names, buckets) > 0)
    if steps == 2:
        return c, (name, zone, twice)
    state = _flags(answers, 2, name, buckets)
    one, two, twice = c.windows((state & 2) > 0)
    if steps == 3:
        return c, (one, two, twice)
    return c, c.spans((state & 1) > 0, _flags(answers, 3, one, buckets) > 0)


# --- the distributed steps ------------------------------------------------------------


def _chunks(docs: DataFrame, id_type: str) -> DataFrame:
    def gather(batches):
        task, made, ids, texts, size, kind = TaskContext.get().partitionId() << 32, 0, [], [], 0, None

        def row():
            ends = np.cumsum([len(t) for t in texts])
            return pa.RecordBatch.from_arrays(
                [pa.array([task + made]), pa.array([ids], pa.list_(kind)), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())],
                names=["chunk", "ids", "ends", "data"],
            )

        for batch in batches:
            kind = batch["doc_id"].type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                data = (text.as_py() or "").encode()
                if texts and size + len(data) > CHUNK:
                    yield row()
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(doc_id)
                texts.append(data)
                size += len(data)
        if texts:
            yield row()

    return docs.mapInArrow(gather, f"chunk long, ids array<{id_type}>, ends array<long>, data binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept``.

    ``spans`` holds start and end (bytes, end exclusive) of the maximal runs
    of bytes covered by a ``length``-byte string that also starts elsewhere in
    any document, the same one included; ``kept`` is the remaining bytes in
    order.  Strings are judged on the input.  A null text counts as empty;
    texts under ``length`` bytes have no spans; repeated rows repeat each
    other; ids may be null or repeated; other columns are not read; an empty
    table gives no rows.
    """
    if not PERIOD + 16 <= length < 4096:  # a tuple needs some bytes; a zone's shape is kept in 12 bits
        raise ValueError(f"length must be from {PERIOD + 16} to 4095")
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = bucket_count(spark, total, BUCKET)
    buckets = max(tasks, -(-total * len(COVER) // PERIOD // SORTED))
    name = f"ledgerline_chunks_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerline-llm/{name}"
    _chunks(rows, id_type).write.option("path", path).option("compression", "zstd").bucketBy(tasks, "chunk").saveAsTable(name)
    chunks = spark.table(name)

    def send(step: int, frame: DataFrame) -> DataFrame:
        def messages(batches):
            for batch in batches:
                for at in range(len(batch)):
                    row = batch.slice(at, 1).to_pylist()[0]
                    out = list(_messages(row["chunk"], buckets, *_replay(row, buckets, length, step)[1]))
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)],
                            names=["bucket", "chunk", "n", "name", "more", "twice"],
                        )

        return frame.mapInArrow(messages, MESSAGE)

    def with_answers(*answers: DataFrame) -> DataFrame:
        found = functools.reduce(DataFrame.unionByName, answers)
        by_chunk = found.groupBy(F.col("chunk").alias("to")).agg(F.collect_list(F.struct("step", "bucket", "flags")).alias("answers"))
        return chunks.join(by_chunk.hint("shuffle_hash"), F.col("chunk") == F.col("to"), "left").drop("to")

    one = cut(send(1, chunks.drop("ids")).groupBy("bucket").applyInArrow(_repeated(1), ANSWER))
    two = cut(send(2, with_answers(one).drop("ids")).groupBy("bucket").applyInArrow(_settle, ANSWER))
    three = cut(send(3, with_answers(one, two).drop("ids")).groupBy("bucket").applyInArrow(_repeated(3), ANSWER))

    def finish(batches):
        for batch in batches:
            kind = batch["ids"].type.value_type
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                c, (start, end) = _replay(row, buckets, length, 4)
                doc = np.searchsorted(c.ends, start, side="right")
                sizes, spans, kept = [], [], []
                for k, (lo, hi) in enumerate(zip(c.starts.tolist(), c.ends.tolist(), strict=True)):
                    a, b = np.searchsorted(doc, (k, k + 1))
                    own, rest, upto = [], [], lo
                    for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True):
                        own.append({"start": s - lo, "end": e - lo})
                        rest.append(row["data"][upto:s])
                        upto = e
                    rest.append(row["data"][upto:hi])
                    sizes.append(hi - lo)
                    spans.append(own)
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], kind), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return with_answers(one, two, three).mapInArrow(
        finish, f"doc_id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


# --- registered query -----------------------------------------------------------------


def query(spark, sf_dir):
    from ledgerline.llm.common import documents

    found = suffix_dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
