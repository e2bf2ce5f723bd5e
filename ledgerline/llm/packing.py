"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document goes whole
into the fullest window that has room for it (best fit); if none has, the
fullest window is topped up with a cut of the document and emitted.  What is
open when a partition ends is merged: a few partitions' leftovers are packed
together, the last one of them in lengths that are powers of two, which need
no padding.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import byte_characters
from ledgerline.llm.common import ready, stored

WINDOW = 4096
#: Open windows of a partition; with their ids they take 1 MB.
OPEN = 64
#: A window is topped up only if it has room for so many ids, so that no
#: document leaves a shorter crumb behind.
LEAST_CUT = 16
#: Partitions whose leftovers are merged in one task.
MERGED = 64
END_ID = 2
#: Words, and pieces of words, that a tokenizing worker remembers.
REMEMBERED = 600_000
#: Rows of a task's output batch.
ROWS = 20_000

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- token ids ------------------------------------------------------------------


# --- fixed values: the tokenizer's published split pattern ---------------------------
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# --- end of fixed values ---------------------------------------------------------------
#: Words of these characters are in normal form already and have one spelling
#: in lower case, so they are split here and only their pieces are looked up.
PLAIN = regex.compile(r"[!-~\xa1-\u024f]+").fullmatch
#: What the pattern leaves for lower-case ASCII without an apostrophe.
ASCII = re.compile("[a-z]+|[0-9]|[^a-z0-9]+").findall


class Words(dict):
    """Ids of words, as the bytes of little-endian 32-bit numbers, worked out
    when first asked for; emptied when full."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model, self.pieces = tokenizer, tokenizer.model, {}
        self.chars = byte_characters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        text = word.decode()
        if word.isascii() and "'" not in text and "<|" not in text:
            ids = b"".join(map(self._piece, ASCII(text.lower())))
        elif PLAIN(text) and "<|" not in text:
            ids = b"".join(map(self._piece, SPLIT.findall(text.lower())))
        else:  # special strings, marks to compose, other scripts: the library's own steps
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() and piece.isprintable() else "".join(self.chars[b] for b in piece.encode())
            ids = np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
            self.pieces[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space: texts are cut
    at ASCII white space, and each distinct word is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.words = Words(tokenizer)

    def __call__(self, text: str, end_id: int) -> np.ndarray:
        words = text.encode().split()  # bytes split at ASCII white space only
        return np.frombuffer(b"".join([*map(self.words.__getitem__, words), end_id.to_bytes(4, "little")]), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


# --- packing --------------------------------------------------------------------


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids); ``done`` receives each
    emitted window's pieces."""

    def __init__(self, done, window: int = WINDOW, open_windows: int = OPEN) -> None:
        self.done, self.window, self.limit = done, window, open_windows
        self.rooms: list[tuple[int, int]] = []  # (room, number), least room first
        self.held: dict[int, list] = {}
        self.made = 0

    def _take(self, at: int) -> tuple[int, list]:
        room, number = self.rooms.pop(at)
        return room, self.held.pop(number)

    def _put(self, room: int, pieces: list) -> None:
        if room == 0:
            self.done(pieces)
            return
        bisect.insort(self.rooms, (room, self.made))
        self.held[self.made] = pieces
        self.made += 1

    def add(self, doc_id, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.done([(doc_id, start, total, ids[: self.window])])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect.bisect_left(self.rooms, (len(ids), -1))
            if at < len(self.rooms):
                room, pieces = self._take(at)
                self._put(room - len(ids), [*pieces, (doc_id, start, total, ids)])
                return
            if len(self.rooms) < self.limit:
                self._put(self.window - len(ids), [(doc_id, start, total, ids)])
                return
            room, pieces = self._take(0)  # none fits: emit the fullest
            if room >= LEAST_CUT and len(ids) - room >= LEAST_CUT:
                pieces = [*pieces, (doc_id, start, total, ids[:room])]
                start, ids = start + room, ids[room:]
            self.done(pieces)

    def leftovers(self) -> list[list]:
        """The windows still open, fullest first."""
        return [self.held[n] for _, n in self.rooms]

    def finish(self) -> None:
        """Merge the open windows: the emptiest ones' pieces top up the
        fullest, and the last window is emitted in powers of two."""
        rest = [p for pieces in self.leftovers() for p in pieces]
        now, room = [], self.window
        for doc_id, start, total, ids in rest:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                now.append((doc_id, start, total, part))
                start, room = start + len(part), room - len(part)
                if room == 0:
                    self.done(now)
                    now, room = [], self.window
        size = self.window
        while now:
            size //= 2
            if sum(len(p[3]) for p in now) < size:
                continue
            part, left, rest = [], size, []
            for doc_id, start, total, ids in now:
                if left:
                    part.append((doc_id, start, total, ids[:left]))
                if len(ids) > left:
                    rest.append((doc_id, start + left, total, ids[left:]))
                left = max(0, left - len(ids))
            self.done(part)
            now = rest
        self.rooms, self.held = [], {}


class _Rows:
    """Gathers emitted windows as rows of ``PIECE`` (and open ones with ids)."""

    def __init__(self, first_sequence: int, id_type: pa.DataType, with_ids: bool) -> None:
        self.next, self.id_type, self.with_ids, self.rows = first_sequence, id_type, with_ids, []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, None))
            offset += len(ids)
        self.next += 1

    def keep_open(self, pieces: list) -> None:
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), None, total, None, None, ids.astype("<u4").tobytes()))

    def batch(self):
        types = [self.id_type, *[pa.int64()] * 6, pa.binary()][: 8 if self.with_ids else 7]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=False)], names=names[: len(types)])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    A row's ids are those of its whole text followed by ``end_id`` (a null or
    empty text has that id alone).  Every id lies in exactly one piece; pieces
    of a sequence are gapless from 0 and at most ``window`` long.  Rows are
    independent: repeated and null ids are packed row by row; other columns
    are not read; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def first(batches):
        encode, out, packer = encoder(path), None, None
        task = TaskContext.get().partitionId()
        for batch in batches:
            if packer is None:
                out = _Rows(task << 32, batch["doc_id"].type, True)
                packer = Packer(out.emit, window, open_windows)
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "", end_id)
                packer.add(doc_id, 0, len(ids), ids)
                if len(out.rows) >= ROWS:
                    yield out.batch()
        if packer is not None:
            for pieces in packer.leftovers():
                out.keep_open(pieces)
            yield out.batch()

    def merge(batches):
        out = packer = None
        task = TaskContext.get().partitionId()
        for batch in batches:
            if packer is None:
                out = _Rows((1 << 62) + (task << 32), batch["doc_id"].type, False)
                packer = Packer(out.emit, window, open_windows)
            for doc_id, start, total, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                packer.add(doc_id, start, total, np.frombuffer(ids, "<u4"))
                if len(out.rows) >= ROWS:
                    yield out.batch()
        if packer is not None:
            packer.finish()
            yield out.batch()

    schema = PIECE.format(id=id_type)
    packed = stored(rows.mapInArrow(first, f"{schema}, ids binary").withColumn("part", F.spark_partition_id()), "packed")
    parts = packed.agg(F.max("part")).first()[0] or 0
    tasks = parts // MERGED + 1
    merged = (
        packed.where("sequence_id is null")
        .repartition(tasks, (F.col("part") / MERGED).cast("int"))
        .sortWithinPartitions(F.desc("length"), "doc_id", "start")
        .select("doc_id", "start", "doc_tokens", "ids")
        .mapInArrow(merge, schema)
    )
    return packed.where("sequence_id is not null").drop("ids", "part").unionByName(merged)


# --- registered query -----------------------------------------------------------


def query(spark, sf_dir):
    import public_tokenizers

    from ledgerline.llm.common import documents

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
