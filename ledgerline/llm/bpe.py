"""Byte-level BPE encoding and decoding.

The vocabulary and merges are read from a tokenizer's JSON file, whose path
is a parameter.  A text is cut at the special strings, then by the byte-level
pattern; each piece becomes a doubly linked list of symbols whose adjacent
pairs wait in a priority queue of merge ranks.  Popping a pair whose symbols
have changed since (a stale entry) is skipped.  Decoding concatenates the
vocabulary strings of the ids.
"""

from __future__ import annotations

import functools
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ready, sha256_text

# --- fixed values of byte-level BPE -------------------------------------------
# The published pattern, with white space as Unicode's White_Space characters.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# --- end of fixed values --------------------------------------------------------

#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: Ids per Arrow batch that an encoding task hands on, at least one document.
BATCH_IDS = 500_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary
    strings: itself if visible in Latin-1, else the next one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Pieces(dict):
    """Ids of pieces, worked out when first asked for."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids = tuple(self.bpe.merge(piece.encode()))
        return ids


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        for token, i in special.items():
            self.strings[i] = token.encode()
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.pieces = Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: lowest rank first, leftmost of equal ranks."""
        ids = [self.byte_ids[b] for b in piece]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for at in range(n - 1):
            if found := ranks.get((ids[at], ids[at + 1])):
                queue.append((found[0], at, ids[at], ids[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, new = heapq.heappop(queue)
            nxt = after[at]
            if ids[at] != left or nxt >= n or ids[nxt] != right:
                continue  # stale: one of the two was merged meanwhile
            ids[at], ids[nxt] = new, -1
            after[at] = nxt = after[nxt]
            if nxt < n:
                before[nxt] = at
                if found := ranks.get((new, ids[nxt])):
                    heapq.heappush(queue, (found[0], at, new, ids[nxt], found[1]))
            if (prev := before[at]) >= 0 and (found := ranks.get((ids[prev], new))):
                heapq.heappush(queue, (found[0], prev, ids[prev], new, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special strings in it become their ids."""
        if self.cut is None or not self.cut.search(text):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += chain.from_iterable(map(self.pieces.__getitem__, self.find(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        return out + list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text[at:]))))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in a row; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One tokenizer per worker process and file."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` per row: a null or empty text has no ids.  Rows are
    independent (repeated and null ids too); other columns are not read.
    ``path`` must be readable on every worker."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches):
        bpe = load(path)
        for batch in batches:
            first, size, held = 0, 0, []

            def hand_on(end, batch=batch):
                values = np.concatenate(held) if held else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                return pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, end - first), ids], names=["doc_id", "ids"])

            for at, text in enumerate(batch["text"], 1):
                held.append(np.array(bpe.encode(text.as_py() or ""), np.int32))
                size += len(held[-1])
                if size >= BATCH_IDS or at == len(batch):
                    yield hand_on(at)
                    first, size, held = at, 0, []

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its ``ids`` replaced by the decoded ``text``; null ids
    give an empty text."""
    others = [c for c in encoded.columns if c != "ids"]

    def decode(batches):
        bpe = load(path)
        for batch in batches:
            texts = []
            for ids in batch["ids"]:
                texts.append(bpe.decode(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in others], pa.array(texts, pa.string())], names=[*others, "text"])

    fields = ", ".join([*[f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in others], "text string"])
    return encoded.mapInArrow(decode, fields)


# --- registered query -----------------------------------------------------------


def query(spark, sf_dir):
    import public_tokenizers

    from ledgerline.llm.common import documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_documents(documents(spark, sf_dir), path)
    figures = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        "ids",
    )
    return decode_documents(figures, path).select(
        "doc_id", "n_tokens", "ids_sha256", sha256_text(F.col("text")).alias("decoded_sha256")
    )
