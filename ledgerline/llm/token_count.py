"""Token counts by a finite-state transducer compiled from a tokenizer file.

Byte-pair merging is turned into a deterministic transducer whose transitions
carry the number of tokens they add.  The last token of a prefix's encoding
is the one token ``t`` that ends there and may follow the last token of the
prefix before it: two neighbours stay apart exactly if no merge across their
border comes before the merges that made them.  So a state needs only, for
each place where a token may still be growing, the node of the vocabulary
tree, the token before that place and its count relative to the present one.
These states are finite in number and are worked out when first reached.  The
same machine cuts pre-tokens (letters, single digits, other signs, English
contractions), so one pass over the characters counts.

Long texts are cut into chunks.  A chunk's map gives, for each state it may be
entered in, the state it is left in and the tokens added.  Maps of neighbours
compose (the composition is associative), first within blocks of chunks, then
over a document's blocks.
"""

from __future__ import annotations

import functools
import json
import os
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import byte_characters
from ledgerline.llm.common import cut, ready, stored

#: Characters of a chunk; longer texts are counted by chunk maps.
CHUNK = 65_536
#: A cut is looked for so far back from a chunk's end.
REACH = 4_096
#: Characters before a cut inside a word from which its states are guessed.
CONTEXT = 256
#: Places in the context at which a guess starts.
GUESSES = 16
#: Chunks whose maps are composed in one group before a document's blocks are.
BLOCK = 64
#: Transitions and pairs that a worker remembers (about 150 bytes each).
REMEMBERED = 300_000
#: Bytes of words with their counts that a worker remembers.
WORD_BYTES = 24_000_000
#: Documents of more tokens are marked.
LIMIT = 2048

# --- fixed values: the tokenizer's published split pattern and word end ---------------
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
# --- end of fixed values ---------------------------------------------------------------

START = (0, (), None)
#: Modes: between words, letters, other signs, and after ' 'r 'v 'l.
LETTERS, SIGNS, MARK, MARK_R, MARK_V, MARK_L = 1, 2, 3, 4, 5, 6
BEGUN = {MARK: "", MARK_R: "r", MARK_V: "v", MARK_L: "l"}
FRESH = ((0, -1, 0),)
NEVER = 1 << 40

SPACE = re.compile("[\x20\x09-\x0d]")
#: Characters in normal form whose lower case does not depend on neighbours.
PLAIN = re.compile("[!-~\xa1-ɏ]+").fullmatch
#: Normal form never joins these to what stands before them.
SAFE = re.compile("[!-~À-ÿЀ-ѿぁ-ゖ一-鿿가-힣]")


class Transducer:
    """States, transitions and counts of one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cuts = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or cuts[0]["pattern"] != {"Regex": SPLIT}:
            raise ValueError(f"{path}: not a byte-level BPE with word ends and the known split pattern")
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self._merges(model)
        self._tree(model["vocab"])
        self.chars: dict[str, tuple[str, bytes]] = {}
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)
        self._forget()

    # -- compilation

    def _merges(self, model: dict) -> None:
        """Ranks by pair, and for each token its left and right edge from a
        single symbol up, with the rank at which each edge was made."""
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.born = [-1] * size
        self.left: list[tuple] = [(i,) for i in range(size)]
        self.right: list[tuple] = [(i,) for i in range(size)]
        self.alone = [True] * size
        for rank, pair in enumerate(model["merges"]):
            first, second = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[first], vocab[second], vocab[first + second]
            if self.born[whole] >= 0 or max(self.born[a], self.born[b]) >= rank:
                raise ValueError("merges must make each token once, after its parts")
            self.rank[a << 20 | b] = rank
            self.born[whole] = rank
            self.left[whole] = (*self.left[a], whole)
            self.right[whole] = (*self.right[b], whole)
        for pair in self.rank:  # a token that other merges pre-empt never comes out of its own symbols
            a, b = pair >> 20, pair & 0xFFFFF
            whole = self._whole(a, b)
            self.alone[whole] = self.alone[a] and self.alone[b] and self._apart(a, b, self.rank[pair])

    def _whole(self, a: int, b: int) -> int:
        """The token that the pair's merge makes."""
        return self.made[self.rank[a << 20 | b]]

    @functools.cached_property
    def made(self) -> dict[int, int]:
        return {rank: token for token, rank in enumerate(self.born) if rank >= 0}

    def _apart(self, u: int, t: int, until: int = NEVER) -> bool:
        """Whether no merge across the border of ``u`` and ``t`` comes before
        both are whole (and before rank ``until``).  Equal ranks go left first."""
        a, b, born, rank = self.right[u], self.left[t], self.born, self.rank
        i = j = 0
        while True:
            more_a = born[a[i + 1]] if i + 1 < len(a) else NEVER
            more_b = born[b[j + 1]] if j + 1 < len(b) else NEVER
            across = rank.get(a[i] << 20 | b[j], NEVER)
            if across < more_a and across <= more_b and across < until:
                return False
            if more_a == more_b == NEVER:
                return True
            if more_a <= more_b:
                i += 1
            else:
                j += 1

    def _tree(self, vocab: dict[str, int]) -> None:
        """Vocabulary tree over symbols: bytes, and bytes that end a word (+256)."""
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.child: dict[int, int] = {}
        self.token, inner = [-1], bytearray(1)
        for text, token in sorted(vocab.items(), key=lambda x: x[1]):
            ends = text.endswith(WORD_END)
            body = text[: -len(WORD_END)] if ends else text
            symbols = [byte_of[c] for c in body]
            if ends:
                symbols[-1] += 256
            node = 0
            for s in symbols:
                inner[node] = 1
                key = node << 9 | s
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    inner.append(0)
            self.token[node] = token
        self.inner = bytes(inner)

    # -- states

    def _forget(self) -> None:
        self.states, self.numbers, self.steps = [START], {START: 0}, {}
        self.pairs.clear()

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def _follows(self, u: int, t: int) -> bool:
        if u < 0:
            return self.alone[t]
        key = u << 20 | t
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.alone[t] and self._apart(u, t)
        return known

    def _feed(self, live: tuple, symbol: int) -> tuple[tuple, int]:
        """The places where tokens may grow after a symbol inside a word, and
        the tokens added."""
        child, token, inner, grown, last, added = self.child, self.token, self.inner, [], -1, 0
        for node, u, k in live:
            after = child.get(node << 9 | symbol)
            if after is None:
                continue
            t = token[after]
            if last < 0 and t >= 0 and self._follows(u, t):
                last, added = t, k + 1
            if inner[after]:
                grown.append((after, u, k))
        return (*[(v, u, k - added) for v, u, k in grown], (0, last, 0)), added

    def _finish(self, live: tuple, symbol: int) -> int:
        """The tokens added by a word's last symbol."""
        for node, u, k in live:
            after = self.child.get(node << 9 | symbol + 256)
            if after is not None and self.token[after] >= 0 and self._follows(u, self.token[after]):
                return k + 1
        raise AssertionError("every symbol is a token")

    def _word(self, data: bytes) -> int:
        live, total = FRESH, 0
        for b in data[:-1]:
            live, added = self._feed(live, b)
            total += added
        return total + self._finish(live, data[-1])

    def _char(self, c: str) -> tuple[str, bytes]:
        """Class (letter, number, space, other) as the tokenizer's own cutter
        sees it, and the bytes of a character."""
        known = self.chars.get(c)
        if known is None:
            pieces = lambda x: len(self.cutter.pre_tokenize_str(x))
            if pieces("a" + c) == 1:
                kind = "S" if not pieces(c) else "L"
            elif pieces("!" + c) == 1:
                kind = "O"
            else:
                kind = "N"
            known = self.chars[c] = (kind, c.encode())
            if len(self.chars) > 50_000:
                self.chars = {c: known}
        return known

    def _close(self, state: tuple) -> int:
        """The tokens added where a word ends."""
        mode, live, pending = state
        if mode in (LETTERS, SIGNS):
            return self._finish(live, pending)
        if mode in BEGUN:
            return self._word(b"'") + (self._word(BEGUN[mode].encode()) if BEGUN[mode] else 0)
        return 0

    def _next(self, state: tuple, c: str) -> tuple[tuple, int]:
        mode, live, pending = state
        kind, data = self._char(c)
        if mode in BEGUN:
            if mode == MARK and c in ("s", "t", "m", "d"):
                return START, self._word(b"'" + data)
            if mode == MARK and c in ("r", "v", "l"):
                return ({"r": MARK_R, "v": MARK_V, "l": MARK_L}[c], (), None), 0
            if (mode, c) in ((MARK_R, "e"), (MARK_V, "e"), (MARK_L, "l")):
                return START, self._word(b"'" + BEGUN[mode].encode() + data)
            if mode == MARK and kind == "O":
                return self._grow(SIGNS, FRESH, ord("'"), data)
            total, state = self._word(b"'"), START
            for d in BEGUN[mode] + c:
                state, added = self._next(state, d)
                total += added
            return state, total
        if mode == LETTERS and kind == "L" or mode == SIGNS and kind == "O":
            return self._grow(mode, live, pending, data)
        total = self._close(state)
        if kind == "S":
            return START, total
        if kind == "N":
            return START, total + self._word(data)
        if c == "'":
            return (MARK, (), None), total
        grown, added = self._grow(LETTERS if kind == "L" else SIGNS, FRESH, None, data)
        return grown, total + added

    def _grow(self, mode: int, live: tuple, pending: int | None, data: bytes) -> tuple[tuple, int]:
        """A character more: its last byte waits, as it may end the word."""
        total = 0
        for b in data:
            if pending is not None:
                live, added = self._feed(live, pending)
                total += added
            pending = b
        return (mode, live, pending), total

    # -- runs

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state after normalised text, and the tokens added."""
        total = 0
        for at in range(0, len(text), REACH):
            if len(self.steps) > REMEMBERED or len(self.pairs) > REMEMBERED:
                self._forget()
            s, steps = self.number(state), self.steps
            for c in text[at : at + REACH]:
                key = s << 21 | ord(c)
                step = steps.get(key)
                if step is None:
                    after, added = self._next(self.states[s], c)
                    step = steps[key] = self.number(after) << 12 | added + 2048
                s = step >> 12
                total += (step & 4095) - 2048
            state = self.states[s]
        return state, total

    def normal(self, raw: str) -> str:
        return raw.lower() if raw.isascii() or PLAIN(raw) else self.normalizer.normalize_str(raw)

    def advance(self, state: tuple, raw: str, close: bool) -> tuple[tuple, int]:
        """Raw text without the tokenizer's space rule applied yet; special
        strings count one each and end words."""
        total, at = 0, 0
        for m in self.special.finditer(raw):
            state, added = self.run(state, self.normal(raw[at : m.start()]))
            total += added + self._close(state) + 1
            state, at = START, m.end()
        state, added = self.run(state, self.normal(raw[at:]))
        total += added
        return (START, total + self._close(state)) if close else (state, total)

    def count(self, data: bytes) -> int:
        """Tokens of a whole text.  ASCII white space (all that ``split`` of
        bytes cuts at) brings the machine back to its start, so a word's count
        is one long transition there and is remembered as such."""
        return sum(map(self.words.__getitem__, data.split()))

    def chunk_map(self, text: str, entries: list[tuple], close: bool) -> dict:
        """``{entry state: (state at the end, tokens)}`` of a chunk."""
        gap = SPACE.search(text)
        if gap is None:
            return {s: self.advance(s, text, close) for s in entries}
        head, tail = text[: gap.start()], text[gap.start() :]
        after, rest = START, 0
        if not close:
            at = max(tail.rfind(c) for c in " \t\n\r\x0b\x0c") + 1
            after, rest = self.advance(START, tail[at:], False)
            tail = tail[:at]
        rest += self.count(tail.encode())
        return {s: (after, self.advance(s, head, True)[1] + rest) for s in entries}

    def guesses(self, context: str) -> list[tuple]:
        """States that the text before a cut inside a word may lead to."""
        if self.special.search(context):
            return [self.advance(START, context, False)[0]]
        text = self.normal(context)
        return list(dict.fromkeys(self.run(START, text[k:])[0] for k in range(min(GUESSES, len(text) + 1))))


class _Words(dict):
    """Tokens of words, worked out when first asked for; emptied when full.
    Words of over 64 bytes are not kept."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine, self.held = machine, 0

    def __missing__(self, word: bytes) -> int:
        n = self.machine.advance(START, word.decode(), True)[1]
        if len(word) <= 64:
            self.held += len(word) + 100
            if self.held > 4 * WORD_BYTES:
                self.clear()
                self.held = 0
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker process and file."""
    return Transducer(path)


# --- chunks -------------------------------------------------------------------------


def _safe(text: str, at: int) -> bool:
    return SAFE.match(text, at) is not None and "<|" not in text[max(0, at - 16) : at + 16]


def chunks(text: str, size: int = CHUNK, reach: int = REACH) -> Iterator[tuple[str, str | None, bool]]:
    """(text, context, closed) of each chunk.  Cuts stand before ASCII white
    space if there is some near, so that the chunk before closes its word;
    else before a character that normal form never joins to the one before,
    and the next chunk gets the text before the cut as ``context``."""
    begin, context = 0, None
    while begin < len(text):
        at = begin + size
        if at >= len(text):
            yield text[begin:], context, True
            return
        spaces = [m.start() for m in SPACE.finditer(text, max(begin + 1, at - reach), at + 1)]
        if spaces:
            yield text[begin : spaces[-1]], context, True
            begin, context = spaces[-1], None
            continue
        at = next((k for k in range(at, max(begin, at - reach), -1) if _safe(text, k)), 0) or next(
            (k for k in range(at + 1, len(text)) if _safe(text, k) or SPACE.match(text, k)), len(text)
        )
        closed = at == len(text) or SPACE.match(text, at) is not None
        yield text[begin:at], context, closed
        context = None
        if not closed:
            back = next((k for k in range(max(0, at - 2 * CONTEXT), max(0, at - CONTEXT)) if _safe(text, k)), at)
            context = text[back:at]
        begin = at


def compose(first: dict, second: dict) -> dict:
    """First one map, then the other; entries that lead to a state which the
    second map lacks are left out."""
    out = {}
    for entry, (state, n) in first.items():
        if state in second:
            after, more = second[state]
            out[entry] = (after, n + more)
    return out


def scan(maps: list[dict]) -> dict:
    """All maps composed, neighbours by neighbours."""
    while len(maps) > 1:
        maps = [compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, reach: int = REACH
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null or empty text has no bytes and no tokens.  Rows are independent:
    repeated and null ids are counted row by row; other columns are not read;
    an empty table gives no rows.  Texts of up to ``chunk`` characters are
    counted where they are read.  Longer ones are cut into chunks that are
    dealt over all tasks; a document's maps are composed in groups of 64
    chunks, then over its blocks (a Spark string ends at 2 GB, so 512 blocks
    at most).  A cut inside a word longer than ``reach`` may be entered in a
    state that was not guessed; such a document's chunks are run again one
    after the other, carrying the exact state.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def first(batches):
        machine, task, made = transducer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held = batch["doc_id"], {k: [] for k in ("at", "bytes", "tokens", "row", "chunk", "text", "context", "closed")}

            def put(*values, held=held):
                for column, v in zip(held.values(), values, strict=True):
                    column.append(v)

            for at, value in enumerate(batch["text"]):
                text = value.as_py() or ""
                data = text.encode()
                if len(text) <= chunk:
                    put(at, len(data), machine.count(data), None, None, None, None, None)
                    continue
                made += 1
                for n, (part, context, closed) in enumerate(chunks(text, chunk, reach)):
                    put(at, len(data), None, task << 32 | made, n, part, context, closed)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(list(held.values())[1:], types, strict=True)]
            names = ["doc_id", "n_bytes", "n_tokens", "row", "chunk", "text", "context", "closed"]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(held["at"], pa.int64())), *arrays], names=names)

    def maps(batches):
        machine = transducer(path)
        for batch in batches:
            out = []
            for text, context, closed in zip(*(batch[c].to_pylist() for c in ("text", "context", "closed")), strict=True):
                entries = [START] if context is None else machine.guesses(context)
                out.append(pickle.dumps(machine.chunk_map(text, entries, closed)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "n_bytes", "row", "chunk")), pa.array(out, pa.binary())], names=[*HEAD, "map"])

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        whole = scan([pickle.loads(m.as_py()) for m in table["map"]])
        one = table.slice(0, 1)
        return pa.table([*(one[c] for c in HEAD), pa.array([pickle.dumps(whole)], pa.binary())], names=[*HEAD, "map"])

    def total(table: pa.Table) -> pa.Table:
        one = block(table)
        ends = pickle.loads(one["map"][0].as_py())
        n = ends[START][1] if START in ends else None
        return pa.table([*(one[c] for c in HEAD[:3]), pa.array([n], pa.int64())], names=[*HEAD[:3], "n_tokens"])

    def in_turn(batches):
        machine, now = transducer(path), None
        for batch in batches:
            done: list = []
            for doc_id, n_bytes, row, text, closed, last in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "row", "text", "closed", "last")), strict=True):
                if now is None or now[0] != row:
                    now = [row, START, 0]
                ((now[1], added),) = machine.chunk_map(text, [now[1]], closed).values()
                now[2] += added
                if last:
                    done.append((doc_id, n_bytes, now[2]))
            columns = list(zip(*done, strict=True)) if done else [()] * 3
            types = [batch["doc_id"].type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_tokens"])

    head = f"doc_id {id_type}, n_bytes long, row long, chunk int"
    read = stored(
        rows.mapInArrow(first, f"doc_id {id_type}, n_bytes long, n_tokens long, row long, chunk int, text string, context string, closed boolean"),
        "token-chunks",
    )
    counted = read.where("row is null").select("doc_id", "n_bytes", "n_tokens")
    cuts = read.where("row is not null").drop("n_tokens")
    mapped = cuts.repartition("row", "chunk").mapInArrow(maps, f"{head}, map binary")
    blocks = mapped.groupBy("row", F.floor(F.col("chunk") / BLOCK).alias("block")).applyInArrow(block, f"{head}, map binary")
    totals = cut(blocks.groupBy("row").applyInArrow(total, f"doc_id {id_type}, n_bytes long, row long, n_tokens long"))
    found = counted.unionByName(totals.where("n_tokens is not null").drop("row"))
    missed = totals.where("n_tokens is null").select("row")
    if not missed.isEmpty():
        ends = cuts.groupBy("row").agg(F.max("chunk").alias("end"))
        again = (
            cuts.join(missed, "row", "left_semi")
            .join(ends, "row")
            .withColumn("last", F.col("chunk") == F.col("end"))
            .repartition("row")
            .sortWithinPartitions("row", "chunk")
            .select("doc_id", "n_bytes", "row", "text", "closed", "last")
        )
        found = found.unionByName(again.mapInArrow(in_turn, f"doc_id {id_type}, n_bytes long, n_tokens long"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


HEAD = ("doc_id", "n_bytes", "row", "chunk")


# --- registered query ---------------------------------------------------------------


def query(spark, sf_dir):
    import public_tokenizers

    from ledgerline.llm.common import documents

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
