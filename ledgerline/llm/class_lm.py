"""Brown class-based n-gram language model.

Words are put into classes by exchange clustering: each word moves to the
class that raises the likelihood of the class bigrams most.  A text is scored
with class-transition probabilities times word-emission probabilities.

Every training word gets a learned class, in Brown's two steps.  Words that
make up at least 1 / ``CORE`` of the training words (at most ``CORE`` of them,
whatever the corpus) are exchanged one by one, pass after pass, from their
bigrams with the classes, gathered in Spark, until a pass gains less than
``TOLERANCE``.  Then every other training word is inserted, in tasks, into the
class that raises the likelihood most given the words right and left of all
its places; neighbours not yet inserted count by their spelling.  Word counts
and classes are joined to the texts, only the core words are broadcast.

A chunk of texts keeps its distinct words as one run of bytes and their
lengths.  Its words travel to the task that inserts them, and their classes
back, in one row for each of its blocks (words by hash), not one for each word.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bucket_count, ready, stored
from ledgerline.session import ensure_checkpoint_dir

#: Words with at least 1 / CORE of the training words are exchanged one by one.
CORE = 65_536
CLASSES = 64
#: Exchange rests when a pass gains less than this many nats a training token
#: (0: when a pass gains nothing).
TOLERANCE = 1e-3
#: Classes by spelling of words not (yet) in a learned class: letters a-z and
#: common marks, a digit, other signs, other scripts.
SHAPES = 4
KINDS = CLASSES + SHAPES + 1  # the end of a text is a class of its own
END = KINDS - 1
#: Share of the words' own frequency mixed with the class model, so that a word
#: whose class rests on few places is never much worse off than without it.
UNIGRAM = 0.2
ONCE = 128  # added to the class of a word met once, for each spelling
#: Bytes of text whose words are numbered together (one document at least).
CHUNK = 4_000_000
#: Chunk bytes read by one task, and text bytes for each block of words, about.
BUCKET = 32_000_000
#: Neighbours' counts weighed against all classes at a time.
WEIGHED = 16_384
#: Words whose bigrams with classes, or slots whose counts, travel in one row.
BLOCK = 512
#: Slots over which the words' counts are added up to rule words out of the core.
SLOTS = 1 << 18

_DIGIT, _PLAIN = frozenset(b"0123456789"), frozenset(b"abcdefghijklmnopqrstuvwxyz.,;:!?'\"()-")


def shape(word: bytes) -> int:
    """Class by spelling, 0 to 3."""
    if not word.isascii():
        return 3
    if _PLAIN.issuperset(word):
        return 0
    return 1 if not _DIGIT.isdisjoint(word) else 2


# Signs of the bytes of a word (a digit 1, other ASCII 2, other scripts 4), and
# the shape by the signs met.
_SIGN = np.array([4 if b > 127 else 1 if b in _DIGIT else 0 if b in _PLAIN else 2 for b in range(256)], np.uint8)
_SHAPE = np.array([0, 1, 2, 1, 3, 3, 3, 3])
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 320, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- lists of words -------------------------------------------------------------------


def _ends(lengths: np.ndarray) -> np.ndarray:
    """Where each of the runs of these lengths begins, and the last one ends."""
    return np.append(0, np.cumsum(lengths, dtype=np.int64))


def _binary(data, bounds: np.ndarray) -> pa.BinaryArray:
    """The bytes between bounds, one value each."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _flat(values: pa.BinaryArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values' bytes after each other, and their bounds."""
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).astype(np.int64)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _words(row) -> pa.BinaryArray:
    """The word list of a chunk or block."""
    return _binary(row["words"][0].as_buffer(), _ends(_numbers(row, "lengths", "<u4")))


def _numbers(row, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name][0].as_buffer(), kind)


def _shapes(words: pa.BinaryArray) -> np.ndarray:
    """:func:`shape` of each word (none is empty)."""
    data, bounds = _flat(words)
    return _SHAPE[np.bitwise_or.reduceat(_SIGN[data], bounds[:-1])] if len(words) else np.zeros(0, np.int64)


def _hashes(words: pa.BinaryArray) -> np.ndarray:
    """An unsigned 64-bit hash of each word."""
    data, bounds = _flat(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    h = np.add.reduceat(_MIX[data] * _MIX[256 + place % 64], bounds[:-1])
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


# --- words of chunks ------------------------------------------------------------------


def _number_words(batches):
    """A row for each chunk: its documents, their tokens as numbers of the
    chunk's own word list, that list, each word's training count and their sum."""
    task, made, docs, size, kind = TaskContext.get().partitionId() << 32, 0, [], 0, None

    def row():
        text = b" ".join(data for _, _, data in docs)
        bytes_ = np.frombuffer(text, np.uint8)
        inside = np.concatenate([[False], (bytes_ != 32) & (bytes_ - np.uint8(9) > 4), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        coded = _binary(text.lower().translate(None, b" \t\n\v\f\r"), _ends(ends - starts)).dictionary_encode()
        tokens = coded.indices.to_numpy()
        upto = np.searchsorted(starts, np.cumsum([len(data) + 1 for _, _, data in docs]))
        train = np.bincount(tokens[np.repeat([not held for _, held, _ in docs], np.diff(upto, prepend=0))], minlength=len(coded.dictionary))
        words, bounds = _flat(coded.dictionary)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task + made]),
                pa.array([[d for d, _, _ in docs]], pa.list_(kind)),
                pa.array([[h for _, h, _ in docs]], pa.list_(pa.bool_())),
                pa.array([upto], pa.list_(pa.int64())),
                pa.array([tokens.astype("<i4").tobytes()], pa.binary()),
                pa.array([words.tobytes()], pa.binary()),
                pa.array([np.diff(bounds).astype("<u4").tobytes()], pa.binary()),
                pa.array([train.astype("<u4").tobytes()], pa.binary()),
                pa.array([int(train.sum())], pa.int64()),
            ],
            names=["chunk", "ids", "held", "ends", "tokens", "words", "lengths", "train", "total"],
        )

    for batch in batches:
        kind = batch["doc_id"].type
        for doc_id, held, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), batch["text"], strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if docs and size + len(data) > CHUNK:
                yield row()
                made, docs, size = made + 1, [], 0
            docs.append((doc_id, held, data))
            size += len(data)
    if docs:
        yield row()


# --- core words -----------------------------------------------------------------------


def _slots(words: pa.BinaryArray) -> np.ndarray:
    return (_hashes(words) % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches):
    """Per task: training counts added up by slot."""
    total = np.zeros(SLOTS, np.int64)
    for row in _single_rows(batches):
        total += np.bincount(_slots(_words(row)), _numbers(row, "train", "<u4"), SLOTS).astype(np.int64)
    blocks = total.astype("<i8").reshape(-1, BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "n"])


def _add_slots(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table["n"]:
        total += np.frombuffer(x.as_py(), "<i8")
    return pa.table({"block": table["block"][:1], "n": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _counts_of(open_: np.ndarray):
    """``word, n`` of the chunks' training words whose slot is open."""

    def counts(batches):
        for row in _single_rows(batches):
            listed, train = _words(row), _numbers(row, "train", "<u4")
            at = np.flatnonzero(open_[_slots(listed)] & (train > 0))
            yield pa.RecordBatch.from_arrays([listed.take(pa.array(at)), pa.array(train[at].astype(np.int64))], names=["word", "n"])

    return counts


def _core_counts(chunks: DataFrame, core: int, n_words: int) -> DataFrame:
    """``word, c`` of the words that hold 1 / ``core`` of the training words.
    A slot's count is at least that of each of its words, so only words of
    slots with that share are counted one by one."""
    listed = chunks.select("words", "lengths", "train")
    found = listed.mapInArrow(_slot_counts, "block int, n binary").groupBy("block").applyInArrow(_add_slots, "block int, n binary").toArrow()
    slots = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    for block, n in zip(found["block"].to_pylist(), found["n"].to_pylist(), strict=True):
        slots[block] = np.frombuffer(n, "<i8")
    counts = listed.mapInArrow(_counts_of(slots.ravel() * core >= n_words), "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("c")).where(F.col("c") * core >= n_words)


def _codes(words: pa.BinaryArray, core: pa.BinaryArray) -> np.ndarray:
    """A core word's number, or the core's size plus a shape."""
    codes = pc.index_in(words, value_set=core).fill_null(-1).to_numpy().astype(np.int64)
    other = np.flatnonzero(codes < 0)
    codes[other] = len(core) + _shapes(words.take(pa.array(other)))
    return codes


def _tokens(row):
    """A chunk's tokens (its words' numbers, after each text the number past
    them) and each text's number of tokens."""
    ends = row["ends"][0].values.to_numpy()
    n = np.diff(np.concatenate([[0], ends])) + 1
    return np.insert(_numbers(row, "tokens", "<i4"), ends, len(row["lengths"][0].as_buffer()) // 4), n


def _single_rows(batches):
    for batch in batches:
        for at in range(len(batch)):
            yield batch.slice(at, 1)


def _core_coder(core: pa.BinaryArray):
    """Chunks with their tokens as codes; the end's code is the last one."""

    def code(batches):
        for row in _single_rows(batches):
            seq, n = _tokens(row)
            codes = np.append(_codes(_words(row), core), len(core) + SHAPES)[seq]
            yield pa.RecordBatch.from_arrays(
                [row["held"], pa.array([n], pa.list_(pa.int64())), pa.array([codes.astype("<u4").tobytes()], pa.binary())], names=["held", "n", "codes"]
            )

    return code


# --- exchange -------------------------------------------------------------------------


def _bigrams(classes: np.ndarray, kinds: int):
    """Per task: each code's bigrams with the classes right and left of it,
    and with itself, over training documents."""

    def count(batches):
        size = len(classes)
        right, left, self_ = np.zeros(size * kinds, np.int64), np.zeros(size * kinds, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for held, n, codes in zip(batch["held"].to_pylist(), batch["n"].to_pylist(), batch["codes"].to_pylist(), strict=True):
                now = np.frombuffer(codes, "<u4").astype(np.int64)
                before = np.concatenate([[size - 1], now[:-1]])  # END is the last code
                train = np.repeat(~np.array(held), n)
                now, before = now[train], before[train]
                right += np.bincount(before * kinds + classes[now], minlength=size * kinds)
                left += np.bincount(now * kinds + classes[before], minlength=size * kinds)
                self_ += np.bincount(now[now == before], minlength=size)
        rows = []
        for a in range(0, size, BLOCK):
            parts = [x[a * w : (a + BLOCK) * w] for x, w in ((right, kinds), (left, kinds), (self_, 1))]
            if any(p.any() for p in parts):
                found = [np.flatnonzero(p) for p in parts]
                rows.append((a // BLOCK, *[np.stack([f, p[f]]).astype("<i8").tobytes() for f, p in zip(found, parts, strict=True)]))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "right", "left", "self"]
            )

    return count


def _gather(coded: DataFrame, classes: np.ndarray, kinds: int):
    """Arrays right and left [code, class] and self [code], summed in Spark."""
    size = len(classes)

    def add(table: pa.Table) -> pa.Table:
        out = [table["block"][:1]]
        for name, w in (("right", kinds), ("left", kinds), ("self", 1)):
            total = np.zeros(BLOCK * w, np.int64)
            for x in table[name]:
                at, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                total[at] += n
            out.append(pa.chunked_array([pa.array([total.astype("<i8").tobytes()], pa.binary())]))
        return pa.Table.from_arrays(out, names=["block", "right", "left", "self"])

    schema = "block int, right binary, left binary, self binary"
    found = coded.select("held", "n", "codes").mapInArrow(_bigrams(classes, kinds), schema).groupBy("block").applyInArrow(add, schema).toArrow()
    right, left, self_ = (np.zeros((-(-size // BLOCK) * BLOCK, w), np.int64) for w in (kinds, kinds, 1))
    for k, block in enumerate(found["block"].to_pylist()):
        for total, name in ((right, "right"), (left, "left"), (self_, "self")):
            total[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(found[name][k].as_py(), "<i8").reshape(BLOCK, -1)
    return right[:size].astype(float), left[:size].astype(float), self_[:size, 0].astype(float)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _matrix(right: np.ndarray, classes: np.ndarray, kinds: int) -> np.ndarray:
    out = np.zeros((kinds, kinds))
    np.add.at(out, classes, right)
    return out


def likelihood(m: np.ndarray) -> float:
    """What the classes add to the training text's log likelihood."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def exchange(right: np.ndarray, left: np.ndarray, self_: np.ndarray, classes: np.ndarray, movable: int, kinds: int) -> tuple[np.ndarray, int]:
    """One pass: the first ``movable`` codes, one by one, move to the class
    (0 to CLASSES - 1) that raises the likelihood of the class bigrams most,
    their neighbours' classes taken as they were when counted."""
    classes, moves = classes.copy(), 0
    now = _matrix(right, classes, kinds)
    for w in range(movable):
        a, s = classes[w], self_[w]
        r, l = right[w].copy(), left[w].copy()
        r[a] -= s  # the word's own bigrams with itself
        l[a] -= s
        m = now.copy()
        m[a] -= r
        m[:, a] -= l
        m[a, a] -= s
        np.maximum(m, 0, out=m)
        c = np.arange(CLASSES)
        rows, cols, diagonal = m[:CLASSES], m[:, :CLASSES].T, m[c, c]
        gain = (_f(rows + r) - _f(rows)).sum(1) + (_f(cols + l) - _f(cols)).sum(1)
        both = r[:CLASSES] + l[:CLASSES] + s
        gain += _f(diagonal + both) - _f(diagonal + r[:CLASSES]) - _f(diagonal + l[:CLASSES]) + _f(diagonal)
        for total, own in ((m.sum(1)[:CLASSES], r.sum() + s), (m.sum(0)[:CLASSES], l.sum() + s)):
            gain -= _f(total + own) - _f(total)
        b = int(np.argmax(gain))
        if gain[b] > gain[a] + 1e-6:
            m[b] += r
            m[:, b] += l
            m[b, b] += s
            now, classes[w] = m, b
            moves += 1
    return classes, moves


# --- insertion of the other words -----------------------------------------------------


def _in_blocks(words: pa.BinaryArray, codes: np.ndarray, size: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words outside the core (codes from ``size`` on) in
    the order of their blocks, and those blocks."""
    at = np.flatnonzero(codes >= size)
    block = ((_hashes(words.take(pa.array(at))) >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    return at[order], block[order]


def _places(core: pa.BinaryArray, classes: np.ndarray, blocks: int):
    """A row for each chunk and block: the chunk's words of that block, outside
    the core, their training places and ``near``, a byte for each place's right
    neighbour (its class) and one for the left neighbour (KINDS plus its class)."""

    def places(batches):
        for row in _single_rows(batches):
            listed = _words(row)
            codes = _codes(listed, core)
            at, block = _in_blocks(listed, codes, len(core), blocks)
            rank = np.full(len(listed) + 1, -1)
            rank[at] = np.arange(len(at))
            seq, n = _tokens(row)
            kind = np.append(classes[codes], END).astype(np.uint8)[seq]
            who = rank[seq]
            wanted = (who >= 0) & np.repeat(~row["held"][0].values.to_numpy(zero_copy_only=False), n)
            near = np.stack([np.append(kind[1:], END)[wanted], KINDS + np.append(END, kind[:-1])[wanted]], axis=1).astype(np.uint8)
            who = who[wanted]
            near = near[np.argsort(who, kind="stable")].tobytes()
            size = np.bincount(who, minlength=len(at))
            data, bounds = _flat(listed.take(pa.array(at)))
            first = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(at))  # of each block's words
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first) - 1, row["chunk"][0].as_py(), np.int64)),
                    pa.array(block[first[:-1]].astype(np.int32)),
                    _binary(data, bounds[first]),
                    _binary(np.diff(bounds).astype("<u4").tobytes(), 4 * first),
                    _binary(size.astype("<u4").tobytes(), 4 * first),
                    _binary(near, 2 * _ends(size)[first]),
                ],
                names=["chunk", "block", "words", "lengths", "n", "near"],
            )

    return places


def best_classes(word: np.ndarray, at: np.ndarray, n: np.ndarray, size: int, m: np.ndarray) -> np.ndarray:
    """The class (0 to CLASSES - 1, the lowest of equals) in which each of the
    ``size`` words raises the likelihood of the class bigrams ``m`` most, by
    its counts ``n`` of right (``at`` is the class) and left neighbours (KINDS
    plus the class), in the order of words and ``at``."""

    def gained(cells, at, n):  # of cells [:, at] when n are added, for all classes
        many = n.max(initial=0) + 1
        key, back = np.unique(at * many + n, return_inverse=True)
        at, n = np.divmod(key, many)
        old = cells[:, at]
        return (_f(old + n) - _f(old)).T[back]

    gain = np.zeros((size, CLASSES))
    for cells, total, base in ((m[:CLASSES], m.sum(1), 0), (m.T[:CLASSES], m.sum(0), KINDS)):
        part = np.flatnonzero((at >= base) & (at < base + KINDS))
        if len(part):
            first = np.flatnonzero(np.diff(word[part], prepend=-1))
            gain[word[part][first]] += np.add.reduceat(gained(cells, at[part] - base, n[part]), first)
        own = np.bincount(word[part], n[part], size).astype(np.int64)
        gain -= gained(total[:CLASSES, None], np.zeros(size, np.int64), own)
    # A class that is its own neighbour: both counts enter one cell.
    cell = word * KINDS + at % KINDS
    right, left = (np.flatnonzero(x) for x in (at < CLASSES, (at >= KINDS) & (at < KINDS + CLASSES)))
    both, i, j = np.intersect1d(cell[right], cell[left], assume_unique=True, return_indices=True)
    w, c = np.divmod(both, KINDS)
    d, r, l = m[c, c], n[right[i]], n[left[j]]
    gain[w, c] += _f(d + r + l) - _f(d + r) - _f(d + l) + _f(d)
    return np.argmax(gain, axis=1)


def _insert(m: np.ndarray):
    """A block's words with their training counts and classes (``chunk`` is
    null), and for each chunk its words' counts and classes in its own order."""

    def insert(table: pa.Table) -> pa.Table:
        data, _ = _flat(table["words"])
        lengths, bounds = _flat(table["lengths"])
        coded = _binary(data, _ends(lengths.view("<u4"))).dictionary_encode()
        which, listed = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        n = _flat(table["n"])[0].view("<u4")
        count = np.bincount(which, n, len(listed)).astype(np.int64)
        places = np.sort(np.repeat(which * 2 * KINDS, 2 * n.astype(np.int64)) + _flat(table["near"])[0])
        first = np.flatnonzero(np.diff(places, prepend=-1))
        size = np.diff(first, append=len(places))
        word, at = np.divmod(places[first], 2 * KINDS)
        # Words in parts of about WEIGHED neighbours.
        upto = np.searchsorted(word, np.arange(len(listed) + 1))
        cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, len(word), WEIGHED)), [0, len(listed)]))
        kind = np.zeros(len(listed), np.int8)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = slice(upto[a], upto[b])
            kind[a:b] = best_classes(word[part] - a, at[part], size[part], b - a, m)
        seen = np.flatnonzero(count)
        words, ends = _flat(listed.take(pa.array(seen)))
        per_chunk = bounds // 4
        block, nothing = table["block"][0].as_py(), pa.nulls(table.num_rows, pa.binary())
        out = [
            pa.array([*table["chunk"].to_pylist(), None], pa.int64()),
            pa.array([block] * (table.num_rows + 1), pa.int32()),
            pa.concat_arrays([nothing, pa.array([words.tobytes()], pa.binary())]),
            pa.concat_arrays([nothing, pa.array([np.diff(ends).astype("<u4").tobytes()], pa.binary())]),
            pa.concat_arrays([_binary(count[which].astype("<i8").tobytes(), 8 * per_chunk), pa.array([count[seen].astype("<i8").tobytes()], pa.binary())]),
            pa.concat_arrays([_binary(kind[which].tobytes(), per_chunk), pa.array([kind[seen].tobytes()], pa.binary())]),
        ]
        return pa.Table.from_arrays(out, names=["chunk", "block", "words", "lengths", "counts", "kinds"])

    return insert


def _model_words(batches):
    """``word, c, kind`` of the blocks' words."""
    for row in _single_rows(batches):
        yield pa.RecordBatch.from_arrays([_words(row), pa.array(_numbers(row, "counts", "<i8")), pa.array(_numbers(row, "kinds", "i1"))], names=["word", "c", "kind"])


def _model_sums(batches):
    """``at, n``: training words by class, then types by spelling, then those met once."""
    for row in _single_rows(batches):
        c, shapes = _numbers(row, "counts", "<i8"), _shapes(_words(row))
        per_class = np.zeros(CLASSES, np.int64)
        np.add.at(per_class, _numbers(row, "kinds", "i1"), c)
        n = np.concatenate([per_class, np.bincount(shapes, minlength=SHAPES), np.bincount(shapes[c == 1], minlength=SHAPES)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["at", "n"])


# --- texts in classes -----------------------------------------------------------------


def _kinds_of(core: pa.BinaryArray, blocks: int, core_count: np.ndarray, classes: np.ndarray, log_types: np.ndarray, end_count: int, log_total: float):
    """Turns a chunk's tokens into classes (plus ONCE times 1 + its spelling
    for a word met once in training) and adds up what needs words' own counts."""
    def code(batches):
        size = len(core)
        for row in _single_rows(batches):
            listed = _words(row)
            codes = _codes(listed, core)
            inside = codes < size
            counts, kind = np.zeros(len(codes)), classes[codes]
            counts[inside] = core_count[codes[inside]]
            found = row["found"][0]
            if found.is_valid:
                at, _ = _in_blocks(listed, codes, size, blocks)
                order = pc.sort_indices(found.values.field("block"))
                c, k = (_flat(found.values.field(name).take(order))[0].view(width) for name, width in (("counts", "<i8"), ("kinds", "i1")))
                counts[at] = c
                kind[at[c > 0]] = k[c > 0]  # words of held-out texts alone keep their spelling
            seen = counts > 0
            emission = np.empty(len(codes))
            emission[seen] = np.log10(counts[seen])
            emission[~seen] = -log_types[kind[~seen] - CLASSES]
            once = np.flatnonzero(counts == 1)
            kind[once] += ONCE * (1 + _shapes(listed.take(pa.array(once))))
            seq, n = _tokens(row)
            sums = lambda x, end: np.add.reduceat(np.append(x, end)[seq], np.cumsum(n) - n)  # noqa: B023, E731
            base = sums(np.log10(counts + 1), np.log10(end_count + 1)) - n * log_total
            known = sums(seen.astype(np.int64), int(end_count > 0))
            lists = [pa.array([x], pa.list_(t)) for x, t in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (sums(emission, np.log10(max(end_count, 1))), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [row["ids"], row["held"], pa.array([np.append(kind, END)[seq].astype("<u2").tobytes()], pa.binary()), *lists],
                names=["ids", "held", "kinds", "n", "known", "base", "emission"],
            )

    return code


def _transitions(batches):
    """Class bigrams of a task's training documents.  A word met once would be
    an unseen one without its own place, so it counts by its spelling."""
    total = np.zeros(KINDS * KINDS, np.int64)
    for row in _single_rows(batches):
        codes = np.frombuffer(row["kinds"][0].as_py(), "<u2").astype(np.int64)
        train = np.repeat(~row["held"][0].values.to_numpy(zero_copy_only=False), row["n"][0].values.to_numpy())
        now = np.where(codes < ONCE, codes, CLASSES + codes // ONCE - 1)
        total += np.bincount((np.append(END, now[:-1]) * KINDS + now)[train], minlength=KINDS * KINDS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])


# --- the operator ---------------------------------------------------------------------


def class_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity``.

    Tokens are the lower-cased (A-Z) words and one end of text.  Rows whose
    crc32 of the id as text leaves 2 modulo 7 are held out; a null id counts
    as an empty text (training).  ``base_score`` is the add-one unigram
    model's log10 probability, ``score`` the class model's.  A null or empty
    text is the end alone; repeated rows count each time; with no training
    rows every count is zero; other columns are not read.

    Words met once in training stand in for words never met (Good and
    Turing): a class by spelling follows another class as often as they do,
    and its probability is shared evenly by one word more than were met.
    """
    return fit(docs, id_col, text_col, core, tolerance)[0]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """:func:`class_lm`'s rows and the model's words: ``word, c, kind``."""
    spark = docs.sparkSession
    ready(spark)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sizes = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held"), 1))).first()
    total_bytes, end_count = sizes[0] or 0, sizes[1]

    # Chunks bucketed by their number: what is found for them joins without moving them.
    tasks = bucket_count(spark, total_bytes, BUCKET)
    schema = f"chunk long, ids array<{id_type}>, held array<boolean>, ends array<long>, tokens binary, words binary, lengths binary, train binary, total long"
    chunks = _bucketed(rows.mapInArrow(_number_words, schema), "words", tasks, "chunk")

    n_words = chunks.agg(F.sum("total")).first()[0] or 0
    top = _core_counts(chunks, core, n_words).orderBy(F.desc("c"), "word").toArrow()
    core_words = pa.concat_arrays([*top["word"].chunks, pa.array([], pa.binary())])
    core_count = top["c"].to_numpy().astype(float)
    size = len(core_words)

    # They start in classes by rank; then passes of exchange until it rests.
    coded = stored(chunks.select("held", "ends", "tokens", "words", "lengths").mapInArrow(_core_coder(core_words), "held array<boolean>, n array<long>, codes binary"), "coded")
    now = np.concatenate([np.arange(size) % CLASSES, CLASSES + np.arange(SHAPES + 1)])
    classes, bigram, best = now, np.zeros((KINDS, KINDS)), -np.inf
    while True:
        counts = _gather(coded, now, KINDS)
        m = _matrix(counts[0], now, KINDS)
        value = likelihood(m)
        rests = value <= best + tolerance * (n_words + end_count)
        if value > best:
            classes, bigram, best = now, m, value
        if rests:
            break
        now, moves = exchange(*counts, now, size, KINDS)
        if not moves:
            break

    # All other words, with their places, by word; each is inserted once and
    # joined back to its chunks.
    blocks = max(tasks, -(-total_bytes // BUCKET))
    places = chunks.select("chunk", "held", "ends", "tokens", "words", "lengths").mapInArrow(
        _places(core_words, classes, blocks), "chunk long, block int, words binary, lengths binary, n binary, near binary"
    ).withColumn("part", F.col("block") % tasks)
    schema = "chunk long, block int, words binary, lengths binary, counts binary, kinds binary"
    inserted = stored(places.repartitionById(tasks, "part").groupBy("part", "block").applyInArrow(_insert(bigram), schema), "inserted")
    model = inserted.where("chunk is null").select("words", "lengths", "counts", "kinds")
    back = (
        inserted.where("chunk is not null")
        .select(F.col("chunk").alias("to"), F.struct("block", "counts", "kinds").alias("piece"))
        .repartition(tasks, "to")
        .groupBy("to")
        .agg(F.collect_list("piece").alias("found"))
    )

    # Emissions and the share of unseen words.
    sums = np.zeros(CLASSES + 2 * SHAPES)
    for r in model.mapInArrow(_model_sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    in_class = np.bincount(classes[:size], core_count, minlength=KINDS).astype(float)
    in_class[:CLASSES] += sums[:CLASSES]
    types, once = sums[CLASSES:].reshape(2, SHAPES)
    core_shapes = _shapes(core_words)
    types += np.bincount(core_shapes, minlength=SHAPES)
    once += np.bincount(core_shapes[core_count == 1], minlength=SHAPES)
    n_total, n_types = n_words + end_count, int(types.sum()) + (end_count > 0)
    unseen = (once.sum() + 1) / (n_total + 2) * (once + 1) / (once.sum() + SHAPES)

    coder = _kinds_of(core_words, blocks, core_count, classes, np.log10(types + 1), end_count, float(np.log10(n_total + n_types + 1)))
    texts = stored(
        chunks.select("chunk", "ids", "held", "ends", "tokens", "words", "lengths")
        .join(back.hint("shuffle_hash"), F.col("chunk") == F.col("to"), "left")
        .drop("to", "chunk")
        .mapInArrow(coder, f"ids array<{id_type}>, held array<boolean>, kinds binary, n array<long>, known array<long>, base array<double>, emission array<double>"),
        "texts",
    )

    final = np.zeros(KINDS * KINDS)
    for r in texts.select("held", "kinds", "n").mapInArrow(_transitions, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        final[r["at"]] = r["n"]
    in_class[END] = end_count
    transition = transitions(final.reshape(KINDS, KINDS), unseen, np.maximum(in_class, 1), max(n_total, 1))

    def score(batches):
        for row in _single_rows(batches):
            kind = np.frombuffer(row["kinds"][0].as_py(), "<u2") % ONCE
            n = row["n"][0].values.to_numpy()
            logs = transition[np.append(np.uint16(END), kind[:-1]), kind]
            total = np.add.reduceat(logs, np.cumsum(n) - n) + row["emission"][0].values.to_numpy()
            columns = [row["ids"][0].values, row["held"][0].values, row["n"][0].values, row["known"][0].values]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([n_total] * len(n), pa.int64()), row["base"][0].values, pa.array(total), pa.array(10 ** (-total / n))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    scored = texts.mapInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )
    top = top.append_column("kind", pa.array(classes[:size].astype(np.int8)))
    words = model.mapInArrow(_model_words, "word binary, c long, kind tinyint")
    return scored, words.unionByName(spark.createDataFrame(top, words.schema))


def transitions(bigram: np.ndarray, unseen: np.ndarray, in_class: np.ndarray, total: int) -> np.ndarray:
    """log10 probability of the next class: into the classes by spelling as
    often as words met once follow, smoothed towards their overall share
    ``unseen``; the rest into learned classes and the end, smoothed towards
    their frequency, divided by the class's tokens and mixed with the words'
    own frequency (times a word's count it is the word's probability)."""
    open_ = np.r_[0:CLASSES, END]
    share = bigram[open_][:, open_].sum(0) + 1
    seen = bigram[:, open_].sum(1, keepdims=True)
    new = (bigram[:, CLASSES:END] + KINDS * unseen) / (bigram.sum(1, keepdims=True) + KINDS)
    out = np.zeros((KINDS, KINDS))
    out[:, CLASSES:END] = np.log10(new)
    step = (bigram[:, open_] + KINDS * share / share.sum()) / (seen + KINDS)
    words = (1 - UNIGRAM) * step / in_class[open_] + UNIGRAM / total
    out[:, open_] = np.log10(words) + np.log10(1 - new.sum(1, keepdims=True))
    return out


def _bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """Cut lineage: a table in the shared folder, bucketed by a column."""
    spark = df.sparkSession
    name = f"ledgerline_{name}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerline-llm/{name}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name)


# --- registered query -----------------------------------------------------------------


def query(spark, sf_dir):
    from ledgerline.llm.common import documents

    return class_lm(documents(spark, sf_dir))
