"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_secrets(text: str | None):
    text = text or ""
    found = []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    key += "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    counts = Counter(f[3] for f in found)
    return (counts["assign"], counts["access"], counts["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found)))


def quality_base(text: str | None):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def simhash_fp(text: str | None, width: int = 3) -> int:
    import xxhash

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps: dict, limit: int = 3) -> dict:
    """{id: smallest id reachable} for {id: fingerprint}, from all pairs."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def check_pieces(pieces, ids_of: dict, window: int = 4096) -> int:
    """Asserts the packing contract for rows of pieces; returns the padding."""
    import zlib
    from collections import defaultdict

    import numpy as np

    at, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = ids_of[p["doc_id"]]
        assert p["doc_tokens"] == len(ids)
        part = ids[p["start"] : p["start"] + p["length"]]
        assert p["length"] == len(part) > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(at) == set(ids_of)
    for doc, parts in at.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == len(ids_of[doc])
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding


def maximal_chats(turns) -> dict:
    """{conv_id: (number of turns, number of equal conversations)}."""
    by: dict = {}
    for t in turns:
        by.setdefault(t["conv_id"], []).append((t["turn"], t["role"], t["text"]))
    convs = {k: tuple((r, x) for _, r, x in sorted(v)) for k, v in by.items()}
    whole: dict = {}
    for k in sorted(convs):
        whole.setdefault(convs[k], []).append(k)
    proper = {c[:n] for c in whole for n in range(1, len(c))}
    return {ks[0]: (len(c), len(ks)) for c, ks in whole.items() if c not in proper}


def repeated_spans(texts: list[str | None], length: int = 200) -> list[list[tuple[int, int]]]:
    """Maximal covered runs of each text, from a dictionary of all strings."""
    datas = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        spans: list[tuple[int, int]] = []
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        out.append(spans)
    return out


def unigram(docs) -> dict:
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    import math
    import zlib

    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = Counter(x for d, ts in tokens.items() if not held[d] for x in ts)
    n, v = sum(count.values()), len(count)
    return {
        d: (held[d], len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts))
        for d, ts in tokens.items()
    }


# --- class language model


def class_scores(split, train, model):
    """log10 probability of each text by plain counting over ``train``."""
    from ledgerline.llm.class_lm import CLASSES, KINDS, SHAPES, UNIGRAM, shape

    end = KINDS - 1
    pairs, in_class, once, types = Counter(), Counter(), [0] * SHAPES, [0] * SHAPES
    for w, (c, k) in model.items():
        in_class[k] += c
        types[shape(w)] += 1
        once[shape(w)] += c == 1
    for words in train:
        kinds = [end, *[model[w][1] if model[w][0] > 1 else CLASSES + shape(w) for w in words], end]
        pairs.update(zip(kinds, kinds[1:]))
    n = sum(map(len, train)) + len(train)
    share = [(sum(once) + 1) / (n + 2) * (x + 1) / (sum(once) + SHAPES) for x in once]
    goals = [*range(CLASSES), end]
    out = {a: sum(pairs[a, k] for k in goals) for a in range(KINDS)}
    into = {k: sum(pairs[a, k] for a in goals) + 1 for k in goals}
    new = {(a, s): (pairs[a, CLASSES + s] + KINDS * share[s]) / (sum(pairs[a, k] for k in range(KINDS)) + KINDS) for a in range(KINDS) for s in range(SHAPES)}
    old = {a: 1 - sum(new[a, s] for s in range(SHAPES)) for a in range(KINDS)}
    step = lambda a, k: (pairs[a, k] + KINDS * into[k] / sum(into.values())) / (out[a] + KINDS)
    in_class[end] = len(train)
    word = lambda a, k, c: math.log10(old[a] * ((1 - UNIGRAM) * step(a, k) * c / in_class[k] + UNIGRAM * c / n))

    def score(words):
        total, before = 0.0, end
        for w in words:
            if w in model:
                c, k = model[w]
                total += word(before, k, c)
            else:
                k = CLASSES + shape(w)
                total += math.log10(new[before, shape(w)] / (types[shape(w)] + 1))
            before = k
        return total + word(before, end, len(train))

    return {i: score(words) for i, words in split.items()}


def insertion_values(word, train, kind):
    """Likelihood of the class bigrams with ``word``'s neighbours' counts
    moved into each class, the word's other places as they were."""
    from ledgerline.llm.class_lm import CLASSES, KINDS

    end = KINDS - 1
    pairs, near = Counter(), []
    for words in train:
        kinds = [end, *map(kind, words), end]
        pairs.update(zip(kinds, kinds[1:]))
        near += [(kinds[k], kinds[k + 2]) for k, w in enumerate(words) if w == word]
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    values = []
    for c in range(CLASSES):
        moved = pairs.copy()
        for a, b in near:
            moved[a, c] += 1
            moved[c, b] += 1
        rows, cols = Counter(), Counter()
        for (a, b), k in moved.items():
            if a == c:
                rows[a] += k
            if b == c:
                cols[b] += k
        before_rows = sum(k for (a, _), k in pairs.items() if a == c)
        before_cols = sum(k for (_, b), k in pairs.items() if b == c)
        gain = sum(f(k) - f(pairs[p]) for p, k in moved.items())
        values.append(gain - f(rows[c]) + f(before_rows) - f(cols[c]) + f(before_cols))
    return values
