"""Token counts against the tokenizer library itself."""

import random

import pytest
from odd_rows import ODD

from ledgerline.llm import token_count as T
from ledgerline.llm.queries import QUERIES

SIGNS = [
    "don't you've 'really we'll '''s !'s a'b 'rx 'r 'v 'l' 'le 'd'm", "<|endoftext|>a<|startoftext|>b<|x|>", "ÀÉé İstanbul ΣΑΣ ς ½ ² ٣ 你好世界",
    "　x\xa0y\x85z \x1c\x1d\x0bq\x0c", "😂" * 100, "’s it’s", "é́ ́a", "한국어 각", "12345 1a2b", "_" * 77, "ﬁ ① Ⅳ ª º", "", "'",
]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def count(path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


def test_query(spark, sf, documents, count):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, sf).collect()}
    want = {i: (len((t or "").encode()), count(t)) for i, t in documents}
    assert got == {i: (b, n, n > 2048) for i, (b, n) in want.items()}


@pytest.mark.parametrize("chunk", [T.CHUNK, 700])
def test_odd_rows(odd, empty, path, count, chunk):
    """Also with texts of over 700 characters cut into chunks."""
    got = T.count_tokens(odd, path, chunk=chunk, reach=100).collect()
    want = [(i, len((t or "").encode()), count(t), count(t) > 2048) for i, t, _ in ODD]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert T.count_tokens(empty, path, chunk=chunk).count() == 0


def test_signs(path, count):
    machine = T.transducer(path)
    for text in SIGNS:
        assert machine.count(text.encode()) == count(text), text


def test_chunk_maps_compose(path, count):
    """Words longer than a chunk, at random: composed maps and runs in turn
    equal the library; a missing state shows as a missing entry."""
    machine, rng = T.transducer(path), random.Random(3)
    makers = [
        lambda: "".join(rng.choice("abcdefghij") for _ in range(9000)),
        lambda: "a" * rng.randint(5000, 9000),
        lambda: "".join(rng.choice("你好世界中国的人") for _ in range(4000)),
        lambda: "".join(rng.choice(["<|endoftext|>", "abc", "'s", "'", "!!", " ", "😂", "\n"]) for _ in range(3000)),
        lambda: "".join(chr(rng.randrange(33, 0x3000)) for _ in range(4000)),
    ]
    composed = 0
    for trial in range(25):
        text = makers[trial % len(makers)]()
        parts = list(T.chunks(text, rng.choice([500, 1000, 3000]), 64))
        assert "".join(p[0] for p in parts) == text
        want = count(text)
        whole = T.scan([machine.chunk_map(t, [T.START] if c is None else machine.guesses(c), closed) for t, c, closed in parts])
        if T.START in whole:
            composed += 1
            assert whole[T.START][1] == want
        state, total = T.START, 0
        for t, _, closed in parts:
            ((state, n),) = machine.chunk_map(t, [state], closed).values()
            total += n
        assert total == want
    assert composed >= 15


def test_wrong_guesses_are_counted_in_turn(spark, path, count, monkeypatch):
    """With no usable guess every long word falls back to the exact run."""
    texts = ["abcdefghij" * 500, "x " * 900, "token " * 400 + "y" * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(T, "GUESSES", 0)
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(frame, path, chunk=600, reach=50).collect()}
    assert got == {i: count(t) for i, t in enumerate(texts)}


def test_memory_is_emptied(path, count, monkeypatch):
    machine = T.Transducer(path)
    monkeypatch.setattr(T, "REMEMBERED", 50)
    monkeypatch.setattr(T, "WORD_BYTES", 1000)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(400))
    assert machine.count(text.encode()) == count(text)
    assert len(machine.words) < 60 and len(machine.steps) < 200
