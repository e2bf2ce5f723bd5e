"""Odd inputs shared by the tests of the training-data operators."""

LONG = "lorem ipsum dolor " * 3000
COPY = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing " * 4

#: Nulls, empty and very long texts, ties, repeated rows, odd languages.
ODD = [
    (1, None, "en"), (2, "", None), (3, "   \n\t", "en"), (4, "one", "EN-us"), (5, LONG, "en"), (6, COPY, "de"), (7, COPY, "de"),
    (7, COPY, "de"), (8, COPY + "end", "??"), (None, COPY, "en"), (None, "x y z", "en"), (9, "ABC abc ÀÉ " * 30, "fr"),
    (10, "<|endoftext|> a<|endoftext|>　́é  \r\n", "en"), (11, "a" * 5000, "en"),
]
