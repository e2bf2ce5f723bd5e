"""Distributed TF-IDF with a bounded vocabulary.

Tokens are maximal runs of word characters made only of ASCII letters (3+)
in the lowercased text, stop words removed, then unigrams and bigrams of
the remaining tokens.  Vocabulary: terms in at least ``min_df`` documents
and at most ``max_df`` of them, the ``max_features`` most frequent in the
corpus (ties by term).  Weights: ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``
then L2-normalised per document.

Words are cut once and stored as one string per document.  A two-word term is
no more frequent than either of its words, so only pairs of words at least as
frequent as the last unigram of a full vocabulary are counted (Apriori), by
number instead of spelling.  Documents meet the vocabulary, whose size is bounded
by ``max_features``, inside tasks: no row per document and term is shuffled.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import shared_table, ship_package

# --- Fixed values that must equal the reference's --------------------------
DOMAIN_STOP_WORDS = [
    "xxxx", "xx", "xxx", "xxxxxxxx", "complaint", "company", "consumer", "please",
    "said", "told", "would", "cfpb", "received", "date",
]
# Spark ML's English list, in its own order.
SPARK_ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
"""
# --- end of fixed values ----------------------------------------------------
#: A run of word characters; group 1 holds it if it is all a-z.
TOKEN = r"([a-z]{3,}+)(?![\p{L}\p{N}_])|[\p{L}\p{N}_]+"
#: Words that a task handles at once, and terms it counts before passing them on.
TASK_WORDS, TASK_TERMS = 1 << 19, 1 << 18
#: Words whose pairs are counted by number; with more of them, by spelling.
NUMBERED_WORDS = 1 << 16
COUNTS = "term string, df long, cf long"


def spark_english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop-word list (equal to
    ``StopWordsRemover.loadDefaultStopWords("english")``; a test compares them)."""
    return tuple(SPARK_ENGLISH.split())


def stop_words() -> list[str]:
    """Spark's English stop-word list plus the domain words."""
    return sorted(set(spark_english_stop_words()) | set(DOMAIN_STOP_WORDS))


@dataclass
class TfIdf:
    rows: DataFrame  # doc_id, indices, data: a document's terms (ascending) and weights; none without terms
    vocabulary: DataFrame  # term_index, term, df, cf (term_index in term order)
    n_docs: int
    n_features: int

    @property
    def weights(self) -> DataFrame:
        """``doc_id, term_index, weight``."""
        cells = self.rows.select("doc_id", F.explode(F.arrays_zip("indices", "data")).alias("cell"))
        return cells.select("doc_id", F.col("cell.indices").alias("term_index"), F.col("cell.data").alias("weight"))


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, kept``: the words of each document, without stop words."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.array_remove(F.regexp_extract_all(text, F.lit(TOKEN), 1), "").alias("tokens"))
    remover = StopWordsRemover(inputCol="tokens", outputCol="kept", stopWords=stop_words(), caseSensitive=True)
    return remover.transform(tokens).select("doc_id", "kept")


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, terms``: the unigram + bigram sequence of each document."""
    pairs = NGram(n=2, inputCol="kept", outputCol="pairs").transform(words(docs, id_col, text_col))
    return pairs.select("doc_id", F.concat("kept", "pairs").alias("terms"))


def fit(
    docs: DataFrame,
    id_col: str = "complaint_id",
    text_col: str = "excerpt",
    min_df: int = 2,
    max_df: float = 0.95,
    max_features: int = 4000,
) -> TfIdf:
    """Vocabulary and weights of ``docs``, one row per ``id_col``."""
    spark = docs.sparkSession
    ship_package(spark)
    stored = shared_table(words(docs, id_col, text_col).select("doc_id", F.array_join("kept", " ").alias("words")), "tfidf-words")
    n_docs = stored.count()
    max_count = max_df * n_docs
    if max_count < min_df:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    few_enough = F.col("df") <= F.lit(max_count)
    order = [F.col("cf").desc(), F.col("term").asc()]
    unigrams = _added(stored.mapInArrow(_counted(False), COUNTS), "term").filter(F.col("df") >= min_df).persist()
    found = unigrams.filter(few_enough).orderBy(*order).limit(max_features).collect()
    # a pair less frequent than the last of a full vocabulary cannot enter it
    least = found[-1]["cf"] if len(found) == max_features else 1
    frequent = sorted(r["term"] for r in unigrams.filter(F.col("cf") >= least).select("term").limit(NUMBERED_WORDS + 1).collect())
    unigrams.unpersist()
    enters = (F.col("df") >= min_df) & few_enough & (F.col("cf") >= least)
    if len(frequent) <= NUMBERED_WORDS:
        codes = _added(stored.mapInArrow(_pairs_counted(_numbers(frequent)), "code long, df long, cf long"), "code")
        pairs = codes.filter(enters).mapInArrow(_spelled(frequent), COUNTS)
    else:
        pairs = _added(stored.mapInArrow(_counted(True), COUNTS), "term").filter(enters)
    found += pairs.orderBy(*order).limit(max_features).collect()
    best = sorted(found, key=lambda r: (-r["cf"], r["term"]))[:max_features]
    rows = [(i, r["term"], r["df"], r["cf"]) for i, r in enumerate(sorted(best, key=lambda r: r["term"]))]
    vocab = spark.createDataFrame(rows, "term_index int, term string, df long, cf long")
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("indices", T.ArrayType(T.IntegerType())),
            T.StructField("data", T.ArrayType(T.DoubleType())),
        ]
    )
    idf = np.log((1.0 + n_docs) / (1.0 + np.array([r[2] for r in rows], dtype=float))) + 1.0
    return TfIdf(stored.mapInArrow(_weighed([r[1] for r in rows], idf), schema), vocab, n_docs, len(rows))


def _added(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _numbers(names: list[str]) -> dict[str, int]:
    return {name: i for i, name in enumerate(names)}


def _counted(pairs: bool):
    """Documents that hold a word (or pair of words) and its places, per stretch
    of documents."""

    def run(batches):
        df, cf = Counter(), Counter()

        def counts():
            out = pa.RecordBatch.from_pydict({"term": list(cf), "df": [df[t] for t in cf], "cf": list(cf.values())}, schema)
            df.clear(), cf.clear()
            return out

        schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("cf", pa.int64())])
        for batch in batches:
            for text in batch["words"]:
                found = text.as_py().split()
                if pairs:
                    found = [f"{a} {b}" for a, b in zip(found, found[1:])]
                cf.update(found)
                df.update(set(found))
                if len(cf) >= TASK_TERMS:
                    yield counts()
        yield counts()

    return run


def _stretches(batches, number: dict[str, int]):
    """Stretches of whole documents of about ``TASK_WORDS`` words: their ids, the
    document of each word (0, 1, ...) and its number, -1 for other words."""
    ids, lengths, found = [], [], []
    for batch in batches:
        kind = batch["doc_id"].type
        for doc, text in zip(batch["doc_id"], batch["words"]):
            here = [number.get(w, -1) for w in text.as_py().split()]
            ids.append(doc.as_py())
            lengths.append(len(here))
            found += here
            if len(found) >= TASK_WORDS:
                yield pa.array(ids, kind), np.repeat(np.arange(len(ids)), lengths), np.array(found, dtype=np.int64)
                ids, lengths, found = [], [], []
    if ids:
        yield pa.array(ids, kind), np.repeat(np.arange(len(ids)), lengths), np.array(found, dtype=np.int64)


def _pair_codes(doc: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The document and code of each pair of neighbours that both have a number."""
    both = (doc[:-1] == doc[1:]) & (word[:-1] >= 0) & (word[1:] >= 0)
    return doc[:-1][both], word[:-1][both] * size + word[1:][both]


def _pairs_counted(number: dict[str, int]):
    def run(batches):
        for _, doc, word in _stretches(batches, number):
            doc, code = _pair_codes(doc, word, len(number))
            order = np.lexsort((doc, code))
            doc, code = doc[order], code[order]
            new = np.ones(len(code), dtype=bool)
            new[1:] = code[1:] != code[:-1]
            first = new.copy()  # of its code in its document
            first[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(new)
            df = np.add.reduceat(first.astype(np.int64), starts) if len(starts) else starts
            yield pa.RecordBatch.from_pydict({"code": code[starts], "df": df, "cf": np.diff(np.append(starts, len(code)))})

    return run


def _spelled(names: list[str]):
    def run(batches):
        for batch in batches:
            spelt = [" ".join(names[k] for k in divmod(c, len(names))) for c in batch["code"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(spelt, pa.string()), batch["df"], batch["cf"]], names=["term", "df", "cf"])

    return run


def _weighed(vocabulary: list[str], idf: np.ndarray):
    """Documents against the vocabulary: ``(1 + ln tf) * idf``, of length 1."""
    number = _numbers(sorted({w for term in vocabulary for w in term.split()}))
    size, n = len(number), len(vocabulary)
    single, codes, indices = np.full(size + 1, -1), [], []  # the last for words without a number
    for i, term in enumerate(vocabulary):
        if " " in term:
            a, b = term.split()
            codes.append(number[a] * size + number[b])
            indices.append(i)
        else:
            single[number[term]] = i
    order = np.argsort(codes)
    codes, indices = np.array(codes, dtype=np.int64)[order], np.array(indices, dtype=np.int64)[order]

    def run(batches):
        for ids, doc, word in _stretches(batches, number):
            pair_doc, code = _pair_codes(doc, word, size)
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            known = codes[at] == code if len(codes) else np.zeros(len(code), dtype=bool)
            term = single[word]
            cells = np.concatenate([doc[term >= 0] * n + term[term >= 0], pair_doc[known] * n + indices[at[known]]])
            cell, tf = np.unique(cells, return_counts=True)
            row, term = cell // max(n, 1), cell % max(n, 1)
            weight = (1.0 + np.log(tf)) * idf[term]
            weight /= np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(ids)))[row]
            lengths = np.bincount(row, minlength=len(ids))
            held = np.flatnonzero(lengths)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths[held])]), pa.int32())
            columns = [ids.take(pa.array(held)), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "indices", "data"])

    return run
