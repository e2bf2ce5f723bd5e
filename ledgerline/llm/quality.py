"""Quality rules with a modified Kneser-Ney character model.

Base rules look at one document.  The model then judges how ordinary the
text's spelling is for its language: Spark counts all character 4-grams of
the corpus' distinct texts per language, the smoothed log probability of every seen n-gram
is kept in sorted hash arrays, and documents whose perplexity lies outside a
band taken from their language's own distribution are rejected.

Characters are folded to 64 symbols, so a language has at most 64**4 =
16,777,216 distinct 4-grams at 8 bytes each whatever the corpus holds: that
is the proven bound of the broadcast model (some 100,000 occur in practice).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ready, stored

ORDER = 4
SYMBOLS = 64
#: Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOL_CHARS = "#*$%&|<>"
#: A band reaches this many median absolute deviations to either side of the
#: language's median log perplexity; a deviation counts as LEAST_SPREAD at least.
#: The usual rule for outliers: a modified z-score (0.6745 deviations) of 3.5.
BAND = 3.5 / 0.6745
LEAST_SPREAD = 0.016
#: A text of n symbols may lie this / sqrt(n) further out: short texts vary more.
SHORT_TEXT = 1.0
#: A document's perplexity is the median over its segments of so many symbols.
#: A rejected document must also have three quarters of its segments beyond
#: INNER of the band, so that a quoted passage in another language does not
#: decide it.
SEGMENT = 256
INNER = 0.7
#: Log perplexities are read off histograms of this bin width.
BIN = 0.001
#: Codes gathered before they are sorted and merged into a task's counts.
FLUSH = 4_000_000
#: Language tags are folded to their first two or three letters (the bound on
#: the number of models); anything else is one language, "und".
LANG = r"^([a-z]{2,3})(?:[-_].*)?$"


def _symbols() -> np.ndarray:
    """Symbol of each byte of lower-cased text: 0 only pads, 1 space, 2-27
    letters, 28 digits, 29 sentence marks, 30 SYMBOL_CHARS, 31 other ASCII,
    32-63 bytes of non-ASCII characters by their low five bits.  SYMBOL_CHARS
    share one: apart, the model learns each sign's habits and misses more."""
    table = np.full(256, 31, np.uint32)
    table[ord(" ")] = 1
    table[ord("a") : ord("z") + 1] = np.arange(2, 28)
    table[ord("0") : ord("9") + 1] = 28
    for c in ".,;:!?'\"()-":
        table[ord(c)] = 29
    for c in SYMBOL_CHARS:
        table[ord(c)] = 30
    table[128:] = 32 + (np.arange(128) & 31)
    return table


TABLE = _symbols()


def codes_of(words: list[bytes]) -> np.ndarray:
    """4-gram codes of words joined by one space, one code per symbol (the
    first ones with padding before them)."""
    data = np.frombuffer(b" ".join(words).lower(), np.uint8)
    s = np.zeros(len(data) + ORDER - 1, np.uint32)
    s[ORDER - 1 :] = TABLE[data]
    code = s[: len(data)].copy()
    for k in range(1, ORDER):
        code *= SYMBOLS
        code += s[k : len(data) + k]
    return code


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = defaultdict(lambda: len(ids))
    seq = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    name, size = seq[:n], len(ids)
    for k in range(1, width):  # exact names: renumber before a product could overflow
        if size >= 2**62 // len(ids):
            name = np.unique(name, return_inverse=True)[1]
            size = int(name.max()) + 1
        name = name * len(ids) + seq[k : n + k]
        size *= len(ids)
    order = np.argsort(name, kind="stable")
    sorted_ = name[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_of(text: str, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = Counter(x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOL_CHARS)), sum(lines.values()) - len(lines), repeated, failed


# --- counting -------------------------------------------------------------------


def _count(batches):
    """Per task: the 4-gram counts of each language."""
    have: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = defaultdict(list)
    size: Counter = Counter()

    def merge(lang):
        code = np.concatenate(waiting.pop(lang))
        code.sort()
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, count = code[first], np.diff(np.append(first, len(code)))
        if lang in have:
            old, n = have[lang]
            both = np.concatenate([old, code])
            code, inverse = np.unique(both, return_inverse=True)
            count = np.bincount(inverse, np.concatenate([n, count])).astype(np.int64)
        have[lang], size[lang] = (code, count), 0

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            words = (text.as_py() or "").encode().split()
            if words:
                waiting[lang].append(code := codes_of(words))
                size[lang] += len(code)
                if size[lang] >= FLUSH:
                    merge(lang)
    for lang in list(waiting):
        merge(lang)
    for lang, (code, count) in have.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(count.astype(np.int64))],
            names=["lang", "code", "n"],
        )


def count_ngrams(rows: DataFrame) -> DataFrame:
    """``lang, code, n`` over all rows of ``(lang, text)``."""
    return rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


# --- model ----------------------------------------------------------------------


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts by count 0, 1, 2 and 3 or more."""
    n = [int((counts == k).sum()) for k in range(1, 5)]
    if min(n[:3]) == 0:  # too few n-grams for the estimates
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0] + [min(max(d[k], 0.1), k - 0.05) for k in (1, 2, 3)])


class Model:
    """Sorted n-gram hashes of orders 1..4 with interpolated probabilities,
    and the back-off weight of every seen context.  The code of an n-gram is
    its hash; it has no collisions."""

    def __init__(self, code: np.ndarray, count: np.ndarray) -> None:
        grams, counts = [np.asarray(code, np.int64)], [np.asarray(count, np.float64)]
        for k in range(ORDER - 1, 0, -1):  # lower orders count distinct symbols to the left
            suffix = grams[0] % SYMBOLS**k
            g, c = np.unique(suffix, return_counts=True)
            grams.insert(0, g)
            counts.insert(0, c.astype(np.float64))
        lower, self.grams, self.probs, self.contexts, self.backoff = None, [], [], [], []
        for g, c in zip(grams, counts, strict=True):
            d = _discounts(c)[np.minimum(c, 3).astype(int)]
            context, inverse = np.unique(g // SYMBOLS, return_inverse=True)
            total, off = np.bincount(inverse, c), np.bincount(inverse, d)
            backoff = off / total
            below = 1 / SYMBOLS if lower is None else lower(g)
            p = (c - d) / total[inverse] + backoff[inverse] * below
            self.grams.append(g.astype(np.uint32))
            self.probs.append(p.astype(np.float64))
            self.contexts.append(context.astype(np.uint32))
            self.backoff.append(backoff)
            k = len(self.grams)
            lower = lambda g, k=k: self.prob(g % SYMBOLS**k, k)
        self.logs = np.log(self.probs[-1])

    def prob(self, code: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Probability of the last symbol of k-grams given those before it."""
        if k == 0:
            return np.full(len(code), 1 / SYMBOLS)
        at, seen = _find(self.grams[k - 1], code)
        p = self.probs[k - 1][at]
        if not seen.all():
            new = code[~seen]
            at, known = _find(self.contexts[k - 1], new // SYMBOLS)
            p[~seen] = np.where(known, self.backoff[k - 1][at], 1.0) * self.prob(new % SYMBOLS ** (k - 1), k - 1)
        return p

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of a text's symbols."""
        at, seen = _find(self.grams[-1], code)
        logs = self.logs[at]
        if not seen.all():
            logs[~seen] = np.log(self.prob(code[~seen]))
        return logs

    def log_perplexity(self, code: np.ndarray) -> tuple[float, float, float]:
        """Median, lower and upper quartile of the log perplexities of the
        text's segments (a last one of under half a segment is joined to the
        one before it)."""
        starts = np.arange(0, max(len(code) - SEGMENT // 2, 1), SEGMENT)
        sizes = np.diff(np.append(starts, len(code)))
        each = -np.add.reduceat(self.log_prob(code), starts) / sizes
        return tuple(np.quantile(each, (0.5, 0.25, 0.75)).tolist())


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, wanted.astype(sorted_.dtype, copy=False))
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == wanted


def fit(counts: DataFrame) -> dict[str, Model]:
    """Models by language from Spark's counts (bounded: see the module's head)."""
    table = counts.toArrow()
    lang, code, n = table["lang"].to_numpy(), table["code"].to_numpy(), table["n"].to_numpy()
    out = {}
    for name in sorted(set(lang)):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(code[own])]
        out[name] = Model(code[own], n[own])
    return out


# --- scoring --------------------------------------------------------------------

_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ppl double, low_ppl double, high_ppl double, n_letters long"


def _scorer(models):
    def score(batches):
        by_lang = models.value
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                words = text.encode().split()
                code = codes_of(words) if words else ()
                out.append((*base_of(text, words), *(by_lang[lang].log_perplexity(code) if len(code) else [None] * 3), len(code)))
            figures = [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.bool_(), *[pa.float64()] * 3, pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["lang"], batch["digest"], *figures],
                names=["doc_id", "lang", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "low_ppl", "high_ppl", "n_letters"],
            )

    return score


def _weighted_median(rows: DataFrame, value: str) -> DataFrame:
    """``lang, m``: the median of ``value`` weighted by ``n``, per language."""
    upto = Window.partitionBy("lang").orderBy(value)
    half = rows.withColumn("half", F.sum("n").over(upto) * 2 >= F.sum("n").over(Window.partitionBy("lang")))
    return half.where("half").groupBy("lang").agg(F.min(value).alias("m"))


def bands(scored: DataFrame, band: float = BAND) -> DataFrame:
    """``b_lang, least, most``: limits of log perplexity around the median of
    each language's distinct texts that pass the base rules.  A group of
    copies counts once; median and deviation stand up to near copies of less
    than half of the texts.  Both are exact on a histogram, whose size is
    bounded by the range of log perplexity."""
    bins = (
        scored.where("not base_failed and log_ppl is not null")
        .dropDuplicates(["lang", "digest"])
        .groupBy("lang", F.round(F.col("log_ppl") / BIN).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    middle = _weighted_median(bins, "bin")
    away = bins.join(middle, "lang").withColumn("away", F.abs(F.col("bin") - F.col("m"))).drop("m")
    spread = _weighted_median(away, "away").select(F.col("lang").alias("b_lang"), F.col("m").alias("spread"))
    reach = F.greatest(F.col("spread") * BIN, F.lit(LEAST_SPREAD)) * band
    centre = F.col("m") * BIN
    return middle.join(spread, F.col("lang") == F.col("b_lang")).select("b_lang", (centre - reach).alias("least"), (centre + reach).alias("most"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", band: float = BAND) -> DataFrame:
    """One row per input row: ``doc_id, lang, digest``, the base figures,
    ``base_failed``, ``log_ppl`` (natural log of the perplexity per symbol,
    the median of the segments; ``low_ppl`` and ``high_ppl`` their quartiles),
    the language's ``least`` and ``most`` and ``kept``.

    A null text has no words (and fails the base rules); a null or odd
    language tag counts as "und"; null ids and repeated rows are judged row
    by row; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    text = F.col(text_col).cast("string")
    lang = F.regexp_extract(F.lower(F.coalesce(F.col(lang_col).cast("string"), F.lit(""))), LANG, 1)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(lang == "", "und").otherwise(lang).alias("lang"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"),
        text.alias("text"),
    )
    # Copies of a text, however many, count once in the model as in the bands.
    # Each task of the scan drops its own copies before the shuffle.
    distinct = rows.select("lang", "digest", "text").dropDuplicates(["lang", "digest"])
    models = spark.sparkContext.broadcast(fit(count_ngrams(distinct.select("lang", "text"))))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = stored(rows.mapInArrow(_scorer(models), f"doc_id {id_type}, lang string, digest long, {_FIGURES}"), "quality")
    limits = bands(scored, band)
    more = F.lit(SHORT_TEXT) / F.sqrt(F.greatest("n_letters", F.lit(1)))
    shift = (F.col("most") - F.col("least")) / 2 * (1 - INNER)
    below = (F.col("log_ppl") < F.col("least") - more) & (F.col("high_ppl") < F.col("least") + shift - more)
    above = (F.col("log_ppl") > F.col("most") + more) & (F.col("low_ppl") > F.col("most") - shift + more)
    inside = F.coalesce(~(below | above), F.lit(True))
    # One row of limits per language: languages are bounded by their tags' form.
    return (
        scored.join(F.broadcast(limits), scored["lang"] == limits["b_lang"], "left")
        .drop("b_lang")
        .withColumn("kept", ~F.col("base_failed") & inside)
    )


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all columns.
    Rows with equal id, text and language get equal verdicts."""
    verdict = quality(docs, id_col, text_col, lang_col).where("not kept").select(
        F.col("doc_id").alias("v_id"), F.col("digest").alias("v_digest"), F.col("lang").alias("v_lang")
    )
    lang = F.regexp_extract(F.lower(F.coalesce(F.col(f"doc.{lang_col}").cast("string"), F.lit(""))), LANG, 1)
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc",
        F.col(f"doc.{id_col}").alias("id"),
        F.xxhash64(F.coalesce(F.col(f"doc.{text_col}").cast("string"), F.lit(""))).alias("digest"),
        F.when(lang == "", "und").otherwise(lang).alias("lang"),
    )
    on = rows["id"].eqNullSafe(verdict["v_id"]) & (rows["digest"] == verdict["v_digest"]) & (rows["lang"] == verdict["v_lang"])
    return rows.join(verdict, on, "left_anti").select("doc.*")


# --- registered query -----------------------------------------------------------


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.common import documents

    found = quality(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang",
        F.exp("log_ppl").alias("perplexity"), F.exp("least").alias("least_perplexity"), F.exp("most").alias("most_perplexity"),
    )
