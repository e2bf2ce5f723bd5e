"""Representative-quote selection and review questions as column expressions.

The quote rule runs with higher-order array functions (split -> transform ->
filter -> array_max), so it is evaluated inside the JVM per row, with no
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import BOUNDARY, SPACE_CLASS

# --- Fixed values that must equal the reference's --------------------------
QUOTE_MIN_CHARS, QUOTE_MAX_CHARS, QUOTE_MAX_MASKS, FALLBACK_CHARS = 40, 420, 5, 300
CONCERN_STOP_WORDS = ["your", "with", "from", "into", "problem", "information"]
LEGAL_WORDS = r"(section|usc|u\.s\.c|statute)"
ELLIPSIS = "…"
# Review questions: first matching keyword group wins.
REVIEW_QUESTIONS = [
    (["incorrect", "error"],
     "Which information errors recur, and what do customers report about correction attempts?"),
    (["improper use", "identity"],
     "What do customers describe about report access, authorization or identity-related disputes?"),
    (["investigation", "dispute"],
     "Do customers describe repeated disputes, unclear outcomes or difficulty getting a response?"),
    (["payment"],
     "What do customers report about payment processing, fees or account records?"),
    (["collection", "debt"],
     "Which collection contacts or disputed-debt experiences recur in the evidence?"),
]
DEFAULT_QUESTION = "Which repeated customer experiences within this issue warrant a closer process review?"
# --- end of fixed values ----------------------------------------------------

SENTENCE_SPLIT = rf"(?<=[.!?]){SPACE_CLASS}+"
MASK_TOKEN = rf"{BOUNDARY}[xX]{{2,}}{BOUNDARY}"
LEGAL = rf"(?i){BOUNDARY}{LEGAL_WORDS}{BOUNDARY}"


def _words(c: Column) -> Column:
    """Distinct runs of 4+ ASCII lowercase letters of the lowercased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0))


def representative_quote(text: Column, concern: Column) -> Column:
    """A verbatim sentence of 40-420 characters with fewer than 5 masking
    tokens, maximising overlap with the concern's words minus 2 for legal
    boilerplate, earliest on ties; else the first 300 characters (+ '…')."""
    topic = F.array_except(_words(concern), F.array(*[F.lit(w) for w in CONCERN_STOP_WORDS]))
    fallback = F.concat(
        F.left(text, F.lit(FALLBACK_CHARS)),
        F.when(F.length(text) > FALLBACK_CHARS, F.lit(ELLIPSIS)).otherwise(F.lit("")),
    )

    def best(words: Column) -> Column:
        scored = F.transform(
            F.split(text, SENTENCE_SPLIT, -1),
            lambda s, i: F.when(
                F.length(s).between(QUOTE_MIN_CHARS, QUOTE_MAX_CHARS)
                & (F.size(F.regexp_extract_all(s, F.lit(MASK_TOKEN), 0)) < QUOTE_MAX_MASKS),
                F.struct(
                    (F.size(F.array_intersect(_words(s), words)) - F.when(s.rlike(LEGAL), 2).otherwise(0)).alias("score"),
                    (-i).alias("neg_index"),
                    s.alias("sentence"),
                ),
            ),
        )
        return F.array_max(scored)["sentence"]  # NULL entries (not eligible) are skipped

    # A one-element transform binds the concern's words once for all sentences.
    return F.coalesce(F.element_at(F.transform(F.array(topic), best), 1), fallback)


def review_question(concern: Column) -> Column:
    label = F.lower(concern)
    out = None
    for keys, question in REVIEW_QUESTIONS:
        pred = None
        for k in keys:
            p = F.contains(label, F.lit(k))
            pred = p if pred is None else pred | p
        out = F.when(pred, F.lit(question)) if out is None else out.when(pred, F.lit(question))
    return out.otherwise(F.lit(DEFAULT_QUESTION))
