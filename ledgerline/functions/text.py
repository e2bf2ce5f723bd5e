"""Text column helpers: label cleaning, narrative rules, redaction, search.

Regexes run in the JVM (``java.util.regex``).  Character classes are spelled
out so that they mean what Python's Unicode-aware ``re`` means: ``\\w`` is
letters, numbers and underscore; ``\\s`` is every character ``str.isspace``
accepts; ``\\b`` is a change between those word and non-word classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values that must equal the reference's --------------------------
# Unicode space separators (category Zs) removed by the label trim.
ZS_CHARS = "".join(
    chr(cp) for cp in [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
)
# Characters Python treats as whitespace when splitting text.
SPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# Redaction rules, applied in this order: e-mail, link, long number.
EMAIL_RE = rf"{BOUNDARY}[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}{BOUNDARY}"
LINK_RE = rf"https?://[^\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+"
NUMBER_RE = r"(?<![\p{L}\p{N}_])(?:\+?\p{Nd}[\p{Nd} ().-]{6,}\p{Nd})(?![\p{L}\p{N}_])"
EMAIL_TOKEN, LINK_TOKEN, NUMBER_TOKEN = "[email]", "[link]", "[number]"
# --- end of fixed values ----------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zs_trim(c: Column | str) -> Column:
    """Trim Unicode space separators from both ends (not tabs or newlines)."""
    return F.trim(_col(c), F.lit(ZS_CHARS))


def clean_label(c: Column | str) -> Column:
    """Trim; an empty result becomes NULL (``nullif(trim(x), '')``)."""
    return F.nullif(zs_trim(c), F.lit(""))


def nonblank(c: Column | str) -> Column:
    """True when the text has a non-space character (``length(trim(x)) > 0``)."""
    return F.length(zs_trim(c)) > 0


def narrative_or_null(c: Column | str) -> Column:
    """Blank or space-only narrative -> NULL; otherwise the text verbatim."""
    c = _col(c)
    return F.when(F.coalesce(zs_trim(c), F.lit("")) != F.lit(""), c)


def yes_no(c: Column | str) -> Column:
    """Exact 'Yes' -> true, 'No' -> false, anything else -> NULL."""
    c = _col(c)
    return F.when(c == F.lit("Yes"), F.lit(True)).when(c == F.lit("No"), F.lit(False))


def redact(c: Column | str) -> Column:
    """Mask e-mails, links and long numbers, then collapse whitespace.

    Each rule runs only on texts that can match it (an '@', 'http', a
    digit): the cheap guards skip the look-around scans on most rows and
    leave the result unchanged."""
    text = _col(c)
    out = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL_RE, EMAIL_TOKEN)).otherwise(text)
    out = F.when(F.contains(out, F.lit("http")), F.regexp_replace(out, LINK_RE, LINK_TOKEN)).otherwise(out)
    out = F.when(
        F.regexp_like(out, F.lit(r"\p{Nd}")), F.regexp_replace(out, NUMBER_RE, NUMBER_TOKEN)
    ).otherwise(out)
    return F.trim(F.regexp_replace(out, SPACE_CLASS + "+", " "))


def excerpt(c: Column | str, limit: int = 2000) -> tuple[Column, Column]:
    """First ``limit`` characters and whether the text was longer."""
    c = _col(c)
    return F.left(c, F.lit(limit)), F.length(c) > F.lit(limit)


def contains_ci(c: Column | str, phrase: str) -> Column:
    """Literal, case-insensitive substring test (no regex semantics)."""
    return F.contains(F.lower(_col(c)), F.lower(F.lit(phrase)))


def whole_word_match(c: Column | str, term: Column | str) -> Column:
    """Case-insensitive whole-word match of a literal ``term`` inside ``c``.

    ``term`` may be a column, so one expression serves a join of texts with
    per-topic term lists.
    """
    term = F.lit(term) if isinstance(term, str) else term
    pattern = F.concat(
        F.lit("(?iu)" + BOUNDARY + r"\Q"),
        F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
        F.lit(r"\E" + BOUNDARY),
    )
    return F.regexp_like(_col(c), pattern)
