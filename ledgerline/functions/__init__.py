"""Column-expression helpers: every function takes and returns ``Column``.

They compile to built-in Catalyst expressions, so they stay inside
whole-stage code generation; no Python runs per row.
"""

from ledgerline.functions.dates import (
    bucket,
    calendar_attributes,
    date_key,
    parse_mixed_date,
    shift_months,
)
from ledgerline.functions.display import compact_number, percent_text
from ledgerline.functions.keys import surrogate_key
from ledgerline.functions.text import (
    clean_label,
    contains_ci,
    excerpt,
    nonblank,
    narrative_or_null,
    redact,
    whole_word_match,
    yes_no,
)

__all__ = [
    "bucket",
    "calendar_attributes",
    "clean_label",
    "compact_number",
    "contains_ci",
    "date_key",
    "excerpt",
    "narrative_or_null",
    "nonblank",
    "parse_mixed_date",
    "percent_text",
    "redact",
    "shift_months",
    "surrogate_key",
    "whole_word_match",
    "yes_no",
]
