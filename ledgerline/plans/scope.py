"""The shared analytical scope: an inclusive date range plus label lists."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Inclusive ``[start, end]`` on ``date_received``; ``None`` leaves an end
    open, and with both ends open rows without a date belong to the scope too.
    Each non-empty label list restricts its column with ``IN``; an empty list
    keeps every value, NULL labels included."""

    start: dt.date | None = None
    end: dt.date | None = None
    companies: tuple[str, ...] = field(default_factory=tuple)
    products: tuple[str, ...] = field(default_factory=tuple)
    sub_products: tuple[str, ...] = field(default_factory=tuple)

    def predicate(self, date_col: str = "date_received") -> Column:
        return self.dates_predicate(date_col) & self.labels_predicate()

    def dates_predicate(self, date_col: str = "date_received") -> Column:
        pred = F.lit(True)
        if self.start is not None:
            pred = pred & (F.col(date_col) >= F.lit(self.start))
        if self.end is not None:
            pred = pred & (F.col(date_col) <= F.lit(self.end))
        return pred

    def labels_predicate(self) -> Column:
        pred = F.lit(True)
        for column, values in (
            ("company_name", self.companies),
            ("product", self.products),
            ("sub_product", self.sub_products),
        ):
            if values:
                pred = pred & F.col(column).isin(*values)
        return pred

    def holds(self, day: dt.date) -> bool:
        return (self.start is None or self.start <= day) and (self.end is None or day <= self.end)

    @property
    def days(self) -> int:
        if self.start is None or self.end is None:
            raise ValueError("an open scope has no length")
        return (self.end - self.start).days + 1

    def prior(self) -> Scope:
        """The equal-length window ending the day before ``start``."""
        if self.start is None or self.end is None:
            raise ValueError("an open scope has no prior window")
        prior_end = self.start - dt.timedelta(days=1)
        prior_start = prior_end - (self.end - self.start)
        return replace(self, start=prior_start, end=prior_end)


def label_filter(column: str, values: list[str | None]) -> Column:
    """``column IN (labels) OR column IS NULL`` when ``None`` is among ``values``."""
    labels = [v for v in values if v is not None]
    clauses = [F.col(column).isin(*labels)] if labels else []
    if any(v is None for v in values):
        clauses.append(F.col(column).isNull())
    if not clauses:
        raise ValueError("empty label filter")
    pred = clauses[0]
    for c in clauses[1:]:
        pred = pred | c
    return pred
