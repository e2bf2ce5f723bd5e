"""The narrative insight path in one call: match gate -> selected and prior
samples -> themes -> concern briefing -> evidence (TXT-10, AGG-25..30).

Returns named DataFrames; nothing is collected except the one-row gate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans import narratives as N
from ledgerline.plans.scope import Scope
from ledgerline.plans.topics import discover, phrase_mentions


@dataclass
class Insights:
    matches: int
    assigned: DataFrame | None = None
    labels: DataFrame | None = None
    concerns: DataFrame | None = None
    themes: DataFrame | None = None
    briefing: DataFrame | None = None
    changes: DataFrame | None = None
    questions: DataFrame | None = None
    evidence: DataFrame | None = None
    mentions: DataFrame | None = None

    @property
    def available(self) -> bool:
        return self.assigned is not None


def analyze(
    evidence: DataFrame,
    overview: DataFrame,
    scope: Scope,
    cap: int | None = None,
    topics: int = 6,
) -> Insights:
    """Theme and concern analysis of the evidence sample within ``scope``.

    Refuses evidence cut from another snapshot; returns only the match count
    when fewer than 20 excerpts match (the analysis would be unstable)."""
    if not N.snapshot_compatible(evidence, overview):
        raise ValueError("Narrative evidence belongs to a different release.")
    gate = N.match_gate(evidence, scope).first()
    if not gate["enough"]:
        return Insights(matches=int(gate["matches"]))
    first = overview.agg(F.min("date_received")).first()[0]
    frame = N.two_periods(evidence, scope, cap=cap, coverage_start=first)
    assigned, labels = discover(frame, topics=topics)
    concerns = N.concern_summary(assigned)
    return Insights(
        matches=int(gate["matches"]),
        assigned=assigned,
        labels=labels,
        concerns=concerns,
        themes=N.theme_summary(assigned, labels),
        briefing=N.briefing_facts(concerns),
        changes=N.largest_changes(concerns),
        questions=N.questions(concerns),
        evidence=N.best_evidence(assigned),
        mentions=phrase_mentions(assigned, labels),
    )
