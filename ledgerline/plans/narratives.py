"""Narrative evidence: hash-sampled excerpts, redaction, search, two-period
concern summaries, briefing facts and evidence selection.

The evidence export selects complaint IDs first (a hash sample over the
narrow ID column), then joins context and text for just those IDs, so the
wide narrative text never travels through the large side of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import contains_ci, excerpt, nonblank, redact
from ledgerline.operators.quote import representative_quote, review_question
from ledgerline.operators.topk import hash_sample
from ledgerline.operators.totals import attach_totals
from ledgerline.plans.scope import Scope
from ledgerline.schema import ISSUE_NOT_RECORDED

EXCERPT_CHARS = 2000
SAMPLE_METHOD = "global_md5_id_v1"
#: An ID list is broadcast while its size stays below the second figure.
ID_BYTES, BROADCAST_BYTES = 64, 32 * 1024**2
CONTEXT = ["complaint_id", "date_received", "company_name", "product", "sub_product", "issue",
           "state", "company_response"]
SELECTED, PREVIOUS = "Selected", "Previous"
MIN_PERIOD_ROWS, MIN_CONCERN_ROWS, MIN_MATCHES = 50, 10, 20


def population(narratives: DataFrame) -> DataFrame:
    """Narratives with a non-space character: the sampling population."""
    return narratives.filter(nonblank("narrative"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free identity of a table: row count and the decimal sum of the
    first 60 bits of each row's MD5 (a sum, unlike XOR, does not cancel
    duplicate rows).  A row's text is its columns as strings, each ended by
    U+001F, NULL as U+0000, so any engine can compute it."""
    text = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("\x00")), F.lit("\x1f")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).alias("hash_sum")).select(
        F.concat_ws(":", F.col("rows").cast("string"), F.col("hash_sum").cast("string")).alias("fingerprint")
    )


def reconcile_evidence(metrics: DataFrame, narratives: DataFrame, overview: DataFrame) -> DataFrame:
    """One row comparing the overview grain with the gold table and the
    narrative corpus (QA-15): every ``*_ok`` must be true before export.

    The three inputs are projected to a common labelled shape and unioned,
    so one aggregate (one job, no join) computes all the figures."""
    def part(df: DataFrame, src: str, rows, narr, day) -> DataFrame:
        return df.select(
            F.lit(src).alias("src"),
            rows.cast("long").alias("rows"),
            narr.cast("long").alias("narr"),
            day.alias("day"),
        )

    stacked = (
        part(overview, "o", F.col("complaint_count"), F.col("narrative_count"), F.col("date_received"))
        .unionByName(part(metrics, "g", F.lit(1), F.col("narrative_count"), F.col("date_received")))
        .unionByName(
            part(population(narratives), "c", F.lit(1), F.lit(0), F.lit(None).cast("date"))
        )
    )
    def on(src: str, c: str):
        return F.when(F.col("src") == src, F.col(c))

    t = stacked.agg(
        F.sum(on("o", "rows")).alias("o_rows"),
        F.sum(on("o", "narr")).alias("o_narr"),
        F.min(on("o", "day")).alias("o_first"),
        F.max(on("o", "day")).alias("o_last"),
        F.sum(on("g", "rows")).alias("g_rows"),
        F.sum(on("g", "narr")).alias("g_narr"),
        F.min(on("g", "day")).alias("g_first"),
        F.max(on("g", "day")).alias("g_last"),
        F.count_if(F.col("src") == "c").alias("corpus_narratives"),
    )
    return t.select(
        "corpus_narratives",
        (
            F.col("o_rows").eqNullSafe(F.col("g_rows"))
            & F.col("o_narr").eqNullSafe(F.col("g_narr"))
            & F.col("o_first").eqNullSafe(F.col("g_first"))
            & F.col("o_last").eqNullSafe(F.col("g_last"))
        ).alias("snapshot_ok"),
        (F.col("corpus_narratives") == F.col("g_narr")).alias("corpus_ok"),
    )


def narrative_ids(metrics: DataFrame) -> DataFrame:
    """IDs of narrative-bearing complaints from two narrow gold columns.

    Equal to the non-blank narrative population: staging turns blank text
    into NULL and ``reconcile_evidence`` asserts the corpus count equals
    ``sum(narrative_count)`` before any export, so the sample never has to
    scan the wide text column to find its population."""
    return metrics.filter(F.col("narrative_count") == 1).select("complaint_id")


def sample_excerpts(narratives: DataFrame, limit: int, ids_population: DataFrame | None = None) -> DataFrame:
    """Hash sample of IDs, then the excerpt of just those narratives (TXT-2, SRT-4)."""
    pop = population(narratives)
    source = ids_population if ids_population is not None else pop.select("complaint_id")
    ids = hash_sample(source, "complaint_id", limit)
    if limit * ID_BYTES <= BROADCAST_BYTES:  # a list of IDs of known size; else the planner decides
        ids = F.broadcast(ids)
    text, truncated = excerpt("narrative", EXCERPT_CHARS)
    return pop.join(ids, "complaint_id", "left_semi").select(
        "complaint_id", text.alias("excerpt"), truncated.alias("excerpt_truncated")
    )


def hash_sample_context(metrics: DataFrame, narratives: DataFrame, limit: int) -> DataFrame:
    """Sampled excerpts with their complaint context (JOIN-4), unredacted."""
    sample = sample_excerpts(narratives, limit, narrative_ids(metrics))
    return metrics.select(*CONTEXT).join(sample, "complaint_id", "inner")


def corpus(metrics: DataFrame, narratives: DataFrame) -> DataFrame:
    """Every narrative, whole and redacted, with its complaint context: the
    input of search, concerns and themes.  ``excerpt`` is the whole text."""
    texts = population(narratives).select(
        "complaint_id", redact("narrative").alias("excerpt"), F.lit(False).alias("excerpt_truncated")
    )
    told = metrics.filter(F.col("narrative_count") == 1)  # the others have no text to meet
    return told.select(*CONTEXT).join(texts, "complaint_id", "inner")


def evidence_export(
    metrics: DataFrame,
    narratives: DataFrame,
    overview: DataFrame,
    limit: int = 60000,
    budget_bytes: int | None = None,
    min_rows: int = 1000,
    exported_at: str | None = None,
) -> DataFrame:
    """The published evidence sample (TXT-3): reconciled, hash-sampled,
    context-joined, redacted, tagged with population and snapshot identity.

    ``budget_bytes`` (optional) keeps the largest hash-ordered prefix of
    ``limit / 2**k`` rows whose text fits the budget, never below
    ``min_rows`` (SRT-5).
    """
    check = reconcile_evidence(metrics, narratives, overview).first()
    if not (check["snapshot_ok"] and check["corpus_ok"]):
        raise ValueError("Evidence does not reconcile with the overview snapshot")
    rows = hash_sample_context(metrics, narratives, limit).withColumn("excerpt", redact("excerpt"))
    if budget_bytes is not None:
        rows = shrink_to_budget(rows, budget_bytes, min_rows)
    ident = fingerprint(overview).select(F.col("fingerprint").alias("overview_fingerprint"))
    out = attach_totals(rows, ident).select(
        "*",
        F.lit(check["corpus_narratives"]).cast("long").alias("corpus_narratives"),
        F.lit(SAMPLE_METHOD).alias("sample_method"),
    )
    return out.withColumn("exported_at_utc", F.lit(exported_at)) if exported_at else out


def shrink_to_budget(rows: DataFrame, budget_bytes: int, min_rows: int) -> DataFrame:
    """Halve the hash-ordered prefix until its UTF-8 text size fits (SRT-5).

    Nothing is numbered in one task: rows and bytes are summed per leading
    hash digits, the few sums give every candidate cut's bucket, and only the
    rows of those buckets are ordered.  The narrow (ID, hash, bytes) table is
    checkpointed, so the texts are measured once.
    """
    from ledgerline.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(rows.sparkSession)
    h = F.md5("complaint_id")
    sizes = rows.select("complaint_id", h.alias("h"), F.octet_length("excerpt").alias("bytes")).checkpoint()
    bucket = F.substring("h", 1, 3)  # 4,096 buckets: a bounded table of sums
    table = sizes.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).orderBy("b").collect()
    total = sum(r["n"] for r in table)
    cut = total
    while cut > 0:
        n = used = 0
        inner = None
        for r in table:
            if n + r["n"] > cut:
                inner = r["b"]
                break
            n, used = n + r["n"], used + (r["bytes"] or 0)
        edge = None
        if cut > n:
            first = sizes.filter(bucket == inner).orderBy("h", "complaint_id").limit(cut - n)
            last = first.agg(F.sum("bytes").alias("bytes"), F.max(F.struct("h", "complaint_id")).alias("last")).first()
            used, edge = used + (last["bytes"] or 0), last["last"]
        if used < budget_bytes:
            break
        if cut <= min_rows:
            raise ValueError("Narrative evidence exceeds the size budget")
        cut //= 2
    if cut >= total:
        return rows
    if cut == 0:
        return rows.limit(0)
    if edge is None:  # the cut ends with a bucket
        return rows.filter(F.substring(h, 1, 3) < F.lit(inner))
    return rows.filter((h < edge["h"]) | ((h == edge["h"]) & (F.col("complaint_id") <= edge["complaint_id"])))


def snapshot_compatible(evidence: DataFrame, overview: DataFrame) -> bool:
    """Evidence is usable only with the overview it was cut from (QA-16)."""
    stored = evidence.select("overview_fingerprint").limit(1).collect()
    if not stored:
        return False
    return stored[0][0] == fingerprint(overview).first()[0]


def search(
    evidence: DataFrame,
    scope: Scope,
    phrase: str,
    issue: str | None = None,
    limit: int = 8,
    overview: DataFrame | None = None,
    clip: int | None = None,
    index=None,
) -> DataFrame:
    """Literal, case-insensitive phrase search in scope (SRT-8): up to
    ``limit`` rows in hash order, re-redacted (and cut to ``clip`` characters
    if given), each carrying the total number of matching excerpts.  With ``overview`` given, evidence cut
    from another snapshot is refused (QA-16).  A ``PhraseIndex`` of the
    excerpts by complaint ID spares reading those that cannot match."""
    if not isinstance(phrase, str) or len(phrase) > 100 or not 1 <= limit <= 8:
        raise ValueError("Evidence search exceeds phrase or result limit.")
    if issue is not None and (not isinstance(issue, str) or len(issue) > 300):
        raise ValueError("Invalid issue filter.")
    if overview is not None and not snapshot_compatible(evidence, overview):
        raise ValueError("Narratives are from a different release; evidence search disabled.")
    df = evidence.filter(scope.predicate())
    if phrase.strip():
        text = phrase.strip()
        df = df.filter(contains_ci("excerpt", text)) if index is None else index.matches(df, "complaint_id", "excerpt", text)
    if issue is not None:
        df = df.filter(F.col("issue") == F.lit(issue))
    matches = df.agg(F.count(F.lit(1)).alias("matching_sample_excerpts"))
    rows = (
        df.orderBy(F.md5("complaint_id"), "complaint_id")
        .limit(limit)
        .select(
            "complaint_id", "date_received", "company_name", "product", "issue",
            (redact("excerpt") if clip is None else F.left(redact("excerpt"), F.lit(clip))).alias("excerpt"),
            "excerpt_truncated",
        )
    )
    return attach_totals(rows, matches)


def two_periods(evidence: DataFrame, scope: Scope, cap: int | None = None, coverage_start=None) -> DataFrame:
    """Selected scope and its equal-length prior window, stacked with a
    period label (TXT-10, SET-3).  ``cap`` optionally keeps the first rows
    per period in hash order; the prior period is empty when its window
    starts before coverage (FLT-11)."""
    def take(s: Scope) -> DataFrame:
        df = evidence.filter(s.predicate())
        if cap is not None:
            df = df.orderBy(F.md5("complaint_id"), "complaint_id").limit(cap)
        return df

    current = take(scope).withColumn("period", F.lit(SELECTED))
    prior = scope.prior()
    if coverage_start is not None and prior.start < coverage_start:
        previous = current.limit(0).withColumn("period", F.lit(PREVIOUS))
    else:
        previous = take(prior).withColumn("period", F.lit(PREVIOUS))
    return current.unionByName(previous)


def concern_column() -> F.Column:
    return F.coalesce(F.nullif(F.col("issue"), F.lit("")), F.lit(ISSUE_NOT_RECORDED))


def _period_summary(frame: DataFrame, key: F.Column, key_name: str) -> DataFrame:
    """Per key: selected count, share of all selected rows, prior count and
    the supported change in percentage points (AGG-25/26)."""
    sel, pre = F.col("period") == SELECTED, F.col("period") == PREVIOUS
    per = frame.groupBy(key.alias(key_name)).agg(
        F.count_if(sel).alias("narratives"), F.count_if(pre).alias("prior_narratives")
    )
    totals = frame.agg(F.count_if(sel).alias("n_sel"), F.count_if(pre).alias("n_pre"))
    supported = (
        (F.col("n_sel") >= MIN_PERIOD_ROWS)
        & (F.col("n_pre") >= MIN_PERIOD_ROWS)
        & (F.col("narratives") >= MIN_CONCERN_ROWS)
        & (F.col("prior_narratives") >= MIN_CONCERN_ROWS)
    )
    share = F.lit(100.0) * F.col("narratives") / F.col("n_sel")
    return (
        per.filter(F.col("narratives") > 0)
        .transform(lambda df: attach_totals(df, totals))
        .select(
            key_name,
            F.col("narratives").cast("long").alias("narratives"),
            share.alias("share_pct"),
            F.col("prior_narratives").cast("long").alias("prior_narratives"),
            F.when(supported, share - F.lit(100.0) * F.col("prior_narratives") / F.col("n_pre")).alias("change_pp"),
        )
    )


def concern_summary(frame: DataFrame) -> DataFrame:
    """Recorded-issue concerns of the two-period frame (AGG-25)."""
    return _period_summary(frame, concern_column(), "concern")


def theme_summary(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Topic themes (AGG-26): unassigned rows stay in the denominator;
    topics without selected rows are dropped."""
    s = _period_summary(assigned, F.col("topic"), "topic")
    return s.join(F.broadcast(labels), "topic", "inner").select(
        "topic", "theme", "narratives", "share_pct", "change_pp"
    )


def briefing_facts(summary: DataFrame) -> DataFrame:
    """Leading concern, top-3 share and the largest supported gain (AGG-30)."""
    order = [F.col("narratives").desc(), F.col("concern").asc()]
    lead = summary.orderBy(*order).limit(1).select(
        F.col("concern").alias("leading_concern"), F.col("share_pct").alias("leading_share_pct")
    )
    # integer counts first, one division last: exact and order-independent
    # (every selected row belongs to exactly one concern, so the summary's
    # narratives add up to the selected total)
    top3 = (
        summary.orderBy(*order)
        .limit(3)
        .agg(F.sum("narratives").alias("top3"))
        .transform(lambda df: attach_totals(df, summary.agg(F.sum("narratives").alias("n_sel"))))
        .select((F.lit(100.0) * F.col("top3") / F.col("n_sel")).alias("top3_share_pct"))
    )
    gain = summary.filter(F.col("change_pp").isNotNull()).agg(
        F.min_by(F.col("concern"), F.struct(-F.col("change_pp"), F.col("concern"))).alias(
            "largest_change_concern"
        ),
        F.max("change_pp").alias("largest_change_pp"),
    )
    return attach_totals(attach_totals(lead, top3), gain).select(
        "*", (F.col("largest_change_pp") > 0).alias("gained")
    )


def largest_changes(summary: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` absolute supported changes with a direction word (SRT-7)."""
    c = F.col("change_pp")
    return (
        summary.filter(c.isNotNull())
        .orderBy(F.abs(c).desc(), F.col("concern").asc())
        .limit(k)
        .select(
            "concern", "prior_narratives", "narratives", "change_pp",
            F.when(c > 0, "Gained").when(c < 0, "Lost").otherwise("Unchanged by").alias("direction"),
        )
    )


def questions(summary: DataFrame, k: int = 3) -> DataFrame:
    """Review questions for the ``k`` largest concerns (TXT-9)."""
    return (
        summary.orderBy(F.col("narratives").desc(), F.col("concern").asc())
        .limit(k)
        .select("concern", review_question(F.col("concern")).alias("question"))
    )


def best_evidence(assigned: DataFrame) -> DataFrame:
    """Per concern of the selected period: the heaviest excerpt, lowest ID on
    ties (WIN-2), with its representative quote (TXT-8)."""
    w = Window.partitionBy("concern").orderBy(F.col("weight").desc(), F.col("complaint_id").asc())
    sel = assigned.filter(F.col("period") == SELECTED).withColumn("concern", concern_column())
    best = sel.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
    return best.select(
        "concern", "complaint_id", "date_received",
        representative_quote(F.col("excerpt"), F.col("concern")).alias("quote"),
    )


def evidence_list(
    assigned: DataFrame, concern: str, topic: int | None = None, phrase: str = "", k: int = 5
) -> DataFrame:
    """Top ``k`` selected excerpts of one concern by weight, then ID (SRT-6)."""
    df = assigned.filter((F.col("period") == SELECTED) & (concern_column() == F.lit(concern)))
    if topic is not None and topic != -1:
        df = df.filter(F.col("topic") == topic)
    if phrase.strip():
        df = df.filter(contains_ci("excerpt", phrase.strip()))
    return df.orderBy(F.col("weight").desc(), F.col("complaint_id").asc()).limit(k)


def match_gate(evidence: DataFrame, scope: Scope) -> DataFrame:
    """Matching excerpts in scope and whether theme discovery may run."""
    return evidence.filter(scope.predicate()).agg(F.count(F.lit(1)).alias("matches")).select(
        "matches", (F.col("matches") >= MIN_MATCHES).alias("enough")
    )
