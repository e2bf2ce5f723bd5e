"""Oracle SQL per registered query name (DuckDB dialect)."""

from __future__ import annotations

from ledgerline.plans.registry import MODEL_QUERIES
from oracles import themes
from oracles.prefix import _date, with_models

ORACLES: dict[str, str] = {}

for _q, _m in MODEL_QUERIES.items():
    ORACLES[_q] = with_models(f"SELECT * FROM {_m}")


# --- Step 5: quality suite -------------------------------------------------
from ledgerline.plans.quality import LAYERS, PRESERVES, SUITE  # noqa: E402
from ledgerline.schema import FLAGS, OUTCOMES  # noqa: E402


def _generic(model: str) -> list[str]:
    not_null, unique, rels = SUITE[model]
    out = [
        f"SELECT 'not_null:{model}.{c}' AS check, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS failures FROM {model}"
        for c in not_null
    ]
    out += [
        f"SELECT 'unique:{model}.{c}' AS check, CAST(count(*) AS BIGINT) AS failures FROM "
        f"(SELECT {c} FROM {model} GROUP BY {c} HAVING count(*) > 1)"
        for c in unique
    ]
    out += [
        f"SELECT 'relationships:{model}.{c}->{p}.{pc}' AS check, CAST(count(*) AS BIGINT) AS failures "
        f"FROM {model} ch WHERE ch.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} pa WHERE pa.{pc} = ch.{c})"
        for c, (p, pc) in rels.items()
    ]
    return out


def _singular(layer: str) -> list[str]:
    out = [
        f"SELECT '{n}' AS check, CAST(abs((SELECT count(*) FROM {a}) - (SELECT count(*) FROM {b})) AS BIGINT) AS failures"
        for n, a, b in PRESERVES
        if n.startswith(layer)
    ]
    if layer == "silver":
        out += [
            "SELECT 'silver_preserves_narratives' AS check, CAST(abs((SELECT count(*) FROM stg_complaints WHERE narrative IS NOT NULL) - (SELECT count(*) FROM complaint_narratives)) AS BIGINT) AS failures",
            "SELECT 'consistent_product_issue' AS check, CAST(count(*) AS BIGINT) AS failures FROM complaints c JOIN issue_categories i ON c.issue_category_id = i.issue_category_id WHERE c.product_category_id <> i.product_category_id",
            "SELECT 'unique_complaint_tag_pairs' AS check, CAST(count(*) AS BIGINT) AS failures FROM (SELECT complaint_id, tag_id FROM complaint_tags GROUP BY ALL HAVING count(*) > 1)",
        ]
    if layer == "gold":
        binary = " OR ".join(["complaint_count <> 1"] + [f"{f} NOT IN (0, 1)" for f in FLAGS[1:]])
        outcomes = " + ".join(list(OUTCOMES) + ["unknown_response_outcome_count"])
        consistency = (
            "timely_response_count + not_timely_response_count <> known_timeliness_count "
            "OR known_timeliness_count + unknown_timeliness_count <> 1 "
            "OR narrative_count <> CASE WHEN has_narrative THEN 1 ELSE 0 END "
            f"OR {outcomes} <> 1"
        )
        out += [
            "SELECT 'gold_preserves_narratives' AS check, CAST(abs((SELECT count(*) FROM complaint_narratives) - (SELECT sum(narrative_count) FROM complaint_metrics)) AS BIGINT) AS failures",
            f"SELECT 'gold_flags_are_binary' AS check, CAST(count(*) AS BIGINT) AS failures FROM complaint_metrics WHERE {binary}",
            f"SELECT 'gold_flag_consistency' AS check, CAST(count(*) AS BIGINT) AS failures FROM complaint_metrics WHERE {consistency}",
        ]
    if layer == "star":
        sums_s = ", ".join(["count(*) AS rows"] + [f"sum({f}) AS {f}" for f in FLAGS])
        diffs = " + ".join(
            f"CASE WHEN s.{n} IS DISTINCT FROM g.{n} THEN 1 ELSE 0 END" for n in ["rows"] + FLAGS
        )
        out.append(
            f"SELECT 'star_matches_wide_gold' AS check, CAST({diffs} AS BIGINT) AS failures "
            f"FROM (SELECT {sums_s} FROM fact_complaints) s CROSS JOIN (SELECT {sums_s} FROM complaint_metrics) g"
        )
    return out


for _layer, _models in LAYERS.items():
    _parts = [q for m in _models for q in _generic(m)] + _singular(_layer)
    ORACLES[f"qa_{_layer}"] = with_models("\nUNION ALL\n".join(_parts))

_TOTALS = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in FLAGS)
ORACLES["grain_invariant"] = with_models(
    "\nUNION ALL\n".join(
        f"SELECT '{label}' AS source, {_TOTALS} FROM {rel}"
        for label, rel in [
            ("gold", "complaint_metrics"),
            ("overview", "grain_overview"),
            ("issues", "grain_issues"),
            ("geography", "grain_geography"),
            ("channels", "grain_channels"),
        ]
    )
)

# --- Step 7: analytics -----------------------------------------------------
FULL = "true"
PRODUCTS = FULL + " AND product IN ('ECONOMY', 'PROMO')"
_ODD_RANGE = "date_received BETWEEN DATE '1996-05-17' AND DATE '1998-02-03' AND product IN ('ECONOMY', 'PROMO')"
YEAR = "date_received BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"


def _rate(n: str, d: str) -> str:
    return f"100.0 * {n} / NULLIF({d}, 0)"


def _rank(col: str, rel: str, where: str, limit: int | None) -> str:
    order = "" if limit is None else f" ORDER BY complaints DESC, category LIMIT {limit}"
    return (
        f"SELECT COALESCE({col}, 'Missing label') AS category, CAST(SUM(complaint_count) AS BIGINT) AS complaints "
        f"FROM {rel} WHERE {where} GROUP BY 1{order}"
    )


def _headline(where: str) -> str:
    return with_models(
        "SELECT *, " + _rate("timely", "known") + " AS timely_rate_pct, "
        + _rate("narratives", "complaints") + " AS narrative_coverage_pct FROM ("
        "SELECT CAST(COALESCE(SUM(complaint_count), 0) AS BIGINT) AS complaints, "
        "CAST(COALESCE(SUM(timely_response_count), 0) AS BIGINT) AS timely, "
        "CAST(COALESCE(SUM(known_timeliness_count), 0) AS BIGINT) AS known, "
        "CAST(COALESCE(SUM(narrative_count), 0) AS BIGINT) AS narratives, "
        "CAST(COALESCE(SUM(unknown_timeliness_count), 0) AS BIGINT) AS unknown "
        f"FROM grain_overview WHERE {where})"
    )


def _trend(interval: str, where: str) -> str:
    period = "date_received" if interval == "day" else f"CAST(date_trunc('{interval}', date_received) AS DATE)"
    return with_models(
        f"SELECT *, {_rate('narratives', 'complaints')} AS coverage_pct FROM ("
        f"SELECT {period} AS period, CAST(SUM(complaint_count) AS BIGINT) AS complaints, "
        f"CAST(SUM(narrative_count) AS BIGINT) AS narratives FROM grain_overview WHERE {where} GROUP BY 1)"
    )


ORACLES.update(
    {
        "headline": _headline(FULL),
        "headline_products": _headline(PRODUCTS),
        "trend_month": _trend("month", FULL),
        "trend_week": _trend("week", PRODUCTS),
        "trend_day": _trend("day", YEAR),
        "weekly_report": with_models(
            "SELECT CAST(date_trunc('week', date_received) AS DATE) AS week_start, "
            "CAST(SUM(complaint_count) AS BIGINT) AS complaints, "
            f"{_rate('SUM(timely_response_count)', 'SUM(known_timeliness_count)')} AS timely_response_rate, "
            f"{_rate('SUM(narrative_count)', 'SUM(complaint_count)')} AS narrative_coverage "
            f"FROM grain_overview WHERE {FULL} GROUP BY 1"
        ),
        "rank_company": with_models(_rank("company_name", "grain_overview", FULL, 15)),
        "rank_product": with_models(_rank("product", "grain_overview", FULL, 5)),
        "rank_issue": with_models(_rank("issue", "grain_issues", FULL, 10)),
        "rank_sub_issue": with_models(_rank("sub_issue", "grain_issues", FULL, 10)),
        "rank_channel": with_models(_rank("submission_channel", "grain_channels", FULL, 10)),
        "rank_state": with_models(_rank("state", "grain_geography", FULL, 100)),
        "issue_drilldown": with_models(_rank("sub_issue", "grain_issues", FULL + " AND issue = 'BUILDING'", 10)),
        "top5_share": with_models(
            "SELECT top_complaints, scope_total, 100.0 * top_complaints / scope_total AS top_share_pct FROM "
            f"(SELECT CAST(SUM(complaints) AS BIGINT) AS top_complaints FROM ({_rank('company_name', 'grain_overview', FULL, 5)})) "
            f"CROSS JOIN (SELECT CAST(SUM(complaint_count) AS BIGINT) AS scope_total FROM grain_overview WHERE {FULL})"
        ),
        "company_comparison": with_models(
            "SELECT company, complaints, timely_rate_pct, narrative_coverage_pct, "
            "100.0 * complaints / scope_total AS complaint_share_pct FROM ("
            "SELECT COALESCE(company_name, 'Missing label') AS company, CAST(SUM(complaint_count) AS BIGINT) AS complaints, "
            f"{_rate('SUM(timely_response_count)', 'SUM(known_timeliness_count)')} AS timely_rate_pct, "
            f"{_rate('SUM(narrative_count)', 'SUM(complaint_count)')} AS narrative_coverage_pct "
            f"FROM grain_overview WHERE {FULL} GROUP BY 1) "
            f"CROSS JOIN (SELECT CAST(SUM(complaint_count) AS BIGINT) AS scope_total FROM grain_overview WHERE {FULL})"
        ),
        "product_share": with_models(
            "SELECT category, complaints, 100.0 * complaints / scope_total AS share_pct FROM "
            f"({_rank('product', 'grain_overview', PRODUCTS, None)}) "
            f"CROSS JOIN (SELECT CAST(SUM(complaint_count) AS BIGINT) AS scope_total FROM grain_overview WHERE {PRODUCTS})"
        ),
        "response_rates": with_models(
            f"SELECT {_rate('SUM(not_timely_response_count)', 'SUM(known_timeliness_count)')} AS not_timely_rate_pct, "
            f"{_rate('(SUM(monetary_relief_count) + SUM(non_monetary_relief_count))', 'SUM(complaint_count)')} AS relief_share_pct, "
            "CAST(COALESCE(SUM(unknown_response_outcome_count), 0) AS BIGINT) AS missing_outcomes "
            f"FROM grain_overview WHERE {FULL}"
        ),
        "location_totals": with_models(
            "SELECT CAST(COALESCE(SUM(complaints) FILTER (WHERE mapped), 0) AS BIGINT) AS mapped_complaints, "
            "CAST(COALESCE(SUM(complaints) FILTER (WHERE NOT mapped), 0) AS BIGINT) AS omitted_complaints, "
            "CAST(count(*) FILTER (WHERE mapped) AS BIGINT) AS mapped_locations, "
            "CAST(count(*) FILTER (WHERE NOT mapped) AS BIGINT) AS omitted_locations FROM ("
            "SELECT *, category IN ('" + "', '".join(__import__('ledgerline.schema', fromlist=['x']).STATE_CODES) + "') AS mapped "
            f"FROM ({_rank('state', 'grain_geography', FULL, None)}))"
        ),
        "prior_period": with_models(
            "SELECT DATE '1998-01-01' AS prior_start, DATE '1998-12-31' AS prior_end, available, current_complaints, "
            "CASE WHEN available THEN previous_complaints END AS previous_complaints, "
            "CASE WHEN available AND previous_complaints <> 0 THEN 100.0 * (current_complaints / previous_complaints - 1.0) END AS change_pct "
            "FROM (SELECT "
            "CAST(COALESCE(SUM(complaint_count) FILTER (WHERE date_received BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'), 0) AS BIGINT) AS current_complaints, "
            "CAST(COALESCE(SUM(complaint_count) FILTER (WHERE date_received BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'), 0) AS BIGINT) AS previous_complaints "
            "FROM grain_overview) CROSS JOIN (SELECT DATE '1998-01-01' >= min(date_received) AS available FROM grain_overview)"
        ),
        "filter_companies": with_models(
            "SELECT DISTINCT company_name FROM grain_overview WHERE company_name IS NOT NULL"
        ),
        "filter_sub_products": with_models(
            "SELECT DISTINCT sub_product FROM grain_overview WHERE product IN ('ECONOMY') AND sub_product IS NOT NULL"
        ),
        "tag_filter_semi": with_models(
            "SELECT product, CAST(SUM(complaint_count) AS BIGINT) AS complaints FROM complaint_metrics m "
            "WHERE EXISTS (SELECT 1 FROM complaint_tags t WHERE t.complaint_id = m.complaint_id "
            "AND t.tag_id = md5(CAST(to_json(list_value('R')) AS VARCHAR))) GROUP BY product"
        ),
        "star_role_dates": with_models(
            "SELECT r.iso_year AS received_iso_year, s.is_weekend AS sent_on_weekend, "
            "CAST(SUM(f.complaint_count) AS BIGINT) AS complaints, "
            "CAST(SUM(f.sent_before_received_count) AS BIGINT) AS sent_before_received "
            "FROM fact_complaints f JOIN dim_date r ON f.received_date_key = r.date_key "
            "JOIN dim_date s ON f.sent_date_key = s.date_key GROUP BY 1, 2"
        ),
        "gold_summary": with_models(
            "SELECT count(*) AS complaints, CAST(SUM(complaint_count) AS BIGINT) AS complaint_count_total, "
            "CAST(SUM(narrative_count) AS BIGINT) AS complaints_with_narrative, "
            "CAST(SUM(timely_response_count) AS BIGINT) AS timely_responses, "
            "CAST(SUM(not_timely_response_count) AS BIGINT) AS not_timely_responses, "
            "CAST(SUM(known_timeliness_count) AS BIGINT) AS known_timeliness, "
            "CAST(SUM(unknown_response_outcome_count) AS BIGINT) AS missing_response_outcomes FROM complaint_metrics"
        ),
    }
)

from ledgerline.plans.analytics import OTHER_OUTCOMES, OUTCOME_ROWS as _OUTCOME_ROWS  # noqa: E402

_osums = ", ".join(
    f"CAST(COALESCE(SUM({f}), 0) AS BIGINT) AS o{i}" for i, (_, f) in enumerate(_OUTCOME_ROWS)
)
_orows = [f"SELECT {i} AS position, '{lab}' AS outcome, o{i} AS complaints, total FROM w" for i, (lab, _) in enumerate(_OUTCOME_ROWS)]
_orows.append(
    f"SELECT {len(_OUTCOME_ROWS)} AS position, '{OTHER_OUTCOMES}' AS outcome, "
    f"greatest(0, total - ({' + '.join(f'o{i}' for i in range(len(_OUTCOME_ROWS)))})) AS complaints, total FROM w"
)
ORACLES["outcome_mix"] = with_models(
    "SELECT position, outcome, complaints, 100.0 * complaints / total AS share_pct FROM ("
    + " UNION ALL ".join(_orows)
    + ")",
    ctes=f"w AS (SELECT CAST(COALESCE(SUM(complaint_count), 0) AS BIGINT) AS total, {_osums} FROM grain_overview WHERE {FULL})",
)

# --- Step 8: governed metric query ------------------------------------------
from ledgerline.plans.registry import MQ_REQUESTS  # noqa: E402
from ledgerline.schema import RATIOS  # noqa: E402

_MQ_EXPR = {f: f"CAST(SUM({f}) AS BIGINT)" for f in FLAGS}
_MQ_EXPR.update({n: _rate(f"SUM({a})", f"SUM({b})") for n, (a, b) in RATIOS.items()})
_MQ_EXPR["company_count"] = "COUNT(DISTINCT company_name)"


def _mq_sql(req) -> str:
    where = [FULL]
    if req.start_date:
        where.append(f"date_received >= DATE '{req.start_date}'")
    if req.end_date:
        where.append(f"date_received <= DATE '{req.end_date}'")
    for col, values in req.filters:
        labels = [v for v in values if v is not None]
        clauses = [f"{col} IN ({', '.join(repr(v) for v in labels)})"] if labels else []
        if None in values:
            clauses.append(f"{col} IS NULL")
        where.append("(" + " OR ".join(clauses) + ")")
    sel = [
        f"CAST(date_trunc('{req.interval}', date_received) AS DATE) AS period" if g == "period" else g
        for g in req.group_by
    ] + [f"{_MQ_EXPR[m]} AS {m}" for m in req.metrics]
    sql = f"SELECT {', '.join(sel)} FROM grain_{req.dataset} WHERE {' AND '.join(where)}"
    if req.group_by:
        sql += " GROUP BY " + ", ".join(str(i + 1) for i in range(len(req.group_by)))
    order = [f"{req.order_by} {'DESC' if req.descending else 'ASC'} NULLS LAST"]
    order += [f"{g} ASC NULLS LAST" for g in req.group_by if g != req.order_by]
    sql += f" ORDER BY {', '.join(order)} LIMIT {req.limit + 1}"
    return (
        f"SELECT * EXCLUDE (__pos) FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(order)}) AS __pos, "
        f"count(*) OVER () > {req.limit} AS truncated FROM ({sql})) WHERE __pos <= {req.limit}"
    )


for _name, _req in MQ_REQUESTS.items():
    ORACLES[_name] = with_models(_mq_sql(_req))
ORACLES["dataset_bounds"] = with_models(
    "SELECT min(date_received) AS first_date, max(date_received) AS last_date FROM grain_overview"
)

# --- Step 9: narratives -----------------------------------------------------
# RE2 has no look-around: the word-boundary and "not preceded/followed by a
# word character" rules are emulated with captured neighbour characters.
_W = r"\p{L}\p{N}_"
_SP = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def redact_sql(col: str) -> str:
    """The redaction chain in RE2: e-mail, link, long number (two passes,
    since a consumed neighbour character can hide an adjacent number), then
    whitespace collapse and trim."""
    email = (
        f"regexp_replace({col}, '(^|[^{_W}.+-])([{_W}.+-]*?)([{_W}][{_W}.+-]*@[{_W}.-]+\\.[A-Za-z]{{2,}})\\b', "
        "'\\1\\2[email]', 'g')"
    )
    link = f"regexp_replace({email}, 'https?://[^{_SP}]+', '[link]', 'g')"
    number = f"(^|[^{_W}])\\+?\\p{{Nd}}[\\p{{Nd}} ().-]{{6,}}\\p{{Nd}}([^{_W}]|$)"
    once = f"regexp_replace({link}, '{number}', '\\1[number]\\2', 'g')"
    twice = f"regexp_replace({once}, '{number}', '\\1[number]\\2', 'g')"
    return f"trim(regexp_replace({twice}, '[{_SP}]+', ' ', 'g'), ' ')"


_CTX = "m.complaint_id, m.date_received, m.company_name, m.product, m.sub_product, m.issue, m.state, m.company_response"
_EVIDENCE = (
    f"ev AS (SELECT {_CTX}, {redact_sql('left(n.narrative, 2000)')} AS excerpt, "
    "length(n.narrative) > 2000 AS excerpt_truncated FROM complaint_metrics m "
    "JOIN complaint_narratives n ON m.complaint_id = n.complaint_id WHERE length(trim(n.narrative)) > 0 "
    "AND n.complaint_id IN (SELECT complaint_id FROM complaint_narratives WHERE length(trim(narrative)) > 0 "
    "ORDER BY md5(complaint_id), complaint_id LIMIT 60000))"
)
_CORPUS = (
    f"ev AS (SELECT {_CTX}, {redact_sql('n.narrative')} AS excerpt, false AS excerpt_truncated "
    "FROM complaint_metrics m JOIN complaint_narratives n ON m.complaint_id = n.complaint_id "
    "WHERE length(trim(n.narrative)) > 0)"
)
_YEAR_SEL = "date_received BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"
_YEAR_PRE = "date_received BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
_FRAME = (
    _CORPUS + ", fr AS (SELECT *, 'Selected' AS period FROM ev WHERE " + _YEAR_SEL
    + " UNION ALL SELECT *, 'Previous' AS period FROM ev WHERE " + _YEAR_PRE + ")"
)
_SUMMARY = (
    _FRAME
    + ", per AS (SELECT coalesce(nullif(issue, ''), 'Issue not recorded') AS concern, "
    "count(*) FILTER (WHERE period = 'Selected') AS narratives, count(*) FILTER (WHERE period = 'Previous') AS prior_narratives "
    "FROM fr GROUP BY 1), tot AS (SELECT count(*) FILTER (WHERE period = 'Selected') AS n_sel, "
    "count(*) FILTER (WHERE period = 'Previous') AS n_pre FROM fr), "
    "s AS (SELECT concern, narratives, 100.0 * narratives / n_sel AS share_pct, prior_narratives, "
    "CASE WHEN n_sel >= 50 AND n_pre >= 50 AND narratives >= 10 AND prior_narratives >= 10 "
    "THEN 100.0 * narratives / n_sel - 100.0 * prior_narratives / n_pre END AS change_pp, n_sel "
    "FROM per, tot WHERE narratives > 0)"
)
_QUESTIONS = [
    (["incorrect", "error"], "Which information errors recur, and what do customers report about correction attempts?"),
    (["improper use", "identity"], "What do customers describe about report access, authorization or identity-related disputes?"),
    (["investigation", "dispute"], "Do customers describe repeated disputes, unclear outcomes or difficulty getting a response?"),
    (["payment"], "What do customers report about payment processing, fees or account records?"),
    (["collection", "debt"], "Which collection contacts or disputed-debt experiences recur in the evidence?"),
]
_QCASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(concern), '{k}')" for k in keys) + f" THEN '{q}'"
    for keys, q in _QUESTIONS
) + " ELSE 'Which repeated customer experiences within this issue warrant a closer process review?' END"

ORACLES.update(
    {
        "redact_documents": with_models(f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents"),
        "redact_conversations": with_models(
            f"SELECT conv_id, turn, {redact_sql('text')} AS redacted FROM conversations"
        ),
        "excerpt": with_models(
            "SELECT complaint_id, left(narrative, 2000) AS excerpt, length(narrative) > 2000 AS excerpt_truncated "
            "FROM complaint_narratives"
        ),
        "hash_sample": with_models(
            f"SELECT {_CTX}, left(n.narrative, 2000) AS excerpt, length(n.narrative) > 2000 AS excerpt_truncated "
            "FROM complaint_metrics m JOIN complaint_narratives n ON m.complaint_id = n.complaint_id "
            "WHERE n.complaint_id IN (SELECT complaint_id FROM complaint_narratives WHERE length(trim(narrative)) > 0 "
            "ORDER BY md5(complaint_id), complaint_id LIMIT 500)"
        ),
        "evidence_export": with_models(
            "SELECT ev.*, (SELECT count(*) FROM complaint_narratives WHERE length(trim(narrative)) > 0) AS corpus_narratives, "
            "'global_md5_id_v1' AS sample_method FROM ev",
            ctes=_EVIDENCE,
        ),
        "evidence_reconcile": with_models(
            "SELECT c.corpus_narratives, "
            "(o.o_rows IS NOT DISTINCT FROM g.g_rows AND o.o_narr IS NOT DISTINCT FROM g.g_narr "
            "AND o.o_first IS NOT DISTINCT FROM g.g_first AND o.o_last IS NOT DISTINCT FROM g.g_last) AS snapshot_ok, "
            "c.corpus_narratives = g.g_narr AS corpus_ok FROM "
            "(SELECT CAST(sum(complaint_count) AS BIGINT) AS o_rows, CAST(sum(narrative_count) AS BIGINT) AS o_narr, "
            "min(date_received) AS o_first, max(date_received) AS o_last FROM grain_overview) o, "
            "(SELECT count(*) AS g_rows, CAST(sum(narrative_count) AS BIGINT) AS g_narr, "
            "min(date_received) AS g_first, max(date_received) AS g_last FROM complaint_metrics) g, "
            "(SELECT count(*) AS corpus_narratives FROM complaint_narratives WHERE length(trim(narrative)) > 0) c"
        ),
        "narrative_search": with_models(
            "SELECT r.*, c.matching_sample_excerpts FROM (SELECT complaint_id, date_received, company_name, product, issue, "
            f"{redact_sql('excerpt')} AS excerpt, excerpt_truncated FROM ev WHERE {FULL} "
            "AND contains(lower(excerpt), lower('the')) AND issue = 'BUILDING' "
            "ORDER BY md5(complaint_id), complaint_id LIMIT 8) r CROSS JOIN "
            f"(SELECT count(*) AS matching_sample_excerpts FROM ev WHERE {FULL} "
            "AND contains(lower(excerpt), lower('the')) AND issue = 'BUILDING') c",
            ctes=_CORPUS,
        ),
        "narrative_search_indexed": with_models(
            "SELECT r.*, c.matching_sample_excerpts FROM (SELECT complaint_id, date_received, company_name, product, issue, "
            f"{redact_sql('excerpt')} AS excerpt, excerpt_truncated FROM ev WHERE {FULL} "
            "AND contains(lower(excerpt), lower('in the')) ORDER BY md5(complaint_id), complaint_id LIMIT 8) r CROSS JOIN "
            f"(SELECT count(*) AS matching_sample_excerpts FROM ev WHERE {FULL} AND contains(lower(excerpt), lower('in the'))) c",
            ctes=_CORPUS,
        ),
        "match_gate": with_models(
            f"SELECT count(*) AS matches, count(*) >= 20 AS enough FROM ev WHERE {YEAR}", ctes=_CORPUS
        ),
        "concern_summary": with_models(
            "SELECT concern, narratives, share_pct, prior_narratives, change_pp FROM s", ctes=_SUMMARY
        ),
        "briefing_facts": with_models(
            "SELECT l.concern AS leading_concern, l.share_pct AS leading_share_pct, t.top3_share_pct, "
            "g.largest_change_concern, g.largest_change_pp, g.largest_change_pp > 0 AS gained FROM "
            "(SELECT concern, share_pct FROM s ORDER BY narratives DESC, concern LIMIT 1) l CROSS JOIN "
            "(SELECT 100.0 * sum(narratives) / max(n_sel) AS top3_share_pct FROM "
            "(SELECT narratives, n_sel FROM s ORDER BY narratives DESC, concern LIMIT 3)) t CROSS JOIN "
            "(SELECT (SELECT concern FROM s WHERE change_pp IS NOT NULL ORDER BY change_pp DESC, concern LIMIT 1) "
            "AS largest_change_concern, (SELECT max(change_pp) FROM s) AS largest_change_pp) g",
            ctes=_SUMMARY,
        ),
        "largest_changes": with_models(
            "SELECT concern, prior_narratives, narratives, change_pp, CASE WHEN change_pp > 0 THEN 'Gained' "
            "WHEN change_pp < 0 THEN 'Lost' ELSE 'Unchanged by' END AS direction FROM s "
            "WHERE change_pp IS NOT NULL ORDER BY abs(change_pp) DESC, concern LIMIT 3",
            ctes=_SUMMARY,
        ),
        "review_question": with_models(
            f"SELECT concern, {_QCASE} AS question FROM s ORDER BY narratives DESC, concern LIMIT 3",
            ctes=_SUMMARY,
        ),
    }
)

# --- Step 10: TF-IDF vocabulary ---------------------------------------------
from ledgerline.operators.tfidf import stop_words  # noqa: E402

_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + "]"
ORACLES["tfidf_vocabulary"] = with_models(
    "SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, term, df, cf FROM ("
    "SELECT term, df, cf FROM st WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM fr) "
    "ORDER BY cf DESC, term LIMIT 4000)",
    ctes=_FRAME
    + ", tok AS (SELECT complaint_id, list_filter(list_filter(regexp_extract_all(lower(excerpt), '[\\p{L}\\p{N}_]+'), "
    "lambda x: regexp_full_match(x, '[a-z]{3,}')), lambda x: NOT list_contains(" + _STOPS + ", x)) AS t FROM fr), "
    "grams AS (SELECT complaint_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM tok), "
    "cnt AS (SELECT complaint_id, term, count(*) AS tf FROM (SELECT complaint_id, unnest(terms) AS term FROM grams) GROUP BY ALL), "
    "st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM cnt GROUP BY term)",
)

# --- Step 6: raw rows: ingest, dedup, retention, coverage, profiling --------
_RAW_DATE = _date('"Date received"')
_NARR = "coalesce(trim(\"Consumer complaint narrative\"), '') <> ''"
from ledgerline.plans.profile import BLANK_FIELDS as _BLANK_FIELDS, VALUE_FIELDS as _VALUE_FIELDS  # noqa: E402

_CSV_FILES = (
    "archive_files AS (SELECT _source_archive, count(*) // 20000 + 1 AS files FROM incoming GROUP BY 1),\n"
    "bucketed AS (SELECT i.*, CAST('0x' || substr(md5(\"Complaint ID\"), 1, 8) AS BIGINT) % files AS bucket "
    "FROM incoming i JOIN archive_files USING (_source_archive)),\n"
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY _source_archive, bucket "
    "ORDER BY \"Complaint ID\", md5(\"Consumer complaint narrative\")) AS number FROM bucketed)"
)
_IV = (
    "iv AS (SELECT _source_archive AS name, _source_priority AS priority, "
    f"CAST(date_trunc('month', min({_RAW_DATE})) AS DATE) AS first_month, "
    f"CAST(date_trunc('month', max({_RAW_DATE})) AS DATE) AS last_month FROM incoming GROUP BY ALL), "
    "win AS (SELECT CAST(max(last_month) - INTERVAL 35 MONTH AS DATE) AS ws, "
    "CAST(max(last_month) + INTERVAL 1 MONTH AS DATE) AS we FROM iv), "
    "sel AS (SELECT iv.* FROM iv, win WHERE last_month >= ws AND first_month < we)"
)

ORACLES.update(
    {
        "overlap_excess": with_models(
            "SELECT count(*) - count(DISTINCT trim(\"Complaint ID\")) AS overlap_records_removed FROM incoming"
        ),
        "validity_gate": with_models(
            f"SELECT count(*) FILTER (WHERE {_RAW_DATE} IS NULL) AS unparsed_dates, "
            f"count(*) FILTER (WHERE regexp_replace(coalesce(\"Complaint ID\", ''), '[{_SP}]', '', 'g') = '') AS blank_ids FROM incoming"
        ),
        "retention_window": with_models(
            "SELECT _source_archive, count(*) AS rows FROM (SELECT * FROM incoming "
            f"WHERE {_RAW_DATE} >= DATE '1996-01-01' AND {_RAW_DATE} < DATE '2000-01-01' "
            "QUALIFY row_number() OVER (PARTITION BY trim(\"Complaint ID\") ORDER BY _source_priority DESC, "
            "_source_record_number DESC) = 1) GROUP BY 1"
        ),
        "profile_quality": with_models(
            f"SELECT count(*) AS raw_records, min({_RAW_DATE}) AS earliest_date, max({_RAW_DATE}) AS latest_date, "
            "count(*) FILTER (WHERE nullif(trim(\"Complaint ID\"), '') IS NULL) AS missing_complaint_ids, "
            f"count(*) FILTER (WHERE {_RAW_DATE} IS NULL) AS missing_or_unparsed_dates, "
            f"count(*) FILTER (WHERE {_NARR}) AS records_with_narrative FROM incoming"
        ),
        "profile_yearly": with_models(
            "SELECT year, raw_records, records_with_narrative, "
            "CAST((20000 * records_with_narrative + raw_records) // (2 * raw_records) AS DOUBLE) / 100.0 AS narrative_coverage_pct FROM ("
            f"SELECT CAST(extract(year FROM {_RAW_DATE}) AS INTEGER) AS year, count(*) AS raw_records, "
            f"count(*) FILTER (WHERE {_NARR}) AS records_with_narrative FROM incoming GROUP BY 1)"
        ),
        "profile_duplicates": with_models(
            "SELECT count(*) AS distinct_nonempty_ids, count(*) FILTER (WHERE occurrences > 1) AS ids_appearing_multiple_times, "
            "CAST(coalesce(sum(occurrences - 1), 0) AS BIGINT) AS extra_records FROM ("
            "SELECT nullif(trim(\"Complaint ID\"), '') AS id, count(*) AS occurrences FROM incoming "
            "WHERE nullif(trim(\"Complaint ID\"), '') IS NOT NULL GROUP BY 1)"
        ),
        "profile_blanks": with_models(
            " UNION ALL ".join(
                f"SELECT '{f}' AS field, count(*) FILTER (WHERE coalesce(trim(\"{f}\"), '') = '') AS blank_records FROM incoming"
                for f in _BLANK_FIELDS
            )
        ),
        "profile_top_values": with_models(
            "SELECT field, value, complaints, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field "
            "ORDER BY complaints DESC, value) AS INTEGER) AS rank FROM ("
            + " UNION ALL ".join(
                f"SELECT '{f}' AS field, coalesce(nullif(trim(\"{f}\"), ''), '[blank]') AS value, count(*) AS complaints "
                f"FROM incoming GROUP BY 1, 2"
                for f in _VALUE_FIELDS
            )
            + ")) WHERE rank <= 20"
        ),
        "source_inventory": with_models(
            f"SELECT _source_archive, _source_csv, count(*) AS rows, count(*) FILTER (WHERE {_NARR}) AS rows_with_narrative "
            "FROM incoming GROUP BY ALL"
        ),
        "month_coverage": with_models(
            "SELECT m.month, CAST(coalesce(c.archives, 0) AS BIGINT) AS archives FROM "
            "(SELECT CAST(t.m AS DATE) AS month FROM win, generate_series(ws, ws + INTERVAL 35 MONTH, INTERVAL 1 MONTH) AS t(m)) m "
            "LEFT JOIN (SELECT CAST(t.m AS DATE) AS month, count(DISTINCT name) AS archives FROM sel, win, "
            "generate_series(greatest(first_month, ws), last_month, INTERVAL 1 MONTH) AS t(m) GROUP BY 1) c ON m.month = c.month",
            ctes=_IV,
        ),
        "interval_selection": with_models(
            "SELECT name, priority, first_month, last_month FROM sel", ctes=_IV
        ),
        "source_dedup": with_models(
            "SELECT d.doc_id AS skipped_id, f.kept_id, d.signature FROM "
            "(SELECT doc_id, md5(text) AS signature FROM documents) d JOIN "
            "(SELECT md5(text) AS signature, min(doc_id) AS kept_id FROM documents GROUP BY 1) f "
            "ON d.signature = f.signature WHERE d.doc_id <> f.kept_id"
        ),
        "range_headline": _headline(YEAR),
        "range_headline_products": _headline(_ODD_RANGE),
        "range_trend_month": _trend("month", _ODD_RANGE),
        "range_trend_week": _trend("week", YEAR),
        "range_prior_period": ORACLES["prior_period"],
        "release_bronze": with_models("SELECT * FROM bronze_complaints"),
        "release_grains": with_models("SELECT * FROM grain_channels"),
        "release_changes": with_models(
            "SELECT CAST(v AS INTEGER) AS version, arrived, left_rows, CAST(months_written AS INTEGER) AS months_written FROM ("
            "SELECT 1 AS v, (SELECT count(DISTINCT k) FROM best WHERE p = 1) AS arrived, 0 AS left_rows, "
            "(SELECT count(DISTINCT m) FROM best WHERE p = 1) AS months_written UNION ALL "
            "SELECT 2, (SELECT count(*) FROM best WHERE p = 2), (SELECT count(*) FROM best b JOIN best a ON a.k = b.k AND a.p = 1 WHERE b.p = 2), "
            "(SELECT count(DISTINCT m) FROM (SELECT m FROM best WHERE p = 2 UNION ALL SELECT a.m FROM best b JOIN best a ON a.k = b.k AND a.p = 1 WHERE b.p = 2) x)) r",
            ctes=f"best AS (SELECT * FROM (SELECT trim(\"Complaint ID\") AS k, _source_priority AS p, strftime({_RAW_DATE}, '%Y-%m') AS m, row_number() OVER ("
            "PARTITION BY trim(\"Complaint ID\"), _source_priority ORDER BY _source_record_number DESC) AS n FROM incoming) r WHERE n = 1)",
        ),
        "csv_records": with_models(
            'SELECT _source_archive, bucket, "Complaint ID" AS complaint_id, number AS record_number, md5("Consumer complaint narrative") AS narrative_md5 FROM numbered',
            ctes=_CSV_FILES,
        ),
        "csv_roundtrip": with_models(
            "SELECT _source_archive, CAST(sum(n) AS BIGINT) AS rows, min(first) AS first_record, CAST(sum(last) AS BIGINT) AS records_numbered, "
            "bool_and(first = 1 AND last = n AND numbers = n) AS numbers_exact, CAST(sum(narratives) AS BIGINT) AS rows_with_narrative "
            "FROM (SELECT _source_archive, bucket, count(*) AS n, min(number) AS first, max(number) AS last, count(DISTINCT number) AS numbers, "
            "count(*) FILTER (WHERE trim(\"Consumer complaint narrative\") <> '') AS narratives FROM numbered GROUP BY 1, 2) f GROUP BY 1",
            ctes=_CSV_FILES,
        ),
        "export_grains": with_models(
            " UNION ALL ".join(
                f"SELECT '{g}' AS export, count(*) AS rows, CAST(sum(complaint_count) AS BIGINT) AS complaint_count, "
                f"CAST(sum(narrative_count) AS BIGINT) AS narrative_count, "
                f"CAST(sum(timely_response_count) AS BIGINT) AS timely_response_count FROM grain_{g}"
                for g in ("overview", "issues", "geography", "channels")
            )
        ),
        "manifest": with_models(
            "SELECT win.ws AS window_start, win.we AS window_end_exclusive, m.* FROM win CROSS JOIN ("
            "SELECT min(date_received) AS observed_first_date, max(date_received) AS observed_last_date, "
            "count(*) AS complaints, " + ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in FLAGS)
            + " FROM complaint_metrics) m",
            ctes=_IV,
        ),
        "display_format": with_models(
            "SELECT category, "
            + "CASE WHEN abs(v) >= 1e9 THEN printf('%.2f B', v / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.2f M', v / 1e6) "
            "WHEN abs(v) >= 1e3 AND round_even(v / 1000.0, 0) >= 1000 THEN printf('%.2f M', v / 1e6) "
            "WHEN abs(v) >= 1e3 THEN printf('%.0fK', round_even(v / 1000.0, 0)) ELSE printf('%.0f', round_even(v, 0)) END AS complaints_label, "
            + "CASE WHEN abs(t) >= 1e9 THEN printf('%.2f B', t / 1e9) WHEN abs(t) >= 1e6 THEN printf('%.2f M', t / 1e6) "
            "WHEN abs(t) >= 1e3 AND round_even(t / 1000.0, 0) >= 1000 THEN printf('%.2f M', t / 1e6) "
            "WHEN abs(t) >= 1e3 THEN printf('%.0fK', round_even(t / 1000.0, 0)) ELSE printf('%.0f', round_even(t, 0)) END AS total_label, "
            "CASE WHEN coalesce(t, 0) <> 0 THEN printf('%.2f%%', 100.0 * v / t) ELSE 'N/A' END AS share_label FROM ("
            "SELECT category, CAST(complaints AS DOUBLE) AS v, CAST(scope_total AS DOUBLE) AS t FROM ("
            + _rank("company_name", "grain_overview", FULL, None)
            + f") CROSS JOIN (SELECT CAST(SUM(complaint_count) AS BIGINT) AS scope_total FROM grain_overview WHERE {FULL}))"
        ),
    }
)

# --- representative quote (TXT-8) --------------------------------------------
# Python's look-behind sentence split becomes "mark the split points, then
# split on the mark"; word-boundary token counts become whole word-run tests.
_WRUN = "'[\\p{L}\\p{N}_]+'"


def quote_sql(text: str, concern: str) -> str:
    words = (
        f"list_filter(list_distinct(regexp_extract_all(lower({concern}), '[a-z]{{4,}}')), "
        "lambda w: NOT list_contains(['your', 'with', 'from', 'into', 'problem', 'information'], w))"
    )
    sentences = f"string_split(regexp_replace({text}, '([.!?])[{_SP}]+', '\\1' || chr(1), 'g'), chr(1))"
    scored = (
        f"list_transform({sentences}, lambda s, i: {{'score': len(list_intersect(list_distinct("
        f"regexp_extract_all(lower(s), '[a-z]{{4,}}')), {words})) - CASE WHEN regexp_matches(s, "
        f"'(?i)(^|[^{_W}])(section|usc|u\\.s\\.c|statute)([^{_W}]|$)') THEN 2 ELSE 0 END, 'neg': -i, 's': s, "
        f"'ok': length(s) BETWEEN 40 AND 420 AND len(list_filter(regexp_extract_all(s, {_WRUN}), "
        "lambda t: regexp_full_match(t, '[xX]{2,}'))) < 5})"
    )
    eligible = f"list_filter({scored}, lambda x: x.ok)"
    best = f"list_max(list_transform({eligible}, lambda x: {{'score': x.score, 'neg': x.neg, 's': x.s}}))"
    fallback = f"left({text}, 300) || CASE WHEN length({text}) > 300 THEN '…' ELSE '' END"
    return f"CASE WHEN len({eligible}) > 0 THEN ({best}).s ELSE {fallback} END"


ORACLES["representative_quote"] = with_models(
    "SELECT complaint_id, "
    + quote_sql("excerpt", "coalesce(nullif(issue, ''), 'Issue not recorded')")
    + " AS quote FROM ev",
    ctes=_CORPUS,
)

# --- SRT-5: budget shrink ----------------------------------------------------
ORACLES["evidence_budget"] = with_models(
    "SELECT complaint_id, excerpt FROM ranked WHERE pos <= (SELECT keep FROM choice)",
    ctes=_EVIDENCE
    + ", ranked AS (SELECT complaint_id, excerpt, row_number() OVER (ORDER BY md5(complaint_id), complaint_id) AS pos, "
    "sum(strlen(excerpt)) OVER (ORDER BY md5(complaint_id), complaint_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used "
    "FROM ev), total AS (SELECT count(*) AS n FROM ranked), "
    "steps AS (SELECT k, n // (2 ** k)::BIGINT AS keep FROM total, generate_series(0, 62) AS g(k) WHERE n // (2 ** k)::BIGINT > 0), "
    "fits AS (SELECT s.k, s.keep FROM steps s JOIN ranked r ON r.pos = s.keep WHERE r.used < 1000000), "
    "choice AS (SELECT keep FROM fits WHERE k <= (SELECT coalesce(min(k), 0) FROM steps WHERE keep <= 100) "
    "OR NOT EXISTS (SELECT 1 FROM steps WHERE keep <= 100) ORDER BY k LIMIT 1)",
)

# --- TF-IDF weights, themes after a fixed number of updates ---------------------
from ledgerline.plans.registry import BITMAP_QUERIES, TOPIC_UPDATES  # noqa: E402

_WEIGHTS = (
    _FRAME + ", tok AS ("
    + ORACLES["tfidf_vocabulary"].partition("tok AS (")[2].rpartition("\nSELECT CAST(row_number()")[0]
    + ", voc AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, term, df FROM ("
    "SELECT term, df, cf FROM st WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM fr) ORDER BY cf DESC, term LIMIT 4000)), "
    "x AS MATERIALIZED (SELECT complaint_id AS d, term_index AS t, w / sqrt(sum(w * w) OVER (PARTITION BY complaint_id)) AS v FROM ("
    "SELECT c.complaint_id, v.term_index, (1 + ln(c.tf)) * (ln((1.0 + n.n) / (1.0 + v.df)) + 1) AS w "
    "FROM cnt c JOIN voc v ON c.term = v.term CROSS JOIN (SELECT count(*) AS n FROM fr) n))"
)


def _start(kind: str, name: str) -> str:
    return f"(CAST('0x' || substr(md5('{kind}:' || j || ':' || {name}), 1, 6) AS BIGINT) + 1) / 16777216.0 AS v"


def _steps(updates: int) -> str:
    """The updates as matrix algebra: W (d, j) and H (j, t) after each."""
    nonzero = "CASE WHEN n.v = 0 THEN 1.1920928955078125e-07 ELSE n.v END"
    out = [
        "ks AS (SELECT unnest(generate_series(0, least(6, (SELECT count(*) FROM voc), (SELECT count(*) FROM fr) - 1) - 1)) AS j)",
        f"w0 AS MATERIALIZED (SELECT d, j, {_start('w', 'd')} FROM (SELECT DISTINCT d FROM x), ks)",
        f"h0 AS MATERIALIZED (SELECT j, term_index AS t, {_start('h', 'term_index')} FROM voc, ks)",
    ]
    for i in range(updates + 1):
        out += [
            f"hh{i} AS MATERIALIZED (SELECT p.j AS a, q.j AS b, sum(p.v * q.v) AS v FROM h{i} p JOIN h{i} q USING (t) GROUP BY 1, 2)",
            f"xh{i} AS MATERIALIZED (SELECT x.d, h.j, sum(x.v * h.v) AS v FROM x JOIN h{i} h USING (t) GROUP BY 1, 2)",
            f"wo{i} AS (SELECT p.j AS a, q.j AS b, sum(p.v * q.v) AS v FROM w{i} p JOIN w{i} q USING (d) GROUP BY 1, 2)",
            f"er{i} AS (SELECT sqrt(greatest(0, (SELECT sum(v * v) FROM x) - 2 * (SELECT sum(w.v * xh.v) FROM w{i} w JOIN xh{i} xh USING (d, j)) "
            f"+ (SELECT sum(wo.v * hh.v) FROM wo{i} wo JOIN hh{i} hh USING (a, b)))) AS error)",
        ]
        if i < updates:
            n = i + 1
            out += [
                f"wn{i} AS (SELECT w.d, hh.b AS j, sum(w.v * hh.v) AS v FROM w{i} w JOIN hh{i} hh ON w.j = hh.a GROUP BY 1, 2)",
                f"w{n} AS MATERIALIZED (SELECT w.d, w.j, w.v * (xh.v / {nonzero}) AS v FROM w{i} w JOIN xh{i} xh USING (d, j) JOIN wn{i} n USING (d, j))",
                f"wx{i} AS (SELECT w.j, x.t, sum(w.v * x.v) AS v FROM w{n} w JOIN x USING (d) GROUP BY 1, 2)",
                f"ww{i} AS (SELECT p.j AS a, q.j AS b, sum(p.v * q.v) AS v FROM w{n} p JOIN w{n} q USING (d) GROUP BY 1, 2)",
                f"hn{i} AS (SELECT ww.a AS j, h.t, sum(ww.v * h.v) AS v FROM ww{i} ww JOIN h{i} h ON ww.b = h.j GROUP BY 1, 2)",
                f"h{n} AS MATERIALIZED (SELECT h.j, h.t, h.v * (wx.v / {nonzero}) AS v FROM h{i} h JOIN wx{i} wx USING (j, t) JOIN hn{i} n USING (j, t))",
            ]
    last = updates
    out += [
        f"top AS (SELECT d, v, CASE WHEN total > 0 THEN j ELSE -1 END AS topic FROM (SELECT *, sum(v) OVER (PARTITION BY d) AS total, "
        f"row_number() OVER (PARTITION BY d ORDER BY v DESC, j) AS place FROM w{last}) r WHERE place = 1)",
        "asg AS MATERIALIZED (SELECT fr.*, CAST(coalesce(top.topic, -1) AS INTEGER) AS topic, round(coalesce(top.v, 0.0), 7) AS weight, "
        "coalesce(nullif(issue, ''), 'Issue not recorded') AS concern FROM fr LEFT JOIN top ON fr.complaint_id = top.d)",
        f"lab AS MATERIALIZED (SELECT CAST(j AS INTEGER) AS topic, string_agg(term, ' · ' ORDER BY v DESC, t DESC) AS theme FROM ("
        f"SELECT h.j, h.t, h.v, voc.term, row_number() OVER (PARTITION BY h.j ORDER BY h.v DESC, h.t DESC) AS place "
        f"FROM h{last} h JOIN voc ON voc.term_index = h.t) r WHERE place <= 4 GROUP BY j)",
    ]
    return ", ".join(out)


_ASSIGNED = _WEIGHTS + ", " + _steps(TOPIC_UPDATES)
ORACLES.update(
    {
        "tfidf_weights": with_models(
            "SELECT d AS complaint_id, t AS term_index, round(v, 9) AS weight FROM x", ctes=_WEIGHTS
        ),
        "topic_steps": with_models("SELECT complaint_id, period, topic, weight FROM asg", ctes=_ASSIGNED),
        "topic_components": with_models(
            "SELECT CAST(h.j AS INTEGER) AS topic, h.t AS term_index, voc.term, round(h.v, 7) AS weight "
            f"FROM h{TOPIC_UPDATES} h JOIN voc ON voc.term_index = h.t",
            ctes=_ASSIGNED,
        ),
        "topic_objective": with_models(
            "SELECT CAST(step AS INTEGER) AS step, round(error, 6) AS error, coalesce(error <= lag(error) OVER (ORDER BY step), true) AS not_higher FROM ("
            + " UNION ALL ".join(f"SELECT {i} AS step, error FROM er{i}" for i in range(TOPIC_UPDATES + 1))
            + ")",
            ctes=_ASSIGNED,
        ),
        "topic_labels": with_models("SELECT topic, theme FROM lab", ctes=_ASSIGNED),
        "topics": "WITH RECURSIVE "
        + with_models(
            "SELECT period, topic, count(*) AS narratives, round(sum(weight), 4) AS weight, round(max(weight), 6) AS strongest FROM ("
            "SELECT fr.period, CAST(coalesce(best.topic, -1) AS INTEGER) AS topic, coalesce(best.v, 0.0) AS weight FROM fr LEFT JOIN best ON fr.complaint_id = best.d) "
            "GROUP BY 1, 2",
            ctes=_WEIGHTS + ", " + themes.fitted()
            + ", best AS (SELECT d, v, CASE WHEN total > 0 THEN j ELSE -1 END AS topic FROM (SELECT d, j, v, sum(v) OVER (PARTITION BY d) AS total, "
            "row_number() OVER (PARTITION BY d ORDER BY v DESC, j) AS place FROM fit WHERE it = (SELECT it FROM ended) AND d IS NOT NULL) r WHERE place = 1)",
        ).removeprefix("WITH "),
        "theme_summary": with_models(
            "SELECT p.topic, lab.theme, p.narratives, 100.0 * p.narratives / t.n_sel AS share_pct, "
            "CASE WHEN t.n_sel >= 50 AND t.n_pre >= 50 AND p.narratives >= 10 AND p.prior >= 10 "
            "THEN 100.0 * p.narratives / t.n_sel - 100.0 * p.prior / t.n_pre END AS change_pp FROM "
            "(SELECT topic, count(*) FILTER (WHERE period = 'Selected') AS narratives, "
            "count(*) FILTER (WHERE period = 'Previous') AS prior FROM asg GROUP BY 1) p "
            "JOIN lab USING (topic) CROSS JOIN (SELECT count(*) FILTER (WHERE period = 'Selected') AS n_sel, "
            "count(*) FILTER (WHERE period = 'Previous') AS n_pre FROM asg) t WHERE p.narratives > 0",
            ctes=_ASSIGNED,
        ),
        "phrase_mentions": with_models(
            "SELECT a.topic, CAST(w.position AS INTEGER) AS position, w.term, count(*) FILTER (WHERE regexp_matches("
            "lower(a.excerpt), '(^|[^\\p{L}\\p{N}_])' || w.term || '($|[^\\p{L}\\p{N}_])')) AS mentions "
            "FROM asg a JOIN (SELECT topic, generate_subscripts(string_split(theme, ' · '), 1) - 1 AS position, "
            "unnest(string_split(theme, ' · ')) AS term FROM lab) w USING (topic) WHERE a.period = 'Selected' GROUP BY ALL",
            ctes=_ASSIGNED,
        ),
        "best_evidence": with_models(
            "SELECT concern, complaint_id, date_received, " + quote_sql("excerpt", "concern") + " AS quote FROM ("
            "SELECT *, row_number() OVER (PARTITION BY concern ORDER BY weight DESC, complaint_id) AS place "
            "FROM asg WHERE period = 'Selected') WHERE place = 1",
            ctes=_ASSIGNED,
        ),
        "evidence_topk": with_models(
            "SELECT complaint_id, date_received, company_name, product, issue, topic, weight FROM asg "
            "WHERE period = 'Selected' AND concern = 'BUILDING' AND topic = 2 AND contains(lower(excerpt), 'the') "
            "ORDER BY weight DESC, complaint_id LIMIT 5",
            ctes=_ASSIGNED,
        ),
    }
)

# --- identities ------------------------------------------------------------------
_GRAIN_COLUMNS = {
    "overview": "date_received company_id company_name product_category_id product sub_product",
    "issues": "date_received company_id company_name product_category_id product sub_product issue sub_issue",
    "geography": "date_received company_id company_name product_category_id product sub_product state",
    "channels": "date_received company_id company_name product_category_id product sub_product submission_channel",
}


def fingerprint_sql(grain: str) -> str:
    columns = [*_GRAIN_COLUMNS[grain].split(), *FLAGS]
    text = " || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0)) || chr(31)" for c in columns)
    return (
        f"SELECT CAST(count(*) AS VARCHAR) || ':' || CAST(coalesce(sum(CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)), 0) AS VARCHAR) "
        f"AS fingerprint FROM grain_{grain}"
    )


ORACLES["snapshot_identity"] = with_models(fingerprint_sql("overview"))
ORACLES["manifest_exports"] = with_models(
    " UNION ALL ".join(f"SELECT '{g}' AS export, fingerprint FROM ({fingerprint_sql(g)})" for g in _GRAIN_COLUMNS)
)

# --- Step 12: sources, sinks and gates ---------------------------------------------
ORACLES.update(
    {
        "parquet_parts": (
            "WITH both_ AS (SELECT lang, text, NULL AS quality FROM documents UNION ALL SELECT NULL, NULL, quality FROM labels) "
            "SELECT lang, count(*) AS rows, count(text) AS rows_with_text, count(quality) AS rows_with_quality FROM both_ GROUP BY 1"
        ),
        "column_gate": with_models(
            " UNION ALL ".join(
                f"SELECT '{f}' AS field, list_contains((SELECT json_keys(to_json(i)) FROM (SELECT * FROM incoming LIMIT 1) i), '{f}') AS present, "
                + (f"(SELECT count(*) FROM incoming WHERE coalesce(trim(\"{f}\"), '') = '')" if f in _BLANK_FIELDS else "CAST(NULL AS BIGINT)")
                + " AS blank_records"
                for f in __import__("ledgerline.schema", fromlist=["x"]).RAW_FIELDS
            )
        ),
        "verified_parquet": with_models("SELECT * FROM companies"),
        "csv_report": with_models(_rank("product", "grain_overview", FULL, None)),
        "metric_columns": with_models(
            " UNION ALL ".join(f"SELECT '{f}' AS metric, CAST(sum({f}) AS BIGINT) AS total FROM grain_overview" for f in FLAGS)
        ),
        "named_views": with_models("SELECT product, count(*) AS complaints FROM complaint_metrics GROUP BY 1"),
        "snapshot_gate": with_models(
            f"SELECT v.overview, v.fingerprint = cut.fingerprint AS compatible, (SELECT count(*) FROM grain_overview) AS overview_rows FROM ("
            f"SELECT 'own' AS overview, fingerprint FROM ({fingerprint_sql('overview')}) a UNION ALL "
            f"SELECT 'other', fingerprint FROM ({fingerprint_sql('overview')} WHERE complaint_count > 1) b) v "
            f"CROSS JOIN ({fingerprint_sql('overview')}) cut"
        ),
        # a stored row takes at least a byte, and less than ten times its text
        "size_gate": with_models(
            "SELECT count(*) AS rows, coalesce(sum(10 * length(CAST(g AS VARCHAR))), 0) < 1000000000000 AS within_large_limit, "
            "count(*) < 1 AS within_one_byte FROM grain_channels g"
        ),
        **{
            f"company_bitmaps_{name}": with_models(
                f"SELECT {', '.join(by)}, count(DISTINCT company_name) AS company_count FROM grain_{grain} WHERE {where} GROUP BY ALL"
                if by
                else f"SELECT count(DISTINCT company_name) AS company_count FROM grain_{grain} WHERE {where}"
            )
            for name, (grain, by, where) in BITMAP_QUERIES.items()
        },
        "inspect_datasets": with_models(
            " UNION ALL ".join(
                f"SELECT '{g}' AS dataset, count(*) AS rows, min(date_received) AS first_date, max(date_received) AS last_date, "
                f"CAST({len(_MQ_EXPR)} AS BIGINT) AS metrics, CAST(50 AS BIGINT) AS row_limit FROM grain_{g}"
                for g in _GRAIN_COLUMNS
            )
        ),
    }
)
