"""Registered queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame.

Each entry runs one operator (or model) of the inventory over the whole
input; ``oracles/sql.py`` holds the DuckDB SQL of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window

from ledgerline.plans.warehouse import for_testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _model(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return for_testdata(spark, sf_dir)[name]

    return run


# Step 1-5: the model graph itself, one query per model.
MODEL_QUERIES = {
    "bronze_complaints": "bronze_complaints",
    "stg_complaints": "stg_complaints",
    "stg_keyed": "stg_complaints_keyed",
    "stg_tags": "stg_complaint_tags",
    "silver_companies": "companies",
    "silver_product_categories": "product_categories",
    "silver_issue_categories": "issue_categories",
    "silver_submission_channels": "submission_channels",
    "silver_complaints": "complaints",
    "silver_complaint_narratives": "complaint_narratives",
    "silver_tags": "tags",
    "silver_complaint_tags": "complaint_tags",
    "gold_complaint_metrics": "complaint_metrics",
    "gold_narrative_docs": "narrative_search_documents",
    "dim_company": "dim_company",
    "dim_product": "dim_product",
    "dim_issue": "dim_issue",
    "dim_submission_channel": "dim_submission_channel",
    "dim_geography": "dim_geography",
    "dim_response": "dim_response",
    "dim_date": "dim_date",
    "fact_complaints": "fact_complaints",
    "grain_overview": "grain_overview",
    "grain_issues": "grain_issues",
    "grain_geography": "grain_geography",
    "grain_channels": "grain_channels",
}
for _q, _m in MODEL_QUERIES.items():
    QUERIES[_q] = _model(_m)


# Step 5: quality suite and cross-grain invariant.
def _qa(layer: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ledgerline.plans import quality

        return quality.run_layer(for_testdata(spark, sf_dir), layer)

    return run


for _layer in ("staging", "silver", "gold", "star"):
    QUERIES[f"qa_{_layer}"] = _qa(_layer)


@register("grain_invariant")
def _grain_invariant(spark, sf_dir):
    from ledgerline.plans import quality

    return quality.grain_totals(for_testdata(spark, sf_dir))


# Step 7: dashboard analytics.  Scopes are feature parameters: the whole
# snapshot, a product selection, and one calendar year with its prior year.
import datetime as _dt
import uuid as _uuid  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from ledgerline.functions.keys import surrogate_key  # noqa: E402
from ledgerline.plans import analytics as A  # noqa: E402
from ledgerline.plans.scope import Scope  # noqa: E402

FULL = Scope()  # every row, dated or not
PRODUCTS = Scope(products=("ECONOMY", "PROMO"))
YEAR = Scope(_dt.date(1999, 1, 1), _dt.date(1999, 12, 31))


def _g(spark, sf_dir, dataset="overview"):
    return for_testdata(spark, sf_dir).grain(dataset)


QUERIES.update(
    {
        "headline": lambda s, d: A.headline(_g(s, d), FULL),
        "headline_products": lambda s, d: A.headline(_g(s, d), PRODUCTS),
        "trend_month": lambda s, d: A.trend(_g(s, d), FULL, "month"),
        "trend_week": lambda s, d: A.trend(_g(s, d), PRODUCTS, "week"),
        "trend_day": lambda s, d: A.trend(_g(s, d), YEAR, "day"),
        "weekly_report": lambda s, d: A.weekly_report(_g(s, d), FULL),
        "rank_company": lambda s, d: A.rank(_g(s, d), FULL, "company_name", limit=15),
        "rank_product": lambda s, d: A.rank(_g(s, d), FULL, "product", limit=5),
        "rank_issue": lambda s, d: A.rank(_g(s, d, "issues"), FULL, "issue"),
        "rank_sub_issue": lambda s, d: A.rank(_g(s, d, "issues"), FULL, "sub_issue"),
        "rank_channel": lambda s, d: A.rank(_g(s, d, "channels"), FULL, "submission_channel"),
        "rank_state": lambda s, d: A.rank(_g(s, d, "geography"), FULL, "state", limit=100),
        "issue_drilldown": lambda s, d: A.issue_drilldown(_g(s, d, "issues"), FULL, "BUILDING"),
        "top5_share": lambda s, d: A.top_share(_g(s, d), FULL, "company_name", 5),
        "company_comparison": lambda s, d: A.company_comparison(_g(s, d), FULL),
        "product_share": lambda s, d: A.product_share(_g(s, d), PRODUCTS),
        "outcome_mix": lambda s, d: A.outcome_mix(_g(s, d), FULL),
        "response_rates": lambda s, d: A.response_rates(_g(s, d), FULL),
        "location_totals": lambda s, d: A.location_totals(_g(s, d, "geography"), FULL),
        "prior_period": lambda s, d: A.prior_period(_g(s, d), YEAR),
        "filter_companies": lambda s, d: A.filter_options(_g(s, d), "company_name"),
        "filter_sub_products": lambda s, d: A.filter_options(_g(s, d), "sub_product", ("ECONOMY",)),
    }
)


@register("tag_filter_semi")
def _tag_filter_semi(spark, sf_dir):
    """Complaints carrying tag 'R', by product, without multiplying rows (JOIN-8)."""
    w = for_testdata(spark, sf_dir)
    tagged = w["complaint_tags"].filter(F.col("tag_id") == surrogate_key(F.lit("R")))
    return (
        w["complaint_metrics"]
        .join(tagged, "complaint_id", "left_semi")
        .groupBy("product")
        .agg(F.sum("complaint_count").alias("complaints"))
    )


@register("star_role_dates")
def _star_role_dates(spark, sf_dir):
    """Star query with dim_date in two roles, received and sent (JOIN-10)."""
    w = for_testdata(spark, sf_dir)
    r = w["dim_date"].select(F.col("date_key").alias("r_key"), F.col("iso_year").alias("received_iso_year"))
    s = w["dim_date"].select(F.col("date_key").alias("s_key"), F.col("is_weekend").alias("sent_on_weekend"))
    return (
        w["fact_complaints"]
        .join(r, F.col("received_date_key") == F.col("r_key"))
        .join(s, F.col("sent_date_key") == F.col("s_key"))
        .groupBy("received_iso_year", "sent_on_weekend")
        .agg(
            F.sum("complaint_count").alias("complaints"),
            F.sum("sent_before_received_count").alias("sent_before_received"),
        )
    )


@register("gold_summary")
def _gold_summary(spark, sf_dir):
    m = for_testdata(spark, sf_dir)["complaint_metrics"]
    return m.agg(
        F.count(F.lit(1)).alias("complaints"),
        F.sum("complaint_count").alias("complaint_count_total"),
        F.sum("narrative_count").alias("complaints_with_narrative"),
        F.sum("timely_response_count").alias("timely_responses"),
        F.sum("not_timely_response_count").alias("not_timely_responses"),
        F.sum("known_timeliness_count").alias("known_timeliness"),
        F.sum("unknown_response_outcome_count").alias("missing_response_outcomes"),
    )


# Step 8: governed metric query.
from ledgerline.plans import metric_query as MQ  # noqa: E402

MQ_REQUESTS = {
    "mq_basic": MQ.MetricRequest(
        "overview", ("product",), ("complaint_count", "timely_response_rate"), order_by="complaint_count"
    ),
    "mq_period": MQ.MetricRequest(
        "overview",
        ("period",),
        ("complaint_count", "narrative_coverage", "monetary_relief_share"),
        interval="quarter",
        start_date="1996-01-01",
        end_date="2000-12-31",
        order_by="period",
        descending=False,
        limit=50,
    ),
    "mq_null_filter": MQ.MetricRequest(
        "issues",
        ("issue",),
        ("complaint_count", "company_count", "non_monetary_relief_share"),
        filters=(("issue", (None, "BUILDING")),),
        order_by="issue",
        descending=False,
    ),
    "mq_truncated": MQ.MetricRequest(
        "geography",
        ("state", "product"),
        ("complaint_count", "missing_zip_count"),
        filters=(("product", ("ECONOMY", "STANDARD")),),
        order_by="complaint_count",
        limit=5,
    ),
    "mq_totals": MQ.MetricRequest(
        "channels", (), ("complaint_count", "timely_response_rate", "company_count"), order_by="complaint_count"
    ),
}
for _name, _req in MQ_REQUESTS.items():
    QUERIES[_name] = (lambda req: lambda s, d: MQ.query_metrics(_g(s, d, req.dataset), FULL, req))(_req)

QUERIES["dataset_bounds"] = lambda s, d: MQ.dataset_bounds(_g(s, d))


# Ranges from running totals (AGG-13, AGG-14, AGG-22): two days instead of a scan.
ODD_RANGE = Scope(_dt.date(1996, 5, 17), _dt.date(1998, 2, 3), products=("ECONOMY", "PROMO"))


def _running(spark, sf_dir):
    from ledgerline.operators import cumulative

    w = for_testdata(spark, sf_dir)
    return w.derived("running_totals", lambda: cumulative.build(w.grain("overview"), ("product", "sub_product")))


def _range_headline(scope):
    from ledgerline.operators import cumulative

    return lambda s, d: A.headline(cumulative.between(_running(s, d), scope.start, scope.end), scope)


def _range_trend(scope, interval):
    from ledgerline.operators import cumulative

    labels = Scope(products=scope.products)
    return lambda s, d: A.trend(cumulative.buckets(_running(s, d), scope.start, scope.end, interval), labels, interval)


def _range_prior(spark, sf_dir):
    from ledgerline.operators import cumulative

    table, prior = _running(spark, sf_dir), YEAR.prior()
    both = cumulative.between(table, YEAR.start, YEAR.end).unionByName(cumulative.between(table, prior.start, prior.end))
    return A.prior_period(both, YEAR, coverage_start=cumulative.bounds(table)[0])


QUERIES.update(
    {
        "range_headline": _range_headline(YEAR),
        "range_headline_products": _range_headline(ODD_RANGE),
        "range_trend_month": _range_trend(ODD_RANGE, "month"),
        "range_trend_week": _range_trend(YEAR, "week"),
        "range_prior_period": _range_prior,
    }
)


# Distinct companies from bitmaps (AGG-4): name -> grain, groups, filter.
BITMAP_QUERIES = {
    "all": ("overview", (), "true"),
    "product": ("overview", ("product",), "date_received >= DATE '1995-03-15'"),
    "state": ("geography", ("state", "product"), "product IN ('ECONOMY', 'STANDARD') OR state = 'TX'"),
}


def _company_bitmaps(name):
    from ledgerline.operators import bitmaps

    grain, by, where = BITMAP_QUERIES[name]

    def run(spark, sf_dir):
        w = for_testdata(spark, sf_dir)
        source = w.grain(grain)
        table = w.derived(f"company_bitmaps_{grain}", lambda: bitmaps.build(source, "company_name", drop=("company_id",), numbers=_company_numbers(w)))
        return bitmaps.count_distinct(table.filter(where), by, "company_count")

    return run


def _company_numbers(w):
    from ledgerline.operators import bitmaps

    return w.derived("company_numbers", lambda: bitmaps.number_labels(w["companies"], "company_name"))


QUERIES.update({f"company_bitmaps_{name}": _company_bitmaps(name) for name in BITMAP_QUERIES})


# Step 9: narratives (deterministic part).  Search, concerns and themes read
# every narrative whole.  Sample sizes belong to the sampling operators only:
# 500 of the sf0.01 corpus of 1,000 exercises the hash threshold, 60,000 is
# the export size.
from ledgerline.plans import narratives as N  # noqa: E402
from ledgerline.functions.text import redact as _redact  # noqa: E402

SAMPLE_ROWS = 500
EVIDENCE_ROWS = 60000


def _evidence(spark, sf_dir):
    w = for_testdata(spark, sf_dir)
    return w.derived(
        "evidence_export",
        lambda: N.evidence_export(
            w["complaint_metrics"], w["complaint_narratives"], w.grain("overview"), EVIDENCE_ROWS
        ),
    )


def _corpus(spark, sf_dir):
    """Every narrative, whole."""
    w = for_testdata(spark, sf_dir)
    return w.derived("narrative_corpus", lambda: N.corpus(w["complaint_metrics"], w["complaint_narratives"]))


def _two_periods(spark, sf_dir):
    w = for_testdata(spark, sf_dir)
    first = w.grain("overview").agg(F.min("date_received")).first()[0]
    return N.two_periods(_corpus(spark, sf_dir), YEAR, cap=None, coverage_start=first)


@register("redact_documents")
def _redact_documents(spark, sf_dir):
    from ledgerline.sources.testdata import read_table

    return read_table(spark, sf_dir, "documents").select("doc_id", _redact("text").alias("redacted"))


@register("redact_conversations")
def _redact_conversations(spark, sf_dir):
    from ledgerline.sources.testdata import read_table

    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", _redact("text").alias("redacted")
    )


@register("excerpt")
def _excerpt(spark, sf_dir):
    from ledgerline.functions.text import excerpt

    n = for_testdata(spark, sf_dir)["complaint_narratives"]
    text, truncated = excerpt("narrative")
    return n.select("complaint_id", text.alias("excerpt"), truncated.alias("excerpt_truncated"))


@register("hash_sample")
def _hash_sample(spark, sf_dir):
    w = for_testdata(spark, sf_dir)
    return N.hash_sample_context(w["complaint_metrics"], w["complaint_narratives"], SAMPLE_ROWS)


@register("evidence_export")
def _evidence_export(spark, sf_dir):
    return _evidence(spark, sf_dir).drop("overview_fingerprint")


@register("evidence_reconcile")
def _evidence_reconcile(spark, sf_dir):
    w = for_testdata(spark, sf_dir)
    return N.reconcile_evidence(w["complaint_metrics"], w["complaint_narratives"], w.grain("overview"))


@register("narrative_search")
def _narrative_search(spark, sf_dir):
    return N.search(_corpus(spark, sf_dir), FULL, "the", issue="BUILDING", limit=8)


@register("narrative_search_indexed")
def _narrative_search_indexed(spark, sf_dir):
    """The same kind of search through the index of three-character runs."""
    from ledgerline.operators import phrase_index

    w = for_testdata(spark, sf_dir)
    texts = _corpus(spark, sf_dir)
    index = w.memo("__phrase_index", lambda: phrase_index.build(texts, "complaint_id", "excerpt", f"{w.store}/phrase-index-{_uuid.uuid4().hex}"))
    return N.search(texts, FULL, SEARCHED, limit=8, index=index)


#: Words that some narratives hold next to each other.
SEARCHED = "in the"


@register("match_gate")
def _match_gate(spark, sf_dir):
    return N.match_gate(_corpus(spark, sf_dir), YEAR)


@register("concern_summary")
def _concern_summary(spark, sf_dir):
    return N.concern_summary(_two_periods(spark, sf_dir))


@register("briefing_facts")
def _briefing_facts(spark, sf_dir):
    return N.briefing_facts(N.concern_summary(_two_periods(spark, sf_dir)))


@register("largest_changes")
def _largest_changes(spark, sf_dir):
    return N.largest_changes(N.concern_summary(_two_periods(spark, sf_dir)))


@register("review_question")
def _review_question(spark, sf_dir):
    return N.questions(N.concern_summary(_two_periods(spark, sf_dir)))


@register("representative_quote")
def _representative_quote(spark, sf_dir):
    from ledgerline.operators.quote import representative_quote

    return _corpus(spark, sf_dir).select(
        "complaint_id",
        representative_quote(F.col("excerpt"), N.concern_column()).alias("quote"),
    )


# Step 10: TF-IDF and NMF themes.  ``topics`` is the whole method: the fitted
# start and updates until the error rests.  The steps' queries, and the readers
# of their assignment, use a fixed number of updates from the hash start.
TOPIC_UPDATES = 3


def _fitted(spark, sf_dir):
    from ledgerline.plans import topics as T

    w = for_testdata(spark, sf_dir)
    return w.derived("fitted_themes", lambda: T.discover(_two_periods(spark, sf_dir))[0].select("complaint_id", "period", "topic", "weight"))


def _themes(spark, sf_dir):
    from ledgerline.plans import topics as T

    w = for_testdata(spark, sf_dir)

    def build():
        found = T.topic_steps(_two_periods(spark, sf_dir), TOPIC_UPDATES)
        # all parts come from one run and are stored together
        return T.TopicSteps(*[w.derived(f"theme_{name}", lambda part=part: part) for name, part in zip(found._fields, found)])

    return w.memo("__themes", build)


def _assigned(spark, sf_dir):
    found = _themes(spark, sf_dir)
    return found.assigned.withColumn("weight", F.round("weight", 7)), found.labels


def _tfidf(spark, sf_dir):
    from ledgerline.operators import tfidf

    return tfidf.fit(_two_periods(spark, sf_dir))


@register("tfidf_vocabulary")
def _tfidf_vocabulary(spark, sf_dir):
    return _tfidf(spark, sf_dir).vocabulary


@register("tfidf_weights")
def _tfidf_weights(spark, sf_dir):
    """L2-normalised weights of every document, to nine digits (TXT-4)."""
    return _tfidf(spark, sf_dir).weights.select(
        F.col("doc_id").alias("complaint_id"), "term_index", F.round("weight", 9).alias("weight")
    )


@register("topic_steps")
def _topic_steps(spark, sf_dir):
    """Each narrative's theme and weight after the updates (TXT-5, TXT-6)."""
    return _assigned(spark, sf_dir)[0].select("complaint_id", "period", "topic", "weight")


@register("topic_components")
def _topic_components(spark, sf_dir):
    """The terms' weights in each theme after the updates (TXT-5)."""
    return _themes(spark, sf_dir).components.withColumn("weight", F.round("weight", 7))


@register("topic_objective")
def _topic_objective(spark, sf_dir):
    """Distance of the matrix and its factors before each update and after the
    last; no update raises it (TXT-5)."""
    found = _themes(spark, sf_dir).objective
    before = F.lag("error").over(Window.orderBy("step"))  # one row per update
    return found.select("step", F.round("error", 6).alias("error"), F.coalesce(F.col("error") <= before, F.lit(True)).alias("not_higher"))


@register("topic_labels")
def _topic_labels(spark, sf_dir):
    """Each theme's four heaviest terms (TXT-7)."""
    return _themes(spark, sf_dir).labels


@register("topics")
def _topics(spark, sf_dir):
    """Narratives and their weight per period and theme, of themes fitted by the
    whole method: NNDSVDa start, updates until the error rests (TXT-5, TXT-6)."""
    return _fitted(spark, sf_dir).groupBy("period", "topic").agg(
        F.count(F.lit(1)).alias("narratives"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.max("weight"), 6).alias("strongest")
    )


@register("theme_summary")
def _theme_summary(spark, sf_dir):
    return N.theme_summary(*_assigned(spark, sf_dir))


@register("phrase_mentions")
def _phrase_mentions(spark, sf_dir):
    from ledgerline.plans import topics as T

    return T.phrase_mentions(*_assigned(spark, sf_dir))


@register("best_evidence")
def _best_evidence(spark, sf_dir):
    return N.best_evidence(_assigned(spark, sf_dir)[0])


@register("evidence_topk")
def _evidence_topk(spark, sf_dir):
    assigned, _ = _assigned(spark, sf_dir)
    return N.evidence_list(assigned, "BUILDING", topic=2, phrase="the", k=5).select(
        "complaint_id", "date_received", "company_name", "product", "issue", "topic", "weight"
    )


# Step 6: bronze ingest, dedup, retention, coverage and profiling on the raw
# (string) rows of both releases.
from ledgerline.plans import bronze as B  # noqa: E402
from ledgerline.plans import coverage as C  # noqa: E402
from ledgerline.plans import profile as P  # noqa: E402


def _raw(spark, sf_dir):
    return for_testdata(spark, sf_dir)["incoming"]


RETENTION = (_dt.date(1996, 1, 1), _dt.date(2000, 1, 1))

QUERIES.update(
    {
        "overlap_excess": lambda s, d: P.overlap_excess(_raw(s, d)),
        "validity_gate": lambda s, d: __import__("ledgerline.sources.raw", fromlist=["x"]).validity_counts(_raw(s, d)),
        "retention_window": lambda s, d: B.dedup_latest(B.retain_window(_raw(s, d), *RETENTION))
        .groupBy("_source_archive")
        .agg(F.count(F.lit(1)).alias("rows")),
        "profile_quality": lambda s, d: P.overall_quality(_raw(s, d)),
        "profile_yearly": lambda s, d: P.yearly_coverage(_raw(s, d)),
        "profile_duplicates": lambda s, d: P.duplicate_ids(_raw(s, d)),
        "profile_blanks": lambda s, d: P.blanks_by_field(_raw(s, d)),
        "profile_top_values": lambda s, d: P.top_values(_raw(s, d)),
        "source_inventory": lambda s, d: P.source_inventory(_raw(s, d)),
        "month_coverage": lambda s, d: C.month_coverage(C.intervals_from_rows(_raw(s, d))),
        "interval_selection": lambda s, d: C.select_intervals(C.intervals_from_rows(_raw(s, d))),
    }
)


def _releases(spark, sf_dir):
    """The archives as a first release and the revision as a second one, merged
    in that order."""
    from ledgerline.plans.releases import ReleaseStore
    from ledgerline.session import shared_path

    def build():
        store = ReleaseStore(spark, shared_path(spark, "ledgerline-releases", _uuid.uuid4().hex))
        raw = _raw(spark, sf_dir)
        for priority in (1, 2):
            store.merge(raw.filter(F.col("_source_priority") == priority))
        return store

    return for_testdata(spark, sf_dir).memo("__releases", build)


@register("release_bronze")
def _release_bronze(spark, sf_dir):
    """Bronze after both merges (WIN-1)."""
    return _releases(spark, sf_dir).bronze()


@register("release_grains")
def _release_grains(spark, sf_dir):
    """The channels grain after the signed change of the second merge (AGG-2d)."""
    return _releases(spark, sf_dir).grain("channels")


@register("release_changes")
def _release_changes(spark, sf_dir):
    """Rows that arrived and left and months written anew in each version."""
    store = _releases(spark, sf_dir)
    rows = []
    for v in store.versions():
        c = store.manifest(v)["changes"]
        rows.append((v, c["arrived"], c["left"], len(c["months"])))
    return spark.createDataFrame(rows, "version int, arrived long, left_rows long, months_written int")


@register("source_dedup")
def _source_dedup(spark, sf_dir):
    """Exact-copy documents: each skipped copy with the first (lowest id) kept."""
    from ledgerline.sources.testdata import read_table

    docs = read_table(spark, sf_dir, "documents")
    return P.signature_duplicates(docs, "doc_id", [F.col("text")])


#: Rows of one exported CSV file, about.
CSV_ROWS = 20_000


def _csv_export(spark, sf_dir):
    """The raw rows as CSV files, read back with record numbers (SRC-2, SRC-5,
    WIN-3).  A large archive becomes several files: as many buckets of the ID's
    md5 as its rows need, each sorted by ID.  Any of them may be read by
    several tasks."""
    from ledgerline.schema import RAW_FIELDS
    from ledgerline.session import freed_shuffles
    from ledgerline.sources import csv_ranges

    w = for_testdata(spark, sf_dir)

    def build():
        with freed_shuffles(spark):  # the rows' shuffle is gone when the files are read
            return export()

    def export():
        path = f"{w.store}/csv_export-{_uuid.uuid4().hex}"
        raw = _raw(spark, sf_dir)
        files = raw.groupBy("_source_archive").agg((F.floor(F.count(F.lit(1)) / CSV_ROWS) + 1).alias("files"))
        number = F.conv(F.substring(F.md5("Complaint ID"), 1, 8), 16, 10).cast("long")
        (
            raw.select(*[F.col(f"`{c}`") for c in RAW_FIELDS], "_source_archive")
            .join(F.broadcast(files), "_source_archive")  # one row per archive
            .withColumn("bucket", F.pmod(number, F.col("files")))
            .drop("files")
            .repartition("_source_archive", "bucket")
            .sortWithinPartitions("_source_archive", "bucket", "Complaint ID", F.md5("Consumer complaint narrative"))
            .write.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("compression", "bzip2")  # a fraction of the bytes, and still read in ranges
            .partitionBy("_source_archive", "bucket")
            .csv(path)
        )
        back = csv_ranges.read_csv_numbered(spark, path)
        return back.select(
            F.url_decode(F.regexp_extract("_source_file", "_source_archive=([^/]+)", 1)).alias("_source_archive"),
            F.regexp_extract("_source_file", "bucket=([0-9]+)", 1).cast("long").alias("bucket"),
            F.col("Complaint ID").alias("complaint_id"),
            F.col("_source_record_number").alias("record_number"),
            F.col("Consumer complaint narrative").alias("narrative"),
        )

    return w.memo("__csv_export", build)


@register("csv_records")
def _csv_records(spark, sf_dir):
    """Every record of the exported files with its number."""
    rows = _csv_export(spark, sf_dir)
    return rows.withColumn("narrative_md5", F.md5("narrative")).drop("narrative")


@register("csv_roundtrip")
def _csv_roundtrip(spark, sf_dir):
    """Counts of the records read back, and whether the numbers of each file
    run from 1 to its rows."""
    n = F.col("record_number")
    per_file = _csv_export(spark, sf_dir).groupBy("_source_archive", "bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(n).alias("first"),
        F.max(n).alias("last"),
        F.sum(n).alias("total"),
        F.count_if(F.trim("narrative") != "").alias("narratives"),
    )
    # Numbers 1..rows of a file, each once: right ends and the right sum.
    exact = (F.col("first") == 1) & (F.col("last") == F.col("rows")) & (F.col("total") * 2 == F.col("rows") * (F.col("rows") + 1))
    return per_file.groupBy("_source_archive").agg(
        F.sum("rows").alias("rows"),
        F.min("first").alias("first_record"),
        F.sum("last").alias("records_numbered"),
        F.bool_and(exact).alias("numbers_exact"),
        F.sum("narratives").alias("rows_with_narrative"),
    )


# Step 11: sinks and manifest.
@register("export_grains")
def _export_grains(spark, sf_dir):
    from ledgerline.sources import sinks

    w = for_testdata(spark, sf_dir)
    base = w.store
    names = ("overview", "issues", "geography", "channels")
    written = sinks.export_grains(w["complaint_metrics"], {f"export_{g}": w.grain(g) for g in names}, base)
    parts = [
        written[f"export_{g}"]
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("complaint_count").alias("complaint_count"),
            F.sum("narrative_count").alias("narrative_count"),
            F.sum("timely_response_count").alias("timely_response_count"),
        )
        .select(F.lit(g).alias("export"), "*")
        for g in names
    ]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


@register("manifest")
def _manifest(spark, sf_dir):
    from ledgerline.sources import sinks

    w = for_testdata(spark, sf_dir)
    win = C.rolling_window(C.intervals_from_rows(_raw(spark, sf_dir))).first()
    return sinks.manifest(w["complaint_metrics"], win["window_start"], win["window_end"])


@register("snapshot_identity")
def _snapshot_identity(spark, sf_dir):
    w = for_testdata(spark, sf_dir)
    return N.fingerprint(w.grain("overview"))


@register("display_format")
def _display_format(spark, sf_dir):
    """Compact counts and percentage text of the company comparison (FN-8)."""
    from ledgerline.functions.display import compact_number, percent_text

    g = _g(spark, sf_dir)
    per = A.rank(g, FULL, "company_name", limit=None)
    total = g.filter(FULL.predicate()).agg(F.sum("complaint_count").alias("scope_total"))
    from ledgerline.operators.totals import attach_totals

    return attach_totals(per, total).select(
        "category",
        compact_number(F.col("complaints")).alias("complaints_label"),
        compact_number(F.col("scope_total")).alias("total_label"),
        percent_text(F.col("complaints"), F.col("scope_total")).alias("share_label"),
    )


@register("evidence_budget")
def _evidence_budget(spark, sf_dir):
    """The evidence sample shrunk by halving its hash-ordered prefix until
    the redacted text fits a 1 MB budget, never below 100 rows (SRT-5).  The
    operator's own floor of 1,000 exceeds the corpus of the smallest tables."""
    w = for_testdata(spark, sf_dir)
    rows = N.hash_sample_context(w["complaint_metrics"], w["complaint_narratives"], EVIDENCE_ROWS).withColumn(
        "excerpt", _redact("excerpt")
    )
    return N.shrink_to_budget(rows, 1_000_000, 100).select("complaint_id", "excerpt")


# Step 12: sources, sinks and gates on their own.
@register("parquet_parts")
def _parquet_parts(spark, sf_dir):
    """Parts with different columns read together, aligned by name (SRC-1)."""
    from ledgerline.sources import raw as R

    parts = R.read_parquet(spark, [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")])
    return parts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.count("text").alias("rows_with_text"), F.count("quality").alias("rows_with_quality")
    )


@register("column_gate")
def _column_gate(spark, sf_dir):
    """Which required fields the raw rows have (SRC-3); the gate passes them."""
    from ledgerline.schema import RAW_FIELDS
    from ledgerline.sources import raw as R

    columns = R.require_columns(_raw(spark, sf_dir)).columns
    present = spark.createDataFrame([(f, f in columns) for f in RAW_FIELDS], "field string, present boolean")
    blanks = P.blanks_by_field(_raw(spark, sf_dir))
    return present.join(blanks, "field", "left")


@register("verified_parquet")
def _verified_parquet(spark, sf_dir):
    """A table written, counted from its files and read back (SRC-6)."""
    from ledgerline.sources import sinks

    w = for_testdata(spark, sf_dir)
    return sinks.write_parquet_verified(w["companies"], f"{w.store}/verified_companies")


@register("csv_report")
def _csv_report(spark, sf_dir):
    """A report table written as CSV and read back by its header (SRC-8)."""
    from ledgerline.sources import sinks

    w = for_testdata(spark, sf_dir)
    report = A.rank(w.grain("overview"), FULL, "product", limit=None)
    sinks.write_csv(report, f"{w.store}/product_report")
    return spark.read.option("header", True).csv(f"{w.store}/product_report").select(
        "category", F.col("complaints").cast("long").alias("complaints")
    )


@register("metric_columns")
def _metric_columns(spark, sf_dir):
    """The additive metrics that a grain's schema shows, with totals (SRC-11)."""
    from ledgerline.sources import sinks

    grain = _g(spark, sf_dir)
    names = sinks.metric_names(grain)
    one = grain.agg(*[F.sum(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("total")) for n in names])
    return one.select(F.explode(pairs).alias("p")).select("p.metric", "p.total")


@register("named_views")
def _named_views(spark, sf_dir):
    """Models as named relations, queried by SQL text (SRC-13)."""
    from ledgerline.sources import sinks

    w = for_testdata(spark, sf_dir)
    sinks.register_views(spark, {"v_complaint_metrics": w["complaint_metrics"], "v_dim_product": w["dim_product"]})
    return spark.sql(
        "SELECT p.product, count(*) AS complaints FROM v_complaint_metrics m "
        "JOIN v_dim_product p ON m.product_category_id = p.product_category_id GROUP BY p.product"
    )


@register("snapshot_gate")
def _snapshot_gate(spark, sf_dir):
    """Evidence fits the overview it was cut from and no other one (QA-16)."""
    w = for_testdata(spark, sf_dir)
    evidence, overview = _evidence(spark, sf_dir), w.grain("overview")
    other = overview.filter(F.col("complaint_count") > 1)
    rows = [("own", N.snapshot_compatible(evidence, overview)), ("other", N.snapshot_compatible(evidence, other))]
    counts = overview.agg(F.count(F.lit(1)).alias("overview_rows"))
    return spark.createDataFrame(rows, "overview string, compatible boolean").join(F.broadcast(counts))


@register("size_gate")
def _size_gate(spark, sf_dir):
    """Written exports against the size guard, passing and failing (QA-19)."""
    from ledgerline.sources import sinks

    w = for_testdata(spark, sf_dir)
    written = sinks.export_grains(w["complaint_metrics"], {"guarded_channels": w.grain("channels")}, w.store)
    path = f"{w.store}/guarded_channels"

    def passes(limit: int) -> bool:
        try:
            return sinks.size_guard(spark, path, limit) < limit
        except ValueError:
            return False

    return written["guarded_channels"].agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(passes(10**12)).alias("within_large_limit"),
        F.lit(passes(1)).alias("within_one_byte"),
    )


@register("manifest_exports")
def _manifest_exports(spark, sf_dir):
    """Identity of each written export in the release manifest (SRC-12)."""
    from ledgerline.sources import sinks

    w = for_testdata(spark, sf_dir)
    names = ("overview", "issues", "geography", "channels")
    sinks.export_grains(w["complaint_metrics"], {f"release_{g}": w.grain(g) for g in names}, w.store)
    record = sinks.release_manifest(spark, w["complaint_metrics"], {g: f"{w.store}/release_{g}" for g in names})
    return spark.createDataFrame([(g, record["exports"][g]["fingerprint"]) for g in names], "export string, fingerprint string")


@register("inspect_datasets")
def _inspect_datasets(spark, sf_dir):
    """Datasets, their dimensions, rows and covered dates (AGG-24)."""
    out = None
    for name in ("overview", "issues", "geography", "channels"):
        grain = _g(spark, sf_dir, name)
        info = MQ.inspect_datasets(grain, FULL)
        row = grain.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"),
            "rows",
            F.lit(info["snapshot_coverage"]["first_date"]).cast("date").alias("first_date"),
            F.lit(info["snapshot_coverage"]["last_date"]).cast("date").alias("last_date"),
            F.lit(len(info["metrics"])).cast("long").alias("metrics"),
            F.lit(info["limits"]["limit"]).cast("long").alias("row_limit"),
        )
        out = row if out is None else out.unionByName(row)
    return out
