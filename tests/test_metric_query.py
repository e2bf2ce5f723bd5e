"""The governed metric query contract."""

import datetime as dt

import pytest

from fixtures import GRAIN_ROWS, metric_grains
from ledgerline.plans.metric_query import MetricRequest, dataset_bounds, query_metrics
from ledgerline.plans.scope import Scope

SCOPE = Scope(dt.date(2022, 5, 30), dt.date(2022, 5, 31), products=("Loan",))
LOANS = [r for r in GRAIN_ROWS if r[2] == "Loan"]


def req(**changes):
    base = dict(dataset="overview", group_by=(), metrics=("complaint_count", "timely_response_rate"),
                interval="month", filters=(), start_date=None, end_date=None,
                order_by="complaint_count", descending=True, limit=10)
    base.update(changes)
    return MetricRequest(**base)


@pytest.fixture(scope="module")
def grains(spark):
    return metric_grains(spark)


def run(grains, r):
    return query_metrics(grains[r.dataset], SCOPE, r).collect()


def expect(rows):
    """Complaints and the rate of all rows together, not the mean of rates."""
    complaints, timely, known = (sum(r[k] for r in rows) for k in (3, 4, 5))
    return complaints, 100 * timely / known


def test_rate_is_weighted_and_filters_narrow(grains):
    cases = [
        (req(), LOANS),
        (req(start_date="2022-05-31"), [r for r in LOANS if r[0] == "2022-05-31"]),
        (req(end_date="2022-05-30"), [r for r in LOANS if r[0] == "2022-05-30"]),
        (req(filters=(("company_name", ("Harbor Bank", "nobody")),)), [r for r in LOANS if r[1] == "Harbor Bank"]),
        (req(filters=(("sub_product", (None,)),)), LOANS),
    ]
    for request, rows in cases:
        (got,) = run(grains, request)
        assert (got["complaint_count"], got["timely_response_rate"]) == (expect(rows)[0], pytest.approx(expect(rows)[1]))


@pytest.mark.parametrize("label", ["Harbor Bank' OR '1'='1", "x\"; SELECT 1", "100%", "\\", "🚗"])
def test_labels_are_values(grains, label):
    """A label is compared, never read as SQL: no row bears it."""
    (row,) = run(grains, req(filters=(("company_name", (label,)),)))
    assert row["complaint_count"] is None and row["timely_response_rate"] is None


REJECTED = {
    "unknown metric": dict(metrics=("sum(complaint_count)",)),
    "dimension of another grain": dict(group_by=("submission_channel",)),
    "dimensions of two grains": dict(dataset="geography", group_by=("state", "issue")),
    "before the scope": dict(start_date="2022-05-01"),
    "after the scope": dict(end_date="2022-06-30"),
    "unknown order": dict(order_by="complaint_count DESC"),
    "too many rows": dict(limit=1000),
    "unknown interval": dict(interval="decade"),
    "dimension twice": dict(group_by=("company_name", "company_name")),
}


@pytest.mark.parametrize("why", REJECTED)
def test_rejected(grains, why):
    with pytest.raises(ValueError):
        run(grains, req(**REJECTED[why]))


def test_truncation_shows(grains):
    by_day = req(group_by=("period",), interval="day", order_by="period", descending=False)
    assert [(r["period"].isoformat(), r["complaint_count"], r["truncated"]) for r in run(grains, by_day)] == [
        ("2022-05-30", 12, False), ("2022-05-31", 13, False)]
    cut = run(grains, MetricRequest(**{**by_day.__dict__, "limit": 1}))
    assert len(cut) == 1 and cut[0]["truncated"]


def test_no_known_timeliness_gives_no_rate(grains):
    (row,) = run(grains, req(filters=(("company_name", ("Pine Credit",)),)))
    assert row["complaint_count"] == 5 and row["timely_response_rate"] is None


def test_companies_are_counted_once(grains):
    rows = run(grains, req(dataset="issues", group_by=("issue", "sub_issue"), metrics=("company_count",), order_by="company_count"))
    assert [(r["issue"], r["sub_issue"], r["company_count"]) for r in rows] == [("Fees", None, 2)]


def test_bounds(grains):
    days = sorted(r[0] for r in GRAIN_ROWS)
    assert [d.isoformat() for d in dataset_bounds(grains["overview"]).first()] == [days[0], days[-1]]


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from ledgerline.schema import FLAGS  # noqa: E402

grain_rows = st.lists(
    st.tuples(
        st.dates(dt.date(2024, 1, 1), dt.date(2024, 3, 31)),
        st.sampled_from(["A", "B", None]),
        st.sampled_from(["Card", "Loan", None]),
        st.integers(0, 50),
        st.integers(0, 50),
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(grain_rows, st.booleans())
def test_grouped_query_matches_pandas(spark, rows, descending):
    fields = [T.StructField("date_received", T.DateType()), T.StructField("company_name", T.StringType()),
              T.StructField("product", T.StringType()), T.StructField("sub_product", T.StringType())]
    fields += [T.StructField(f, T.LongType()) for f in FLAGS]
    data = []
    for d, company, product, n, timely in rows:
        vals = {f: 0 for f in FLAGS}
        vals.update(complaint_count=n, timely_response_count=min(timely, n), known_timeliness_count=n)
        data.append((d, company, product, None, *[vals[f] for f in FLAGS]))
    grain = spark.createDataFrame(data, T.StructType(fields))
    scope = Scope(dt.date(2024, 1, 1), dt.date(2024, 2, 29))
    req = MetricRequest("overview", ("product",), ("complaint_count", "timely_response_rate", "company_count"),
                        order_by="complaint_count", descending=descending, limit=50)
    got = {r["product"]: (r["complaint_count"], r["timely_response_rate"], r["company_count"])
           for r in query_metrics(grain, scope, req).collect()}
    kept = [r for r in data if scope.start <= r[0] <= scope.end]
    want = {}
    for product in {r[2] for r in kept}:
        sub = [r for r in kept if r[2] == product]
        n = sum(r[4 + FLAGS.index("complaint_count")] for r in sub)
        t = sum(r[4 + FLAGS.index("timely_response_count")] for r in sub)
        k = sum(r[4 + FLAGS.index("known_timeliness_count")] for r in sub)
        want[product] = (n, 100.0 * t / k if k else None, len({r[1] for r in sub if r[1] is not None}))
    assert set(got) == set(want)
    for key, (n, rate, companies) in want.items():
        g = got[key]
        assert g[0] == n and g[2] == companies
        assert (g[1] is None and rate is None) or abs(g[1] - rate) < 1e-9
