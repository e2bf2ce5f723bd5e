"""Binding of the driver's TPC-H-style tables to the raw complaint schema.

The driver ships ``orders``, ``lineitem``, ``customer``, ``nation``,
``supplier``, ``part`` and ``documents`` tables.  This module turns them into
the 16 raw string fields of a complaint export plus provenance, one complaint
per order, so every model downstream runs on data whose size grows with the
driver's scale factor.  The same mapping is written in SQL for the oracle
(``oracles/prefix.py``); the two must stay in step.

Missingness and quirks are injected deterministically so that the blank ->
NULL rules, the two date formats, the ID trim, NULL key components, the
three-valued timeliness and the release-precedence dedup are all exercised.
A second, higher-priority "revised" release re-issues every complaint whose
timeliness was still unrecorded (pending orders) with a changed company label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schema import RAW_FIELDS, STATE_CODES
from ledgerline.session import shared_table

# --- Fixed values of the binding (shared with the SQL oracle) --------------
RESPONSES = [
    "Closed with explanation",
    "Closed with monetary relief",
    "Closed with non-monetary relief",
    "In progress",
    "Untimely response",
    "",
]
PUBLIC_RESPONSE = "Company has responded to the consumer and chooses not to provide a public response"
SOURCE_CSV = "complaints.csv"
REVISED_ARCHIVE = "archive_revised.zip"
INGESTED_AT = "2026-01-01T00:00:00+00:00"
REVISED_PREFIX = "Revised "
# Nation key -> reported state; the last nation reports a territory that the
# location map omits.
NATION_STATES = STATE_CODES[:24] + ["PR"]
# --- end of fixed values ----------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Raw rows in one bucket, about: a task sorts them whole, texts included.
BUCKET_ROWS = 50_000


def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """Buckets for the raw rows, one task each; orders are counted from the
    file's footer."""
    return max(spark.sparkContext.defaultParallelism, -(-read_table(spark, sf_dir, "orders").count() // BUCKET_ROWS))


def order_complaints(spark: SparkSession, sf_dir: str, buckets: int | None = None, steps: list[DataFrame] | None = None) -> DataFrame:
    """One raw complaint per order (priority-1 release), before the revision,
    in ``buckets`` partitions by complaint ID if given.  With ``steps``, the rows
    without texts are stored, so that the shuffles of their joins are gone when
    the texts move; the table is added to the list, to be dropped afterwards."""
    t = lambda name: read_table(spark, sf_dir, name)
    lines = (
        t("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("min_supp"),
            F.min("l_partkey").alias("min_part"),
            F.max("l_returnflag").alias("max_flag"),
            F.min("l_shipdate").alias("first_ship"),
            F.array_join(F.sort_array(F.collect_set("l_returnflag")), ", ").alias("tags"),
        )
    )
    states = F.array(*[F.lit(s) for s in NATION_STATES])
    customers = t("customer").join(
        F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select(
        "c_custkey",
        "c_mktsegment",
        F.when(F.col("n_regionkey") == 0, F.lit(""))
        .otherwise(F.element_at(states, F.col("n_nationkey") + 1))
        .alias("state"),
    )
    # Hash-partition orders by key: the line aggregate has the same key, so they
    # meet co-partitioned, and a single large input file still fans out.  Texts
    # come last: no other join moves them, and their shuffle leaves the rows in
    # the partitions that the stored buckets need.
    narrow = (
        t("orders")
        .repartition("o_orderkey")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(
            t("supplier").select("s_suppkey", "s_name"),
            F.col("min_supp") == F.col("s_suppkey"),
            "left",
        )
        .join(
            t("part").select("p_partkey", "p_type", "p_brand"),
            F.col("min_part") == F.col("p_partkey"),
            "left",
        )
        .withColumn("order_text", F.col("o_orderkey").cast("string"))
    )
    docs = t("documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.col("text").alias("doc_text"))
    if steps is not None:
        narrow = shared_table(narrow, "raw-narrow")
        steps.append(narrow)
    if buckets is not None:
        narrow, docs = narrow.repartition(buckets, "order_text"), docs.repartition(buckets, "doc_key")
    o = narrow.join(docs, F.col("order_text") == F.col("doc_key"), "left")
    k = F.col("o_orderkey")
    key_text = F.col("order_text")
    response = F.element_at(F.array(*[F.lit(r) for r in RESPONSES]), (k % 6 + 1).cast("int"))
    raw = {
        "Date received": F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
            F.date_format("o_orderdate", "MM/dd/yyyy")
        ),
        "Product": F.coalesce(F.col("p_type"), F.lit("")),
        "Sub-product": F.coalesce(F.col("p_brand"), F.lit("")),
        "Issue": F.when(k % 50 == 0, F.lit("")).otherwise(F.col("c_mktsegment")),
        "Sub-issue": F.when(
            F.col("max_flag").isNull() | (F.col("max_flag") == "N"), F.lit("")
        ).otherwise(F.col("max_flag")),
        "Consumer complaint narrative": F.coalesce(F.col("doc_text"), F.lit("")),
        "Company public response": F.when(k % 3 == 0, F.lit(PUBLIC_RESPONSE)).otherwise(F.lit("")),
        "Company": F.coalesce(F.col("s_name"), F.lit("Unassigned")),
        "State": F.coalesce(F.col("state"), F.lit("")),
        "ZIP code": F.when(F.col("c_custkey") % 40 == 0, F.lit("")).otherwise(
            F.lpad(F.col("c_custkey").cast("string"), 5, "0")
        ),
        "Tags": F.coalesce(F.col("tags"), F.lit("")),
        "Submitted via": F.col("o_orderpriority"),
        "Date sent to company": F.date_format(
            F.coalesce(F.col("first_ship"), F.col("o_orderdate")), "yyyy-MM-dd"
        ),
        "Company response to consumer": response,
        "Timely response?": F.when(F.col("o_orderstatus") == "F", F.lit("Yes"))
        .when(F.col("o_orderstatus") == "O", F.lit("No"))
        .otherwise(F.lit("")),
        "Complaint ID": F.when(k % 7 == 0, F.concat(F.lit("  "), key_text, F.lit(" "))).otherwise(
            key_text
        ),
    }
    return o.select(
        k.alias("_order_key"),
        *[raw[name].alias(name) for name in RAW_FIELDS],
        F.concat(F.lit("archive_"), F.year("o_orderdate").cast("string"), F.lit(".zip")).alias(
            "_source_archive"
        ),
        F.lit(SOURCE_CSV).alias("_source_csv"),
        (k + 1).alias("_source_record_number"),
        F.lit(INGESTED_AT).alias("_ingested_at"),
        F.lit(1).alias("_source_priority"),
    )


def incoming(spark: SparkSession, sf_dir: str, buckets: int | None = None, steps: list[DataFrame] | None = None) -> DataFrame:
    """Both releases, one after the other: the input of the overlap dedup
    (``buckets`` and ``steps`` as in :func:`order_complaints`).

    The revision re-issues every complaint whose timeliness was still
    unrecorded (pending orders) under a changed company label.  It comes from
    the same pass over the tables, so the orders, their lines and their texts
    are joined once."""
    pending = F.col("`Timely response?`") == ""
    releases = F.when(pending, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = order_complaints(spark, sf_dir, buckets, steps).withColumn("_source_priority", F.explode(releases))
    revised = F.col("_source_priority") == 2
    changed = {
        "Company": F.concat(F.lit(REVISED_PREFIX), F.col("Company")),
        "Complaint ID": F.col("_order_key").cast("string"),
        "_source_archive": F.lit(REVISED_ARCHIVE),
    }
    return rows.select(
        *[F.when(revised, changed[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in rows.columns if c != "_order_key"]
    )
