"""Small inputs that cover the edge cases listed in FIXTURES.md."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schema import FLAGS, RAW_FIELDS

BRONZE_COLUMNS = RAW_FIELDS + ["_source_archive", "_source_csv", "_source_record_number", "_ingested_at"]
#: An ordinary complaint; each edge case changes what it is about.
ORDINARY = {
    "Date received": "2023-03-14", "Product": "Vehicle lease", "Sub-product": "Used car", "Issue": "Delivery", "Sub-issue": "Late",
    "Consumer complaint narrative": "The dealer never sent the papers.", "Company public response": "", "Company": "Northwind Motors",
    "State": "OR", "ZIP code": "97201", "Tags": "", "Submitted via": "Phone", "Date sent to company": "2023-03-15",
    "Company response to consumer": "Closed with explanation", "Timely response?": "Yes",
}

#: One edge case a row, by name.
EDGES = {
    "ordinary": {},
    "two tags": {"Tags": "Older American, Servicemember", "Company response to consumer": "Closed with monetary relief"},
    "blank labels": {"Sub-product": "", "Issue": " ", "State": "", "ZIP code": "", "Company response to consumer": "Closed with non-monetary relief"},
    "ISO year before": {"Date received": "1/2/2021", "Date sent to company": "1/4/2021", "Company response to consumer": "In progress"},
    "sent too early": {"Date sent to company": "2023-03-01", "Company response to consumer": "Untimely response", "Timely response?": "No"},
    "outcome unknown": {"Company response to consumer": ""},
    "narrative of spaces": {"Consumer complaint narrative": " \u2003 "},
    "no narrative, odd company": {"Consumer complaint narrative": "", "Company": 'Smith | "Sons" & Co'},
    "leading zeros": {"ZIP code": "00420"},
}
IDS = {name: str(7001 + k) for k, name in enumerate(EDGES)}


def edge_rows():
    """Bronze rows, one per edge case."""
    return [
        {**ORDINARY, **edge, "Complaint ID": IDS[name], "_source_archive": "made_up.zip", "_source_csv": "made_up.csv",
         "_source_record_number": k, "_ingested_at": "2024-02-02"}
        for k, (name, edge) in enumerate(EDGES.items(), 1)
    ]


def bronze_df(spark, rows, priority=1):
    schema = T.StructType(
        [T.StructField(c, T.LongType() if c == "_source_record_number" else T.StringType()) for c in BRONZE_COLUMNS]
    )
    df = spark.createDataFrame([tuple(r[c] for c in BRONZE_COLUMNS) for r in rows], schema)
    return df.withColumn("_source_priority", F.lit(priority))


#: date, company, product, complaints, timely, known timeliness
GRAIN_ROWS = [
    ("2022-05-30", "Harbor Bank", "Loan", 12, 9, 10),
    ("2022-05-31", "Harbor Bank", "Loan", 8, 2, 6),
    ("2022-05-31", "Pine Credit", "Loan", 5, 0, 0),
    ("2022-05-31", "Pine Credit", "Lease", 70, 70, 70),
]


def metric_grains(spark):
    """The overview grain of ``GRAIN_ROWS`` and the other grains of the same rows."""
    fields = [T.StructField("date_received", T.DateType()), T.StructField("company_name", T.StringType()),
              T.StructField("product", T.StringType()), T.StructField("sub_product", T.StringType())]
    fields += [T.StructField(f, T.LongType()) for f in FLAGS]
    rows = []
    for received, company, product, *counts in GRAIN_ROWS:
        known = dict(zip(("complaint_count", "timely_response_count", "known_timeliness_count"), counts), narrative_count=1)
        rows.append((dt.date.fromisoformat(received), company, product, None, *[known.get(f, 0) for f in FLAGS]))
    overview = spark.createDataFrame(rows, T.StructType(fields))
    return {
        "overview": overview,
        "issues": overview.withColumn("issue", F.lit("Fees")).withColumn("sub_issue", F.lit(None).cast("string")),
        "geography": overview.withColumn("state", F.lit("OR")),
        "channels": overview.withColumn("submission_channel", F.lit("Phone")),
    }
