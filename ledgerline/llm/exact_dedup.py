"""Exact duplicate removal with a heavy-hitter split (native DataFrame code).

A group of copies may hold a large share of all rows.  Its digest is found
with a Misra-Gries sketch, verified by an exact count, and its winner is
broadcast, so its rows are decided map-side and are never shuffled.  Digests
that are not frequent have groups below ``support`` of the rows and take an
ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sha256_text, text_or_empty

#: A digest is frequent when it holds more than this share of the rows.  The
#: sketch keeps at most ``1 / SUPPORT`` digests, which bounds the broadcast.
SUPPORT = 0.001


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.
    Of equal texts the row with the largest id stays (a null id is smaller
    than any other).  If rows repeat that id with the same text, exactly one
    of them is ``kept``.  Other input columns are not read; an empty table
    gives an empty result.
    """
    narrow = cut(
        docs.select(F.col(id_col).alias("doc_id"), sha256_text(text_or_empty(text_col)).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    best = F.max(F.struct("doc_id", "row"))
    total = narrow.agg(F.count(F.lit(1)).alias("n"))
    # Misra-Gries: every digest above `support` is among the sketch's items;
    # the exact count below removes the others.
    sketch = narrow.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = cut(
        narrow.join(F.broadcast(sketch), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .join(F.broadcast(total), F.col("group_size") > F.col("n") * F.lit(support))
        .drop("n")
    )
    frequent = narrow.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    ordinary = (
        narrow.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("best", best.over(same))
    )
    return frequent.unionByName(ordinary).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all columns.

    Decisions are joined back on (id, digest); where rows repeat both, one
    arbitrary row of them stays.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.col(f"doc.{id_col}").alias("id"), sha256_text(text_or_empty(f"doc.{text_col}")).alias("digest")
    )
    on = rows["id"].eqNullSafe(kept["id"]) & (rows["digest"] == kept["digest"])
    return rows.join(kept, on, "left_semi").dropDuplicates(["id", "digest"]).select("doc.*")


# --- registered query ---------------------------------------------------------


def query(spark, sf_dir):
    from ledgerline.llm.common import documents

    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
