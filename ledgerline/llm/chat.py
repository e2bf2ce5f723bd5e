"""Chat formatting after a cumulative-snapshot collapse.

Logs often hold a conversation once per turn, each snapshot repeating the
turns before it.  Rolling hashes over a conversation's turns name all its
prefixes; a conversation whose whole hash is a proper prefix of another's is
dropped by an anti-join, equal conversations keep the smallest id, and only
the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ready

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies``: the conversations that are no proper
    prefix of another.  Of equal ones the smallest id stays and ``n_copies``
    counts them all.

    Turns are compared in the order of (turn, role, text), so ties and
    repeated rows have a defined place; a null turn number comes first, a
    null role counts as "unknown" and a null text as empty.  Rows with a null
    conversation id form one conversation.  Other columns are not read.
    """
    ready(turns.sparkSession)
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    # The rolling hash of a prefix: two 64-bit sums without carry of hashes
    # that hold each turn's place.  It needs no group in memory.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("n", F.row_number().over(order))
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    prefixes = cut(
        placed.select(
            "conv_id",
            "n",
            F.bit_xor(F.xxhash64("n", "role", "text")).over(upto).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit(7), "text", "role", "n")).over(upto).alias("h2"),
            size.alias("n_turns"),
        )
    )
    key = ["n", "h1", "h2"]
    whole = prefixes.where("n = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = prefixes.where("n < n_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def _rows(turns, conv_col, turn_col, role_col, text_col):
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, chat`` of each maximal conversation: its
    turns in order between role and end marks.  Marks inside a text are kept
    from being read as marks by a space after their first character.  A
    rendered conversation is one row, so its size bounds the memory it takes."""
    kept = maximal_conversations(turns, conv_col, turn_col, role_col, text_col)
    clean = F.replace(F.col("text"), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(HEAD), F.col("role"), F.lit("\n"), clean, F.lit(TAIL))
    rows = _rows(turns, conv_col, turn_col, role_col, text_col).select(F.col("conv_id").alias("c"), "turn", "role", "text", line.alias("line"))
    on = rows["c"].eqNullSafe(kept["conv_id"])
    return (
        rows.join(kept, on)
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("all"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("all.line"), "").alias("chat"))
    )


# --- registered query -----------------------------------------------------------


def query(spark, sf_dir):
    ready(spark)
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         count(*) OVER (PARTITION BY conv_id) AS size FROM r
), p AS (
  SELECT conv_id, n, size,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, ',')
           OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, max(size) AS n_turns, count(*) AS n_copies
  FROM p WHERE n = size GROUP BY prefix
), kept AS (
  SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < size)
)
SELECT k.conv_id, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
       string_agg('<|im_start|>' || t.role || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10), ''
                  ORDER BY t.n) AS chat
FROM kept k JOIN t ON t.conv_id = k.conv_id
GROUP BY ALL
"""
