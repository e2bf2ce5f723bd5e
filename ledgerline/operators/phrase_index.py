"""Phrase search without reading every text (FLT-7, SRT-8).

The index lists, for each run of three characters of the lower-cased texts, the
rows that hold it.  A phrase's rows must be listed under all its runs, so the
lists of its rarest runs are intersected and only the rows left are compared
with the phrase.  Lists are stored by a hash of their run, sorted by run, and a
long list is spread over several files, so no task holds one whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import contains_ci
from ledgerline.session import ship_package

RUN = 3
#: Lists intersected for one phrase.
RAREST = 4
#: Rows of a stored file, about.
FILE_ROWS = 2_000_000
#: Characters whose runs are sorted at once, about.
CHARS = 1_000_000


def runs(text) -> F.Column:
    """The distinct runs of three code points of a lower-cased text."""
    chars = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))
    # the characters next to those one and two places on; the last two lack a neighbour
    shifted = [F.slice(chars, k + 1, F.greatest(F.size(chars), F.lit(0))).alias(f"c{k}") for k in range(RUN)]
    joined = F.transform(F.arrays_zip(*shifted), lambda x: F.concat(*[x[f"c{k}"] for k in range(RUN)]))
    return F.array_distinct(F.array_compact(joined))


def _listed(batches):
    """``id, run`` of a task's texts (lower-cased): the distinct runs of three
    code points of each, found by sorting their numbers."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHARS):  # a bounded part of the batch
                size += len(texts[end] or "")
                end += 1
            points = np.frombuffer("".join(t or "" for t in texts[at:end]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
            lengths = np.array([len(t or "") for t in texts[at:end]], dtype=np.int64)
            owner = np.repeat(np.arange(end - at), lengths)
            if len(points) >= RUN:
                inside = owner[2:] == owner[:-2]
                code = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inside]
                who = owner[2:][inside]
                order = np.lexsort((code, who))
                code, who = code[order], who[order]
                new = np.ones(len(code), dtype=bool)
                new[1:] = (code[1:] != code[:-1]) | (who[1:] != who[:-1])
                code, who = code[new], who[new]
                if len(code):
                    three = np.stack([code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF], axis=1).astype("<u4")
                    text = three.tobytes().decode("utf-32-le", "surrogatepass")
                    runs_found = pa.array([text[k : k + RUN] for k in range(0, len(text), RUN)], pa.string())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who + at)), runs_found], names=["id", "run"])
            at = end


class PhraseIndex:
    """An index written by :func:`build` under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.lists = spark.read.parquet(f"{self.path}/lists")
        self.sizes = spark.read.parquet(f"{self.path}/sizes")

    def _bucket(self, run):
        return F.pmod(F.xxhash64(run), F.lit(self.buckets)).cast("int")

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/shape").first()["buckets"]

    def matches(self, df: DataFrame, id_col: str, text_col: str, phrase: str) -> DataFrame:
        """The rows of ``df`` (indexed rows or some of them) whose text holds the
        phrase, whatever its case; the same rows as a scan finds.  Phrases of
        under three characters have no run and are looked for by a scan."""
        wanted = self.spark.createDataFrame([(phrase,)], "p string").select(F.explode(runs(F.col("p"))).alias("run"))
        found = wanted.select("run", self._bucket(F.col("run")).alias("bucket")).collect()  # at most the phrase's characters
        holds = contains_ci(text_col, phrase)
        if not found:
            return df.filter(holds)
        names = [r.run for r in found]
        sizes = {r.run: r.n for r in self.sizes.where(F.col("run").isin(names)).collect()}
        if len(sizes) < len(names):
            return df.limit(0)
        rare = sorted(names, key=lambda run: (sizes[run], run))[:RAREST]
        buckets = sorted({r.bucket for r in found if r.run in rare})
        listed = self.lists.where(F.col("bucket").isin(buckets) & F.col("run").isin(rare))
        if len(rare) > 1:
            listed = listed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare))
        return df.join(listed.select(F.col("id").alias(id_col)), id_col, "left_semi").filter(holds)


def build(docs: DataFrame, id_col: str, text_col: str, path: str, buckets: int = 64) -> PhraseIndex:
    """Index ``text_col`` of rows with unique ids.  Null and short texts have no
    runs: no phrase of three characters is in them."""
    spark, path = docs.sparkSession, path.rstrip("/")
    ship_package(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    listed = texts.mapInArrow(_listed, f"id {docs.schema[id_col].dataType.simpleString()}, run string")
    listed = listed.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int"))
    total = listed.agg(F.count(F.lit(1))).first()[0]
    files = max(1, math.ceil(total / buckets / FILE_ROWS))
    salted = listed.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(files)))
    (
        salted.repartition("bucket", "file")
        .sortWithinPartitions("bucket", "file", "run")
        .drop("file")
        .write.partitionBy("bucket")
        .parquet(f"{path}/lists")
    )
    stored = spark.read.parquet(f"{path}/lists") if total else listed
    sizes = stored.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    sizes.repartitionByRange("run").sortWithinPartitions("run").write.parquet(f"{path}/sizes")
    if not total:  # a partitioned write of no rows leaves no schema behind
        listed.write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/shape")
    return PhraseIndex(spark, path)
