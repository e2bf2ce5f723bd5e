"""The quality checks must fail on deliberately broken inputs."""

from pyspark.sql import functions as F

from fixtures import bronze_df, edge_rows
from ledgerline.operators.quality import duplicates, not_null_counts, orphans
from ledgerline.plans import quality
from ledgerline.plans.warehouse import Warehouse


class Broken(Warehouse):
    """A warehouse whose named tables can be overridden."""

    def __init__(self, spark, overrides):
        super().__init__(spark, lambda: bronze_df(spark, edge_rows()))
        self.overrides = overrides

    def __getitem__(self, name):
        if name in self.overrides:
            return self.overrides[name](super().__getitem__(name))
        return super().__getitem__(name)


def failures(w, layer):
    return {r["check"]: r["failures"] for r in quality.run_layer(w, layer).collect() if r["failures"]}


def test_detects_duplicates_nulls_orphans(spark):
    w = Broken(
        spark,
        {
            "complaint_metrics": lambda df: df.unionByName(df.limit(1)).withColumn(
                "timely_response_count",
                F.when(F.col("complaint_id") == "7002", F.lit(7)).otherwise(F.col("timely_response_count")),
            ),
            "companies": lambda df: df.filter(F.col("company_name") != "Northwind Motors"),
        },
    )
    gold = failures(w, "gold")
    assert gold["unique:complaint_metrics.complaint_id"] == 1
    assert gold["gold_flags_are_binary"] >= 1 and gold["gold_flag_consistency"] >= 1
    silver = failures(w, "silver")
    assert silver["relationships:complaints.company_id->companies.company_id"] == 8


def test_star_mismatch(spark):
    w = Broken(spark, {"fact_complaints": lambda df: df.withColumn("narrative_count", F.lit(0))})
    assert failures(w, "star")["star_matches_wide_gold"] == 1


def test_generic_operators(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "b")], "k int, v string")
    assert {r["check"]: r["failures"] for r in not_null_counts(df, ["k", "v"]).collect()} == {
        "not_null:k": 0, "not_null:v": 1}
    assert duplicates(df, ["k"]).count() == 1
    parent = spark.createDataFrame([(1,)], "k int")
    assert orphans(df, parent, "k").count() == 1
