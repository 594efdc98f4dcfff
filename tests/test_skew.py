"""Joins on keys that a third of all rows may share: the final plan splits them over several tasks."""

import pytest
from pyspark.sql import functions as F

from causegraph.operators import graph, grounding

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "6k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def hot(spark):
    before = {k: spark.conf.get(k) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_a_hub_are_split(hot):
    nodes = hot.range(3000).select(F.concat(F.lit("n:"), "id").alias("id"))
    edges = hot.range(20_000).repartition(8).select(F.when(F.col("id") % 2 == 0, "n:1").otherwise(F.concat(F.lit("n:"), F.col("id") % 4000)).alias("start_id"), F.concat(F.lit("n:"), F.col("id") % 3500).alias("end_id"), "id")
    rows, plan = final_plan(graph.keep_complete(edges, nodes))
    wanted = sum((1 if i % 2 == 0 else i % 4000) < 3000 and i % 3500 < 3000 for i in range(20_000))
    assert len(rows) == wanted and "skew=true" in plan


def test_a_word_that_most_texts_hold_is_split(hot):
    texts = hot.range(6000).repartition(8).select(F.col("id").alias("doc"), F.concat(F.lit("a common word and "), F.col("id"), F.lit(" more")).alias("text"))
    evidence = hot.createDataFrame([(1, "a common word"), (2, "and 77 more"), (3, "nowhere to be found")], "item int, needle string")
    rows, plan = final_plan(grounding.exact_spans(texts, evidence))
    assert len(rows) == 6001 and "skew=true" in plan
