"""The overlap fold: what it shuffles, entities given twice, keys that anonymize is told are unique."""

import pytest
from pyspark.sql import functions as F

from umbra.operators.anonymize import anonymize
from umbra.plans import evaluation  # noqa: F401  registers more
from umbra.plans.queries import QUERIES

ENTITIES = "doc_id long, start int, end int, entity_type string, text string, score double"


def test_overlap_fold_shuffles_keys_alone(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = QUERIES["overlap_fold"](spark, str(tmp_path))
        dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(dealt) == 2 and all("hashpartitioning(k#" in x for x in dealt)
    assert out.count() == 100


def test_entities_given_twice_count_once(spark):
    docs = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    one = [(1, 2, 4, "DATE", "cd", 0.9), (1, 3, 6, "PERSON", "def", None), (1, 8, 8, "TIME", "", 0.8), (1, 8, 8, "DATE", "", 0.8)]
    out = anonymize(docs, spark.createDataFrame(one * 3, ENTITIES), unique=True).first()
    assert sorted((x.start, x.end, x.entity_type) for x in out["items"]) == [(3, 6, "PERSON"), (8, 8, "DATE"), (8, 8, "TIME")]
    assert [x.start for x in out["items"]] == [8, 8, 3]


def test_a_null_key_told_to_be_unique_is_an_error(spark):
    docs = spark.createDataFrame([(1, "ab"), (None, "cd")], "doc_id long, text string")
    entities = spark.createDataFrame([(1, 0, 1, "DATE", "a", 0.9)], ENTITIES)
    with pytest.raises(Exception, match="a key is null"):
        anonymize(docs, entities, unique=True).collect()
