"""Labelled texts: what a key gives, and how often it is worked out."""

from pyspark.sql import functions as F

from umbra.plans import gold


def test_pieces_are_made_once(spark):
    rows = gold.labelled(spark.range(100), "id")
    spans = rows.select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Letter of a clinic") == 1


def test_spans_are_of_the_text(spark):
    rows = gold.labelled(spark.sql("select * from values (8L), (-3L), (null) as t(id)"), "id").collect()
    got = {r.doc_id: r for r in rows}
    assert got[8].text.startswith("Intake memo\n\nInsured: ") and [s.label for s in got[8].spans] == [x[0] for x in gold.TEMPLATES[0] if not isinstance(x, str)]
    first = got[8].spans[0]
    assert got[8].text[first.start : first.end] == got[8].text.split("Insured: ")[1].split(",")[0]
    assert [(got[k].text, got[k].spans) for k in (-3, None)] == [("", [])] * 2


def test_keys_are_dealt_to_all_tasks(spark):
    from umbra.plans import evaluation, queries

    folder = "/root/testdata/sf0.001"
    for rows in (evaluation._texts(spark, folder), evaluation.letters(spark, folder), queries.extras(spark, folder)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
