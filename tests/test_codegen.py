"""Generated methods stay within what the JVM compiles (8,000 bytes of code)."""

import re

from umbra.functions.catalog import Catalogue
from umbra.operators.detect import detect


def longest(spark, df, capsys) -> int:
    """Bytes of the longest method of a plan's stages."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        df.explain(mode="codegen")
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_arbitration_is_compiled(spark, capsys):
    docs = spark.createDataFrame([(1, "His TFN is 123 456 789, mail a.b@x.example.com")], "doc_id long, text string")
    assert 0 < longest(spark, detect(docs, catalogue=Catalogue()), capsys) < 8000


def test_native_scans_wait_for_their_literals(spark):
    texts = ["his tfn is 123 456 789", "Tax File Number 123 456 789, TFN 12", "taſ TFN: 123456789, K", "policy # ١٢٣٤٥٦", "ſ", "Medicare: 2123 45678 0", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = detect(docs, engine="native", active={"AU_TFN"})._jdf.queryExecution().optimizedPlan().toString().lower()
    assert re.search(r"contains\((named)?lambda", plan)
    rows = lambda engine: sorted(tuple(r) for r in detect(docs, engine=engine, active={"AU_TFN"}).collect())
    assert rows("native") == rows("arrow") != []
