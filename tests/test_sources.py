"""CSV, text files, settings and streams."""

import pytest
from pyspark.sql import functions as F

from umbra.sources import settings, tables
from umbra.streaming import streams

ROWS = [(1, "Ann Lee", "ann@x.example.com", "plain"), (2, "Bob Ray", "bob@x.example.com", "words"), (3, "Cy Moe", None, "only")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(ROWS, "id long, name string, email string, note string")


def test_columns_are_found_and_rewritten(people):
    assert tables.pii_columns(people) == ["name", "email"]
    out = tables.anonymize_columns(people, ["email"], {"EMAIL_ADDRESS": "redact"}, key="id").orderBy("id").collect()
    assert [r.email for r in out] == ["[REDACTED]", "[REDACTED]", None] and [r.name for r in out] == [r[1] for r in ROWS]
    assert tables.process_table(people, ["name"], "detect", key="id")["entities"].count() == 3
    for bad in (lambda: tables.process_table(people, ["name"], "other"), lambda: tables.detect_columns(people, ["nope"])):
        with pytest.raises(ValueError):
            bad()
    assert {r.column for r in tables.preview(people, rows=2).collect()} == {"name", "email"}


def test_csv_folder_round_trip(spark, people, tmp_path):
    people.coalesce(1).write.csv(str(tmp_path / "in"), header=True)
    done = tables.process_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert done["columns_processed"] == ["name", "email"] and back.count() == 3 and back.where(F.col("email").contains("@")).count() == 0
    assert {r.entity_type for r in done["entities"].collect()} == {"PERSON", "EMAIL_ADDRESS"}
    c = tables.Config(columns=["name"], delimiter=";")
    c.save(tmp_path / "c.json")
    assert tables.Config.load(tmp_path / "c.json") == c
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    assert tables.read_texts(spark, str(tmp_path / "t")).first().text == "one\ntwo"


def test_settings(tmp_path):
    s = settings.Settings()
    s.set("a.b", 1)
    assert s.get("a.b") == 1 and s.get("a.c", 2) == 2 and s.save(tmp_path / "s.json") and settings.Settings().load(tmp_path / "s.json") and not settings.Settings().load(tmp_path / "none.json")
    (tmp_path / "a.csv").write_text("acronym,expansion\nTP, Third Party\n,\n")
    assert settings.acronyms(tmp_path / "a.csv") == (True, {"TP": "Third Party"}) and settings.acronyms(tmp_path / "no.csv") == (False, {})
    (tmp_path / "p.csv").write_text('entity_type,pattern,context,name,score\nX_ID,X\\d+,"a,b",n,\n')
    catalogue, n = settings.patterns(tmp_path / "p.csv", settings.Catalogue())
    assert n == 1 and catalogue.definitions[-1].context == ["a", "b"] and catalogue.definitions[-1].score == 0.85


def test_stream_equals_batch(spark, people, tmp_path):
    docs = people.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "name", "email").alias("text"))
    docs.write.parquet(str(tmp_path / "in"))
    rows = streams.stream(spark, str(tmp_path / "in"), "doc_id long, text string", "parquet")
    streams.anonymize_stream(rows, str(tmp_path / "out"), str(tmp_path / "ents"), str(tmp_path / "ck")).awaitTermination()
    from umbra.operators.anonymize import anonymize
    from umbra.operators.detect import detect

    got = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: r.text for r in anonymize(docs, detect(docs)).collect()} and "<PERSON>" in got[1]


def test_windows(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10) as ts, id % 2 as user_id, 'x' as event_type from range(12)")
    assert [r.n for r in streams.windowed_counts(rows).orderBy("window_start").collect()] == [6, 6]
    assert sorted(r.n for r in streams.session_counts(rows).collect()) == [6, 6]
    assert streams.windowed_counts(rows, slide="30 minutes").count() == 5


def test_entry_point_without_llm(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("umbra.llm", "corpus_pipeline") else real(name, *a))
    names = __spark_entry__.queries()
    assert names and not any(n.startswith("op1") or n == "pipeline" for n in names) and set(__spark_entry__.oracle_sql()) <= set(names)
