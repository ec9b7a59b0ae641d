"""Row identity, whole results, files, model spans, patterns' own scores."""

import json

import pytest
from pyspark.sql import functions as F

from umbra.functions.catalog import Catalogue, Definition
from umbra.operators import named, report
from umbra.operators.anonymize import anonymize
from umbra.operators.arrow import literals, needs_digit
from umbra.operators.detect import detect, identified
from umbra.operators.process import applied, claim_notes, process, process_files, with_acronyms
from umbra.sources import settings, tables

ROWS = [
    (None, "mail bob.x@mail.example.com now"), (None, "nothing here at all, really nothing to see"), (1, "mail ann.y@mail.example.com"), (1, "nothing here at all, only words"),
    (1, "mail ann.y@mail.example.com"), (2, None), (3, ""), (None, None), (4, "call 0412 345 678 or 0412 345 678"),
]
CLEAN = {None: None, "": "", "mail bob.x@mail.example.com now": "mail <EMAIL_ADDRESS> now", "mail ann.y@mail.example.com": "mail <EMAIL_ADDRESS>", "call 0412 345 678 or 0412 345 678": "call <AU_PHONE> or <AU_PHONE>"}


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, entity_type string, start int")


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_rows_keep_their_own_spans(odd, engine):
    active = {"EMAIL_ADDRESS", "AU_PHONE"}
    for docs in (odd, odd.repartition(3), odd.unionByName(odd)):
        found = detect(docs, active=active, engine=engine)
        got = sorted(((r.doc_id, r.text) for r in anonymize(docs, found).collect()), key=repr)
        want = sorted(((r.doc_id, CLEAN.get(r.text, r.text)) for r in docs.collect()), key=repr)
        assert got == want
    assert detect(odd, active=active, engine=engine).count() == 5
    assert anonymize(odd.limit(0), detect(odd.limit(0), engine=engine)).count() == 0
    with pytest.raises(ValueError):  # without the text's hash nothing tells rows of one key apart
        anonymize(odd, detect(odd, active=active, engine=engine, hashed=False))


def test_columns_of_odd_keys(spark):
    df = spark.createDataFrame([(1, "ann@x.example.com", "a"), (1, "hello", None), (None, "bob@x.example.com", "carl@x.example.com"), (1, "hello", None)], "id long, note string, other string")
    out = sorted(((r.id, r.note, r.other) for r in tables.anonymize_columns(df, ["note", "other"], key="id").collect()), key=repr)
    e = "<EMAIL_ADDRESS>"
    assert out == sorted([(1, e, "a"), (1, "hello", None), (None, e, e), (1, "hello", None)], key=repr)
    both = tables.process_table(df, ["note"], key="id")
    assert both["table"].count() == 4 and sorted(r.id or 0 for r in both["entities"].collect()) == [0, 1]
    assert tables.anonymize_columns(df.limit(0), ["note"]).count() == 0


def test_process_gives_one_row_each(spark, odd):
    long = "Mr. Roe wrote to ann@x.example.com.\n\n" + "word " * 70 + "\n\nLater bob@x.example.com answered, DOB: 15/03/1980."
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(9, long)], "doc_id long, text string")).withColumn("kind", F.lit("note"))
    rows = process(docs, content_type="kind", active={"EMAIL_ADDRESS", "AU_PHONE", "DATE_OF_BIRTH"}).collect()
    assert len(rows) == 10 and all(r.content_type == "note" for r in rows)
    by = {r.doc_id: r for r in rows}
    r = by[9]
    assert r.entity_count == 3 and r.type_counts == {"EMAIL_ADDRESS": 2, "DATE_OF_BIRTH": 1} and r.structured_data["email_address"] == ["ann@x.example.com", "bob@x.example.com"]
    assert len(r.segments) > 1 and "@" not in "".join(s.anonymized for s in r.segments) and "@" not in r.anonymized
    assert by[2].anonymized is None and by[2].entities == [] and by[2].segments == []


def test_acronyms_before_detection(spark):
    docs = spark.createDataFrame([(1, "The TP wrote"), (2, None)], "doc_id long, text string")
    words = {"TP": "Third Party ann@x.example.com"}
    out = process(docs, acronyms=words, active={"EMAIL_ADDRESS"}).orderBy("doc_id").collect()
    assert out[0].anonymized == "The Third Party <EMAIL_ADDRESS> wrote" and out[0].expanded_acronyms[0].acronym == "TP" and out[1].anonymized is None
    assert detect(docs, active={"EMAIL_ADDRESS"}, acronyms=words).first().start == 16
    assert with_acronyms(docs, words).where("doc_id = 2").first().text is None


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("mail ann@x.example.com")
    got = {r["name"]: r for r in process_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "no.txt")], str(tmp_path / "out"), active={"EMAIL_ADDRESS"}).collect()}
    assert got["a"].success and got["a"].anonymized == "mail <EMAIL_ADDRESS>" and not got["no"].success and got["no"].error
    assert spark.read.text(str(tmp_path / "out/anonymized")).first().value == "mail <EMAIL_ADDRESS>"
    assert json.loads(spark.read.text(str(tmp_path / "out/analysis")).first().value)["entity_count"] == 1
    assert process_files(spark, [str(tmp_path / "no.txt")]).count() == 1


def test_model_spans_are_cleaned(spark):
    said = [("PERSON", "Joe Smith\nDOB", "Joe Smith"), ("PERSON", "Policy Smith", None), ("PERSON", "Repairs Done Today", None), ("PERSON", "Mary Queen Street", None), ("ORG", "Medicare", None), ("ORG", "Acme", "Acme"), ("GPE", "Repairs", None), ("GPE", "Paris", "Paris"), ("GPE", "Processing", None), ("OTHER", "x y", None)]
    found = spark.createDataFrame([(i, k, 3, 3 + len(t), t) for i, (k, t, _) in enumerate(said)], "doc_id long, label string, start int, end int, text string")
    got = {r.doc_id: (r.text, r.end) for r in named.cleaned(found).collect()}
    assert got == {i: (w, 3 + len(w)) for i, (_, _, w) in enumerate(said) if w}
    docs = spark.createDataFrame([(0, "to Joe Smith\nDOB and more"), (0, "another text of that key"), (5, "by Acme here")], "doc_id long, text string")
    ents = detect(docs, active={"PERSON", "ORGANIZATION"}, extra=named.cleaned(found)).collect()
    assert sorted((r.doc_id, r.entity_type, r.text) for r in ents) == [(0, "PERSON", "Joe Smith"), (5, "ORGANIZATION", "Acme")]
    assert detect(docs, active={"PERSON"}, extra=named.cleaned(found)).where("entity_type = 'ORGANIZATION'").count() == 0


def test_patterns_with_their_own_score(spark):
    c = Catalogue([Definition("X_ID", [r"X(\d+)", "ref number"], score=0.4)])
    docs = spark.createDataFrame([(None, "X12 X12 ref number"), (1, None)], "doc_id long, text string")
    got = sorted((r.start, r.end, r.text, r.score) for r in applied(docs, c).collect())
    assert got == [(1, 3, "12", 0.4), (5, 7, "12", 0.4), (8, 18, "ref number", 0.4)] and applied(docs, c, types={"Y"}).count() == 0


def test_literals_never_hide_a_match():
    assert literals("(?:ab|cde)x*") == {"ab", "cde"} and literals("a*b?") == frozenset() and literals("(?i)NSW ") == {"nsw "} and literals("[ab]c+") == {"a", "b"} or literals("[ab]c+")
    assert needs_digit(r"\b[A-Z]{2}\d{5}") and not needs_digit("[A-Z0-9]{17}") and needs_digit("(?=x*[0-9])[A-Z]+")


def test_claim_notes_text_report_and_export(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail ann@x.example.com " + "w" * 120), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in claim_notes(docs, active={"EMAIL_ADDRESS"}).collect()}
    assert got[1].pii_entities[0].text == "ann@x.example.com" and got[1].incident_description.endswith("...") and got[None].pii_entities == []
    found = detect(docs, active={"EMAIL_ADDRESS"})
    path = report.export(report.document_report(anonymize(docs.where("doc_id = 1"), found, sized=True)), report.entity_stats(found), str(tmp_path / "r.txt"), "txt")
    assert "  - EMAIL_ADDRESS: 1" in open(path).read()
    s = settings.Settings({"acronyms": {"dictionary": {"TP": "Third Party"}}, "entity_types": {"active": ["PERSON"]}, "patterns": [{"entity_type": "X"}]})
    assert s.export(tmp_path / "c.json") and not s.export(tmp_path / "c.ini")
    out = json.loads((tmp_path / "c.json").read_text())
    assert out["entity_types"] == {"active": ["PERSON"]} and out["metadata"]["patterns"] == {"count": 1, "types": ["X"]}


def test_rows_are_told_apart(odd):
    assert identified(odd, "doc_id", "text").columns == ["doc_id", "text", "__hash", "__hash2", "__part"]
