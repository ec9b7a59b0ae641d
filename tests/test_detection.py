"""Spans against Python's re, golden strings, arbitration, rewriting, reports."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.functions import catalog as C
from umbra.functions import regexgen, validators
from umbra.functions.spans import clean, spans
from umbra.operators import report
from umbra.operators import text as T
from umbra.operators.anonymize import anonymize
from umbra.operators.arrow import scanned as by_arrow
from umbra.operators.detect import detect, scanned

NOTES = [
    "His TFN is 123 456 789.", "Contact 123 456 789 for details", "ABN number is 51 824 753 556", "Medicare: 1123 45678 1", "Medicare: 2123 45678 0", "131 450",
    "The incident occurred on 15/03/2023 at 10:30am.", "Claim Number: ABCDEF", "Registration: DOB30", "SSN: 666-04-7100", "SSN: 818-04-7100", "Card on file: 4111 1111 1111 1112", "Card on file: 4111 1111 1111 1111",
    "Number 0013 408-555-2222 logged", "Email: a.b@x.example.com, phone 0412 345 678 for Jane Doe at 12 Main Street, Sydney NSW 2000", "DOB: 15/03/1980 and paid $1,250.00 on 1/2/2024", "Assigned To: Jane Doe Subject: x\r\n",
    "\U0001f600 TFN: 123\xa0456\xa0782 caf\xe9 Toyota Corolla 2020 VIN 1HGCM82633A004352 POL-987654 CL-12345678", "", None,
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(list(enumerate(NOTES)), "doc_id long, text string")


@pytest.fixture(scope="module")
def found(notes):
    out = {}
    for r in detect(notes).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def kinds(found, i):
    return {r.entity_type for r in found.get(i, [])}


def test_all_scans_equal_python(spark, notes):
    catalogue = C.Catalogue()
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "ordinal", "entity_type", "start", "end", "text", "before", "after").collect())
    assert rows(scanned(notes, catalogue)) == rows(by_arrow(notes, catalogue))


def test_phones_one_character_apart_are_all_found(spark):
    """The regex looks ahead at what follows a number and doesn't take it, so the next number may follow at once."""
    text = "call +1 (528) 555-3435 +1 (528) 555-3435\n+1 (611) 555-1352 today"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "none")], "doc_id long, text string")
    spans = lambda regex: [m.span() for m in re.finditer(regex, text)]
    want = spans(dict((t, p) for t, p, _ in C.DEFINITIONS)["PHONE_INTL"][0])
    assert len(want) == 3 and all(b[0] - a[1] == 1 for a, b in zip(want, want[1:], strict=False))
    for options in ({}, {"once": True}, {"engine": "native", "active": {"PHONE_INTL"}}):
        rows = detect(docs, **options).where("entity_type = 'PHONE_INTL'").collect()
        assert sorted((r.doc_id, r.start, r.end) for r in rows) == [(d, *x) for d in (1, 2) for x in want]


def test_every_builtin_group_is_terminal():
    assert all(C.terminal_group(s.regex) for s in C.Catalogue().scans())
    assert not C.terminal_group(r"a(b)c") and not C.terminal_group(r"(a)(b)")


def test_span_texts_are_where_they_say(found):
    for i, rows in found.items():
        for r in rows:
            assert NOTES[i][r.start : r.end] == r.text and 0 < r.score <= 1
        assert len({(r.start, r.end) for r in rows}) == len(rows)


def test_golden_strings(found):
    assert kinds(found, 0) >= {"AU_TFN"} and "AU_CENTRELINK_CRN" not in kinds(found, 0)
    assert kinds(found, 1) == {"AU_CENTRELINK_CRN"}
    assert kinds(found, 2) == {"AU_ABN"}
    assert "AU_MEDICARE" not in kinds(found, 3) and "AU_MEDICARE" in kinds(found, 4)
    assert "AU_PHONE" not in kinds(found, 5) and "AU_POSTCODE" not in kinds(found, 6)
    assert "VEHICLE_REGISTRATION" not in kinds(found, 7) and "VEHICLE_REGISTRATION" in kinds(found, 8)
    assert "US_SSN" not in kinds(found, 9) and "US_SSN" in kinds(found, 10)
    assert "CREDIT_CARD" not in kinds(found, 11) and "CREDIT_CARD" in kinds(found, 12)
    assert "PHONE_INTL" in kinds(found, 13)
    assert kinds(found, 14) >= {"EMAIL_ADDRESS", "PERSON", "AU_ADDRESS", "AU_POSTCODE"}
    assert kinds(found, 15) >= {"DATE_OF_BIRTH", "MONEY_AMOUNT", "INCIDENT_DATE"}


def test_options(notes):
    assert {r.entity_type for r in detect(notes, active={"EMAIL_ADDRESS"}).collect()} == {"EMAIL_ADDRESS"}
    assert {r.entity_type for r in detect(notes, threshold=0.95).collect()} == {"EMAIL_ADDRESS"}
    assert detect(notes, active={"DATE"}, adjust={"DATE": -0.5}).count() == 0
    with pytest.raises(ValueError):
        detect(notes, threshold=2)
    plan = detect(notes, active={"EMAIL_ADDRESS"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Medicare" not in plan.split("Generate")[-1]


def test_custom_patterns(spark, tmp_path):
    catalogue = C.Catalogue().add(C.Definition("STAFF_ID", [r"\bEMP-\d{4}\b", "("]))
    assert catalogue.definitions[-1].patterns == [r"\bEMP-\d{4}\b"] and catalogue.add(catalogue.definitions[-1]) is catalogue
    df = spark.createDataFrame([(1, "see EMP-1234 now")], "doc_id long, text string")
    assert [r.text for r in detect(df, catalogue=catalogue, active={"STAFF_ID"}).collect()] == ["EMP-1234"]
    catalogue.save(tmp_path / "p.json")
    loaded, n = C.Catalogue([]).load(tmp_path / "p.json")
    assert n == len(catalogue.definitions) and loaded.types() == catalogue.types()


def test_anonymised_texts(notes):
    ops = {"EMAIL_ADDRESS": "mask", "AU_TFN": "hash", "DATE_OF_BIRTH": "age_bracket", "MONEY_AMOUNT": "redact", "PERSON": lambda c: F.concat(F.left(c, F.lit(1)), F.lit("."))}
    out = {r.doc_id: r for r in anonymize(notes, detect(notes), ops).collect()}
    assert "a.b@x.example.com" not in out[14].text and "*" * 17 in out[14].text and "J." in out[14].text and " 2000 " in out[14].text
    assert "HASH-" in out[0].text and "40-44" in out[15].text and "[REDACTED]" in out[15].text
    assert out[18].text == "" and out[19].text is None and out[19]["items"] == []
    for i, r in out.items():
        for x in r["items"]:
            assert NOTES[i][x.start : x.end] == x.original


def test_overlaps_fold(spark):
    rows = [(1, "EMAIL_ADDRESS", 0, 10, "0123456789", 0.9), (1, "PERSON", 5, 15, "56789abcde", 0.9), (1, "DATE", 20, 25, "klmno", 0.9), (1, "DATE", 20, 28, "klmnopqr", 0.9)]
    entities = spark.createDataFrame(rows, "doc_id long, entity_type string, start int, end int, text string, score double")
    docs = spark.createDataFrame([(1, "0123456789abcdefghijklmnopqrstuvw")], "doc_id long, text string")
    with pytest.raises(ValueError):
        anonymize(docs, entities)
    assert anonymize(docs, entities, unique=True).first().text == "<EMAIL_ADDRESS>abcdefghij<DATE>stuvw"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aZ0159 -:./@+()$é\xa0\n\U0001f600TFN", max_size=40), min_size=20, max_size=40))
def test_spans_equal_re_on_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for rx in (C.EMAIL, C.TFN, r"\b\d{1,3}[A-Z]{2,3}\b", C.AU_PHONE[2]):
        grouped = re.compile(rx).groups > 0
        got = {r.id: [(s.start, s.end) for s in r.s] for r in df.select("id", spans(clean(F.col("text")), rx, grouped).alias("s")).collect()}
        assert got == {i: [m.span(1 if grouped else 0) for m in re.finditer(rx, t)] for i, t in enumerate(texts)}


def test_validators(spark):
    rows = [("123456782", "51824753556", "2123456701", "4111111111111111", "0412 345 678", "15/03/2020"), ("123456789", "51824753557", "1123456701", "4111111111111112", "1234", "NSW 2000")]
    df = spark.createDataFrame(rows, "t string, a string, m string, c string, p string, d string")
    good, bad = df.select(validators.valid_tfn(F.col("t")), validators.valid_abn(F.col("a")), validators.valid_medicare(F.col("m")), validators.valid_card(F.col("c")), validators.valid_phone(F.col("p")), validators.valid_date(F.col("d"), 2024)).collect()
    assert all(good) and not any(bad)
    assert validators.pattern_errors({"entity_type": "x", "patterns": ["("]}).keys() == {"entity_type", "patterns"}
    assert validators.examined(r"\d+", ["1", "a"], ["2"])["metrics"]["f1"] == 0.5


def test_acronyms(spark):
    df = spark.createDataFrame([("The TP reported an issue to the TL. tp",), (None,)], "text string")
    first, none = df.select(T.expanded(F.col("text"), {"TL": "Team Leader", "TP": "Third Party"}).alias("x")).collect()
    assert first.x.text == "The Third Party reported an issue to the Team Leader. Third Party" and none.x is None
    for e in first.x.expansions:
        assert first.x.text[e.expanded_start : e.expanded_end] == e.expansion


def test_segments(spark):
    paragraphs = ["a" * 120, "b" * 150, "c" * 200, "d" * 20]
    rows = T.segmented(spark.createDataFrame([(1, "\n\n".join(paragraphs)), (2, "short"), (3, None)], "doc_id long, text string")).orderBy("doc_id", "segment").collect()
    assert [(r.doc_id, r.start, r.end) for r in rows] == [(1, 0, 272), (1, 222, 222 + 50 + 2 + 200 + 2 + 20), (2, 0, 5)]
    claim = spark.createDataFrame([(1, "Claim Details: a car hit\n\nCustomer: Ann Lee. Claim Number: CL-1")], "doc_id long, text string")
    assert T.claim_metadata(claim).first().claim_number == "CL-1" and T.incident(claim).first().incident_description.startswith("a car hit")


def test_reports(notes, tmp_path):
    entities = detect(notes).cache()
    new = anonymize(notes, entities, sized=True)
    reports = report.document_report(new)
    whole = report.summary(reports).first()
    assert whole.total_documents == len(NOTES) and 0 < whole.anonymization_rate < 1
    stats = report.entity_stats(entities)
    assert abs(sum(r.percentage for r in stats.collect()) - 100) < 0.5
    for kind in ("json", "html", "csv"):
        report.export(reports, stats, str(tmp_path / f"r.{kind}"), kind)
    with pytest.raises(ValueError):
        report.export(reports, stats, "x", "xml")


@pytest.mark.parametrize(
    "examples,level,hit,miss",
    [(["REF-12345", "REF-67890"], "none", "REF-12345", "REF-1"), (["REF-12345", "REF-67890"], "low", "REF-99", "RF-1"), (["AB-1234", "CD-5678"], "medium", "XY-9999", "xy-1"), (["Customer: ABC (2023)", "Customer: XYZ (2024)"], "high", "Customer: QQ (1999)", "Customer: 1"), (["a1B"], "medium", "z9Q", "zz")],
)
def test_regexes_from_examples(examples, level, hit, miss):
    rx = regexgen.from_examples(examples, level)
    assert all(re.fullmatch(rx, x) for x in [*examples, hit]) and not re.fullmatch(rx, miss)


def test_regexes_need_examples():
    for bad in (([], "none"), (["a"], "most")):
        with pytest.raises(ValueError):
            regexgen.from_examples(*bad)


def test_scans_need_as_many_digits_as_their_matches_take():
    import re

    from umbra.functions.catalog import Catalogue
    from umbra.operators import arrow

    said = {r"\b(?:\d[ -]?){12,18}\d\b": 13, r"\d{3}\s*(?:\d{2}|[A-Z]\d)[0-9]?": 4, r"(?=\d)[A-Z0-9]+": 1, r"[^0-9]+|\d": 0, r"x(\d+)-\d*": 1}
    assert {r: arrow.least_digits(r) for r in said} == said
    catalogue = Catalogue()
    scans, gates = catalogue.scans(), arrow.Gates(catalogue.scans())
    text = "Call 0412 345 678 or TFN 123 456 789 at 12:30, card 4111 1111 1111 1111, DOB: 01/02/1990, N1234567, ١٢ x"
    for cut in range(len(text)):
        part = text[:cut]
        found = {k for k, s in enumerate(scans) if re.search(s.regex, part, re.IGNORECASE if s.ignore_case else 0)}
        assert {k for k in found if scans[k].gate is None or scans[k].gate == "digit" or scans[k].gate in part} <= set(gates.open(part))
    card = next(k for k, s in enumerate(scans) if s.entity_type == "CREDIT_CARD" and arrow.least_digits(s.regex) == 13)
    assert card not in gates.open("TFN 123 456 789")
