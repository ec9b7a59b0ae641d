"""Rows that share keys or have none, very many spans in one text, sweeps against plain Python, gold spans."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.functions import catalog as C
from umbra.operators import report
from umbra.operators import text as T
from umbra.operators.anonymize import anonymize
from umbra.operators.detect import absorbed, detect
from umbra.plans import gold

ODD = [(1, "mail ann@x.example.com"), (1, "mail bob.y@x.example.com now"), (None, "mail c@x.example.com"), (1, "mail ann@x.example.com"), (None, None), (2, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in ODD], "doc_id long, text string, entity_type string")


def test_a_report_row_for_each_row(odd):
    out = report.document_report(anonymize(odd, detect(odd, active={"EMAIL_ADDRESS"}), sized=True))
    got = sorted(map(tuple, out.select("doc_id", "original_length", "entity_count", "anonymized_chars").collect()), key=repr)
    want = [(k, len(t or ""), int("@" in (t or "")), len((t or "").split("mail ")[-1].split(" ")[0]) if "@" in (t or "") else 0) for k, t in ODD]
    assert got == sorted(want, key=repr)
    whole = report.summary(out).first()
    assert whole.total_documents == 6 and whole.total_entities == 4
    assert report.document_report(anonymize(odd.limit(0), detect(odd.limit(0)), sized=True)).count() == 0


def test_times_and_shares(odd):
    new = anonymize(odd, detect(odd, active={"EMAIL_ADDRESS"}), sized=True).withColumn("took", F.lit(0.5))
    assert report.summary(report.document_report(new, seconds="took")).first().avg_processing_time == 0.5
    assert [tuple(r) for r in report.distribution(new).collect()] == [("EMAIL_ADDRESS", 4, 100.0)]


def test_explained_and_by_segment_keep_rows_apart(odd):
    found = detect(odd, active={"EMAIL_ADDRESS"})
    why = T.explained(found, odd, C.Catalogue()).collect()
    assert len(why) == 4 and all(r.matched_text in r.context for r in why)
    inside = T.by_segment(T.segmented(odd), found).collect()
    assert sorted(((r.doc_id, r.start, r.text) for r in inside), key=repr) == sorted(((k, 5, t.split("mail ")[1].split(" ")[0]) for k, t in ODD if t), key=repr)


def test_many_rows_of_one_key(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("mail u"), "id", F.lit("@x.example.com")).alias("text"))
    began = time.time()
    out = anonymize(rows, detect(rows, active={"EMAIL_ADDRESS"})).where("text = 'mail <EMAIL_ADDRESS>'").count()
    assert out == 4000 and time.time() - began < 60


def folded(items):
    rank = lambda t: C.PRIORITY.get(t, 0)
    kept = []
    for e in sorted(items, key=lambda e: (e[0], -e[1])):
        met = next((k for k in kept if e[0] < k[1] and e[1] > k[0]), None)
        if met is None:
            kept.append(e)
        elif (rank(e[2]) > rank(met[2]) and not (e[0] >= met[0] and e[1] <= met[1])) or (rank(e[2]) == rank(met[2]) and e[1] - e[0] > met[1] - met[0]):
            kept = [k for k in kept if k != met] + [e]
    return sorted(kept)


KINDS = ["EMAIL_ADDRESS", "PERSON", "DATE", "LOCATION", "AU_TFN"]
SPANS = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12), st.sampled_from(KINDS)), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(SPANS, min_size=15, max_size=25))
def test_fold_equals_plain_python(spark, texts):
    said = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(i, t, s, s + n, said[s : s + n], 0.9) for i, spans in enumerate(texts) for s, n, t in spans]
    entities = spark.createDataFrame(rows, "doc_id long, entity_type string, start int, end int, text string, score double")
    docs = spark.createDataFrame([(i, said) for i in range(len(texts))], "doc_id long, text string")
    got = {r.doc_id: sorted((x.start, x.end, x.entity_type) for x in r["items"]) for r in anonymize(docs, entities, unique=True).collect()}
    want = {}
    for i, spans in enumerate(texts):
        ordered = sorted({(s, s + n, t) for s, n, t in spans}, key=lambda e: (e[0], e[1], e[2]))
        want[i] = folded(ordered)
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(SPANS, min_size=15, max_size=25))
def test_absorption_equals_plain_python(spark, texts):
    kinds = ["EMAIL_ADDRESS", "PERSON", "AU_POSTCODE", "AU_ADDRESS", "AU_TFN", "INSURANCE_CLAIM_NUMBER"]
    rows = []
    for i, spans in enumerate(texts):
        one = {(s, s + n): kinds[KINDS.index(t)] for s, n, t in spans}  # a winner a span
        rows += [(i, s, e, t) for (s, e), t in one.items()]
    rank = lambda t: C.PRIORITY.get(t, C.UNLISTED_PRIORITY)
    want = [w for w in rows if w[3] in C.NEVER_ABSORBED or not any(o[0] == w[0] and o[3] in C.CONTAINERS and o[1] <= w[1] and w[2] <= o[2] and o[2] - o[1] > w[2] - w[1] and rank(w[3]) <= rank(o[3]) for o in rows)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, entity_type string")
    assert sorted(map(tuple, absorbed(df, ["doc_id"]).collect())) == sorted(want)


def test_a_hundred_thousand_spans_in_one_text(spark):
    n = 100_000
    text = "".join(f"u{i % 10}@x.au é " for i in range(n))
    entities = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("EMAIL_ADDRESS").alias("entity_type"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 7).cast("int").alias("end"), F.lit("u@x.au").alias("text"), F.lit(0.9).alias("score"))
    also = entities.withColumn("end", F.col("end") - 2).withColumn("entity_type", F.lit("PERSON"))  # each overlaps another
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    out = anonymize(docs, entities.unionByName(also), {"EMAIL_ADDRESS": "redact"}, unique=True).select("text", F.size("items").alias("n")).first()
    assert out.n == n and out.text == "[REDACTED] é " * n and time.time() - began < 60
    began = time.time()
    assert absorbed(entities.unionByName(also).drop("text"), ["doc_id"]).count() == n and time.time() - began < 30


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 9), st.sampled_from("ab"), st.booleans()), min_size=10, max_size=40))
def test_sweeps_equal_characters(spark, spans):
    of = lambda side: spark.createDataFrame([(None if d == 2 else d, s, s + n, label) for d, s, n, label, g in spans if g == side], "doc_id long, start int, end int, label string")
    chars = lambda side: {(d, label, at) for d, s, n, label, g in spans if g == side for at in range(s, s + n)}
    gold_, found = chars(True), chars(False)
    got = {r.label: (r.tp, r.fp, r.fn) for r in report.char_scores(of(True), of(False)).collect()}
    want = {x: tuple(sum(c[1] == x for c in some) for some in (gold_ & found, found - gold_, gold_ - found)) for x in {c[1] for c in gold_ | found}}
    assert got == want
    runs = report.error_runs(of(True), of(False)).collect()
    wrong = {("fp", *c) for c in found - gold_} | {("fn", *c) for c in gold_ - found}
    assert {(r.kind, 2 if r.doc_id is None else r.doc_id, r.label, at) for r in runs for at in range(r.start, r.end)} == wrong
    assert all((r.kind, 2 if r.doc_id is None else r.doc_id, r.label, r.end) not in wrong for r in runs)


def test_gold_texts(spark):
    texts = gold.labelled(spark.range(64), "id").cache()
    for r in texts.collect():
        assert r.spans and all(r.text[s.start : s.end].strip() == r.text[s.start : s.end] != "" for s in r.spans)
        assert {s.label for s in r.spans} <= set(gold.GOLD_CATEGORY)
    found = {r.label: r.f1 for r in gold.scores(texts, detect(texts)).collect()}
    assert found["EMAIL"] == 1.0 and found["ACCOUNT_LIKE"] > 0.9 and found["DATE"] > 0.9 and found["PHONE"] > 0.9
    perfect = texts.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", F.col("s.label").alias("entity_type")).replace({"POLICY_NUMBER": "INSURANCE_POLICY_NUMBER", "VIN": "VEHICLE_VIN"}, subset=["entity_type"])
    assert all(r.f1 == 1.0 for r in gold.scores(texts, perfect).collect())


def test_swept_scores_hold_no_table_of_places(spark):
    """Sweeps sort a task's events and aggregate nothing by place or run, whose table would grow with the task's share."""
    from umbra.operators import report

    gold = spark.createDataFrame([(1, 0, 4, "A"), (1, 4, 8, "A"), (1, 2, 6, "A"), (None, 1, 3, "B")], "doc_id long, start int, end int, label string")
    found = spark.createDataFrame([(1, 3, 5, "A"), (1, 5, 6, "A"), (1, 8, 9, "A"), (None, 0, 1, "B"), (2, 5, 5, "B")], "doc_id long, start int, end int, label string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in report.char_scores(gold, found).collect()}
    assert got == {"A": (3, 1, 5), "B": (0, 1, 2)}
    runs = report.error_runs(gold, found)
    want = {("A", "fn", 1, 0, 3, 3), ("A", "fn", 1, 6, 8, 2), ("A", "fp", 1, 8, 9, 1), ("B", "fp", None, 0, 1, 1), ("B", "fn", None, 1, 3, 2)}
    assert sorted(map(repr, map(tuple, runs.collect()))) == sorted(map(repr, want))
    assert "Aggregate" not in runs._jdf.queryExecution().optimizedPlan().toString()
