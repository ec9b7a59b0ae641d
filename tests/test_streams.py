"""Streams: late rows, sessions, repeats, a restart; texts that repeat; scans that a text can match."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from umbra.functions.catalog import Catalogue
from umbra.operators.arrow import Gates
from umbra.operators.detect import detect
from umbra.operators.repeats import detect_once
from umbra.streaming import streams

AT = datetime.datetime(2024, 1, 1, 10)
KIND = "ts timestamp, user_id long, event_type string, text string"


def batch(spark, folder, rows):
    minutes = [(AT + datetime.timedelta(minutes=m), u, "a", t) for m, u, t in rows]
    spark.createDataFrame(minutes, KIND).coalesce(1).write.mode("append").parquet(folder)


def run(spark, make, tmp_path, batches):
    """Each batch arrives, the stream starts anew with the same checkpoint and runs dry; returns the rows after each."""
    after = []
    for rows in batches:
        batch(spark, str(tmp_path / "in"), rows)
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        streams.appended(make(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        after.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr))
    return after


def test_windows_settle_and_late_rows_are_dropped(spark, tmp_path):
    first, second, third = run(spark, streams.windowed_counts, tmp_path, [[(5, 1, "x"), (50, 1, "x")], [(95, 1, "x"), (55, 2, "x")], [(20, 1, "late"), (240, 1, "x")]])
    hour = lambda h: AT + datetime.timedelta(hours=h)
    assert first == [] and second == [(hour(0), hour(1), "a", 3)]  # 55 came after 95 in one batch: in time
    assert third == [(hour(0), hour(1), "a", 3), (hour(1), hour(2), "a", 1)]  # 20 was late: its window stays as it was settled


def test_sessions_settle(spark, tmp_path):
    first, second = run(spark, streams.session_counts, tmp_path, [[(0, 1, "x"), (20, 1, "x"), (25, 2, "x")], [(45, 1, "x"), (200, 3, "x")]])
    m = lambda k: AT + datetime.timedelta(minutes=k)
    assert first == [] and sorted(second) == [(1, m(0), m(75), 3), (2, m(25), m(55), 1)]


def test_repeated_texts_of_a_stream(spark, tmp_path):
    first, second, third = run(spark, streams.distinct_texts, tmp_path, [[(0, 1, "a"), (1, 2, "a"), (2, 3, None)], [(3, 1, "a"), (4, 1, ""), (60, 1, "b")], [(120, 1, "a")]])
    assert sorted(str(r[3]) for r in first) == ["None", "a"]
    assert sorted(str(r[3]) for r in second) == ["None", "a", "b"]  # an empty text repeats a null one
    assert len(third) == 4  # by then the watermark has forgotten the text


@pytest.mark.parametrize("spread", [1, 10_000])
def test_repeats_are_detected_alike(spark, spread):
    texts = ["mail ann@x.example.com", "mail bob@x.example.com or 0412 345 678", "", None, "plain"]
    rows = [(None if i % 7 == 0 else i % 4, texts[i % 5]) for i in range(60)] + [(99, "lone@x.example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("entity_type", F.lit("x"))
    options = {"active": {"EMAIL_ADDRESS", "AU_PHONE"}}
    for hashed in (True, False):
        want = sorted(map(tuple, detect(docs, hashed=hashed, **options).collect()), key=repr)
        assert sorted(map(tuple, detect_once(docs, hashed=hashed, spread=spread, **options).collect()), key=repr) == want and want
    assert detect(docs.limit(0), once=True, **options).count() == 0
    with pytest.raises(ValueError):
        detect(docs, once=True, extra=docs)


def test_gates_leave_no_match_out():
    scans = Catalogue().scans()
    gates = Gates(scans)
    texts = ["", "plain words", "TFN: 123 456 782", "Passport N1234567", "ﬁ İ Kelvin 12", "Rego: ABC 123", "Assigned To: Jane Doe Subject: x", "$1,250.00 on 1/2/2024", "a@b.example.com", "Customer: John Smith of Melbourne, VIC", "Medicare: 2123 45678 0", "logged 2024-05-01T14:32:00Z"]
    for t in texts:
        some = set(gates.open(t))
        for k, s in enumerate(scans):
            if re.search(s.regex, t, re.IGNORECASE if s.ignore_case else 0) and (s.gate is None or (re.search(r"\d", t) if s.gate == "digit" else s.gate in t)):
                assert k in some, (t, s.regex)
    assert len(gates.open("plain words")) < len(scans) / 3
