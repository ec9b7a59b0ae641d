"""The forest's numbers against plain Python, and findings in lines that weren't planted."""

import math
import re

import pytest
from pyspark.sql import functions as F

from umbra.llm import secrets

LINES = [
    'password = "Zx9!kQ2#pL7"', "db: postgres://admin:s3cr3t!Pw@db.example.net/x", "token: ghp_16C7e42F292c6912E7710c838347Ae178B4a", '"pwd": "qW3$rT6&yU8"',
    "commit 5f2d9c1e8b7a6f4d3c2b1a0f9e8d7c6b5a4f3e2d merged", 'version = "release-candidate"', '"language": "javascript"', "cache_key = 'user_session_index_17'", 'name: "Customer.Service.Desk"', "sha-256 digest: aaaa0000bbbb1111",
]
PAIRS = {a + b: math.log2((ord(a) * 7 + ord(b) * 3) % 29 + 1) - 5 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}
WORDS = ["release", "candidate", "customer", "service", "user", "session", "index", "java", "script"]


def numbers(c, path, before, after):
    n, line = len(c), before.split("\n")[-1]
    share = lambda rx: len(re.findall(rx, c)) / n
    steps = [PAIRS.get(c.lower()[i : i + 2], -8.0) for i in range(n - 1)]
    covered = sum(len(w) for w in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", c) if len(w) >= 3 and w.lower() in WORDS)
    out = {
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "symbols": share("[+/_=-]"), "odd": share("[^A-Za-z0-9+/_=-]"),
        "transitions": sum(1 for a, b in zip(c, c[1:], strict=False) if a.isalpha() and b.isdigit() or a.isdigit() and b.isalpha() or a.islower() and b.isupper() or a.isalnum() and b in "+/_=-") / n,
        "likely": sum(steps) / (n - 1), "hexadecimal": bool(re.fullmatch("[0-9a-fA-F]+", c)), "distinct": len(set(c)), "entropy": -sum(c.count(x) / n * math.log2(c.count(x) / n) for x in set(c)), "coverage": covered / n,
        "repeats": bool(re.search(r"(.)\1{3}", c)), "path_test": bool(re.search("(?i)test|example|sample|mock|fixture|spec|doc", path)), "path_code": path.endswith((".py", ".env", ".sh")),
        "key_word": bool(re.search("(?i)secret|token|passw|api[_-]?key|auth|credential|private", line)), "assigned": bool(re.search("[=:]\\s*[\"'`]?$", line)), "quoted": before[-1:] in "\"'`" and after[:1] in "\"'`" and before != "" and after != "",
        "digest_word": bool(re.search("(?i)commit|sha-?[0-9]*|md5|digest|checksum|uuid|revision|integrity", line)), "url": bool(re.search(r"(?i)(https?://|www\.)\S*$", line)), "userinfo": bool(re.search(r"://[^\s:@/]+:$", before)) and after.startswith("@"),
    }
    return {k: round(float(v), 6) for k, v in out.items()}


def test_numbers_equal_plain_python(spark):
    paths = ["src/run.py", "tests/a.py", "", "x/.env"]
    docs = spark.createDataFrame([(i, t, paths[i % 4]) for i, t in enumerate([*LINES, "x\n" * 9000 + LINES[2], None, ""])], "doc_id long, text string, path string")
    dictionary = spark.createDataFrame([(w,) for w in WORDS], "word string")
    rows = secrets.described(secrets.candidates(docs, path="path"), dictionary, PAIRS).collect()
    assert len(rows) == len(LINES) + 1
    for r in rows:
        want = numbers(r.candidate, r.path, r.before, r.after)
        assert {f: pytest.approx(r[f], abs=2e-6) for f in secrets.FEATURES} == {f: want[f] for f in secrets.FEATURES}


def test_lines_that_were_not_planted(spark):
    words = " ".join(secrets.CODE_WORDS) + " the javascript of a customer at the desk is a release candidate"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*LINES[:9], *[words] * 3])], "doc_id long, text string")
    found = secrets.scan(docs)
    got = {r.doc_id: r.predicted for r in found.collect()}
    assert [got[i] for i in range(4)] == [1] * 4 and [got[i] for i in range(4, 9)] == [0] * 5
    twice = spark.createDataFrame([(None, LINES[0]), (None, LINES[5]), (1, LINES[1]), (1, "plain"), (1, None)], "doc_id long, text string")
    clean = sorted((r.text or "" for r in secrets.redacted(twice, secrets.scan(twice.unionByName(docs.where("doc_id > 8")))).collect()))
    assert clean == sorted(['password = "[SECRET]"', LINES[5], "db: postgres://admin:[SECRET]@db.example.net/x", "plain", ""])


def test_planted_labels_overlap(spark):
    rows = secrets.planted(spark, 2000)
    whole = secrets.candidates(rows, "n", "text", "path").join(rows.select("n", "start", "end"), ["n", "start", "end"]).count()
    assert whole >= 1900  # nearly every planted value is one candidate
    line = F.when(F.substring("text", 1, 200).rlike("(?i)(secret|token|passw|api[_-]?key|auth|credential|private)"), 1).otherwise(0)
    each = {(r.label, r.line): r.n for r in rows.groupBy("label", line.alias("line")).agg(F.count("*").alias("n")).collect()}
    assert min(each.values()) > 150  # either label in either kind of line
