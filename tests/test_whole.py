"""Detection and scoring of whole rows in one pass, against the detection that deals candidates, and against plain Python."""

import random
import re

from umbra.functions.catalog import Catalogue
from umbra.operators import named, tagger, whole
from umbra.operators.arrow import clean
from umbra.operators.detect import detect
from umbra.plans import evaluation, gold
from umbra.plans import queries as Q

ODD = [
    "", "Ref Number: Policy Number", "TFN 123 456 782 and TFN: 123 456 789, ABN number is 51 824 753 556", "Card 4111 1111 1111 1111 or 4111 1111 1111 1112", "Medicare: 2123 45678 0 or 1123 45678 1",
    "+1 (528) 555-3435 (528) 555-3435", "lives at 12 Abbott Street, Sydney NSW 2000 since 1/2/2020\r\nDOB: 03/04/1999\r", "Policy Alice Abbott, Claim Brendan Barker Id", "١٢/١٢/٢٠٢٠ naïve Zoë Abbott ſ POL-1234567",
    "Agent: Mary Smith\n", "Agent: Mary Smith Subject: x", "Consultant: Ann Lee", "Payee: Big Bank 12/12/2020 Pty Ltd, Sydney, NSW", "Jane Doe on 01/01/2020", "NSW 1/2/2020 phone: 01/02/2020 medicare 3/4/2021", "Rego: ABC-123 reg ABC 12D DOB30 AU-12345 P1234567",
    "Mark Street Mary Number\nMary Ref", "SSN 123-45-6789 ssn: 666-04-7100 0013 408-555-2222 at 10:30 pm", "10 Sydney Road, Perth WA 6000 " * 40, "\U0001f600 Ann Bo, mail x@y.com.au;" * 30,
]


def _mixed(n: int) -> list[str]:
    chance = random.Random(5)
    words = [w for t in ODD[:18] for w in re.split("( )", t)] + ["\n", "\t", "\r\n", "Name:", "TFN", "12", "0412 345 678", "id", "Jane Doe", "Inc", "é", "İd", "(02) 9999 1234"]
    return ["".join(chance.choice(words) for _ in range(chance.randrange(1, 30))) for _ in range(n)]


def test_same_as_dealt_candidates(spark):
    notes = spark.range(96).selectExpr("id as k", "id as o_custkey")
    texts = ODD + _mixed(400) + [r[0] for r in notes.selectExpr(Q.CLAIM, Q.EXTRA).collect()] + [r[1] for r in notes.selectExpr(Q.CLAIM, Q.EXTRA).collect()] + [r.text for r in gold.labelled(notes, "k").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(r.doc_id, r.entity_type, r.start, r.end) for r in detect(docs).collect()}
    scanner, said = whole.Scanner(), [clean(t) for t in texts]
    for _ in range(2):  # the second time regexes without a match are asked for together
        got = {(i, *e) for i, (t, found) in enumerate(zip(said, scanner.candidates(said))) for e in scanner.entities(t, found)}
        assert got == want


def test_loose_forms_match_wherever_the_regex_does():
    forms = {s.regex: whole.loose(s.regex) for s in Catalogue().scans()}
    assert all(form for form, _ in forms.values())
    assert whole.loose(r"(?i)(?<=NT\s)[0-9]\b") == (r"(?i)(?:NT\s)[0-9]\b", False)
    assert whole.loose(r"a[$(?=]\$(?!b(c))d$") == (r"a[$(?=]\$d", False)
    for text in [t for t in ODD + _mixed(200) if not re.search(whole.PLAIN, t)]:
        for regex, (form, same) in forms.items():
            want, got = [m.start() for m in re.finditer(regex, text)], [m.start() for m in re.finditer(form, text)]
            assert (want == got) if same else (not want or got and got[0] <= want[0])


def test_one_long_text():
    text = "Jane Doe, 0412 345 678; " * 20_000
    scanner = whole.Scanner()
    assert len(scanner.entities(text, scanner.candidates([text])[0])) == 40_000


def test_runs_by_plain_python():
    chance = random.Random(2)
    for _ in range(300):
        a, b = ([(s := chance.randrange(20), s + chance.randrange(6)) for _ in range(chance.randrange(5))] for _ in range(2))
        chars = lambda x: {c for s, e in x for c in range(s, e)}
        got = gold.less(gold.merged(a), gold.merged(b))
        assert chars(got) == chars(a) - chars(b) and all(x[1] < y[0] for x, y in zip(got, got[1:])) and all(s < e for s, e in got)


def test_scores_where_texts_are_made(spark):
    keys = spark.sql("select id from range(400) union all select -3L union all select null")
    texts, pieces = gold.labelled(keys, "id").cache(), gold.in_pieces(keys, "id")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(gold.scores_found(texts)) == key(gold.scores_found(pieces)) == key(gold.scores(texts, detect(texts)))
    columns = ["label", "kind", "doc_id", "start", "end", "length"]
    assert key(gold.errors_found(texts, 5).select(*columns)) == key(gold.errors_found(pieces, 5).select(*columns)) == key(gold.errors(texts, detect(texts)).select(*columns))
    model = tagger.fit(texts.where("doc_id % 8 in (0, 2, 5)"), {"PERSON"}, most=100)
    got = {r.label: r for r in gold.scores_tagged(texts, model).collect()}
    for name, extra in (("scans", None), ("tagged", named.cleaned(tagger.tagged(texts, model)))):
        want = gold.scores(texts, detect(texts, extra=extra)).collect()
        assert {r.label: (r.tp, r.fp, r.fn, r.f1) for r in want} == {k: tuple(r[f"{c}_{name}"] for c in ("tp", "fp", "fn", "f1")) for k, r in got.items()}
    assert got["PERSON"].tp_tagged > got["PERSON"].tp_scans
    assert gold.scores_found(texts.limit(0)).count() == gold.errors_found(texts.limit(0)).count() == 0


def test_texts_are_scanned_once_and_no_span_is_shuffled(spark):
    for query in (evaluation.tagger_f1, evaluation.gold_f1, evaluation.gold_errors):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Generate explode" not in plan
