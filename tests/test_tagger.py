"""The tagger against every tag sequence, on odd texts and keys, and on templates that it hasn't seen."""

import itertools
import random

from pyspark.sql import functions as F

from umbra.operators import named, tagger
from umbra.operators.detect import detect
from umbra.plans import gold

_TAGS = ["O", "B-PERSON", "I-PERSON", "B-PLACE", "I-PLACE"]


def _model():
    """A tagger by hand: "Ann", "Bo" and "Cy" begin or go on with a person, other words don't."""
    said = [next(tagger.features(w, tagger.tokens(w))) for w in ("Ann", "Bo", "Cy")]
    weights = {said[0][-1]: [1.5, 0.0, 0.0], **{f[0]: [0.0, 2.0, 2.0] for f in said}}
    return tagger.Model(["O", "B-PERSON", "I-PERSON"], weights, [[0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]])


def test_best_sequence_by_brute_force():
    chance = random.Random(3)
    n = len(_TAGS)
    for _ in range(30):
        model = tagger.Model(_TAGS, {f: [chance.gauss(0, 1) for _ in _TAGS] for f in range(6)}, [[chance.gauss(0, 1) for _ in _TAGS] for _ in range(n + 1)])
        rows = [[chance.randrange(8) for _ in range(3)] for _ in range(4)]

        def worth(path, model=model, rows=rows):
            before = [n, *path]
            return sum(model.steps[a][b] + sum(model.weights[f][b] for f in row if f in model.weights) for a, b, row in zip(before, path, rows))

        fine = [p for p in itertools.product(range(n), repeat=4) if all(tagger.follows(_TAGS, a, b) for a, b in zip([n, *p], p))]
        got = tagger.decode(model, rows)
        assert tuple(got) in fine and abs(worth(got) - max(map(worth, fine))) < 1e-9
    assert tagger.decode(model, []) == []


def test_average_by_plain_python():
    text, marked = "Ann saw Rex", [(0, 3, "PERSON"), (8, 11, "DOG")]
    model = tagger.learnt([(text, marked)], {"PERSON"}, rounds=1, drop=0.0)
    # one step: all O is said first, then the gold path is added; the mean of the value before it and after it
    first, other, _ = tagger.features(text, tagger.tokens(text))
    assert {f: w for f, w in model.weights.items() if f == first[0]} == {first[0]: [-0.5, 0.5, 0.0]}
    assert other[0] not in model.weights
    assert list(tagger.spans(tagger.learnt([(text, marked)], {"PERSON"}, rounds=20, drop=0.0), text)) == [("PERSON", 0, 3)]


def test_odd_rows(spark):
    long = "to Ann Bo and " * 20_000
    rows = [(1, "hi Ann Bo!", 7), (1, "Cy", 7), (None, "hi Ann Bo!", 7), (None, "hi Ann Bo!", 8), (2, "", 7), (3, None, 7), (4, long, 7), (5, "\U0001f600 Ann", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label long").withColumn("start", F.lit("x"))
    got = tagger.tagged(docs, _model()).where("doc_id is null or doc_id <> 4").select("doc_id", "label", "start", "end", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "PERSON", 3, 9, "Ann Bo"), (1, "PERSON", 0, 2, "Cy"), (None, "PERSON", 3, 9, "Ann Bo"), (None, "PERSON", 3, 9, "Ann Bo"), (5, "PERSON", 2, 5, "Ann")], key=str)
    assert tagger.tagged(docs, _model()).where("doc_id = 4").count() == 20_000
    assert tagger.tagged(docs.limit(0), _model()).count() == 0
    assert tagger.tagged(docs, tagger.fit(spark.createDataFrame([], "doc_id long, text string, spans array<struct<start:int,end:int,label:string>>"), {"PERSON"})).count() == 0


def test_rows_keep_their_own_names(spark):
    rows = [(None, "said to Ann bo", 1)] * 40 + [(None, "xx Bo yy", 1), (7, "said to Ann bo", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = named.cleaned(tagger.tagged(docs, _model()))
    got = detect(docs, active={"PERSON"}, extra=found).groupBy("doc_id", "text", "start").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "Ann bo", 8, 40), (None, "Bo", 3, 1), (7, "Ann bo", 8, 1)], key=str)


def test_templates_not_seen(spark):
    texts = gold.labelled(spark.range(800), "id").cache()
    seen = f"doc_id % {len(gold.TEMPLATES)} in (0, 2, 5)"
    unseen = texts.where(f"not {seen}")
    model = tagger.fit(texts.where(seen), {"PERSON"}, most=200)
    assert model == tagger.fit(texts.repartition(5).where(seen), {"PERSON"}, most=200)
    alone, both = (gold.scores(unseen, detect(unseen, extra=x)).where("label = 'PERSON'").first() for x in (None, named.cleaned(tagger.tagged(unseen, model))))
    assert both.fn < alone.fn and both.f1 > alone.f1
