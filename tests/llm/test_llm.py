"""The corpus operators against brute force, round trips and held-out labels, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import components, decontaminate, lattice, lzprint, machine, mixing, sanitise, secrets, setsketch, sstable, toxicity
from umbra.llm.queries import tokenizer_file
from umbra.llm.shared import fresh, training

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ñu", "ö", "ti"]
SCHEMA = "doc_id long, text string, lang string, score double, id long, token string"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", 0.5, 7, "x") for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \t\n ", "one", "A b", "a a a a a a a a", "É ÉTÉ ñ é", "x" * 3000, "\U0001f600 emoji \U0001f600"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 80)
    for k in range(12):  # near and exact copies
        ws = base.split()
        for _ in range(k % 4):
            ws[rng.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    return texts + ODD + [prose(rng, 6000)]


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split("[ \t-\r]+", low) if w]
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else frozenset()


def classes(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, width):
    got = {r.doc_id: r for r in setsketch.near_duplicates(documents(spark, corpus), width=width).collect()}
    sets = {i: shingles(t, width) for i, t in enumerate(corpus)}
    want = classes(sets)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(150):  # around the threshold: some pairs link, some don't
        ws = list(base)
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = prose(rng, 1)
        texts.append(" ".join(ws))
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(documents(spark, texts), width=5).collect()}
    assert got == classes({i: shingles(t, 5) for i, t in enumerate(texts)})


def test_large_buckets_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "PER_MEMBER", 0)  # every bucket counts as large
    monkeypatch.setattr(setsketch, "SLICE", 40, raising=False)
    rng = random.Random(15)
    base, texts = [f"w{k}" for k in range(300)], []
    for i in range(120):  # pairs just over the threshold, all from one text and so in the same buckets
        ws = [f"v{i}x{k}" if k in cut else w for cut in [set(rng.sample(range(300), 20))] for k, w in enumerate(base)]
        twin = [f"t{i}x{k}" if k in cut else w for cut in [set(rng.sample(range(300), 33))] for k, w in enumerate(ws)]
        texts += [" ".join(ws), " ".join(twin)]
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(documents(spark, texts), width=1).collect()}
    assert got == classes({i: shingles(t, 1) for i, t in enumerate(texts)})


@pytest.mark.parametrize("own", [True, False])
def test_group_of_copies_around_one_text(spark, own):
    """Random edits of one text: the ones under the threshold end by words of their own, or, where copies draw their
    words from a few, by listing."""
    rng = random.Random(23)
    base, texts = prose(rng, 90).split(), []
    for i in range(260):
        ws = list(base)
        for _ in range(rng.randint(0, 9)):
            ws[rng.randrange(len(ws))] = f"own{i}x{rng.random()}" if own else f"of{rng.randrange(4)}"
        texts.append(" ".join(ws))
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(documents(spark, texts), width=4).collect()}
    assert got == classes({i: shingles(t, 4) for i, t in enumerate(texts)})


def test_ids_of_many_pairs_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "SPREAD", 7)
    monkeypatch.setattr(setsketch, "BROADCAST_ROWS", 0)
    test_large_group_of_near_copies(spark)


def test_keys_with_several_texts_stand_for_one(spark):
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one), (1, two), (2, one), (3, two), (4, "x y z")]
    got = sorted((r.doc_id, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in ([(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)], [(1, 1), (1, 1), (2, 2), (3, 1), (4, 4)])


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 3000, np.uint64), rng.integers(0, 2**63, 1000, np.uint64)
    x, y = a, np.concatenate([a[:2500], b])
    ka, kb = setsketch.registers(x), setsketch.registers(y)
    true = 2500 / 4000
    assert abs(setsketch.estimate(ka[None], kb[None], np.array([3000.0]), np.array([3500.0]))[0] - true) < 0.1
    assert (setsketch.merged(ka, kb) == setsketch.registers(np.concatenate([x, b]))).all()


def test_near_duplicates_of_repeated_null_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, None), (6, "")]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got)[1:] == [(1, 2, 1), (1, 2, 1), (5, 0, 5), (6, 0, 6)]
    assert setsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}


def naive_phrases(text):
    seen, out, w = set(), [], ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            out.append(w)
            w = ""
    return out + ([w] if w else [])


def test_phrases_equal_the_plain_parse(corpus):
    for t in corpus:
        assert lzprint.parse(t or "", 0, set(), []) == naive_phrases(t or "")


def test_fingerprints_with_next(spark, corpus):
    texts = [t or "" for t in corpus]
    got = {r.doc_id: r for r in lzprint.compared_with_next(documents(spark, corpus).repartition(3)).collect()}
    ids = list(range(len(texts)))[::-1]
    assert len(got) == len(texts)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lzprint.fingerprint(t), lzprint.fingerprint(edited))
        assert r.near_edited == lzprint.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == lzprint.likeness(r.fingerprint, lzprint.fingerprint(following))


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(lzprint, "RANGE", 200)
    rows = [(k * 7 - 50, f"text number {k}") for k in range(40)] + [(None, "none")]
    got = {r.doc_id: r.near_next for r in lzprint.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [rows[-1]]
    for k, (i, t) in enumerate(order):
        assert got[i] == lzprint.likeness(lzprint.fingerprint(t), lzprint.fingerprint(order[(k + 1) % len(order)][1]))


def test_fingerprints_of_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(lzprint, "RANGE", 300)
    rows = [(None if k % 2 else 7, prose(random.Random(k), 12)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = {(r.doc_id, r.fingerprint): r.near_next for r in lzprint.compared_with_next(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, hashes[r[1]]), reverse=True)
    for k, (i, t) in enumerate(order):
        assert got[i, lzprint.fingerprint(t)] == lzprint.likeness(lzprint.fingerprint(t), lzprint.fingerprint(order[(k + 1) % len(order)][1]))


def test_fingerprints_of_one_row_and_none(spark):
    assert lzprint.compared_with_next(spark.createDataFrame([(4, "abc")], "doc_id long, text string")).first().near_next == 1.0
    assert lzprint.compared_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_machine_learns_and_the_identity_holds(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(300):
        good = rng.random() < 0.7
        t = prose(rng, 60)
        texts.append(t if good else " ".join(w + "$$$" for w in t.split()))
        labels.append(int(good))
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, label int")
    model = machine.fit(rows.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in machine.score(documents(spark, texts + ODD), model).collect()}
    held = [i for i in range(300) if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == labels[i] for i in held]) > 0.95 and all(0 <= s <= 1 for s in got.values())
    stats, index, at = np.zeros((1, len(model.mean))) + model.mean, np.array([3, 9], np.int32), np.array([0, 2])
    x = 1 / math.sqrt(2)
    pair = model.factor[3].astype(float) @ model.factor[9].astype(float) * x * x
    assert abs(model.raw(stats, index, at)[0] - (model.bias + (model.weight[3] + model.weight[9]) * x + pair)) < 1e-4


def test_machine_without_labels(spark):
    model = machine.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert machine.score(documents(spark, ["a", None]), model).first().score == 0.5


def brute_segments(scores):
    """Ruzzo and Tompa's definition: the best contiguous run (shortest, then leftmost), then the same on either side."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12 or abs(total - best[2]) <= 1e-12 and j + 1 - i < best[1] - best[0]):
                best = (i, j + 1, total)
    if best is None:
        return []
    left, right = brute_segments(scores[: best[0]]), brute_segments(scores[best[1] :])
    return left + [best] + [(a + best[1], b + best[1], s) for a, b, s in right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 14)
        values = {i: rng.choice([1.3, 2.7, 0.45]) for i in range(n) if rng.random() < 0.4}
        got = toxicity.segments(sorted(values), [values[i] for i in sorted(values)], 0.62)
        want = brute_segments([values.get(i, -0.62) for i in range(n)])
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in want]


def test_toxicity_finds_passages(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        ws, bad = prose(rng, 50).split(), i % 5 == 0
        if bad:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(ws), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.where("doc_id % 4 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in rows if i % 4 == 0)
    assert all(got[i].passages for i, _, y in rows if y)
    kept = toxicity.rejected(documents(spark, ODD + [rows[0][1]]), model)
    assert kept.count() == len(ODD) and kept.columns == ["doc_id", "text", "lang", "score", "id", "token"]
    assert toxicity.score(documents(spark, ["idiot"]), toxicity.fit(df.where("doc_id < 0"))).first().score < 0.5
    with pytest.raises(ValueError):
        toxicity.score(documents(spark, ["a"]), model, keep=(F.col("score"),))


INSULTS = "you utterly worthless stinking pile of rotten garbage fools".split()


def _toxic_rows(kind, rng, n=300):
    """Half toxic: by one passage that stands in different texts word for word, or as near copies of a few texts."""
    hosts = [prose(rng, 60).split() for _ in range(8)]
    for i in range(n):
        ws = prose(rng, 60).split()
        if i % 2:
            yield i, " ".join(ws), 0
        elif kind == "passage":
            at = rng.randrange(len(ws))
            yield i, " ".join(ws[:at] + INSULTS + ws[at:]), 1
        else:
            host = list(hosts[i % 8])
            host[rng.randrange(60)] = f"number{i}"
            yield i, " ".join(host[:30] + INSULTS + host[30:]), 1


@pytest.mark.parametrize("kind", ["passage", "copies"])
def test_toxic_words_of_fixed_passages_and_copies_are_learnt(spark, kind):
    df = spark.createDataFrame(list(_toxic_rows(kind, random.Random(21))), "doc_id long, text string, label int")
    model = toxicity.fit(df)
    assert {w.encode() for w in INSULTS} <= set(model.lexicon)
    fresh_ = documents(spark, [" ".join(prose(random.Random(31 + i), 40).split() + INSULTS) for i in range(5)] + [prose(random.Random(50 + i), 60) for i in range(20)])
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(fresh_, model).collect()}
    assert all(got[i] for i in range(5)) and sum(got[i] for i in range(5, 25)) <= 1


def test_the_curve_converges_on_separable_rows():
    x = np.concatenate([np.zeros(14_000), np.full(60, 2.1), np.linspace(2.8, 7, 1700)])
    y = np.concatenate([np.zeros(14_060), np.ones(1700)])
    a, b = toxicity.curve(x, y)
    assert ((a + b * x >= 0) == (y == 1)).all()


def test_training_takes_keys_before_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(3, "a text"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (4, None)], "doc_id long, label int")
    got = {r.key: (r.text, r.label) for r in training(docs, labels, "doc_id", "text", "label", 1000).collect()}
    assert len(got) == 50 and got[3] == ("a text", 1) and got[4] == ("text 4", 0)
    few = [training(docs.repartition(n), labels, "doc_id", "text", "label", 10).collect() for n in (1, 5)]
    assert sorted(few[0]) == sorted(few[1]) and len(few[0]) <= 10
    assert training(docs.where("doc_id < 0"), labels, "doc_id", "text", "label", 10).count() == 0


PII = ["mail ann.b@x.example.com or +61 (2) 1234-5678", "ip 10.0.0.255 and 10.0.0.256", "card 4111 1111 1111 1111 4111-1111-1111-1112", "a@b", "@@x@y.z.", "x.y@z.w@q.r", "1.2.3.4.5.6.7.8", "+1+22222222222", "0" * 5000 + ".1.1.1"]


def naive_base(text):
    rx = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, r in enumerate(rx):
        for m in re.finditer(r, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x.lstrip("0")[:9] or 0) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and sanitise.luhn(digits)):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_the_plain_regexes(spark, corpus):
    rng = random.Random(9)
    noise = ["".join(rng.choice("a1.@+- (9%") for _ in range(60)) for _ in range(300)]
    for t in [*PII, *noise]:
        assert sanitise.base(t) == naive_base(t)
    got = sanitise.digested(sanitise.found(documents(spark, PII + ODD))).collect()
    for r in got:
        t = (PII + ODD)[r.doc_id] or ""
        said = sanitise.shown(naive_base(t))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in naive_base(t)) for k in range(4))


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(6)
    lines = [f"{prose(rng, 4)} zanzibarian {prose(rng, 3)} ann@x.example.com" for _ in range(5)]
    docs = documents(spark, lines + [prose(rng, 30) for _ in range(40)] + [None])
    got = {r.doc_id: r for r in sanitise.digested(sanitise.found(docs)).collect()}
    assert all("term:" in got[i].spans and got[i].n_term == 1 for i in range(5)) and all(got[i].n_term == 0 for i in range(5, 46))
    new = {r.doc_id: r.text for r in sanitise.sanitise(docs, general={"zanzibarian": "[PLACE]"}).collect()}
    assert "[PLACE]" in new[0] and "[EMAIL]" in new[0] and "ann@" not in new[0] and new[10] == docs.where("doc_id = 10").first().text and new[45] is None


def test_terms_count_every_line_and_lines_beside(spark):
    rng = random.Random(17)
    one = "\n".join(f"{prose(rng, 3)} zanzibarian\n{k} ann@x.example.com" for k in range(4)) + "\nann@x.example.com"
    docs = documents(spark, [one, "mail bob@y.example.com about ruritania", *(prose(rng, 30) for _ in range(40))])
    got = {r.doc_id: r for r in sanitise.found(docs).collect()}
    said = lambda i, t: {t[s.start : s.end] for s in got[i].spans if s.kind == 4}
    assert "zanzibarian" in said(0, one) and "ruritania" in said(1, "mail bob@y.example.com about ruritania")
    again = [f"{w} carl@z.example.com {k}" for k, w in enumerate(["seldom", "seldom", "other", "another"])]
    got = {r.doc_id: r for r in sanitise.found(documents(spark, ["\n".join(f"x {a}\n\n" for a in again), *(prose(rng, 30) for _ in range(40))])).collect()}
    assert all(s.kind != 4 for s in got[0].spans)  # two lines of four are too few


def test_terms_go_from_every_document_that_names_the_entity(spark):
    rng = random.Random(18)
    far = f"ann@x.example.com\n{prose(rng, 40)}\n{prose(rng, 2)} Zanzibarian\n{prose(rng, 40)}"
    docs = documents(spark, [f"{prose(rng, 4)} zanzibarian {prose(rng, 3)} ann@x.example.com" for _ in range(5)] + [far, "zanzibarian alone"] + [prose(rng, 30) for _ in range(40)])
    got = {r.doc_id: r.n_term for r in sanitise.digested(sanitise.found(docs)).collect()}
    assert [got[i] for i in range(7)] == [1] * 6 + [0]
    new = {r.doc_id: r.text for r in sanitise.sanitise(docs, general={"zanzibarian": "[PLACE]"}).collect()}
    assert "[PLACE]" in new[5] and "anzibarian" not in new[5] and new[6] == "zanzibarian alone"


def test_mixing_meets_the_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 50) if i % 4 else " | ".join(prose(rng, 50).split()), "clean" if i % 4 else "low") for i in range(400)]
    df, weights = spark.createDataFrame(rows, "doc_id long, text string, domain string"), {"clean": 0.9, "low": 0.1}
    model = mixing.fit(df, None, list(weights))
    out = mixing.mixed(df, model, weights).collect()
    got = [sum(r.tokens * r.p[k] * r.rate for r in out) for k in range(2)]
    assert all(r.rate >= 0 for r in out) and abs(got[0] / sum(got) - 0.9) < 0.01
    thin = mixing.mix(df, model, weights, most=1.0)
    kept = Counter(r.domain for r in thin.collect())
    assert thin.columns == df.columns and kept["clean"] >= 295 and kept["low"] < 80
    odd = mixing.mix(documents(spark, ODD), model, weights)
    assert odd.columns == documents(spark, []).columns and odd.count() >= 0 and mixing.mix(documents(spark, []), model, weights).count() == 0


def test_mixing_copies_rows_by_their_rate(spark):
    df = spark.createDataFrame([(i, f"word{i} again") for i in range(60)], "doc_id long, text string")
    none = mixing.fit(df.where("doc_id < 0").selectExpr("doc_id", "text", "'a' as domain"), None, ["a", "b"])
    got = Counter(r.doc_id for r in mixing.mix(df, none, {"a": 0.5, "b": 0.5}, total=300.0).collect())  # 120 tokens, 300 wanted: 2.5 times each
    assert set(got.values()) == {2, 3} and len(got) == 60


@pytest.mark.parametrize("most", [float("inf"), 1.0])
def test_rates_minimise_the_least_squares(spark, most):
    rng = np.random.default_rng(7)
    p, t = rng.dirichlet([0.3] * 3, 60), rng.integers(0, 900, 60)
    known = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p)], "tokens long, p array<double>")
    share, total = np.array([0.5, 0.3, 0.2]), 0.8 * t.sum()
    steps, goal, reached = mixing.fitted(known, {"a": 0.5, "b": 0.3, "c": 0.2}, total=total, most=most)
    assert np.allclose(goal, share * total)
    r, _ = steps.rates(p)
    assert r.min() >= 0 and r.max() <= most and np.allclose((t * r) @ p, reached)
    a, x = (p * t[:, None]).T, np.ones(60)  # brute force: very many small plain gradient steps
    for _ in range(100_000):
        x = np.clip(x - a.T @ (a @ x - goal) / np.linalg.norm(a, 2) ** 2, 0, most)
    best = np.linalg.norm(a @ x - goal)
    assert np.linalg.norm(reached - goal) <= best + 2e-2 * goal.sum()


def naive_hits(doc, items, width=13):
    rx = re.compile(decontaminate.WORD)
    words = lambda t: rx.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, found = words(doc), set(), set()
    for name, t in items:
        iw = words(t)
        if not iw:
            continue
        n = min(width, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(ws), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(10)
    items = [(3, prose(rng, 40)), (20, "Short-Item, three"), (100, prose(rng, 13)), (7, None), (8, "..."), (9, prose(rng, 40))]
    one = items[0][1].split()
    docs = [prose(rng, 30) + " " + " ".join(one[5:25]).upper() + " " + prose(rng, 10), " ".join(one[:12]), "SHORT item; three short item three", items[2][1] + " " + items[2][1], items[5][1] + "\n" + prose(rng, 2000), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(documents(spark, docs), bench).collect()}
    assert got == {i: naive_hits(t, items) for i, t in enumerate(docs)}
    left = decontaminate.decontaminate(documents(spark, docs), bench)
    assert left.columns == documents(spark, []).columns and {r.doc_id for r in left.collect()} == {i for i, t in enumerate(docs) if not (lambda n, h, _: h > 0 and 20 * h >= n)(*naive_hits(t, items))}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(documents(spark, docs), bench, remove="spans").collect()}
    assert re.sub(r"\W", "", cut[2]) == "" and cut[1] == docs[1] and cut[5] is None
    assert decontaminate.contamination(documents(spark, docs), bench.where("item_id < 0")).where("n_hit > 0").count() == 0


def test_decontamination_by_shuffle_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    test_decontamination_equals_brute_force(spark)


def test_lattice_sums_all_segmentations():
    m = lattice.Lattice.normalised({"▁": 1, "▁a": 2, "a": 3, "ab": 1, "b": 2, "▁ab": 1}, [0.1] * 256, 1.0)

    def every(s):
        if not s:
            return 1.0
        total = sum(math.exp(v) * every(s[len(p) :]) for p, v in m.log.items() if s.startswith(p))
        return total if s[0] in "▁ab" else math.exp(sum(m.bytes_log[x] for x in s[0].encode())) * every(s[1:])

    for w in ("a", "ab", "aab", "abab", "zé", "b▁a"[:1]):
        assert abs(m.word(w) - math.log(every("▁" + w))) < 1e-9
    pieces, of_bytes = {}, [0.0] * 256
    m.expect("abz", 2.0, pieces, of_bytes)
    assert abs(of_bytes[ord("z")] - 2.0) < 1e-9 and abs(sum(len(p) * n for p, n in pieces.items()) - 2.0 * 3) < 1e-9
    assert math.isfinite(m.word("a" * 5000))


def test_lattice_scores_equal_the_plain_model(spark, corpus, monkeypatch):
    texts = corpus[:40] + ODD
    df = documents(spark, texts)
    learn = (F.col("doc_id") % 7) != 2
    for head in (5, 100_000):
        got = {r.doc_id: r for r in lattice.score(df, learn, tokenizer_file("piece_bpe_32k.model"), rounds=1, head=head).collect()}
        split = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
        counts = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in split(t))
        total, distinct = sum(counts.values()), len(counts)
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ws, r = split(t), got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
            assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) < 1e-6 * max(1, len(ws)) and r.score < 0
    twice = lattice.score(df.unionByName(df.where("doc_id = 3")), learn, tokenizer_file("piece_bpe_32k.model"), rounds=1)
    assert twice.where("doc_id = 3").select("score").distinct().count() == 1 and twice.count() == len(texts) + 1


def test_lattice_scores_equal_brute_force(spark, corpus):
    """score and lattice against sums over every segmentation, with the pieces' probabilities that training gives."""
    texts = ["ab ba aab", "zz ab", None, "é ab\tbab", "ab ab ab", "cab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = lattice.Lattice.of(tokenizer_file("piece_bpe_32k.model"))
    learn = F.col("doc_id") != 5
    got = {r.doc_id: r for r in lattice.score(df, learn, tokenizer_file("piece_bpe_32k.model"), rounds=2, head=2).collect()}
    counts = Counter(w for t in texts[:5] for w in (t or "").split())

    def ways(m, s, i=0):
        """Every segmentation of s[i:]: the log-probabilities of its pieces; a character without a piece is its bytes."""
        if i == len(s):
            yield []
            return
        pieces = [(s[i:j], m.log[s[i:j]]) for j in range(i + 1, len(s) + 1) if s[i:j] in m.log]
        if not any(len(p) == 1 for p, _ in pieces):
            pieces.append((s[i], sum(m.bytes_log[b] for b in s[i].encode())))
        for p, v in pieces:
            for rest in ways(m, s, i + len(p)):
                yield [(p, v), *rest]

    total_of = lambda m, w: sum(math.exp(sum(v for _, v in x)) for x in ways(m, "▁" + w))
    m = start
    for _ in range(2):  # expectation maximisation over distinct words, by enumeration
        n, of_bytes = Counter(), [0.0] * 256
        for w in counts:
            z = total_of(m, w)
            for x in ways(m, "▁" + w):
                share = math.exp(sum(v for _, v in x)) / z
                for p, v in x:
                    if p in m.log and m.log[p] == v:
                        n[p] += share
                    else:
                        for b in p.encode():
                            of_bytes[b] += share
        m = lattice.Lattice.normalised({p: n[p] + lattice.FLOOR for p in m.log}, [x + lattice.FLOOR for x in of_bytes], 5 + lattice.FLOOR)
    total, distinct, d = sum(counts.values()) + 5, len(counts) + 1, lattice.DISCOUNT
    for i, t in enumerate(texts):
        ws = (t or "").split()
        pure = sum(math.log10(total_of(m, w)) for w in ws) + m.end / math.log(10)
        whole = sum(math.log10(d * distinct / total * total_of(m, w) + max(0, counts[w] - d) / total) for w in ws)
        whole += math.log10((5 - d) / total + d * distinct / total * math.exp(m.end))
        assert abs(got[i].lattice - pure) < 1e-6 and abs(got[i].score - whole) < 1e-6


def test_lattice_learns_in_two_rounds(spark, corpus):
    df, file = documents(spark, corpus[:40]), tokenizer_file("piece_bpe_32k.model")
    learn = (F.col("doc_id") % 7) != 2
    total = lambda **how: lattice.score(df, learn, file, **how).where("doc_id % 7 = 2").agg(F.sum("score")).first()[0]
    assert abs(total() - total(rounds=2)) < 1e-6 and total() > total(rounds=1)


SECRET = 'call\ntoken = "{}"\nthen go'


def test_secret_forest(spark):
    rng = random.Random(12)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [SECRET.format(key()) for _ in range(80)] + [f"see commit {key()} for more" for _ in range(80)] + ["number 12345678901234567890 stands alone"] * 20
    docs = documents(spark, texts + ODD)
    found = secrets.scan(docs).collect()
    assert {r.doc_id for r in found} == set(range(180))
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.predicted == (r.doc_id < 80) for r in held)
    for r in found:
        assert texts[r.doc_id][r.start : r.end] == r.candidate
    clean = {r.doc_id: r.text for r in secrets.redacted(docs, spark.createDataFrame(found)).collect()}
    assert "[SECRET]" in clean[0] and clean[100] == texts[100]
    assert secrets.scan(documents(spark, [])).count() == 0


def test_planted_findings_held_out(spark):
    rows = secrets.planted(spark, 3000).cache()
    at = secrets.candidates(rows, "n", "text", "path").join(rows.select("n", "start", "end", "label"), ["n", "start", "end"])
    assert at.count() > 2800  # nearly every planted value is one candidate
    docs = rows.where("n % 5 = 0").select(F.col("n").alias("doc_id"), "text")
    host = documents(spark, [prose(random.Random(i), 80) for i in range(50)], 10**6).select("doc_id", "text")
    got = secrets.scan(docs.unionByName(host), rows.where("n % 5 <> 0").drop("n"))
    held = got.join(rows.selectExpr("n as doc_id", "start", "end", "label"), ["doc_id", "start", "end"]).collect()
    caught = np.mean([r.predicted for r in held if r.label])
    right = np.mean([r.label for r in held if r.predicted])
    assert caught > 0.9 and right > 0.9 and 0.2 < np.mean([r.label for r in held]) < 0.8


def test_bare_keys_are_told_from_names(spark):
    rng = random.Random(19)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    texts = [f"{prose(rng, 8)} {key()} {prose(rng, 5)}" for _ in range(40)] + [f"{prose(rng, 8)} defaultUserFactoryManager {prose(rng, 3)}" for _ in range(40)]
    got = secrets.scan(documents(spark, texts)).collect()
    assert np.mean([r.predicted for r in got if r.candidate.startswith("AKIA")]) > 0.9
    assert np.mean([r.predicted for r in got if r.candidate.startswith("default")]) < 0.1
    clash = documents(spark, texts[:3]).select(F.col("doc_id").alias("path"), F.col("text").alias("start"))
    assert secrets.scan(clash, key="path", text="start").columns[0] == "path"


def test_unquoted_secrets_are_found(spark):
    rng = random.Random(16)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    forms = ["AWS_SECRET_ACCESS_KEY={}", "api_key={}\nnext=1", "export GITHUB_TOKEN={}", "see https://x.example.com/?page=2&token={}&a=b", "clientSecretNumber2={}"]
    keys = [key() for _ in range(100)]
    texts = [forms[i % 5].format(k) for i, k in enumerate(keys)] + [f"see commit {key()} for more" for _ in range(80)]
    found = secrets.scan(documents(spark, texts)).collect()
    held = {(r.doc_id, r.candidate): r.predicted for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    for i, k in enumerate(keys):
        at = texts[i].index(k)
        assert (i, at, at + 40, k) in {(r.doc_id, r.start, r.end, r.candidate) for r in found}
        assert held.get((i, k), 1) == 1
    assert all(p == 0 for (i, _), p in held.items() if i >= 100) and len(held) > 20
    padded = secrets.candidates(documents(spark, ["token: QWxhZGRpbjpvcGVuIHNlc2FtZTE==", "a=QWxhZGRpbjpvcGVuIHNlc2FtZTE=\n"])).collect()
    assert sorted(r.candidate for r in padded) == ["QWxhZGRpbjpvcGVuIHNlc2FtZTE=", "QWxhZGRpbjpvcGVuIHNlc2FtZTE=="]


def test_token_shards_round_trip(spark, corpus, monkeypatch):
    from tokenizers import Tokenizer

    path, file = fresh(spark, "t"), tokenizer_file("word_bpe_49k.json")
    df = documents(spark, corpus).unionByName(documents(spark, ["none"]).withColumn("doc_id", F.lit(None).cast("long")))
    sstable.write(df, path, file, size=4000, shard=2000)
    t = Tokenizer.from_file(file)
    order = [(None, "none"), *enumerate(corpus)]
    at, want = 0, {}
    for i, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.offsets(spark, path).collect()}
    assert got == want
    assert sstable.lookup(spark, path, 3) == [[*t.encode(corpus[3], add_special_tokens=False).ids, 1]] and sstable.lookup(spark, path, 10**9) == []
    empty = fresh(spark, "t")
    sstable.write(documents(spark, []), empty, file)
    assert sstable.offsets(spark, empty).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    encode, t = sstable.Encoder(file), Tokenizer.from_file(file)
    rng = random.Random(14)
    alphabet = "aB1 'sth$\tÉñß²½ºª«\xa0\x85́Σσİ漢\U0001f600\n<|endoftext|>"
    assert encode.by_word
    for k in range(800):
        s = "".join(rng.choice(alphabet if k % 2 else "aBcé ßñ$'s12!") for _ in range(rng.randint(0, 40)))
        assert encode(s, 1) == np.array([*t.encode(s, add_special_tokens=False).ids, 1], "<u2").tobytes()


def test_shard_reader_finds_every_key():
    w = sstable.Writer(2)
    keys = sorted({random.Random(1).randrange(-(10**6), 10**6) for _ in range(1)} | set(range(-500, 5000, 3)))
    for k in keys:
        w.add(sstable.key_of(k), np.full(40, k % 1000, "<u2").tobytes())
    w.add(sstable.key_of(keys[-1]), b"\x07\x00")
    r = sstable.Reader(w.finish())
    assert len(r.spots) >= 3 and [k for k, _ in r] == [*keys, keys[-1]]
    assert all(r.get(k)[0][0] == k % 1000 for k in keys) and len(r.get(keys[-1])) == 2 and r.get(-499) == []
    with pytest.raises(ValueError):
        sstable.Reader(b"UMBRASST and then nothing")
