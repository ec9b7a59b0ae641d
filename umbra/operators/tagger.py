"""A sequence tagger for names: an averaged perceptron over words, decoded by Viterbi, fitted on labelled spans.

    model = fit(labelled, {"PERSON"})
    entities = detect(docs, extra=named.cleaned(tagged(docs, model)))

Fitting takes a bounded sample to the driver (see fit); tagging is one narrow pass over Arrow batches, and the model that
goes with it has at most 2**BITS rows of a number for each tag.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import catalog as C

#: Features are hashed to so many bits.
BITS = 16
#: Sums of tokens that are kept from one text to the next.
MEMO = 1 << 16
_TOKEN = re.compile(r"\w+|[^\w\s]")
_NEVER = -1e18


@dataclass(frozen=True)
class Model:
    """tags: "O", then "B-x" and "I-x" of each label; weights: feature -> a number for each tag; steps[a][b]: tag b after
    tag a, the last row for the first token."""

    tags: list[str]
    weights: dict[int, list[float]]
    steps: list[list[float]]


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of words and single marks, in code points."""
    return [m.span() for m in _TOKEN.finditer(text)]


def _shape(word: str) -> str:
    """Kinds of characters with runs shortened: "McKay" is "XxXx", "AB12" is "Xd"."""
    out = ""
    for c in word[:32]:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        if not out.endswith(kind):
            out += kind
    return out


@lru_cache(1 << 14)
def _forms(word: str) -> tuple[str, str]:
    return word.lower(), _shape(word)


def _around(text: str, places: Sequence[tuple[int, int]]) -> list[tuple]:
    """What a token's features are made from: the two words before it, its own, the two after it ("" beyond an end), and
    whether it and the next one begin a line."""
    said = ["", "", *(text[s:e] for s, e in places), "", ""]
    new = [True, *("\n" in text[places[i - 1][1] : places[i][0]] for i in range(1, len(places))), True]
    return [(*said[i : i + 5], new[i], new[i + 1]) for i in range(len(places))]


def _features(b2: str, b: str, now: str, a: str, a2: str, new: bool, ends: bool) -> list[int]:
    (w, s), (pw, ps), (nw, ns) = _forms(now), _forms(b), _forms(a)
    said = (f"w{w}", f"s{s}", f"e{w[-3:]}", f"p{pw}", f"q{ps}", f"n{nw}", f"m{ns}", f"c{b2.lower()} {pw}", f"d{pw} {s}", f"f{s} {ns}", f"g{ps} {s} {ns} {new}{ends}", f"h{ns} {_forms(a2)[1]}", "b")
    return [zlib.crc32(f.encode("utf-8", "replace")) & ((1 << BITS) - 1) for f in said]


def features(text: str, places: Sequence[tuple[int, int]]) -> Iterator[list[int]]:
    """Hashed features of each token: the word, its shape and ending, the words and shapes beside it, line starts."""
    return (_features(*x) for x in _around(text, places))


def follows(tags: Sequence[str], a: int, b: int) -> bool:
    """Whether tag b may stand after tag a (len(tags): the text's beginning): an inner tag only after its own label's."""
    return not tags[b].startswith("I-") or (a < len(tags) and tags[a][2:] == tags[b][2:])


def decode(model: Model, rows: Iterable[Sequence[int]]) -> list[int]:
    """The allowed tag sequence of the greatest sum of weights and steps; of equal ones the earlier tags."""
    return _best(model, (_worth(model, row) for row in rows))


def _worth(model: Model, row: Sequence[int]) -> list[float]:
    """A token's sum of weights for each tag."""
    said = [w for f in row if (w := model.weights.get(f)) is not None]
    return [sum(w[t] for w in said) for t in range(len(model.tags))]


def _best(model: Model, worths: Iterable[list[float]]) -> list[int]:
    n = len(model.tags)
    into = [[(a, model.steps[a][b]) for a in range(n) if follows(model.tags, a, b)] for b in range(n)]
    back, best = [], None
    for here in worths:
        if best is None:
            best = [here[t] + model.steps[n][t] if follows(model.tags, n, t) else _NEVER for t in range(n)]
            continue
        came, scores = bytearray(n), []
        for b in range(n):
            top, frm = _NEVER * 2, 0
            for a, step in into[b]:
                if best[a] + step > top:
                    top, frm = best[a] + step, a
            came[b] = frm
            scores.append(top + here[b])
        back.append(came)
        best = scores
    if best is None:
        return []
    path = [max(range(n), key=lambda t: (best[t], -t))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def _worths(model: Model, text: str, places: Sequence[tuple[int, int]], memo: dict[tuple, list[float]]) -> Iterator[list[float]]:
    """Each token's sums; those of tokens among the same words are worked out once."""
    if len(memo) > MEMO:
        memo.clear()
    for around in _around(text, places):
        if (worth := memo.get(around)) is None:
            worth = memo[around] = _worth(model, _features(*around))
        yield worth


def spans(model: Model, text: str, memo: dict[tuple, list[float]] | None = None) -> Iterator[tuple[str, int, int]]:
    """(label, start, end) of a text; `memo` keeps a model's sums from one text to the next."""
    places = tokens(text)
    label, start, end = "", 0, 0
    for tag, (s, e) in zip(_best(model, _worths(model, text, places, {} if memo is None else memo)), places):
        name = model.tags[tag]
        if name.startswith("I-"):
            end = e
            continue
        if label:
            yield label, start, end
        label, start, end = name[2:], s, e
    if label:
        yield label, start, end


def learnt(examples: Sequence[tuple[str, Sequence[tuple[int, int, str]]]], labels: Iterable[str], rounds: int = 5, drop: float = 0.5, seed: int = 1) -> Model:
    """The averaged perceptron of (text, spans) in their order; a token is of the first span that it overlaps.

    In each step a share `drop` of every token's features is left out, so that one of them alone, such as the line that all
    examples share, doesn't decide."""
    tags = ["O", *[f"{k}-{x}" for x in sorted(labels) for k in "BI"]]
    at, n = {t: i for i, t in enumerate(tags)}, len(tags)
    work = []
    for text, marked in examples:
        places, gold, last = tokens(text), [], None
        marked = sorted(m for m in marked if f"B-{m[2]}" in at)
        i = 0
        for s, e in places:
            while i < len(marked) and marked[i][1] <= s:
                i += 1
            now = i if i < len(marked) and marked[i][0] < e else None
            gold.append(0 if now is None else at[("I-" if now == last else "B-") + marked[now][2]])
            last = now
        work.append((list(features(text, places)), gold))
    model = Model(tags, {}, [[0.0] * n for _ in range(n + 1)])
    # sums of each change times the step it was made at: the mean over all steps is the last value less this over the steps
    chance = random.Random(seed)
    late, late_steps, step = {}, [[0.0] * n for _ in range(n + 1)], 1
    for _ in range(rounds):
        for whole, gold in work:
            rows = [[f for f in row if chance.random() >= drop] for row in whole] if drop else whole
            said = decode(model, rows)
            if said != gold:
                for by, path in ((1.0, gold), (-1.0, said)):
                    a = n
                    for row, t, g, p in zip(rows, path, gold, said):
                        model.steps[a][t] += by
                        late_steps[a][t] += by * step
                        a = t
                        if g != p:
                            for f in row:
                                model.weights.setdefault(f, [0.0] * n)[t] += by
                                late.setdefault(f, [0.0] * n)[t] += by * step
            step += 1
    weights = {f: [x - y / step for x, y in zip(w, late[f])] for f, w in model.weights.items()}
    return Model(tags, {f: w for f, w in weights.items() if any(w)}, [[x - y / step for x, y in zip(w, v)] for w, v in zip(model.steps, late_steps)])


def fit(labelled: DataFrame, labels: Iterable[str], key: str = "doc_id", most: int = 1000, longest: int = 20_000, rounds: int = 5, drop: float = 0.5) -> Model:
    """A model of labelled (key, text, spans: array of (start, end, label)).

    Learns on the driver from a bounded sample: of the rows whose text has at most `longest` characters, the `most` of
    smallest key hash (then by text). Null texts and rows with null spans take no part; spans of other labels count as
    none; an empty table gives a model that finds nothing."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("spans").isNotNull() & (F.char_length("text") <= longest))
    order = F.xxhash64(F.col(key)).alias("__order")
    some = rows.select(order, "text", "spans").orderBy("__order", "text", "spans").limit(most).collect()
    return learnt([(r.text, [(s.start, s.end, s.label) for s in r.spans]) for r in some], labels, rounds, drop)


def tagged(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, start, end, text, before, after, text_hash) of every span the model finds, for named.cleaned.

    One narrow pass, whole texts of any length. Keys may be null or repeat, each row gives its spans; null and empty texts
    give none; other columns are ignored, whatever their names; an empty table gives no rows."""
    rows = docs.select(F.col(key).alias("__of"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.where("__text <> ''").withColumn("__hash", F.xxhash64("__text"))
    wide = C.CONTEXT_WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, list[float]] = {}
        for batch in batches:
            took, out = [], []
            for i, said in enumerate(batch.column("__text")):
                whole = said.as_py()
                for label, s, e in spans(model, whole, memo):
                    took.append(i)
                    out.append((label, s, e, whole[s:e], whole[max(s - wide, 0) : s], whole[e : e + wide]))
            took = pa.array(took, pa.int64())
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("__of").take(took), *columns, batch.column("__hash").take(took)], names)

    names = ["__of", "label", "start", "end", "text", "before", "after", "text_hash"]
    kind = dict(rows.dtypes)["__of"]
    found = rows.mapInArrow(run, f"__of {kind}, label string, start int, end int, text string, before string, after string, text_hash bigint")
    return found.withColumnRenamed("__of", key)
