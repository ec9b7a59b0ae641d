"""Toxic passages as maximum-scoring segments.

Tokens score by the log-odds of toxic against other documents with an informative Dirichlet prior (the corpus counts);
only tokens whose log-odds stand out keep their value, all others cost a little, and a token's k-th time in a text has
a k-th of it. Both labels are counted in the same unit, documents, and c near copies (texts of one least word-pair hash)
count as 1 + log c documents together, so that copies don't make their ordinary words toxic while a passage that stands
in many different texts is learnt word by word. A linear-time scan finds every maximal-scoring segment of a text (Ruzzo
and Tompa). Scores of segments follow an extreme-value law on ordinary text: lambda solves sum p(s) exp(lambda s) = 1
and K comes from the best segments of ordinary texts; segments whose chance is below a level are significant, their
evidence adds up, and a logistic curve turns it into a probability.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.kernels import slices
from umbra.llm.shared import training

#: Labelled rows that a fit takes at most, and tokens that a lexicon holds at most (those of highest z-score).
FIT_ROWS, LEXICON = 20_000, 20_000
PRIOR = 100.0
#: z-score and log-odds from which a token counts, and the toxic documents (near copies weighed down) that must hold it.
Z, ODDS, DOCUMENTS = 2.0, 1.0, 5.0
#: Each other token's cost, and the chance below which a segment is significant.
COST, LEVEL = 0.1, 0.05
_EDGE = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def tokens(raw: bytes) -> list[bytes]:
    """Words at ASCII white space, A-Z lowered, without punctuation at either end."""
    return [w.strip(_EDGE) for w in raw.lower().split()]


def segments(places: list[int], values: list[float], cost: float) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (first token, end token, score) of a text whose tokens cost `cost` each, but
    those at `places` (ascending) score `values`. Linear time: the stack of Ruzzo and Tompa, runs of cost in one step."""
    found: list[list[float]] = []  # left sum, right sum, first, end, index of the nearest candidate with a smaller left sum
    total, before = 0.0, -1
    for at, value in zip(places, values, strict=True):
        total -= cost * (at - before - 1)
        before = at
        left, total = total, total + value
        if value <= 0:
            continue
        now = [left, total, at, at + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= now[0]:
                j = int(found[j][4])
            if j < 0 or found[j][1] >= now[1]:
                found.append([*now, j])
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(int(f[2]), int(f[3]), f[1] - f[0]) for f in found]


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0
    cost: float = COST

    def scored(self, ws: list[bytes]) -> tuple[list[int], list[float]]:
        """Places and values of the tokens that count."""
        places, values, times = [], [], {}
        for i, v in enumerate(map(self.lexicon.get, ws)):
            if v is not None:
                k = times[ws[i]] = times.get(ws[i], 0) + 1
                places.append(i)
                values.append(v / k)
        return places, values

    def evidence(self, raw: bytes) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Summed evidence, the best segment's chance on ordinary text, and the significant segments."""
        ws = tokens(raw)
        places, values = self.scored(ws)
        if not places:
            return 0.0, 1.0, []
        found = segments(places, values, self.cost)
        space = self.log_k + math.log(len(ws))
        kept = [x for x in found if space - self.rate * x[2] < math.log(-math.log1p(-LEVEL))]
        best = max((x[2] for x in found), default=0.0)
        chance = -math.expm1(-math.exp(min(50.0, space - self.rate * best))) if found else 1.0
        return sum(self.rate * x[2] - space for x in kept), chance, kept

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.intercept + self.slope * math.log1p(max(0.0, evidence))))))


def _likeness(ws: list[bytes]) -> int:
    """The least hash of a text's word pairs: equal for most near copies, seldom for texts that share a passage only."""
    return min((zlib.crc32(a + b" " + b) for a, b in zip(ws, ws[1:], strict=False)), default=zlib.crc32(b"".join(ws)))


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        like = pa.array([_likeness(tokens(raw)) for raw in _raws(batch)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label"), like], names=["text", "label", "like"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n0, n1): the weights of the documents of either label that hold each token, summed within a task."""
    seen: dict[bytes, list[float]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([n[k] for n in seen.values()], pa.float64()) for k in (0, 1))], names=["token", "n0", "n1"])
        seen.clear()
        return out

    for batch in batches:
        for raw, label, weight in zip(_raws(batch), batch.column("label").to_pylist(), batch.column("weight").to_pylist(), strict=True):
            for w in {*tokens(raw)} - {b""}:
                seen.setdefault(w, [0.0, 0.0])[label] += weight
            if len(seen) > 300_000:
                yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "label", rows: int = FIT_ROWS) -> Model:
    """A model from at most `rows` documents that `labels` (key, 0/1 label) names; without `labels`, docs has the label.

    Which rows count says training(); equal texts count once, with the greatest of their labels. Without rows of both
    labels every text scores 0."""
    some = training(docs, labels, key, text, label, rows).groupBy("text").agg(F.max(F.col("label").cast("int")).alias("label"))
    some = some.mapInArrow(_signed, "text string, label int, like long").persist()
    copies = some.groupBy("label", "like").count()  # at most `rows` rows
    weighed = some.join(F.broadcast(copies), ["label", "like"]).select("text", "label", ((1 + F.log("count")) / F.col("count")).alias("weight"))
    n = {r["label"]: r["n"] for r in weighed.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        some.unpersist()
        return Model(intercept=-40.0)
    counts = weighed.mapInArrow(_counted, "token binary, n0 double, n1 double").groupBy("token").agg(F.round(F.sum("n0"), 6).alias("n0"), F.round(F.sum("n1"), 6).alias("n1"))
    counts = counts.where(F.col("n1") >= DOCUMENTS)
    prior = F.lit(PRIOR) * (F.col("n0") + F.col("n1")) / F.lit(n[0] + n[1])
    odds = lambda c, k: F.log((F.col(c) + prior) / (F.lit(n[k] + PRIOR) - F.col(c) - prior))
    value = odds("n1", 1) - odds("n0", 0)
    z = value / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    chosen = counts.select("token", value.alias("value"), z.alias("z")).where((F.col("z") >= Z) & (F.col("value") >= ODDS)).orderBy(F.desc("z"), "token").limit(LEXICON).collect()
    model = Model({bytes(r["token"]): float(r["value"]) for r in chosen})
    if model.lexicon:
        _calibrate(model, some)
    else:
        model.intercept = -40.0
    some.unpersist()
    return model


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of the logistic curve of greatest likelihood, with a small ridge for rows that one value
    separates: Newton's steps on a convex loss, each halved until the loss falls."""

    def loss(a: float, b: float) -> float:
        z = a + b * x
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * b * b)

    a, b = math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)), 0.0
    now = loss(a, b)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -700, 700)))
        w = p * (1 - p)
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + 1e-9, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-9 and loss(a + size * step[0], b + size * step[1]) > now:
            size /= 2
        if size <= 1e-9:
            break
        a, b = a + size * float(step[0]), b + size * float(step[1])
        before, now = now, loss(a, b)
        if before - now < 1e-10:
            break
    return a, b


def _calibrate(model: Model, some: DataFrame) -> None:
    start = model

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, label in zip(pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist(), batch.column("label").to_pylist(), strict=True):
                ws = tokens(raw)
                places, values = start.scored(ws)
                rows.append((label, len(ws), values, [x[2] for x in segments(places, values, start.cost)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["label", "n", "values", "scores"])

    got = some.select("text", "label").mapInArrow(profile, "label int, n long, values array<double>, scores array<double>").collect()
    plain = [r for r in got if r["label"] == 0]
    # one token of the lexicon's mean value stands for what ordinary texts haven't shown yet
    values = np.array([*(v for r in plain for v in r["values"]), np.mean([*model.lexicon.values()])])
    every = sum(r["n"] for r in plain) + 1
    rest = every - len(values)

    def mass(rate: float) -> float:
        return (np.exp(np.minimum(700, rate * values)).sum() + rest * math.exp(-rate * model.cost)) / every - 1

    lo, hi = 1e-6, 0.01
    while mass(hi) < 0 and hi < 50:
        hi *= 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mass(mid) < 0 else (lo, mid)
    model.rate = hi
    best = [model.rate * max(r["scores"]) - math.log(r["n"]) for r in plain if r["scores"] and r["n"]]
    # texts without any segment are below all: K from the median of all ordinary texts where it's known, else from the mean of the rest
    model.log_k = float(np.mean(best)) - 0.5772 + math.log(max(1e-9, len(best) / max(1, len(plain)))) if best else 0.0
    level = math.log(-math.log1p(-LEVEL))
    x, y = [], []
    for r in got:
        space = model.log_k + math.log(max(1, r["n"]))
        x.append(math.log1p(sum(max(0.0, model.rate * s - space) for s in r["scores"] if space - model.rate * s < level)))
        y.append(r["label"])
    model.intercept, slope = curve(np.array(x), np.array(y, float))
    model.slope = max(0.0, slope)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Key (and the columns of keep) of every row with score in 0..1, the best segment's chance on ordinary text, and
    every significant passage (first word, end word, score). No shuffle.

    Null and empty texts have no passage; long texts are scanned whole; repeated rows each get their (equal) result; an
    empty table gives no rows. Segments of one score are all kept. Other columns are ignored; a column of keep called
    score, chance or passages is an error, as the result would have two."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON tokens
    rows = docs.select(F.col(key), *keep, F.col(text).alias("__text"))
    kept = [f for f in rows.schema if f.name != "__text"]
    if {"score", "chance", "passages"} & {f.name for f in kept}:
        raise ValueError("keep can't hold a column called score, chance or passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                got = [m.evidence(raw) for raw in pc.fill_null(part.column("__text").cast(pa.binary()), b"").to_pylist()]
                passages = pa.array([[{"first": a, "end": b, "score": s} for a, b, s in g[2]] for g in got], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array([m.probability(g[0]) for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), passages], names=[*(f.name for f in kept), "score", "chance", "passages"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{kind}, score double, chance double, passages array<struct<first:int,end:int,score:double>>")


def rejected(docs: DataFrame, model: Model, text: str = "text", level: float = 0.5) -> DataFrame:
    """docs with its own columns, without rows whose score is `level` or more. Null and empty texts stay unless every
    text would go by the labels alone. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raws = pc.fill_null(batch.column(at).cast(pa.binary()), b"").to_pylist()
            yield batch.filter(pa.array([m.probability(m.evidence(raw)[0]) < level for raw in raws], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
