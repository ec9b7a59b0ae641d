"""Factorisation machine over hashed words, structure statistics and metadata (lengths, counts of lines).

score(x) = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2): the sum-of-squares identity makes all
pairwise interactions linear in the number of non-zero inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.features import STATS, statistics
from umbra.llm.kernels import slices, utf8
from umbra.llm.shared import training

BUCKETS, RANK = 1 << 15, 8
#: Labelled rows that a fit takes at most, those of the smallest key hash.
FIT_ROWS = 8000


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # (BUCKETS + STATS,)
    factor: np.ndarray  # (BUCKETS + STATS, RANK)
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)

    def raw(self, stats: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores in log-odds, whole batches at once."""
        d = self.dense(stats)
        n = np.diff(at)
        x = 1 / np.sqrt(np.maximum(n, 1)).astype(np.float32)  # each distinct word of a text has this value
        sums = lambda a: _sums(a, at)
        f = self.factor[index]
        linear = self.bias + d @ self.weight[BUCKETS:] + sums(self.weight[index]) * x
        inner = d @ self.factor[BUCKETS:] + sums(f) * x[:, None]
        squares = (d**2) @ (self.factor[BUCKETS:] ** 2) + sums(f**2) * (x**2)[:, None]
        return linear + 0.5 * (inner**2 - squares).sum(1)


def _sums(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(stats: np.ndarray, index: np.ndarray, at: np.ndarray, label: np.ndarray, epochs: int = 6, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> Machine:
    """AdaGrad on the logistic loss in small batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATS)
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    base = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m = Machine(float(np.log(base / (1 - base))), np.zeros(size, np.float32), rng.normal(0, 0.01, (size, RANK)).astype(np.float32), mean, scale)
    seen_w, seen_f, seen_b = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            n = (at[rows + 1] - at[rows]).astype(np.int64)
            idx = np.concatenate([index[at[r] : at[r + 1]] for r in rows]) if n.sum() else np.zeros(0, np.int32)
            own = np.concatenate([[0], np.cumsum(n)])
            d = m.dense(stats[rows])
            x = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
            f = m.factor[idx]
            inner = d @ m.factor[BUCKETS:] + _sums(f, own) * x[:, None]
            error = (sigmoid(m.raw(stats[rows], idx, own)) - label[rows]).astype(np.float32) / len(rows)
            seen_b += float(error.sum()) ** 2
            m.bias -= rate * float(error.sum()) / seen_b**0.5
            rep = np.repeat(np.arange(len(rows)), n)
            pull = error[rep] * x[rep]
            uniq, inv = np.unique(idx, return_inverse=True)
            gw = np.bincount(inv, pull, len(uniq))
            gf = np.stack([np.bincount(inv, pull * (inner[rep, c] - f[:, c] * x[rep]), len(uniq)) for c in range(RANK)], 1) if len(uniq) else np.zeros((0, RANK))
            places = np.concatenate([uniq, np.arange(BUCKETS, size)])
            gw = np.concatenate([gw, d.T @ error]) + decay * m.weight[places]
            dense_f = d.T @ (error[:, None] * inner) - ((d**2).T @ error)[:, None] * m.factor[BUCKETS:]
            gf = np.concatenate([gf, dense_f]) + decay * m.factor[places]
            seen_w[places] += gw**2
            seen_f[places] += gf**2
            m.weight[places] -= rate * gw / np.sqrt(seen_w[places])
            m.factor[places] -= rate * gf / np.sqrt(seen_f[places])
    return m


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            stats, index, at = statistics(*utf8(part.column("text")), BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [part.column("h"), part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), stats.shape[1]).cast(pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index))],
                names=["h", "label", "stats", "words"],
            )


def gathered(some: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, word buckets, their offsets and labels of a bounded (key, text, label) table, in an order that doesn't
    depend on how its rows are dealt. What comes to the driver are numbers, no texts."""
    rows = some.select(F.xxhash64("key").alias("h"), F.col("label").cast("double").alias("label"), "text")
    got = rows.mapInArrow(_featured, "h long, label double, stats array<double>, words array<int>").toArrow().sort_by("h")
    if not got.num_rows:
        return np.zeros((0, len(STATS))), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0)
    lists = got.column("words").combine_chunks()
    stats = got.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return stats, lists.flatten().to_numpy(zero_copy_only=False), at, got.column("label").to_numpy()


def fit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "label", rows: int = FIT_ROWS) -> Machine:
    """A machine from at most `rows` documents that `labels` (key, 0/1 label) names; without `labels`, docs has the label.

    Which rows count says training(). Without any labelled row the machine scores a half for every text."""
    stats, index, at, y = gathered(training(docs, labels, key, text, label, rows))
    if not len(y):
        size = BUCKETS + len(STATS)
        return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), np.zeros(len(STATS)), np.ones(len(STATS)))
    return train(stats, index, at, y)


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Key (and the columns of keep) of every row with its score in 0..1. No shuffle.

    Null is the empty text, which has a score like any other; long texts are read whole, a piece at a time; repeated
    rows each get their (equal) score; an empty table gives no rows. Other columns are ignored; a column of keep that is
    called score is an error, as the result would have two."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: BUCKETS x (RANK + 1) numbers
    rows = docs.select(F.col(key), *keep, F.col(text).alias("__text"))
    kept = [f for f in rows.schema if f.name != "__text"]
    if "score" in {f.name for f in kept}:
        raise ValueError("keep can't hold a column called score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                probability = sigmoid(model.value.raw(*statistics(*utf8(part.column("__text")), BUCKETS)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(probability)], names=[*(f.name for f in kept), "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{kind}, score double")
