"""Mixing to target weights with soft domain membership.

A classifier learnt from a labelled table gives every document a posterior over domains. Nonnegative document rates r
are then fitted so that the expected domain totals sum_d r_d * tokens_d * p_dk meet the targets in least squares, by
projected gradient from r = 1 with momentum. The gradient is scaled by a positive number of each document, its tokens
times its expected domain size q_d = sum_k p_dk * T_k, so the projection stays a clip and the step 1 / L, L the greatest
eigenvalue of sum_d tokens_d * p_d p_d' / q_d, is one that projected gradient converges with. A step needs the K totals
at the current point, summed over all documents by one aggregation; the driver sees nothing else, and a document's rate
follows from its posterior and the few steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.features import STATS, statistics
from umbra.llm.kernels import slices, utf8
from umbra.llm.machine import BUCKETS, _sums, gathered
from umbra.llm.shared import drop, training, written

#: Labelled rows that a fit takes at most, those of the smallest key hash.
FIT_ROWS = 8000
#: Gradient steps at most, the residual (share of all target tokens) that is near enough, and the least relative gain of five steps.
STEPS, ENOUGH, GAIN = 40, 1e-3, 1e-3


@dataclass
class Domains:
    """Softmax regression over hashed distinct words and structure statistics."""

    names: list[str]
    bias: np.ndarray
    weight: np.ndarray  # (BUCKETS + STATS, K)
    mean: np.ndarray
    scale: np.ndarray

    def posterior(self, stats: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = np.clip((stats - self.mean) / self.scale, -4, 4)
        x = 1 / np.sqrt(np.maximum(np.diff(at), 1))
        z = self.bias + d @ self.weight[BUCKETS:] + _sums(self.weight[index], at) * x[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame | None, names: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", rows: int = FIT_ROWS, epochs: int = 6, rate: float = 0.05, decay: float = 1e-4) -> Domains:
    """From at most `rows` documents that `labels` (key, domain) names; without `labels`, docs has the domain. Rows of
    other domains don't count. Without rows the posterior is even."""
    k = len(names)
    number = F.coalesce(*[F.when(F.col(domain) == n, F.lit(float(i))) for i, n in enumerate(names)])
    marks = (docs if labels is None else labels).select(F.col(key), number.alias("label"))
    size, rng = BUCKETS + len(STATS), np.random.default_rng(1)
    stats, index, at, label = gathered(training(docs, marks, key, text, "label", rows))
    if not len(label):
        return Domains(names, np.zeros(k), np.zeros((size, k), np.float32), np.zeros(len(STATS)), np.ones(len(STATS)))
    label = label.astype(int)
    share = np.bincount(label, minlength=k) / len(label)
    m = Domains(names, np.log(share + 1e-3), np.zeros((size, k), np.float32), stats.mean(0), stats.std(0) + 1e-3)
    seen = np.full((size, k), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for j in range(0, len(order), 64):
            r = order[j : j + 64]
            n = at[r + 1] - at[r]
            idx = np.concatenate([index[at[q] : at[q + 1]] for q in r])
            own = np.concatenate([[0], np.cumsum(n)])
            error = (m.posterior(stats[r], idx, own) - np.eye(k)[label[r]]) / len(r)
            m.bias -= rate * error.sum(0)
            rep = np.repeat(np.arange(len(r)), n)
            pull = error[rep] / np.sqrt(np.maximum(n, 1))[rep, None]
            uniq, inv = np.unique(idx, return_inverse=True)
            words = np.stack([np.bincount(inv, pull[:, c], len(uniq)) for c in range(k)], 1) if len(uniq) else np.zeros((0, k))
            d = np.clip((stats[r] - m.mean) / m.scale, -4, 4)
            places = np.concatenate([uniq, np.arange(BUCKETS, size)])
            g = np.concatenate([words, d.T @ error]) + decay * m.weight[places]
            seen[places] += g**2
            m.weight[places] -= rate * g / np.sqrt(seen[places])
    return m


def _tokens(stats: np.ndarray) -> np.ndarray:
    return np.rint(np.expm1(stats[:, STATS.index("log_words")])).astype(np.int64)


def posteriors(docs: DataFrame, domains: Domains, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens (words at ASCII white space), p (array in the order of names). Null and empty texts have no tokens."""
    model = docs.sparkSession.sparkContext.broadcast(domains)  # BUCKETS x K numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                stats, index, at = statistics(*utf8(part.column("__text")), BUCKETS)
                p = model.value.posterior(stats, index, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_tokens(stats)), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))], names=[key, "tokens", "p"])

    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, tokens long, p array<double>")


@dataclass
class Steps:
    """What a document's rate follows from: its domain sizes' scale, the gradient steps with their momentum, the bound."""

    totals: np.ndarray
    most: float
    gradients: list[np.ndarray]
    momentum: list[float]

    def scale(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(p @ self.totals, 1e-300)

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and the point that the next gradient is taken at."""
        q = self.scale(p)
        r = ahead = np.ones(len(p))
        for g, m in zip(self.gradients, self.momentum, strict=True):
            new = np.clip(ahead - (p @ g) / q, 0.0, self.most)
            r, ahead = new, new + m * (new - r)
        return r, ahead


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _summed(known: DataFrame, k: int, size: int, of) -> np.ndarray:
    """Sums over all rows of the `size` numbers that of(p, tokens) gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch, k), batch.column("tokens").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "v"])

    got = {r["i"]: r["v"] for r in known.select("tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return np.array([got.get(i, 0.0) for i in range(size)])


def fitted(known: DataFrame, weights: dict[str, float], total: float | None = None, most: float = float("inf")) -> tuple[Steps, np.ndarray, np.ndarray]:
    """Steps for the rates, the targets, and the expected totals reached, for written posteriors (tokens, p).

    Stops when the residual is near enough or, where the targets can't be met, when steps gain nothing any more."""
    k, share = len(weights), np.array(list(weights.values()), float)
    share = share / share.sum()
    totals = _summed(known, k, k, lambda p, t: t @ p)
    goal = share * (totals[0] / share[0] if total is None else total)
    steps = Steps(totals, most, [], [])
    if not totals.any():
        return steps, goal, totals
    gram = _summed(known, k, k * k, lambda p, t: ((p * (t / steps.scale(p))[:, None]).T @ p).ravel()).reshape(k, k)
    size, at, losses, restart = 1.0 / np.linalg.eigvalsh(gram)[-1], totals, [float(((totals - goal) ** 2).sum())], 0
    reached = totals
    for _ in range(STEPS):
        if np.abs(reached - goal).max() <= ENOUGH * max(goal.sum(), 1):
            break
        if len(losses) > 5 and losses[-6] - min(losses[-5:]) <= GAIN * losses[-6]:
            break
        restart += 1
        steps.gradients.append(size * (at - goal))
        steps.momentum.append((restart - 1) / (restart + 2))
        now = Steps(totals, most, list(steps.gradients), list(steps.momentum))
        both = _summed(known, k, 2 * k, lambda p, t, now=now: np.concatenate([(t * r) @ p for r in now.rates(p)]))
        reached, at = both[:k], both[k:]
        losses.append(float(((reached - goal) ** 2).sum()))
        if losses[-1] > losses[-2]:  # momentum went too far: go on from this point without it
            steps.momentum[-1], restart, at = 0.0, 0, reached
    return steps, goal, reached


def mixed(docs: DataFrame, domains: Domains, weights: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None, most: float = float("inf")) -> DataFrame:
    """key, tokens, p, rate of every row of docs.

    weights are the domains' target shares of `total` tokens; without a total it is what keeps the first domain's
    expected tokens as they are. A document without tokens can't move a total and gets a rate by its posterior like any
    other; a null text is empty; repeated rows count each; an empty table gives no rows. Other columns don't count.
    """
    known = written(posteriors(docs, domains, key, text), "posteriors")
    steps, _, _ = fitted(known, weights, total, most)
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps.rates(_matrix(batch, k))[0])], names=[*batch.schema.names, "rate"])

    return known.mapInArrow(run, f"`{key}` {known.schema[0].dataType.simpleString()}, tokens long, p array<double>, rate double")


def mix(docs: DataFrame, domains: Domains, weights: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None, most: float = float("inf"), seed: int = 0) -> DataFrame:
    """docs with its own columns, each row as often as its rate says: the whole part always, the rest by a coin that
    depends on key, text and seed alone, so the same rows come on every run. Texts aren't shuffled: the rates' few steps
    go to a second scan, which finds each document's posterior anew. An empty table stays empty."""
    known = written(posteriors(docs, domains, key, text), "posteriors")
    steps, _, _ = fitted(known, weights, total, most)
    drop(known)
    model = docs.sparkSession.sparkContext.broadcast((domains, steps))
    coin = F.pmod(F.xxhash64(F.col(key), F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), coin.alias("__coin"))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domains, steps = model.value
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                p = domains.posterior(*statistics(*utf8(part.column(at)), BUCKETS))
                times = np.floor(steps.rates(p)[0] + part.column("__coin").to_numpy()).astype(np.int64)
                again = part.take(pa.array(np.repeat(np.arange(len(times)), times)))
                yield pa.RecordBatch.from_arrays(again.columns[:-1], schema=pa.schema([again.schema.field(i) for i in range(len(again.columns) - 1)]))

    return rows.mapInArrow(run, docs.schema)
