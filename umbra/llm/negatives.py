"""Hard negatives by blocked dense products.

Anchors are cut into blocks of a bounded number of bytes. Each block goes to all tasks as a broadcast value and meets every
candidate there, chunk by chunk, in one matrix product of float64, which is exact while every partial sum stays under
2**53; beyond that the product is taken in 64-bit integers. A block takes two passes over the candidates:

1. the best rows of the anchor's own label: a task keeps the first POSITIVES of each anchor among its rows and these
   lists are merged, as the first few of a union are the first few of the parts' first few;
2. for each anchor and positive, whose scores set a window, the first NEGATIVES rows of another label in the window, kept
   and merged the same way.

Nothing but these short lists is shuffled: at most tasks * anchors * 5 * 10 rows a block, and the scores of an anchor with
all candidates never leave a task's chunk. The work is anchors times candidates by nature; blocks bound memory, not work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.shared import drop, written
from umbra.llm.vectors import integers, padded

#: Bytes of an anchor block's vectors as 8-byte numbers, about; anchors and candidates of one matrix product at most.
BLOCK, ANCHORS, CHUNK = 16 << 20, 1024, 2048
_NONE = np.iinfo(np.int64).min


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in float64 where no sum can reach 2**53, in int64 beyond."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a @ b.T


class Best:
    """The first k (score, id) of each of n lists: higher scores first, then smaller ids. Mergeable: add() takes any rows."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), _NONE, np.int64), np.zeros((n, k), np.int64)

    def least(self) -> np.ndarray:
        """The score that a new row must reach, for each list."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(at):
            return
        some = np.unique(at)
        old = self.score[some] != _NONE
        at = np.concatenate([at, np.repeat(some, old.sum(1))])
        score = np.concatenate([score, self.score[some][old]])
        ident = np.concatenate([ident, self.id[some][old]])
        order = np.lexsort((ident, -score, at))
        at, score, ident = at[order], score[order], ident[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        self.score[some], self.id[some] = _NONE, 0
        self.score[at[first], place[first]], self.id[at[first], place[first]] = score[first], ident[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.score != _NONE)
        return at, self.score[at, place], self.id[at, place]


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, label, vectors) of the rows that take part. Chunks start small, so that the lists soon know what they ask for."""
    most = 64
    for batch in batches:
        x, at, ok = integers(batch.column("v"))
        fine = np.flatnonzero(ok)
        ident, label = np.asarray(batch.column("id"), np.int64), np.asarray(batch.column("label"), np.int64)
        p = 0
        while p < len(fine):
            rows = fine[p : p + most]
            yield ident[rows], label[rows], padded(x, at, rows, dim)
            p, most = p + most, min(CHUNK, 2 * most)


def _positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = shared.value
        best = Best(len(ids), k)
        order = np.argsort(labels, kind="stable")  # anchors of one label together
        own, first = np.unique(labels[order], return_index=True)
        groups = dict(zip(own.tolist(), np.split(order, first[1:]), strict=True))
        for ident, label, x in _chunks(batches, vectors.shape[1]):
            for here in np.unique(label).tolist():
                mine = np.flatnonzero(label == here)
                anchors = groups.get(here, np.zeros(0, np.int64))
                for p in range(0, len(anchors), ANCHORS):
                    some = anchors[p : p + ANCHORS]
                    score = product(vectors[some], x[mine])
                    a, c = np.nonzero((score >= best.least()[some][:, None]) & (ids[some][:, None] != ident[mine][None, :]))
                    best.add(some[a], score[a, c].astype(np.int64), ident[mine][c])
        at, score, ident = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(score), pa.array(ident)], names=["slot", "score", "id"])

    return run


def _negatives(shared, k: int, low: int, high: int):
    """(slot, score, id): slot is a place in the block's list of (anchor, positive score), by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, anchor, positive = shared.value
        best = Best(len(anchor), k)
        # low * positive <= 100 * score <= high * positive, in whole scores
        least, most = -(-low * positive // 100), high * positive // 100
        first = np.searchsorted(anchor, np.arange(len(ids) + 1))
        each = int((first[1:] - first[:-1]).max(initial=0))
        for ident, label, x in _chunks(batches, vectors.shape[1]):
            for p in range(0, len(ids), ANCHORS):
                score = product(vectors[p : p + ANCHORS], x)
                other = (labels[p : p + ANCHORS][:, None] != label[None, :]) & (ids[p : p + ANCHORS][:, None] != ident[None, :])
                for turn in range(each):  # the anchors' positives of one place
                    some = np.flatnonzero(first[p : p + len(score)] + turn < first[p + 1 : p + 1 + len(score)])
                    slot = first[p + some] + turn
                    wanted = np.maximum(least[slot], best.least()[slot])
                    s = score[some]
                    a, c = np.nonzero((s >= wanted[:, None]) & (s <= most[slot][:, None]) & other[some])
                    best.add(slot[a], s[a, c].astype(np.int64), ident[c])
        at, score, ident = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(score), pa.array(ident)], names=["slot", "score", "id"])

    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The first k of each slot, over all tasks' lists."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives,
    the first rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.

    `anchors` says which rows are anchors. Scores are inner products of floor(256 * x); of vectors of unequal length the
    shorter counts as filled up with zeros. Rows with a null key, label or vector, or with any component that is null, not
    finite or 2**19 or more take no part. Higher scores come first, ties by smaller key. Rows that repeat a key are rows of
    their own as positives and negatives, but never of an anchor with that key; an anchor row that repeats in all of key,
    label and vector is one anchor. Fewer rows than asked for: all there are. No anchors or an empty table give no rows.
    Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    kind = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("long").alias("id"), kind.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and v is not null")
    chosen = written(rows.where("anchor").select("id", "label", "v").distinct(), "anchors")
    much = chosen.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    blocks = max(1, -(-8 * much["n"] * max(1, much["dim"]) // block))
    candidates, done = rows.select("id", "label", "v"), []
    dealt = F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks))
    for b in range(blocks if much["n"] else 0):
        table = chosen.where(dealt == b).toArrow()  # about `block` bytes
        x, at, ok = integers(table.column("v"))
        own = np.flatnonzero(ok)
        if not len(own):
            continue
        ids, labels, v = np.asarray(table.column("id"), np.int64)[own], np.asarray(table.column("label"), np.int64)[own], padded(x, at, own, max(1, much["dim"]))
        shared = spark.sparkContext.broadcast((ids, labels, v))
        found = _first(candidates.mapInArrow(_positives(shared, positives), "slot long, score long, id long"), positives).select("slot", "rank", "score", "id").toArrow()
        shared.destroy()
        if not found.num_rows:
            continue
        found = found.sort_by([("slot", "ascending"), ("rank", "ascending")])
        anchor, score, positive = (np.asarray(found.column(c), np.int64) for c in ("slot", "score", "id"))
        shared = spark.sparkContext.broadcast((ids, labels, v, anchor, score))
        best = written(_first(candidates.mapInArrow(_negatives(shared, negatives, low, high), "slot long, score long, id long"), negatives), "negatives")
        shared.destroy()
        named = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score}))
        done.append(best.join(F.broadcast(named), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    drop(chosen)
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, done)
