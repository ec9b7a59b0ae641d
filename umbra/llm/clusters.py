"""Lloyd's rounds in exact integers, screened by block norms.

A vector is compressed to the Euclidean norms of its segments (blocks of BLOCK components), after one and the same integer
vector is taken off all of them, which changes no distance. By the Cauchy-Schwarz inequality on each block,

    |x - c|^2  >=  |x|^2 + |c|^2 - 2 * sum over blocks of |x_b| * |c_b|,

so the norms of vectors (made once, kept beside them) and of centroids (made once a round) bound every distance from below
by one product of small matrices. A row's centroids are then taken by ascending bound: each gets its exact integer
distance until the next bound lies above the least distance found; what is left is never computed. Bounds are floats and
so get a margin; distances, sums and means are integers throughout.

A round is one narrow scan that has the centroids (a bound of k * dim numbers) as a broadcast value, sums members by cluster
inside the task, and shuffles one row for each task and cluster. The driver sees k rows a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.shared import drop, written
from umbra.llm.vectors import integers, lists, matrix

#: Components of a segment.
BLOCK = 8


def norms(x: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Norms of each row's segments; the last segment may be short."""
    edges = np.arange(0, x.shape[1], block)
    return np.sqrt(np.add.reduceat((x * x).astype(np.float64), edges, axis=1))


def nearest(x: np.ndarray, xb: np.ndarray, c: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed.

    xb and cb are block norms of x - m and c - m for one and the same m."""
    n, k = len(x), len(c)
    xx, cc = (xb * xb).sum(1), (cb * cb).sum(1)
    bound = xx[:, None] + cc[None, :] - 2.0 * (xb @ cb.T) - (1.0 + 1e-9 * (xx[:, None] + cc[None, :]))
    order = np.argsort(bound, axis=1, kind="stable")
    low = np.take_along_axis(bound, order, 1)
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
    rows, made = np.arange(n), 0
    for turn in range(k):
        rows = rows[low[rows, turn] <= best[rows]]  # bounds ascend, so a row that ends stays ended
        if not len(rows):
            break
        j = order[rows, turn]
        gap = x[rows] - c[j]
        d = np.einsum("ij,ij->i", gap, gap)
        made += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], j[better]
    return at, best, made


def _each(centroids: list[list[int]], middle: list[int]):
    """Arrow batches of (id, v, b) with their nearest centroid and distance."""
    c = np.array(centroids, np.int64)
    dim, cb = c.shape[1], norms(c - np.array(middle, np.int64))

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        x = matrix(batch.column("v"), dim).astype(np.int64)
        xb = matrix(batch.column("b"), cb.shape[1])
        return x, *nearest(x, xb, c, cb)

    return run


def _summed(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, k = _each(*shared.value), len(shared.value[0])
        total, count, made = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x, at, _, n = each(batch)
                order = np.argsort(at, kind="stable")
                here, first = np.unique(at[order], return_index=True)
                total[here] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(at, minlength=k)
                made += n
        some = np.flatnonzero(count)
        made = np.where(np.arange(len(some)) == 0, made, 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(made, pa.int64()), *(pa.array(total[some, i]) for i in range(dim))], names=["cluster", "n", "made", *(f"s{i}" for i in range(dim))])

    return run


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = _each(*shared.value)
        for batch in batches:
            if batch.num_rows:
                _, at, d, _ = each(batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array(d)], names=["id", "cluster", "distance"])

    return run


def _kept(dim: int):
    """(id, h, v) of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at, ok = integers(batch.column("v"))
            rows = np.flatnonzero(ok & (at[1:] - at[:-1] == dim))
            v = x[at[rows][:, None] + np.arange(dim)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), batch.column("h").take(pa.array(rows)), lists(v)], names=["id", "h", "v"])

    return run


def _with_norms(middle: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.array(middle, np.int64)
        for batch in batches:
            if batch.num_rows:
                b = norms(matrix(batch.column("v"), len(m)).astype(np.int64) - m)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists(b)], names=["id", "v", "b"])

    return run


def lloyd(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, seed: str = "2:", stats: list | None = None) -> DataFrame:
    """One row per kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of dim components without null, NaN or infinite ones; those of 2**19 and more are left out too, as
    their distances are no longs. The first centroids are the k kept vectors of least sha256(seed + key), in that order;
    of rows that repeat a key the lesser vector comes first, and a null key counts as empty there. Rows that repeat are
    each a vector of their own; a null key is returned as null; with fewer than k rows each is a centroid; an empty
    table gives no rows. Equally near centroids: the smaller number; an empty cluster keeps its centroid. Other columns
    are ignored, whatever their names. `stats` gets (exact distances, distances without screening) for each round.
    """
    spark = vectors.sparkSession
    said = F.coalesce(F.col(key).cast("string"), F.lit(""))
    some = vectors.where(F.size(vector) == dim).select(F.col(key).cast("long").alias("id"), F.sha2(F.concat(F.lit(seed), said), 256).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    kept = some.mapInArrow(_kept(dim), "id long, h string, v array<int>")
    centroids = [list(r["v"]) for r in kept.orderBy("h", "v").limit(k).select("v").collect()]
    if not centroids:
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    middle = [sum(x) // len(centroids) for x in zip(*centroids, strict=True)]  # any vector will do; near the middle norms tell more
    rows = written(kept.select("id", "v").mapInArrow(_with_norms(middle), "id long, v array<int>, b array<double>"), "vectors")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centroids, middle))
        sums = ", ".join(f"s{i} long" for i in range(dim))
        new = rows.mapInArrow(_summed(shared, dim), f"cluster int, n long, made long, {sums}").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("made").alias("made"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)))
        found = new.collect()  # a row for each cluster
        for r in found:
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
        if stats is not None:
            stats.append((sum(r["made"] for r in found), sum(r["n"] for r in found) * len(centroids)))
        shared.destroy()
    shared = spark.sparkContext.broadcast((centroids, middle))
    last = written(rows.mapInArrow(_assigned(shared), "id long, cluster int, distance long"), "assigned")
    drop(rows)
    inertia = {r["cluster"]: int(r["d"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = [(j, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, d in sorted(inertia.items())]
    by = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(by), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
