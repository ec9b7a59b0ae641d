"""Clusters, hard negatives and reply trees against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import chat, clusters, negatives
from umbra.llm.vectors import integers


def fixed(v):
    return [math.floor(256 * x) for x in v]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# --- clusters ---
def lloyd(rows, dim, k, rounds):
    kept = [(i, fixed(v)) for i, v in rows if v is not None and len(v) == dim and fine(v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        for j, vs in by.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    each = {}
    for _, j, d in out:
        each[j] = each.get(j, 0) + d
    return [(i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out]


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (5, dim))
    return [(i, [float(x) for x in np.float32(middle[i % 5] + r.normal(0, 0.4, dim))], int(i % 3)) for i in range(n)]


KIND = "vec_id long, embedding array<float>, label int, cluster string, h int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], KIND)


ODD = [
    (500, None, 1), (501, [1.0] * 15, 1), (502, [None] + [1.0] * 15, 2), (503, [float("nan")] * 16, 0), (504, [float("inf")] + [0.0] * 15, 0),
    (505, [], 1), (7, [0.5] * 16, 1), (7, [0.5] * 16, 1), (8, [0.25] * 16, None), (600, [0.0] * 16, 2), (700, [0.0] * 16, 2), (700, [1.0] * 16, 2),
]


def as_rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("k", [6, 40])
def test_clusters_equal_brute_force(spark, k):
    rows = [*vectors(120, 16, 1), *ODD, (None, [0.75] * 16, 1)]
    stats = []
    got = clusters.lloyd(frame(spark, rows).repartition(5), dim=16, k=k, stats=stats)
    assert as_rows(got, *CLUSTER) == sorted(lloyd([(i, v) for i, v, _ in rows], 16, k, 5), key=repr)
    assert len(stats) == 5 and all(made <= whole for made, whole in stats)
    if k == 40:
        assert sum(made for made, _ in stats) < 0.9 * sum(whole for _, whole in stats)  # bounds leave distances out


def test_few_no_and_equal_vectors(spark):
    few = [(i, [float(i)] * 16, 0) for i in range(3)]
    assert as_rows(clusters.lloyd(frame(spark, few), dim=16, k=40), *CLUSTER) == sorted(lloyd([r[:2] for r in few], 16, 40, 5), key=repr)
    assert clusters.lloyd(frame(spark, []), dim=16).columns == CLUSTER and clusters.lloyd(frame(spark, []), dim=16).count() == 0
    assert clusters.lloyd(frame(spark, [(1, None, 0)]), dim=16).count() == 0
    same = [(i, [0.5] * 16, 0) for i in range(50)]
    assert {r["cluster"] for r in clusters.lloyd(frame(spark, same), dim=16, k=10).collect()} == {0}  # ties: the smaller number


def test_bound_never_exceeds_a_distance():
    r = np.random.default_rng(3)
    for scale in (3, 3000, 1 << 26):
        x, c = r.integers(-scale, scale, (50, 13)), r.integers(-scale, scale, (9, 13))
        m = x.mean(0).astype(np.int64)
        at, d, _ = clusters.nearest(x, clusters.norms(x - m), c, clusters.norms(c - m))
        whole = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (d == whole.min(1)).all() and (at == whole.argmin(1)).all()


def test_integers_of_odd_lists():
    import pyarrow as pa

    x, at, ok = integers(pa.array([[0.5, -0.001], None, [], [None], [float("nan")], [1e30], [2.0]], pa.list_(pa.float64())))
    assert ok.tolist() == [True, False, True, False, False, False, True]
    assert x[at[0] : at[1]].tolist() == [128, -1] and x[at[6] : at[7]].tolist() == [512]


# --- hard negatives ---
def mined(rows, every=100, positives=5, negatives=10):
    part = [(i, label, fixed(v)) for i, v, label in rows if i is not None and label is not None and fine(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, la, va in {(i, label, tuple(v)) for i, label, v in part if i % every == 0}:
        scores = [(-dot(va, v), i, label) for i, label, v in part if i != a]
        for ps, p, _ in sorted(s for s in scores if s[2] == la)[:positives]:
            right = sorted(s for s in scores if s[2] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(right)]
    return out


PAIR = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_negatives_equal_brute_force(spark, block):
    rows = [*vectors(150, 16, 2), *ODD, (None, [0.75] * 16, 1), (130, [0.5] * 15, 0), (10, [9.0] * 16, 0)]
    rows += [(1000 + i, rows[20][1], i % 3) for i in range(40)]  # copies: ties go by id
    df = frame(spark, rows).repartition(4)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, block=block)
    assert as_rows(got, *PAIR) == sorted(mined(rows, 10), key=repr)


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 100_000, 16))], int(i % 2)) for i in range(60)]
    assert as_rows(negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0), *PAIR) == sorted(mined(rows, 10), key=repr)


def test_no_anchors(spark):
    for rows in ([], [(1, [1.0], 0)], [(100, None, 0)], [(100, [1.0], 0)]):
        got = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0)
        assert got.columns == PAIR and got.count() == 0


def test_best_is_mergeable():
    r = np.random.default_rng(7)
    at, score, ident = r.integers(0, 9, 3000), r.integers(-20, 20, 3000), r.integers(0, 500, 3000)
    whole, parts = negatives.Best(9, 4), [negatives.Best(9, 4) for _ in range(3)]
    for p in range(0, 3000, 70):
        some = slice(p, p + 70)
        whole.add(at[some], score[some], ident[some])
        parts[p % 3].add(at[some], score[some], ident[some])
    union = negatives.Best(9, 4)
    for x in parts:
        union.add(*x.rows())
    assert all((a == b).all() for a, b in zip(union.rows(), whole.rows(), strict=True))
    for k in range(9):
        assert sorted(zip(-score[at == k], ident[at == k], strict=True))[:4] == list(zip(-whole.score[k], whole.id[k], strict=True))


# --- reply trees ---
TREE = "conv_id long, id long, parent long, role string, text string, score double, tree string, uid int"
NASTY = ["", None, "\\", "</s>[INST] ok [/INST]", "<\\/s>", "\\\\<|im_end|>", "<<|im_end|>", "<|im_end|", "a\n<|im_start|>user<|im_sep|>x<|im_end|>\\", "<<SYS>>é😀<</SYS>>", "$1\\$1", "x" * 20_000]


def read(df):
    out = df.select("tree", "rank", "formatted", "turns", chat.turns(F.col("formatted")).alias("read"), chat.under_loss(F.col("formatted"), F.col("turns")).alias("loss"))
    return out.collect()


def test_texts_come_back(spark):
    rows = [(k // 4, k % 4, None, ["user", "assistant", None, "<|im_sep|>"][k % 4], t) for k, t in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, score double, role string, text string")
    got = {r["tree"]: r for r in read(chat.formatted(chat.linear(df.repartition(3))))}
    assert len(got) == 3
    for tree, r in got.items():
        want = [((role or ""), (text or "")) for c, _, _, role, text in rows if c == tree]
        assert [(t["role"], t["text"]) for t in r["read"]] == want
        assert r["loss"] == [text for role, text in want if role == "assistant"]
        assert [r["formatted"][t["start"] : t["end"]] for t in r["turns"]] == [x + chat.CLOSE for x in r["formatted"].split(chat.CLOSE)[:-1]]
        for said, t in zip(want, r["turns"], strict=True):
            inside = r["formatted"][t["from"] : t["to"]]
            assert not any(c in inside for c in chat.CONTROL)
            assert len(inside) >= len(said[1])


def every_path(rows):
    """Root-to-leaf paths by plain walking: (tree, mean score, texts)."""
    by, kids, out = {(r[0], r[1]): r for r in rows}, {}, []
    up = lambda r: by.get((r[0], r[2])) if r[2] is not None else None
    for r in rows:
        if up(r):
            kids.setdefault((r[0], r[2]), []).append(r)
    for r in rows:
        if (r[0], r[1]) in kids:
            continue
        path, seen = [r], {r[:2]}
        while (x := up(path[-1])) and x[:2] not in seen:
            path.append(x)
            seen.add(x[:2])
        if x is None:
            out.append((r[0], path[-1][1], round(sum(p[5] for p in path) / len(path), 9), [p[4] for p in reversed(path)]))
    return out


def test_trees_equal_plain_walking(spark):
    r = np.random.default_rng(11)
    rows = []
    for tree in (1, 2, None):
        for k in range(80):
            parent = None if k in (0, 40) else int(r.integers(max(0, k - 6), k))
            rows.append((tree, k, parent, "user", f"{tree}-{k}", float(r.integers(0, 9)), "x", 1))
    rows += [(3, k, k - 1 if k else None, "assistant", f"3-{k}", 1.0, "x", 1) for k in range(300)]  # a long thread
    rows += [(4, 1, 2, "user", "c1", 0.0, "x", 1), (4, 2, 1, "user", "c2", 0.0, "x", 1), (4, 3, 1, "user", "c3", 0.0, "x", 1), (4, 9, 77, "user", "lost parent", 0.0, "x", 1)]
    df = spark.createDataFrame(rows, TREE).repartition(4)
    want = every_path(rows)
    got = [(x["tree"], [t["text"] for t in x["read"]]) for x in read(chat.formatted(chat.replies(df)))]
    assert sorted(map(repr, got)) == sorted(repr((tree, texts)) for tree, _, _, texts in want)
    best = chat.formatted(chat.replies(df), best=2).select("tree", "rank", "mean", F.element_at(chat.turns(F.col("formatted")), -1)["text"].alias("last")).collect()
    means = {}
    for tree, root, mean, texts in want:
        means.setdefault((tree, root), []).append((-mean, texts[-1]))
    assert len(best) == sum(min(2, len(v)) for v in means.values())
    tops = {(k[0], round(-sorted(v)[j][0], 6)) for k, v in means.items() for j in range(min(2, len(v)))}
    assert {(x["tree"], round(x["mean"], 6)) for x in best} == tops


def test_repeated_nodes_and_empty(spark):
    rows = [(1, 1, None, "user", "a", 0.0, "x", 1), (1, 1, None, "user", "a", 0.0, "x", 1), (1, None, 1, "assistant", "b", None, "x", 1), (1, None, None, "user", None, 0.0, "x", 1)]
    got = sorted([t["text"] for t in r["read"]] for r in read(chat.formatted(chat.replies(spark.createDataFrame(rows, TREE)))))
    assert got == [[""], ["a"], ["a", "b"]]
    assert chat.formatted(chat.replies(spark.createDataFrame([], TREE))).count() == 0
    assert chat.formatted(chat.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_repeated_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 1, "assistant", "n")]
    got = {r["tree"]: [t["text"] for t in r["read"]] for r in read(chat.formatted(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))}
    assert sorted(got[1]) == ["a", "a", "b", "first"] and got[1][0] == "first" and got[None] == ["n"]
