"""SetSketch near-duplicate detection.

A text's set is its distinct word shingles. m registers hold K = floor(1 - log_b(x)), clamped to 0..q+1, where x is
the least of exponentially spaced hash values of the set's members: registers of a union are the greater of both,
and equal registers are likelier the more alike two sets are. With b = 1.001 and 16-bit registers the chance is the
Jaccard similarity to within 0.0003.

Plan. Texts with one and the same set are grouped by a 128-bit digest first, so that thousands of copies are one set.
Bands of registers give candidate buckets. Pairs never come from all pairs of a bucket while there's another way:

1. Twice, each bucket's most central member (the one that shares most buckets with others) is compared with all members
   of other components, links are contracted to components, and the central member, now judged against all, leaves.
2. The shingles of the members that still share a bucket with another component are counted over them. One that no other
   such member has can't be in any intersection, so with s other shingles a set of n has a similarity of at most s / n
   to anything, and two sets of at most m / (n1 + n2 - m) to each other, m the lesser s. Two members that share a shingle
   which few have (RARE at most) are found by that shingle, a few pairs for each; for all others the bound holds with the
   lesser number of shingles that many have. The bounds are exact: members and pairs below the threshold are dropped
   without losing a link. Near copies of one text that lie under the threshold from its centre are mostly so by words of
   their own, and end here.
3. Crossing pairs that the bounds leave are listed and judged; in buckets that would list very many, one slice of members
   with all others at a time, links being contracted after each slice.

Every pair of a bucket is judged, bounded under the threshold, or already connected at the end, so no bucket is cut off.
A pair is first judged by the joint maximum-likelihood estimate from registers and set sizes; survivors are
compared exactly on their full sets. A pair is judged once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.components import components
from umbra.llm.kernels import mix, shingle_sets, slices, utf8, words
from umbra.llm.shared import drop, written

BASE, TOP = 1.001, 65534
ROWS, BANDS = 7, 36
REGISTERS = ROWS * BANDS
#: A pair goes on to exact comparison unless its estimate lies this many standard errors under the threshold.
ERRORS = 6.0
#: A bucket's crossing pairs are listed at once while they're at most so many a member; else slice by slice.
PER_MEMBER = 512
#: Members of the largest bucket that are compared with the whole bucket in one turn, about.
SLICE = 1024
#: Pairs of one id that one task joins to its registers or text; an id of more is split.
SPREAD = 1000
#: Rows of a table of ids that is broadcast at most: 16 bytes each, twice that as a hash table.
BROADCAST_ROWS = 1_000_000
#: Members that may hold a shingle which pairs are found by.
RARE = 4
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def registers(members: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 2048):
        part = members[at : at + 2048, None]
        np.minimum(least, (part * _ODD + _ADD).min(axis=0), out=least)
    # the least of uniform values, as the least of exponential values with rate 20
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / 20.0
    return np.clip(np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)) + 0, 0, TOP + 1).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity, row by row, from registers and set sizes."""
    up, down = (ka > kb).sum(1), (ka < kb).sum(1)
    same = ka.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        floor = 1e-12
        return up * np.log(np.maximum(a, floor)) + down * np.log(np.maximum(b, floor)) + same * np.log(np.maximum(1 - a - b, floor))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        c, d = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = score(c) > score(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, digest, regs = [], [], []
                hashes, _, _, tok = words(*utf8(part.column("text")))
                for members in shingle_sets(hashes, tok, width):
                    n.append(len(members))
                    digest.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                    regs.append(registers(members).tobytes() if len(members) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("said"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["id", "said", "n", "digest", "regs"])

    return run


def _tokens(width: int):
    """(token, times, ids): each shingle of a part of the texts, how often it stands there, and who holds it, where few do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, tok = words(*utf8(part.column("text")))
                sets = list(shingle_sets(hashes, tok, width))
                every = np.concatenate([np.zeros(0, np.uint64), *sets])
                ids = np.repeat(part.column("id").to_numpy(), [len(x) for x in sets])
                order = np.argsort(every, kind="stable")
                token, first, times = np.unique(every[order], return_index=True, return_counts=True)
                few = np.repeat(times <= RARE, times)
                at = np.concatenate([[0], np.cumsum(np.where(times <= RARE, times, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids[order][few], pa.int64()))], names=["token", "times", "ids"])

    return run


def _bands() -> Column:
    """Bucket keys: one hash of band number and band registers for each band."""
    size = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 1 + k * size, size)) for k in range(BANDS)])


def _near(threshold: float):
    """Pairs whose estimate doesn't rule them out."""
    least = threshold - ERRORS * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS)
                size = lambda c: np.asarray(batch.column(c), np.float64)
                keep = estimate(regs("ra"), regs("rb"), size("na"), size("nb")) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _same(width: int, percent: int):
    """Pairs with 100 * intersection >= percent * union on their full sets."""

    def sets(part: pa.RecordBatch, of: str, text: str) -> list[np.ndarray]:
        _, first, place = np.unique(part.column(of).to_numpy(), return_index=True, return_inverse=True)
        hashes, _, _, tok = words(*utf8(part.column(text).take(pa.array(first))))  # a text of many pairs once
        each = list(shingle_sets(hashes, tok, width))
        return [each[k] for k in place.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta"):
                keep = []
                for x, y in zip(sets(part, "a", "ta"), sets(part, "b", "tb"), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcasting while its count allows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _ends(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of pairs' a and b (and what else they hold) under the name id."""
    return left.withColumnRenamed("a", "id").unionByName(right.withColumnRenamed("b", "id"))


class _Search:
    """The state of one run: docs (id, said, text), reps (id, n, regs; one id for each distinct set), links found, pairs judged."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, percent: int, unique: bool):
        self.docs, self.reps, self.width, self.percent, self.unique = docs, reps, width, percent, unique
        self.links: list[DataFrame] = []
        self.judged: list[DataFrame] = []
        self.made: list[DataFrame] = []  # small tables that go when the run ends
        self.roots: DataFrame | None = None

    def texts(self, ids: DataFrame, few: bool) -> DataFrame:
        """(id, text) of some ids, which may repeat; an id that stands for several texts is its text of least hash."""
        some = self.docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        if self.unique:
            return some.select("id", "text")
        return some.groupBy("id").agg(F.min(F.struct("said", "text")).alias("x")).select("id", "x.text")

    def hot(self, pairs: DataFrame) -> DataFrame | None:
        """(id, salts) of the ids of very many written pairs, None where there's none."""
        if pairs.count() <= SPREAD:
            return None
        each = _ends(pairs.groupBy("a").count(), pairs.groupBy("b").count()).groupBy("id").agg(F.sum("count").alias("count"))
        found = written(each.where(F.col("count") > SPREAD).select("id", F.ceil(F.col("count") / SPREAD).cast("int").alias("salts")), "hot")
        self.made.append(found)
        return None if found.isEmpty() else _small(found)

    def attached(self, pairs: DataFrame, side: str, table: DataFrame, names: list[str], hot: DataFrame | None) -> DataFrame:
        """Pairs with the columns of table (id, ...) of one side; an id of very many pairs is dealt to several tasks."""
        named = table.toDF(side, *names)
        if hot is None:
            return pairs.join(named, side)
        few = hot.withColumnRenamed("id", side)
        left = pairs.join(few, side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        right = named.join(few, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        return left.join(right, [side, "salt"]).drop("salt")

    def verify(self, pairs: DataFrame) -> None:
        """Adds those of the distinct (a, b) that are links and contracts anew."""
        for old in self.judged:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.judged.append(pairs)
        hot = self.hot(pairs)
        regs = self.reps.select("id", "n", "regs")
        joined = self.attached(self.attached(pairs, "a", regs, ["na", "ra"], hot), "b", regs, ["nb", "rb"], hot)
        near = written(joined.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(_near(self.percent / 100), "a long, b long"), "near")
        many = near.count()
        if many:
            texts = written(self.texts(_ends(near.select("a"), near.select("b")).distinct(), 2 * many <= BROADCAST_ROWS), "texts")
            full = self.attached(self.attached(near, "a", texts, ["ta"], hot), "b", texts, ["tb"], hot).select("a", "b", "ta", "tb")
            found = written(full.mapInArrow(_same(self.width, self.percent), "a long, b long"), "found")
            drop(texts)
            if not found.isEmpty():
                self.links.append(found)
                edges = self.links[0]
                for x in self.links[1:]:
                    edges = edges.unionByName(x)
                old, self.roots = self.roots, components(edges)
                if old is not None:
                    drop(old)
        drop(near)

    def rooted(self, rows: DataFrame) -> DataFrame:
        """Rows with the component that their id has so far."""
        if self.roots is None:
            return rows.withColumn("root", F.col("id"))
        return rows.join(self.roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    def crossing(self, rows: DataFrame) -> DataFrame:
        """Rows (with root, members, pairs) of buckets that hold more than one component, written."""
        rows = self.rooted(rows.drop("root", "members", "pairs"))
        parts = rows.groupBy("key", "root").count()
        whole = parts.groupBy("key").agg(F.sum("count").alias("members"), F.count("*").alias("parts"), ((F.sum("count") * F.sum("count") - F.sum(F.col("count") * F.col("count"))) / 2).alias("pairs"))
        return written(rows.join(whole.where("parts > 1").select("key", "members", "pairs"), "key"), "rows")

    def star(self, rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of each bucket's most central member with its members in other components, and the rows without that
        member. In the second turn the central one is that outside the component of the most central of all."""
        rank = F.struct("popular", -F.col("id"))
        some = rows
        if turn:
            lead = rows.groupBy("key").agg(F.max_by("root", rank).alias("lead"))
            some = rows.join(lead, "key").where("root <> lead")
        pivot = some.groupBy("key").agg(F.max_by(F.struct("id", "root"), rank).alias("pivot"))
        both = written(rows.join(pivot, "key"), "star")
        self.made.append(both)
        pairs = both.where("root <> pivot.root").select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()
        return pairs, both.where("id <> pivot.id").select("id", "key", "n", "popular")

    def bounded(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of members that can have a link at all, with s, the shingles that others may share, and f, those that
        many have; and the pairs of such members in other components that share a shingle which few have."""
        ids = written(rows.select("id", "n", "root").distinct(), "ids")
        texts = self.texts(ids.select("id"), ids.count() <= BROADCAST_ROWS)
        tokens = written(texts.mapInArrow(_tokens(self.width), "token long, times long, ids array<long>"), "tokens")
        totals = tokens.groupBy("token").agg(F.sum("times").alias("t"), F.min(F.get("ids", F.lit(0))).alias("id"))
        totals = written(totals.where(F.col("t") <= RARE), "totals")
        own = totals.where("t = 1").groupBy("id").agg(F.count("*").alias("own"))
        rare = written(tokens.join(totals.where("t > 1").select("token"), "token").select("token", F.explode("ids").alias("id")), "rare")
        some = rare.groupBy("id").agg(F.count("*").alias("rare"))
        s = F.col("n") - F.coalesce("own", F.lit(0))
        known = ids.join(own, "id", "left").join(some, "id", "left").select("id", "n", "root", s.alias("s"), (s - F.coalesce("rare", F.lit(0))).alias("f"))
        known = written(known.where(100 * F.col("s") >= self.percent * F.col("n")), "known")
        drop(ids, tokens, totals)
        self.made += [rare, known]
        holds = rare.join(known, "id")
        other = holds.select("token", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "root", "s")))
        both = F.least("s", "s2")
        shared = holds.join(other, "token").where((F.col("id") < F.col("id2")) & (F.col("root") != F.col("root2")) & (100 * both >= self.percent * (F.col("n") + F.col("n2") - both)))
        pairs = shared.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
        return rows.join(known.select("id", "s", "f"), "id"), pairs

    def run(self) -> None:
        keyed = self.reps.select("id", "n", F.explode(_bands()).alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        first = written(keyed.join(shared, "key"), "buckets")
        if first.isEmpty():
            return
        popular = first.groupBy("id").agg(F.sum("size").alias("popular"))
        rows = first.join(popular, "id").select("id", "key", "n", "popular")
        for turn in range(2):
            now = self.crossing(rows)
            if now.isEmpty():
                return
            pairs, rows = self.star(now, turn)
            self.verify(pairs)
            drop(now)
        drop(first)
        now = self.crossing(rows)
        if now.isEmpty():
            return
        left, sharing = self.bounded(now)
        old, now = now, self.crossing(left)
        drop(old)
        few = now.where(F.col("pairs") <= PER_MEMBER * F.col("members"))
        self.verify(self.listed(few, few).unionByName(sharing).distinct())
        large = now.where(F.col("pairs") > PER_MEMBER * F.col("members"))
        if large.isEmpty():
            drop(now)
            return
        old, now = now, self.crossing(large)
        drop(old)
        if now.isEmpty():
            return
        # every pair is compared once, in the turn of the lesser slice of its two ids, unless links found before join them
        turns = -(-now.agg(F.max("members").alias("n")).first()["n"] // SLICE)
        part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(turns))
        for turn in range(turns):
            self.verify(self.listed(now.where(part == turn), now))
            old, now = now, self.crossing(now.where(part > turn))
            drop(old)
            if now.isEmpty():
                return

    def listed(self, some: DataFrame, rows: DataFrame) -> DataFrame:
        """Distinct crossing pairs of some of a bucket's rows with all of its rows that the bound leaves. Pairs that share
        a shingle which few have are judged before, so only those that many have count here."""
        own = rows.groupBy("id").agg(F.collect_set("key").alias("keys"))  # a key for each band at most
        left = some.join(own, "id").select("key", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("f").alias("fx"), F.col("keys").alias("kx"))
        right = rows.join(own, "id").select(F.col("key").alias("of"), F.col("id").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("f").alias("fy"), F.col("keys").alias("ky"))
        both = F.least("fx", "fy")
        may = (F.col("rx") != F.col("ry")) & (100 * both >= self.percent * (F.col("nx") + F.col("ny") - both))
        once = F.array_min(F.array_intersect("kx", "ky")) == F.col("key")  # of the buckets that two members share, one lists them
        pairs = left.join(right, (F.col("key") == F.col("of")) & may & once)
        if some is rows:  # each pair comes from either side
            pairs = pairs.where("x < y")
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (least key reachable), kept (key is component_id).

    Links join texts whose sets of width-word shingles have 100 * intersection >= percent * union; words are split at
    ASCII white space with A-Z lowered. A null, empty or blank text has an empty set and links with nothing. A text of
    fewer words is one shingle. Rows that repeat a key are one document: where their texts differ, that of the least
    hash stands for all, and the others belong to its class. A null key links with nothing and isn't kept out: its
    component_id is null and kept is true. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("said"), "text")
    base = written(rows.mapInArrow(_sketches(width), "id long, said long, n long, digest binary, regs binary"), "sketches")
    some = base.where("id is not null")
    used = [base]
    again = written(some.groupBy("id").count().where("count > 1").select("id"), "again")
    unique = again.isEmpty()
    if not unique:  # the sets of keys that repeat: one row each
        once = some.join(_small(again), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("said", "n", "digest", "regs"), "said").alias("x")).select("id", "x.*")
        some = written(some.join(_small(again), "id", "left_anti").select("id", "said", "n", "digest", "regs").unionByName(once), "sketches")
        used.append(some)
    some = some.where("digest is not null")
    # equal sets: all but the least id are copies of it; registers aren't shuffled for that
    groups = written(some.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep"), "groups")
    copies = written(some.select("id", "digest").join(_small(groups), "digest").where("id <> rep").select("id", "rep"), "copies")
    reps = some.join(_small(copies), "id", "left_anti")
    search = _Search(rows.where("id is not null"), reps, width, percent, unique)
    search.run()
    whole = copies.select("id", F.col("rep").alias("node"))
    if search.roots is not None:
        linked = search.roots.select(F.col("node").alias("id"), "root")
        whole = whole.join(search.roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")).unionByName(linked)
    else:
        whole = whole.withColumnRenamed("node", "root")
    classes = written(whole, "roots")  # one row for each id that isn't alone
    out = base.select("id", "n").join(_small(classes), "id", "left")
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))), "classes")
    drop(*used, again, groups, copies, classes, *search.links, *search.judged, *search.made, *([search.roots] if search.roots is not None else []))
    return out
