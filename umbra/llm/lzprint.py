"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an incremental (LZ78) dictionary: each phrase is the shortest string from the
current place on that no phrase before it was. The phrases are hashed and a minimum-hash signature of SLOTS values of
16 bits stands for their set; the share of equal slots estimates the sets' Jaccard similarity, which behaves like a
compression distance: texts that share long passages share phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.kernels import mix, slices

SLOTS = 128
#: Bytes of text of a range of rows that one task takes, about.
RANGE = 8 << 20
#: Ranges at most, so that their first rows stay a short list on the driver, and rows looked at for each to place its bounds.
RANGES, LOOKED = 100_000, 16
_ODD = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FULL = np.iinfo(np.uint64).max


def parse(text: str, at: int, known: set[str], ends: list[int]) -> list[str]:
    """Phrases of text from code point `at` on, given the phrases so far; known and ends (where each ends) grow.

    The phrases are closed under prefixes, so the longest known string here is found by stepping from the last
    phrase's length, two or three look-ups a phrase, not one for each character.
    """
    out, n, size = [], len(text), 1
    while at < n:
        if text[at : at + size] in known:
            size += 1
            while at + size <= n and text[at : at + size] in known:
                size += 1
        else:
            while size > 1 and text[at : at + size - 1] not in known:
                size -= 1
        phrase = text[at : at + size]  # at the text's end it may be a phrase that is known
        known.add(phrase)
        out.append(phrase)
        at += len(phrase)
        ends.append(at)
        size = max(1, len(phrase))
    return out


def least(phrases: list[str]) -> np.ndarray:
    """The least value of each slot's hash over the phrases."""
    low = np.full(SLOTS, _FULL, np.uint64)
    if phrases:
        digest = xxhash.xxh64_intdigest
        h = np.fromiter(map(digest, phrases), np.uint64, len(phrases))
        for k in range(0, len(h), 1024):
            np.minimum(low, (h[k : k + 1024, None] * _ODD + _ADD).min(axis=0), out=low)
    return low


def shown(low: np.ndarray) -> str:
    return (low >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal slots of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text; null is the empty text, whose slots are all at their highest value."""
    return shown(least(parse(text or "", 0, set(), [])))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint of each row, without a shuffle; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([fingerprint(x) for x in part.column("text").to_pylist()], pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", key)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, guest) of one range, descending, its guest last: each row but the guest with its edited text and the next row."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, done = None, []

    def finish(one: tuple, following: tuple) -> tuple:
        doc, text, phrases, ends, low = one
        n = len(text)
        keep = n - n // 3
        edited = text[:keep] + following[1][: n // 3]
        same = int(np.searchsorted(ends, keep, "right"))  # phrases that end inside what both have
        cut = phrases[:same]
        more = parse(edited, ends[same - 1] if same else 0, set(cut), [])
        changed = np.minimum(least(cut), least(more))
        return doc, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), shown(low), shown(changed), _equal(low, changed), _equal(low, following[4])

    def flush() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[] for _ in names]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
        done.clear()
        return out

    ended = False
    for batch in batches:
        for part in slices(batch, "text"):
            for doc, text, guest in zip(*(part.column(c).to_pylist() for c in ("id", "text", "guest")), strict=True):
                if ended:
                    continue
                text, ends = text or "", []
                phrases = parse(text, 0, set(), ends)
                now = (doc, text, phrases, ends, least(phrases))
                if held is not None:
                    done.append(finish(held, now))
                held, ended = now, guest
                if len(done) >= 512:
                    yield flush()
    if done:
        yield flush()


def _equal(a: np.ndarray, b: np.ndarray) -> float:
    return float(((a >> np.uint64(48)) == (b >> np.uint64(48))).mean())


def _ordered(rank: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Keys and text hashes as 16 bytes each that sort like the pairs."""
    both = np.stack([np.asarray(rank, np.int64), np.asarray(said, np.int64)], 1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def compared_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the one of the next smaller key, after the last the first; the edited text has its last third
    replaced by as much of the next text. Rows of one key follow each other by text hash, then text; a null key comes
    after all others and is returned as null; a null text is empty; one single row is its own next one; an empty table
    gives no rows. Other columns are ignored.

    One shuffle deals the rows to ranges of (key, text hash), cut at equal shares of the bytes, so a key that many rows
    share is dealt to several tasks; only rows alike in key and text stay together. Each range also gets the next one's
    first row, so every task has the neighbours it needs. Only counts, range bounds and first rows, a few numbers a range,
    come to the driver.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rank, said = F.coalesce("id", F.lit(-(2**63))), F.xxhash64("text")  # a null comes last
    size = F.octet_length("text") + 64
    much = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    n = max(1, min(RANGES, -(-much["bytes"] // RANGE)))
    cuts = np.zeros(0, "S16")
    if n > 1:
        one_of = max(1, much["rows"] // (LOOKED * n))
        seen = rows.select(rank.alias("rank"), said.alias("said"), size.alias("size")).where(F.pmod(F.xxhash64("rank", "said", F.lit(5)), F.lit(one_of)) == 0).toArrow()
        places = _ordered(seen.column("rank").to_numpy(), seen.column("said").to_numpy())
        order = np.argsort(places)
        share = np.cumsum(seen.column("size").to_numpy()[order].astype(float))
        if len(order):
            cuts = np.unique(places[order][np.searchsorted(share, share[-1] * np.arange(1, n) / n)])

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, _ordered(ids.to_numpy(), hashes.to_numpy()), "left")).astype(np.int32))

    heads = rows.groupBy(place(rank, said).alias("range")).agg(F.max(F.struct(rank.alias("rank"), said.alias("said"))).alias("head")).orderBy("range").collect()
    kind = f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not heads:
        return docs.sparkSession.createDataFrame([], kind)
    first = {r["range"]: (r["head"]["rank"], r["head"]["said"]) for r in heads}
    before = dict(zip(first, [list(first)[-1], *first], strict=False))  # of the first: the last

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        at = (len(cuts) - np.searchsorted(cuts, _ordered(ids.to_numpy(), hashes.to_numpy()), "left")).tolist()
        return pd.Series([np.array([r, -1 - before[r]] if first[r] == x else [r], np.int32) for r, x in zip(at, zip(ids.tolist(), hashes.tolist(), strict=True), strict=True)])

    dealt = rows.select("id", "text", F.explode(targets(rank, said)).alias("to"))
    dealt = dealt.select("id", "text", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("to"), (F.col("to") < 0).alias("guest"))
    sorted_ = dealt.repartitionById(len(cuts) + 1, "to").sortWithinPartitions("to", "guest", F.desc_nulls_last("id"), F.desc(F.xxhash64("text")), "text")
    out = sorted_.mapInArrow(_compared, kind.replace(f"{key} long", "id long", 1))
    return out.withColumnRenamed("id", key)
