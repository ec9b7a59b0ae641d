"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item; an item of fewer words, but not none, is one window. One scan of
the documents splits each text once. Two small bitmaps, literals of the plan, drop nearly all windows inside the row: one
over hashes of a window's first and last word, and for those left one over the hash of all words. The few that are left
carry their words and meet the hash set of windows in a join that compares length, hash and words, so a hit is verified
there and no text is read or shuffled a second time. The hash set is broadcast while its measured bytes stay under a
bound, and joined by a shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.shared import drop, written

WIDTH = 13
#: Bytes of a table (windows with their words; ids of documents to drop) that is broadcast at most.
BROADCAST_BYTES = 64 << 20
#: Places of a bitmap for each window, and at most.
PLACES, MOST_PLACES = 32, 1 << 22
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words where case still stands.
CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = "array<struct<pos:int,len:int,gram:bigint,said:string>>"


def word_array(text: Column) -> Column:
    """Words of the text with A-Z lowered; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _bound(value: Column, body) -> Column:
    """The array body(value) with value evaluated once, which a projection that Catalyst may merge doesn't promise."""
    return F.flatten(F.transform(F.array(value), body))


def _ends(first: Column, last: Column, length: int, places: int) -> Column:
    """The bitmap's place of a window whose first and last words have these hashes."""
    return F.xxhash64(first, last, F.lit(length)).bitwiseAND(F.lit(places - 1)).cast("int")


def _bitmap(grams: DataFrame, place: Column, places: int) -> Column:
    """An array literal of 64 flags an element, set where a benchmark window has its place: at most MOST_PLACES flags."""
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)))
    rows = grams.select(F.shiftright(place, 6).alias("at"), flag.alias("flag")).groupBy("at").agg(F.bit_or("flag").alias("flags"))
    packed = [0] * (places // 64)
    for r in rows.collect():  # at most places / 64 numbers
        packed[r["at"]] = r["flags"]
    return F.split(F.lit(",".join(map(str, packed))), ",").cast("array<bigint>")


def _on(bitmap: Column, place: Column) -> Column:
    return F.call_function("shiftright", F.get(bitmap, F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _bitmaps(grams: DataFrame, lengths: list[int], places: int) -> tuple[Column, Column]:
    kind = None
    for n in lengths:
        here = _ends(F.xxhash64(F.element_at("w", 1)), F.xxhash64(F.element_at("w", -1)), n, places)
        kind = F.when(F.col("len") == n, here) if kind is None else kind.when(F.col("len") == n, here)
    return _bitmap(grams, kind, places), _bitmap(grams, _whole(F.col("gram"), places), places)


def _whole(gram: Column, places: int) -> Column:
    return gram.bitwiseAND(F.lit(places - 1)).cast("int")


def _windows(ws: Column, hs: Column, length: int, bitmaps: tuple[Column, Column], places: int) -> Column:
    """(pos, len, gram, said) of those windows of a text that the bitmaps let through."""
    size, (ends, whole) = F.size(ws), bitmaps
    maybe = F.filter(F.sequence(F.lit(1), size - (length - 1)), lambda i: _on(ends, _ends(F.get(hs, i - 1), F.get(hs, i + (length - 2)), length, places)))
    each = F.transform(maybe, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(hs, i, length)).alias("gram")))
    left = F.filter(each, lambda w: _on(whole, _whole(w.gram, places)))
    every = F.transform(left, lambda w: F.struct(w.pos.alias("pos"), F.lit(length).alias("len"), w.gram.alias("gram"), F.array_join(F.slice(ws, w.pos, length), " ").alias("said")))
    return F.when(size >= length, every).otherwise(F.array().cast(_NONE))


def benchmark_windows(bench: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, len, gram, said, w) distinct: each window's hash, its words joined by one space, and its words."""
    rows = bench.select(F.col(key).cast("string").alias("item"), word_array(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    rows = rows.withColumn("len", F.least(F.size("ws"), F.lit(width)))
    rows = rows.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1), lambda i: F.slice("ws", i, F.col("len")))).alias("w"))
    return rows.select("item", "len", F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))).alias("gram"), F.array_join("w", " ").alias("said"), "w").distinct()


def contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, spans: bool = False) -> DataFrame:
    """One row per row of docs: key, text_hash, n_words, n_hit, items (sorted as strings); with spans also hits, (pos, len) of every verified window.

    A word inside any occurrence of a window is hit. Null and empty texts have no words, no hits and no items; rows that
    repeat a key and text get equal results; a null key is a key like others. An empty benchmark hits nothing. Items
    with a null id hit words but aren't listed. Other columns are ignored.
    """
    grams = written(benchmark_windows(bench, item, item_text, width), "benchmark")
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most `width` numbers
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("said") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first()
    places = min(MOST_PLACES, 1 << (max(64, PLACES * size["n"]) - 1).bit_length())

    row = [F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")]

    def looked(ws: Column) -> Column:
        none = F.array().cast(_NONE)
        found = none if not lengths else _bound(F.transform(ws, lambda x: F.xxhash64(x)), lambda hs: F.concat(*[_windows(ws, hs, n, bitmaps, places) for n in lengths]))
        return F.array(F.struct(F.size(ws).cast("bigint").alias("n_words"), found.alias("maybe")))

    bitmaps = _bitmaps(grams, lengths, places) if lengths else None
    seen = docs.select(*row, F.get(_bound(word_array(F.col(text)), looked), F.lit(0)).alias("x")).select("id", "text_hash", "x.*")
    found = written(seen, "windows")

    small = F.broadcast if size["bytes"] <= BROADCAST_BYTES else (lambda x: x)
    maybe = found.where(F.size("maybe") > 0).select("id", "text_hash", F.explode("maybe").alias("m")).select("id", "text_hash", "m.*")
    checked = maybe.join(small(grams.drop("w")), ["len", "gram", "said"])
    hits = checked.groupBy("id", "text_hash").agg(F.collect_set(F.struct("pos", "len")).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.pos, h.pos + h.len - 1))))).cast("bigint"))

    hits = hits.toDF("id_", "hash_", "hits", "items", "n_hit")
    out = found.select("id", "text_hash", "n_words").join(hits, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    out = out.select(
        F.col("id").alias(key),
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        *([F.coalesce("hits", F.array().cast("array<struct<pos:int,len:int>>")).alias("hits")] if spans else []),
    )
    out._umbra_used = [grams, found]
    return out


def contaminated() -> Column:
    """The contract's rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _without(text: Column, hits: Column) -> Column:
    """The text without the words that windows cover; what stands between words stays."""
    gaps = F.split(text, CASED, -1)
    said = F.concat(F.regexp_extract_all(text, F.lit(CASED), F.lit(0)), F.array(F.lit("")))
    dropped = F.flatten(F.transform(hits, lambda h: F.sequence(h.pos, h.pos + h.len - 1)))
    numbered = F.zip_with(said, F.sequence(F.lit(1), F.size(said)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    kept = _bound(F.array_distinct(dropped), lambda d: F.transform(numbered, lambda x: F.when(F.array_contains(d, x.i), F.lit("")).otherwise(x.w)))
    return F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, w)), "")


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, remove: str = "documents") -> DataFrame:
    """docs with its own columns: without contaminated documents (remove="documents"), or with every hit word cut out of
    the texts (remove="spans"). Documents without hits come back as they were: nulls, empty texts, repeated rows. The
    few rows that change are found by key and text, so of rows that share a key only those with the text are touched."""
    result = contamination(docs, bench, key, text, item, item_text, width, spans=remove != "documents")
    bad = contaminated() if remove == "documents" else F.col("n_hit") > 0
    hits = result.where(bad).select(F.col(key).alias("__id"), F.col("text_hash").alias("__hash"), *([F.col("hits").alias("__hits")] if remove != "documents" else [])).dropDuplicates(["__id", "__hash"])
    hits = written(hits, "hits")
    drop(*result._umbra_used)
    size = hits.agg(F.coalesce(F.sum(F.lit(64) + (8 * F.size("__hits") if remove != "documents" else F.lit(0))), F.lit(0)).alias("bytes")).first()["bytes"]
    small = F.broadcast(hits) if size <= BROADCAST_BYTES else hits
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__hash"))
    if remove == "documents":
        return docs.join(small, same, "left_anti")
    joined = docs.join(small, same, "left")
    return joined.withColumn(text, F.when(F.col("__hits").isNull(), F.col(text)).otherwise(_without(F.col(text), F.col("__hits")))).select(*docs.columns)
