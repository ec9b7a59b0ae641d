"""Token ids in sorted-string-table shards.

A shard is one file: data blocks, block index, Bloom filter, footer. Keys are document ids as 8 big-endian bytes with
the sign bit turned, so bytes sort as numbers; a null id is the empty key and sorts first. A block holds entries
(shared prefix length, rest length, value length, rest, value), every RESTART-th with its full key, then the restart
offsets, and is compressed with zstd. The index lists each block's last key and place; it's sparse and searched by
bisection, as are the restarts inside a block. A value is the document's ids, two bytes each while the vocabulary
allows, else four.

Shards are made by range partitioning on the id and written by Spark's own sink, so that any store Spark knows can hold
them and lost tasks leave nothing behind: one file a folder `shard=r..-p..-d..-t..-b..` (range, part of it, documents,
ids, ids before it in its range), whose name tells what offsets need without opening it. Ranges are sized by bytes and
at most RANGES, so the driver holds one total for each, never a list of shards. The sink ends a file with one line feed,
which the reader expects.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.kernels import slices

MAGIC = b"UMBRASST"
FOOTER = struct.Struct("<QQQQQQBx6x8s")  # index at and size, filter at and size, entries, tokens, id width, magic
BLOCK, RESTART = 1 << 16, 16
#: Bytes of ids after which a task starts a new shard; bits of filter for each key and its hashes.
SHARD, BITS, HASHES = 32 << 20, 10, 7
#: Bytes of text of a range, about, and ranges at most: beyond that ranges grow.
RANGE, RANGES = 16 << 20, 100_000
#: Distinct words whose ids a worker process keeps.
CACHE = 150_000


def key_of(doc: int | None) -> bytes:
    return b"" if doc is None else struct.pack(">Q", doc + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class Writer:
    """Builds one shard from entries in ascending key order; equal keys are allowed and stay in order."""

    def __init__(self, width: int):
        self.width, self.out, self.index, self.keys = width, [MAGIC], [], []
        self.at, self.tokens, self.zstd = len(MAGIC), 0, zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.restarts, self.last, self.entries = [], 0, [], b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.entries % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.block.append(entry)
        self.size += len(entry)
        self.last, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.tokens += len(ids) // self.width
        if self.size >= BLOCK:
            self._close()

    def _close(self) -> None:
        if not self.entries:
            return
        raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = self.zstd.compress(raw)
        self.index.append((self.last, self.at, len(packed)))
        self.out.append(packed)
        self.at += len(packed)
        self._open()

    def finish(self) -> bytes:
        self._close()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BITS)
        field = np.zeros((bits + 7) // 8 * 8, bool)
        for k in self.keys:
            field[_places(k, len(field))] = True
        bloom = np.packbits(field).tobytes()
        foot = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, self.width, MAGIC)
        return b"".join([*self.out, index, bloom, foot])


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(HASHES)]


class Reader:
    """One shard's bytes: look up an id, or go through all."""

    def __init__(self, data: bytes):
        data = data.removesuffix(b"\n") if data[-len(MAGIC) :] != MAGIC else data
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.data = data
        index_at, index_size, bloom_at, bloom_size, self.entries, self.tokens, self.width, _ = FOOTER.unpack(data[-FOOTER.size :])
        self.bloom = data[bloom_at : bloom_at + bloom_size]
        self.lasts, self.spots, at, raw = [], [], 0, data[index_at : index_at + index_size]
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.lasts.append(raw[at : at + n])
            at += n
            spot, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            self.spots.append((spot, size))

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        spot, size = self.spots[k]
        raw = zstandard.ZstdDecompressor().decompress(self.data[spot : spot + size])
        n = struct.unpack("<I", raw[-4:])[0]
        return raw[: len(raw) - 4 - 4 * n], list(struct.unpack(f"<{n}I", raw[len(raw) - 4 - 4 * n : -4]))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.spots)):
            for key, ids in self._entries(self._block(k)[0], 0):
                yield id_of(key), np.frombuffer(ids, f"<u{self.width}")

    def may_hold(self, doc: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _places(key_of(doc), 8 * len(self.bloom)))

    def get(self, doc: int | None) -> list[np.ndarray]:
        """The ids of every row with this id: filter, bisection over blocks and restarts, then a short scan."""
        key, out = key_of(doc), []
        if not self.may_hold(doc):
            return out
        for k in range(bisect.bisect_left(self.lasts, key), len(self.spots)):
            raw, restarts = self._block(k)
            lo, hi = 0, len(restarts)  # the last restart whose key is below the key
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if next(self._entries(raw, restarts[mid]))[0] < key else (lo, mid)
            for k2, ids in self._entries(raw, restarts[lo]):
                if k2 > key:
                    return out
                if k2 == key:
                    out.append(np.frombuffer(ids, f"<u{self.width}"))
        return out


#: Texts of these characters alone need no normalisation but lower case, and split as the tokenizer's file says; others go through the library whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s0-9²³¹¼½¾a-zªµºß-öø-ÿ]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it's printable, else one from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts as bytes. For files whose words are encoded one by one, each distinct word is encoded once, by
    the file's own model alone; a few samples decide on opening whether that is what the library does with whole texts."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.bytes = _byte_characters()
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        split = str(head.get("pre_tokenizer"))
        self.special = [t["content"] for t in head.get("added_tokens", [])]
        self.by_word = "'normalizers': [{'type': 'NFC'}, {'type': 'Replace', 'pattern': {'Regex': '\\\\s+'}, 'content': ' '}, {'type': 'Lowercase'}]" in str(head.get("normalizer")) and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in split and "'use_regex': False" in split and "'invert': True" in split
        self.by_word = self.by_word and all(self(x, 1) == self.packed(x) + (1).to_bytes(self.width, "little") for x in ("Don't stop,it's 42!", "É ß ñu — “x”", "$$$ a_b\t<|c|> ½ Ünïcödé"))

    def packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        said = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        self[word] = got = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(said)])
        return got

    def __call__(self, text: str, end: int) -> bytes:
        last = end.to_bytes(self.width, "little")
        if self.by_word and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower()))) + last
        return self.packed(text) + last


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, opened once by each worker process."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1, size: int = RANGE, shard: int = SHARD) -> None:
    """Writes the shards. Ids ascend within a shard and from shard to shard; rows of one id follow each other by text;
    null and empty texts are the end id alone; an empty table leaves no shard."""
    few = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    much = few.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("bytes")).first()
    ranges = max(1, min(RANGES, max(-(-much["bytes"] // size), min(docs.sparkSession.sparkContext.defaultParallelism, much["rows"] // 256))))
    ordered = few.repartitionByRange(ranges, F.asc_nulls_first("id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, place, part, held, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, 0
        writer = Writer(encode.width)

        def flush() -> pa.RecordBatch:
            name = f"r{place}-p{part}-d{len(writer.keys)}-t{writer.tokens}-b{before}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.finish()], pa.binary())], names=["shard", "content"])

        for batch in batches:
            for piece in slices(batch, "text"):
                for doc, said in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids = encode(said, end)
                    writer.add(key_of(doc), ids)
                    held += len(ids)
                    if held >= shard:
                        yield flush()
                        before += writer.tokens
                        part, held, writer = part + 1, 0, Writer(encode.width)
        if writer.keys:
            yield flush()

    made = ordered.mapInArrow(run, "shard string, content binary")
    made.select("shard", F.col("content").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").text(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards' bytes with what their folders say: range, part, docs, tokens, before."""
    kind = "range int, part int, docs long, tokens long, before long"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in raw.columns:  # nothing was written
        return spark.createDataFrame([], f"content binary, {kind}")
    named = raw.select("content", F.split("shard", "-").alias("x"))
    return named.select("content", *(F.substring(F.get("x", F.lit(i)), 2, 20).cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(kind.split(", "))))


def starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each range: one number for each of at most RANGES ranges, from folder names alone."""
    rows = sorted((r["range"], r["tokens"]) for r in shards(spark, path).groupBy("range").agg(F.sum("tokens").alias("tokens")).collect())
    out, total = {}, 0
    for r, n in rows:
        out[r] = total
        total += n
    return out


def offsets(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Reads the shards back: key, start (ids of all documents before), n_tokens, ids_crc32 of each document."""
    first = starts(spark, path)
    shared = spark.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, before, data in zip(batch.column("range").to_pylist(), batch.column("before").to_pylist(), batch.column("content"), strict=True):
                at, rows = shared.value[r] + before, []
                for doc, ids in Reader(data.as_py()):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(4)], names=["id", "start", "n_tokens", "ids_crc32"])

    if not first:
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, ids_crc32 long")
    return shards(spark, path).select("range", "before", "content").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", key)


def lookup(spark: SparkSession, path: str, doc: int | None) -> list[list[int]]:
    """The ids of every row with this id, by filter and bisection in each shard that may hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ids.tolist() for data in batch.column("content") for ids in Reader(data.as_py()).get(doc)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["ids"])

    return [r["ids"] for r in shards(spark, path).select("content").mapInArrow(run, "ids array<long>").collect()]
