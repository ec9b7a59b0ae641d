"""Subword-lattice language model.

The pieces are an existing tokenizer's vocabulary, which is read and never changed; its scores (ranks) give the first
piece probabilities, and expectation maximisation over the corpus's word counts re-estimates them. A word's
probability is the sum over all its segmentations into pieces, by a forward recursion in log space; a text's is the
product over its words and one end. Pieces that hold a word start only inside are left out, so words are independent
and the lattice of a distinct word is walked once, however often it stands in the corpus.

A word that the corpus holds has one more edge over its lattice, the whole word, with its absolutely discounted share
of the corpus; the mass that discounting frees weighs the subword paths. Both kinds of path add up to the word's
marginal probability, so common words aren't paid for piece by piece and unseen ones still have all segmentations.

Two log-probabilities of a text come out: `lattice`, by the vocabulary's pieces alone, all segmentations of each word
added up, and `score`, where the whole-word edge is one more path. Beside them stands the plain add-one unigram model
over words that the contract fixes as base.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.shared import drop, written

START = "▁"
#: Rounds of expectation maximisation; the second gains 0.3 in log10 of an unseen word and costs as much again.
ROUNDS = 2
#: Words of highest count whose scores every task holds; all others meet their scores in a join.
HEAD = 200_000
#: Distinct words that a task counts before it passes them on.
FLUSH = 400_000
#: Count that every word's own edge gives up for the subword paths.
DISCOUNT = 0.75
#: Weight given to every piece before counts come in.
FLOOR = 0.01


class Lattice:
    """Piece log-probabilities and the walks over a word's segmentations.

    A word whose every character is a piece has piece edges alone, and an automaton over the pieces lists them by end
    place in one pass; other words go the long way, where a character may also stand for its bytes."""

    def __init__(self, log: dict[str, float], bytes_log: list[float], end: float):
        self.log, self.bytes_log, self.end = log, bytes_log, end
        self._build()

    def _build(self) -> None:
        self.heads = {p[:k] for p in self.log for k in range(1, len(p) + 1)}
        self.single = {p for p in self.log if len(p) == 1} - {START}
        self.found = ahocorasick.Automaton()
        for p, v in self.log.items():
            self.found.add_word(p, (len(p) - 1, p, v))
        self.found.make_automaton()

    def __getstate__(self):
        return self.log, self.bytes_log, self.end

    def __setstate__(self, state) -> None:
        self.log, self.bytes_log, self.end = state
        self._build()

    def plain(self, word: str) -> bool:
        return START in self.log and self.single.issuperset(word)

    @classmethod
    def of(cls, model_file: str) -> Lattice:
        """From a sentencepiece file: probability falls as 1/(rank + 10), the ranks that its scores hold."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [(-sp.get_score(i), sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        keep = [(r, p) for r, p in plain if START not in p[1:] and not any("A" <= c <= "Z" for c in p)]
        weights = {p: 1 / (r + 10) for r, p in keep}
        weights.setdefault(START, 1e-3)
        return cls.normalised(weights, [1e-4] * 256, 1e-2)

    @classmethod
    def normalised(cls, weights: dict[str, float], of_bytes: list[float], end: float) -> Lattice:
        total = math.fsum(weights.values()) + math.fsum(of_bytes) + end
        return cls({p: math.log(w / total) for p, w in weights.items()}, [math.log(w / total) for w in of_bytes], math.log(end / total))

    def edges(self, word: str) -> list[list[tuple[int, str | None, float]]]:
        """For each end place the pieces that end there: (first place, piece or None for the character's bytes, log)."""
        s, log, heads = START + word, self.log, self.heads
        n = len(s)
        out: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            c = s[i]
            if i and c == START or c not in heads:
                out[i + 1].append((i, None, sum(self.bytes_log[b] for b in c.encode("utf-8", "replace"))))
                continue
            one = False
            for j in range(i + 1, n + 1):
                p = s[i:j]
                if p not in heads:
                    break
                v = log.get(p)
                if v is not None:
                    out[j].append((i, p, v))
                    one |= j == i + 1
            if not one:
                out[i + 1].append((i, None, sum(self.bytes_log[b] for b in c.encode("utf-8", "replace"))))
        return out

    def forward(self, edges: list) -> list[float]:
        alpha = [0.0]
        exp, log = math.exp, math.log
        for ending in edges[1:]:
            terms = [alpha[i] + v for i, _, v in ending]
            if len(terms) == 1:
                alpha.append(terms[0])
            else:
                m = max(terms, default=-math.inf)
                alpha.append(m + log(sum([exp(t - m) for t in terms])) if m > -math.inf else m)
        return alpha

    def word(self, word: str) -> float:
        """Natural log of the word's probability: all segmentations together."""
        if not self.plain(word):
            return self.forward(self.edges(word))[-1]
        exp, log1p = math.exp, math.log1p
        alpha: list = [0.0] + [None] * (len(word) + 1)
        for e, (k, _, v) in self.found.iter(START + word):
            t, o = alpha[e - k] + v, alpha[e + 1]
            alpha[e + 1] = t if o is None else (o + log1p(exp(t - o)) if o > t else t + log1p(exp(o - t)))
        return alpha[-1]

    def expect_plain(self, word: str, weight: float, pieces: dict[str, float]) -> float:
        """expect() of a word whose every character is a piece."""
        exp, log1p, n = math.exp, math.log1p, len(word) + 1
        alpha: list = [0.0] + [None] * n
        edges = []
        for e, (k, p, v) in self.found.iter(START + word):
            i = e - k
            t, o = alpha[i] + v, alpha[e + 1]
            edges.append((e + 1, i, p, v, t))
            alpha[e + 1] = t if o is None else (o + log1p(exp(t - o)) if o > t else t + log1p(exp(o - t)))
        total, get = alpha[n], pieces.get
        beta: list = [None] * n + [0.0]
        edges.reverse()  # by descending end: what follows a place is known before it
        for j, i, p, v, t in edges:
            b = beta[j]
            pieces[p] = get(p, 0.0) + exp(t + b - total) * weight
            t, o = v + b, beta[i]
            beta[i] = t if o is None else (o + log1p(exp(t - o)) if o > t else t + log1p(exp(o - t)))
        return total

    def expect(self, word: str, weight: float, pieces: dict[str, float], of_bytes: list[float]) -> float:
        """Adds the expected counts of the word's pieces, weight times; returns its log-probability."""
        if self.plain(word):
            return self.expect_plain(word, weight, pieces)
        edges = self.edges(word)
        alpha = self.forward(edges)
        n, total = len(edges) - 1, alpha[-1]
        beta = [-math.inf] * n + [0.0]
        exp, log1p = math.exp, math.log1p
        for j in range(n, 0, -1):
            b = beta[j]
            if b == -math.inf:
                continue
            for i, p, v in edges[j]:
                t = v + b
                share = exp(alpha[i] + t - total) * weight
                if p is None:
                    for x in (START + word)[i].encode("utf-8", "replace"):
                        of_bytes[x] += share
                else:
                    pieces[p] = pieces.get(p, 0.0) + share
                o = beta[i]
                beta[i] = t if o == -math.inf else (o + log1p(exp(t - o)) if o > t else t + log1p(exp(o - t)))
        return total


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _raws(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return pc.fill_null(batch.column(name).cast(pa.binary()), b"").to_pylist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): n counts training rows only; words of other rows come with 0."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for raw, learn in zip(_raws(batch, "text"), batch.column("learn").to_pylist(), strict=True):
            ws = raw.lower().split()  # of bytes: A-Z only, ASCII white space only
            if learn:
                seen.update(ws)
            else:
                for w in ws:
                    seen[w] += 0
            if len(seen) > FLUSH:
                yield flush()
    yield flush()


def _expected(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Lattice = shared.value
        pieces: dict[str, float] = {}
        of_bytes = [0.0] * 256
        for batch in batches:
            for raw in batch.column("word").to_pylist():
                m.expect(text(raw), 1.0, pieces, of_bytes)
        names = [*pieces, *(f"\0{k}" for k, x in enumerate(of_bytes) if x)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*pieces.values(), *(x for x in of_bytes if x)], pa.float64())], names=["piece", "n"])

    return run


def train(counts: DataFrame, ends: int, start: Lattice, rounds: int = ROUNDS) -> Lattice:
    """EM over all words with n > 0, each once, as subword paths stand in for words that discounting makes rare; what
    comes to the driver is one number for each piece of the vocabulary."""
    m, spark = start, counts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(m)
        sums = counts.where("n > 0").mapInArrow(_expected(shared), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        got = {r["piece"]: r["n"] for r in sums.collect()}
        m = Lattice.normalised({p: got.get(p, 0.0) + FLOOR for p in m.log}, [got.get(f"\0{k}", 0.0) + FLOOR for k in range(256)], ends + FLOOR)
        shared.unpersist()
    return m


def _scored(shared, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Lattice = shared.value
        free = math.log(DISCOUNT * distinct / total) if total else 0.0
        for batch in batches:
            lm, pieces = [], []
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                pieces.append(m.word(text(w)))
                paths = free + pieces[-1]
                own = math.log((n - DISCOUNT) / total) if n else -math.inf
                lm.append(max(paths, own) + math.log1p(math.exp(-abs(paths - own))))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(lm, pa.float64()), pa.array(pieces, pa.float64())], names=["word", "n", "lm", "pieces"])

    return run


def _parts(shared):
    """Per row: (id, digest, word null, tokens, known, base, lm, pieces) of its end and frequent words; (id, digest, word, tokens) of others."""
    names = ["id", "digest", "word", "tokens", "known", "base", "lm", "pieces"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, end = shared.value
        for batch in batches:
            rows: list[list] = [[] for _ in names]

            def add(*values, rows=rows) -> None:
                for r, v in zip(rows, values, strict=True):
                    r.append(v)

            for doc, raw in zip(batch.column("id").to_pylist(), _raws(batch, "text"), strict=True):
                digest = xxhash.xxh64_intdigest(raw) - (1 << 63)
                known, base, lm, pieces, n = *end, 1
                for w, k in Counter(raw.lower().split()).items():
                    got = head.get(w)
                    if got is None:
                        add(doc, digest, w, k, 0, 0.0, 0.0, 0.0)
                    else:
                        n += k
                        known += k * got[0]
                        base += k * got[1]
                        lm += k * got[2]
                        pieces += k * got[3]
                add(doc, digest, None, n, known, base, lm, pieces)
                if len(rows[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)
                    for r in rows:
                        r.clear()
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)

    return run


def score(docs: DataFrame, learn: Column, model_file: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row per row of docs: key, held_out (not learnt from), n_tokens, n_known, train_tokens, base_score, score, lattice (log10).

    Words are split at ASCII white space with A-Z lowered; each text has one end. A null or empty text is its end
    alone. With no training rows every base probability is 1/(0+0+1). Rows that repeat a key and text get equal
    results; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), learn.alias("learn"))
    ends = rows.where("learn").count()
    counts = written(rows.select("text", "learn").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    model = train(counts, ends, Lattice.of(model_file), rounds) if sums["n"] else Lattice.of(model_file)
    shared = spark.sparkContext.broadcast(model)
    table = written(counts.mapInArrow(_scored(shared, total, distinct), "word binary, n long, lm double, pieces double"), "scores")
    drop(counts)

    whole = math.log10(total + distinct + 1)
    base = F.log10(F.col("n") + 1) - F.lit(whole)
    lm, pieces = (F.col(c) / F.lit(math.log(10)) for c in ("lm", "pieces"))
    most = table.orderBy(F.desc("n"), "word").limit(head).select("word", (F.col("n") > 0).cast("int").alias("known"), base.alias("base"), lm.alias("lm"), pieces.alias("pieces")).toArrow()
    frequent = {w: x for w, *x in zip(*(most.column(c).to_pylist() for c in ("word", "known", "base", "lm", "pieces")), strict=True)}
    own_end = (ends - DISCOUNT) / total + DISCOUNT * distinct / total * math.exp(model.end) if ends else math.exp(model.end)
    at_end = (int(ends > 0), math.log10(ends + 1) - whole, math.log10(own_end), model.end / math.log(10))
    held = spark.sparkContext.broadcast((frequent, at_end))  # at most `head` words
    parts = written(rows.select("id", "text").mapInArrow(_parts(held), "id long, digest long, word binary, tokens long, known long, base double, lm double, pieces double"), "parts")

    rare = parts.where("word is not null").select("id", "digest", "word", "tokens").join(table.select("word", (F.col("n") > 0).cast("long").alias("known"), base.alias("base"), lm.alias("lm"), pieces.alias("pieces")), "word")
    rare = rare.select("id", "digest", F.lit(0).alias("rows"), "tokens", *((F.col("tokens") * F.col(c)).alias(c) for c in ("known", "base", "lm", "pieces")))
    every = rare.unionByName(parts.where("word is null").select("id", "digest", F.lit(1).alias("rows"), "tokens", "known", "base", "lm", "pieces"))
    out = every.groupBy("id", "digest").agg(*(F.sum(c).alias(c) for c in ("rows", "tokens", "known", "base", "lm", "pieces")))
    n = F.col("rows")
    whole_number = lambda c: (F.col(c) / n).cast("long")  # noqa: E731  equal rows were summed together
    out = out.select(F.col("id").alias(key), whole_number("tokens").alias("n_tokens"), whole_number("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / n).alias("base_score"), (F.col("lm") / n).alias("score"), (F.col("pieces") / n).alias("lattice"), F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias("__again"))
    return out.drop("__again")
