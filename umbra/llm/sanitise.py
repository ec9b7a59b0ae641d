"""Personal data by pattern, and terms that give it away by information theory.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each value found is a protected entity e. From
the lines around entities, corpus co-occurrence says how much a term t reveals e: PMI(t, e) = log p(e|t) / p(e),
against the entity's information IC(e) = -log p(e). A term with PMI >= threshold * IC beside e on at least SUPPORT
different lines, or on all lines of an entity that has fewer, is a disclosing term: in documents that name e it is
generalised by a given table, or removed. Lines count over all documents and within each; probabilities are of documents.
Counts of a term are over all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.kernels import slices
from umbra.llm.shared import written

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of an entity's information from which a term discloses it; different lines that must show it, as far as the entity has them; words on either side.
THRESHOLD, SUPPORT, WINDOW = 0.8, 3, 10
FLUSH = 400_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, going from @ to @: a long run of letters is walked once, not from each start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base spans, ordered by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(x := y.lstrip("0")) <= 3 and int(x or 0) <= 255 for y in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The protected value behind a span, whatever its separators and case."""
    said = text[span[0] : span[1]].lower()
    return f"{KINDS[span[2]]}:{said if span[2] < 2 else re.sub('[^0-9]', '', said)}"


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))


def around(text: str, span: tuple[int, int, int], spans: list[tuple[int, int, int]]) -> tuple[int, set[str]]:
    """Hash of the line that holds the span, and the terms at most WINDOW words away on it and the lines beside it, outside all spans."""
    first, last = text.rfind("\n", 0, span[0]) + 1, text.find("\n", span[1])
    last = len(text) if last < 0 else last
    lo, hi = text.rfind("\n", 0, max(first - 1, 0)) + 1, text.find("\n", last + 1)
    hi = len(text) if hi < 0 else hi
    # one term has 3 letters or more; far more than WINDOW words are never needed
    words = [m for m in _WORD.finditer(text, lo, hi) if not any(a < m.end() and m.start() < b for a, b, _ in spans)] if len(spans) < 50 else _outside(text, lo, hi, spans)
    before = [m.group().lower() for m in words if m.end() <= span[0]][-WINDOW:]
    after = [m.group().lower() for m in words if m.start() >= span[1]][:WINDOW]
    return xxhash.xxh64_intdigest(text[first:last].encode("utf-8", "replace")) - (1 << 63), {*before, *after}


def _outside(text: str, lo: int, hi: int, spans: list[tuple[int, int, int]]) -> list[re.Match]:
    out, k = [], 0
    ordered = sorted(spans)
    for m in _WORD.finditer(text, lo, hi):
        while k < len(ordered) and ordered[k][1] <= m.start():
            k += 1
        if k == len(ordered) or ordered[k][0] >= m.end():
            out.append(m)
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: id, digest, base spans, the text of rows with spans; and for rows with spans (entity, term, different lines); the empty term has all lines of the entity."""
    for batch in batches:
        for part in slices(batch, "text"):
            digests, spans, triples, said = [], [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                got = base(text)
                digests.append(xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63) if got else 0)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in got])
                said.append(text if got else None)
                near: dict[tuple[str, str], set[int]] = defaultdict(set)
                for s in got:
                    line, terms = around(text, s, got)
                    e = entity(text, s)
                    for t in (*terms, ""):
                        near[e, t].add(line)
                triples.append([{"e": e, "t": t, "lines": [*lines]} for (e, t), lines in near.items()])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(digests, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))), pa.array(triples, pa.list_(pa.struct([("e", pa.string()), ("t", pa.string()), ("lines", pa.list_(pa.int64()))]))), pa.array(said, pa.string())],
                names=["id", "digest", "spans", "near", "text"],
            )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, summed within a task."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])
        seen.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                seen.update(set(_WORD.findall((text or "").lower())))
                if len(seen) > FLUSH:
                    yield flush()
    yield flush()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for text, terms in zip(part.column("text").to_pylist(), part.column("terms").to_pylist(), strict=True):
                got, wanted = base(text or ""), set(terms)
                free = _outside(text or "", 0, len(text or ""), got)
                rows.append([{"start": m.start(), "end": m.end(), "kind": 4} for m in free if m.group().lower() in wanted])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])))], names=["id", "digest", "added"])


_SPANS = "array<struct<start:int,end:int,kind:int>>"


def disclosing(docs: DataFrame, near: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(e, t, rho): the terms that give an entity away, from (id, digest, e, t, lines) rows and all documents."""
    each = near.select("e", "t", F.posexplode("lines").alias("k", "line"))
    pairs = written(each.groupBy("e", "t").agg(F.count_if(F.col("k") == 0).alias("n_et"), F.count_distinct("line").alias("lines")), "pairs")
    known = pairs.where("t = ''").select("e", F.col("n_et").alias("n_e"), F.least("lines", F.lit(support)).alias("least"))
    terms = written(pairs.where("t <> ''").join(known, "e").where(F.col("lines") >= F.col("least")).drop("least"), "terms")
    if terms.isEmpty():
        return terms.select("e", "t", F.lit(0.0).alias("rho"))
    total = docs.count()
    wanted = written(terms.select("t").distinct(), "wanted")
    counts = docs.select("text").mapInArrow(_documents, "t string, n long").join(F.broadcast(wanted) if wanted.count() <= 500_000 else wanted, "t", "left_semi").groupBy("t").agg(F.sum("n").alias("n_t"))
    all_ = terms.join(counts, "t")
    information = F.greatest(-F.log(F.col("n_e") / F.lit(total)), F.lit(1e-9))
    pmi = F.log(F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0))) + information
    return all_.select("e", "t", (pmi / information).alias("rho")).where(F.col("rho") >= threshold)


def naming(near: DataFrame, telling: DataFrame) -> DataFrame:
    """(e, id, digest, t): the disclosing terms of every entity that a document names, wherever the terms stand in it."""
    return near.where("t = ''").select("e", "id", "digest").join(telling.select("e", "t"), "e")


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """One row per row of docs: key, spans (start, end, kind number; code points), base ones and those the method adds.

    Null and empty texts have none. Repeated rows get equal results and count each; a null key is a key like others;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()
    base_rows = written(rows.mapInArrow(_found, f"id {id_type}, digest long, spans {_SPANS}, near array<struct<e:string,t:string,lines:array<bigint>>>, text string"), "spans")
    near = base_rows.where("size(near) > 0").select("id", "digest", F.explode("near").alias("x")).select("id", "digest", "x.*")
    telling = written(disclosing(rows, near, threshold, support), "telling")
    both = F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))
    if telling.isEmpty():
        return base_rows.select(F.col("id").alias(key), "spans")
    by_doc = naming(near, telling).groupBy("id", "digest").agg(F.collect_set("t").alias("terms"))
    ids = by_doc.toDF("id_", "digest_", "terms")
    # only texts that name an entity are shuffled
    asked = base_rows.where("size(near) > 0").select("id", "digest", "text").join(ids, both).select("id", "digest", "text", "terms").dropDuplicates(["id", "digest"])
    added = asked.mapInArrow(_occurrences, f"id {id_type}, digest long, added {_SPANS}")
    out = base_rows.join(added.toDF("id_", "digest_", "added"), both, "left")
    return out.select(F.col("id").alias(key), F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"))


def digested(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from found(): counts of each kind, base_sha256, spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    line = lambda x: F.concat_ws(":", F.element_at(name, x.kind + 1), x.start.cast("string"), x.end.cast("string"))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))))
    only = lambda f: F.array_join(F.transform(F.filter(ordered, f), line), ",")
    number = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [number(k) for k in range(5)]
    return spans.select(key, *counts[:4], F.sha2(only(lambda x: x.kind < 4), 256).alias("base_sha256"), only(lambda x: x.kind >= 0).alias("spans"), counts[4])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", general: dict[str, str] | None = None, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """docs with its own columns: base spans become [EMAIL], [IP], [CARD], [PHONE]; disclosing terms their general
    term, or [REMOVED]. A span that overlaps an earlier one is covered by it. Null texts stay null. Rows of one key
    share their disclosing terms."""
    table, rows = general or {}, docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    first = rows.mapInArrow(_found, f"id {rows.schema[0].dataType.simpleString()}, digest long, spans {_SPANS}, near array<struct<e:string,t:string,lines:array<bigint>>>, text string")
    near = written(first.where("size(near) > 0").select("id", "digest", F.explode("near").alias("x")).select("id", "digest", "x.*"), "near")
    telling = written(disclosing(rows, near, threshold, support), "telling")
    terms = naming(near, telling).groupBy("id").agg(F.collect_set("t").alias("__terms")).withColumnRenamed("id", "__id")
    joined = docs.join(terms, F.col(key).eqNullSafe(F.col("__id")), "left").select(*docs.columns, "__terms")
    at = joined.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [said if said is None else _rewritten(said, set(words or ()), table) for said, words in zip(batch.column(at).to_pylist(), batch.column("__terms").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def _rewritten(said: str, wanted: set[str], table: dict[str, str]) -> str:
    got = base(said)
    marks = [(a, b, f"[{KINDS[k].upper()}]") for a, b, k in got]
    if wanted:
        marks += [(m.start(), m.end(), table.get(m.group().lower(), "[REMOVED]")) for m in _outside(said, 0, len(said), got) if m.group().lower() in wanted]
    out, done = [], 0
    for a, b, label in sorted(marks):
        if a >= done:
            out += [said[done:a], label]
        done = max(done, b)
    return "".join([*out, said[done:]])
