"""Labelled claim texts, made by Spark from the keys of a table, and scores of the detector against them.

A template is a row of pieces: raw words, or a value with its label. Text and gold spans come from the same pieces, so a
span can't be off. Pieces are SQL expressions over the row's key k that both engines take.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.operators import report, tagger, whole
from umbra.operators.arrow import clean

# Which category a gold label and a detected type are scored under; other types count under ANY alone.
GOLD_CATEGORY = {
    "PERSON": "PERSON", "AU_ADDRESS": "ADDRESS", "EMAIL_ADDRESS": "EMAIL", "AU_PHONE": "PHONE", "PHONE_INTL": "PHONE", "DATE": "DATE", "ISO_DATETIME": "DATE", "TIME": "DATE",
    "AU_TFN": "ACCOUNT_LIKE", "AU_MEDICARE": "ACCOUNT_LIKE", "AU_ABN": "ACCOUNT_LIKE", "AU_ACN": "ACCOUNT_LIKE", "POLICY_NUMBER": "ACCOUNT_LIKE", "INSURANCE_CLAIM_NUMBER": "ACCOUNT_LIKE",
    "VEHICLE_REGISTRATION": "ACCOUNT_LIKE", "VIN": "ACCOUNT_LIKE", "US_SSN": "ACCOUNT_LIKE", "CREDIT_CARD_NUMBER": "ACCOUNT_LIKE",
}
FOUND_CATEGORY = {
    "PERSON": "PERSON", "AU_ADDRESS": "ADDRESS", "LOCATION": "ADDRESS", "AU_POSTCODE": "ADDRESS", "EMAIL_ADDRESS": "EMAIL", "AU_PHONE": "PHONE", "PHONE_INTL": "PHONE", "PHONE_NUMBER": "PHONE",
    "DATE": "DATE", "DATE_OF_BIRTH": "DATE", "INCIDENT_DATE": "DATE", "ISO_DATETIME": "DATE", "TIME": "DATE",
    "AU_TFN": "ACCOUNT_LIKE", "AU_MEDICARE": "ACCOUNT_LIKE", "AU_ABN": "ACCOUNT_LIKE", "AU_ACN": "ACCOUNT_LIKE", "AU_CENTRELINK_CRN": "ACCOUNT_LIKE", "INSURANCE_POLICY_NUMBER": "ACCOUNT_LIKE",
    "INSURANCE_CLAIM_NUMBER": "ACCOUNT_LIKE", "VEHICLE_REGISTRATION": "ACCOUNT_LIKE", "VEHICLE_VIN": "ACCOUNT_LIKE", "US_SSN": "ACCOUNT_LIKE", "CREDIT_CARD": "ACCOUNT_LIKE", "CREDIT_CARD_NUMBER": "ACCOUNT_LIKE",
}
# End of fixed values.


def _pick(words: str, by: str) -> str:
    n = words.count("|") + 1
    return f"split_part('{words}', '|', cast(1 + ({by}) % {n} as int))"


def _digits(by: str, n: int) -> str:
    """n digits that follow from k."""
    return f"lpad(cast(({by}) % {10**n} as string), {n}, '0')"


def _between(by: str, low: int, high: int) -> str:
    return f"cast({low} + ({by}) % {high - low + 1} as string)"


_FIRST, _LAST = "Alice|Brendan|Chloe|Darren|Erin|Fergus|Gemma|Harold|Imogen|Jarrod|Kylie|Lachlan|Megan", "Abbott|Barker|Carter|Dawson|Emery|Foster|Gibson|Harvey|Irwin|Jarvis|Keating"
_STREET = "Albert Street|Bourke Street|Church Road|Denison Avenue|Eagle Parade|Fisher Crescent|Gordon Place"
_TOWN = "Sydney NSW|Melbourne VIC|Brisbane QLD|Perth WA|Adelaide SA|Hobart TAS"
_day = lambda by, year: f"concat({_digits(f'({by}) % 28 + 1', 2)}, '/', {_digits(f'({by}) % 12 + 1', 2)}, '/', {year})"
PERSON = f"concat({_pick(_FIRST, 'k * 7')}, ' ', {_pick(_LAST, 'k * 5 + 2')})"
OTHER = f"concat({_pick(_FIRST, 'k * 3 + 4')}, ' ', {_pick(_LAST, 'k * 11 + 1')})"
BORN = _day("k * 13", _between("k * 17", 1940, 2005))
DAY = _day("k * 19 + 5", _between("k", 2021, 2023))
POLICY = f"concat({_pick('POL|POL-|P', 'k * 3')}, {_between('k * 7919', 1000000, 9999999)})"
CLAIM = f"concat({_pick('CL|CL-|CLM|CLM-', 'k * 5')}, {_between('k * 104729', 10000000, 99999999)})"
PLATE = _pick("DFG482|KLM091|QR-7715|BNT-620|HJX-334|WYZ58K", "k * 7")
VIN = f"concat({_pick('1HGCM82633A|WBA8E9C54GK|JH4DC4370SS', 'k')}, {_digits('k * 31', 6)})"
MOBILE = f"concat('04', {_between('k', 10, 99)}, ' ', {_digits('k * 37', 3)}, ' ', {_digits('k * 41 + 7', 3)})"
LANDLINE = f"concat({_pick('02|03|07|08', 'k')}, ' ', {_between('k * 3', 4000, 9999)}, ' ', {_digits('k * 43 + 11', 4)})"
ABROAD = f"concat('+44 7', {_digits('k * 3', 3)}, ' ', {_digits('k * 53', 3)}, ' ', {_digits('k * 59 + 3', 3)})"
EMAIL = f"concat(lower({_pick(_FIRST, 'k * 7')}), '.', lower({_pick(_LAST, 'k * 5 + 2')}), '@', {_pick('example.com.au|cover.example.com|post.example.net', 'k')})"
DESK = f"concat('desk', {_between('k', 1, 40)}, '@cover.example.com.au')"
ADDRESS = f"concat({_between('k * 3', 1, 400)}, ' ', {_pick(_STREET, 'k')}, ', ', {_pick(_TOWN, 'k * 5')}, ' ', {_between('k * 61', 2000, 7999)})"
TFN = _pick("123 456 782|876 543 210|112 233 445", "k")
MEDICARE = f"concat({_between('k', 2, 6)}, {_digits('k * 67', 3)}, ' ', {_digits('k * 71', 5)}, ' ', {_between('k', 1, 9)})"
ABN, ACN = _pick("51 824 753 556|53 004 085 616", "k"), _pick("004 085 616|123 456 780", "k")
SSN = f"concat({_between('k * 3', 100, 599)}, '-', {_between('k', 10, 99)}, '-', {_between('k * 73', 1000, 9999)})"
CARD = _pick("4111 1111 1111 1111|5500 0055 5555 5559|4012 8888 8888 1881", "k")
STAMP = f"concat('2023-', {_digits('k % 12 + 1', 2)}, '-', {_digits('k % 28 + 1', 2)}, 'T', {_digits('k % 24', 2)}, ':', {_digits('k * 7 % 60', 2)}, ':00')"
CLOCK = f"concat({_digits('k % 24', 2)}, ':', {_digits('k * 11 % 60', 2)})"

#: Raw words as they stand; (label, value) where personal data stands.
TEMPLATES: list[list[str | tuple[str, str]]] = [
    ["Intake memo\n\nInsured: ", ("PERSON", PERSON), ", born ", ("DATE", BORN), ".\nPolicy Number: ", ("POLICY_NUMBER", POLICY), "\nClaim: ", ("INSURANCE_CLAIM_NUMBER", CLAIM), "\nWe were told on ", ("DATE", DAY), " that the car with registration ", ("VEHICLE_REGISTRATION", PLATE), " (VIN: ", ("VIN", VIN), ") was hit. Mobile: ", ("AU_PHONE", MOBILE), ". Mail: ", ("EMAIL_ADDRESS", EMAIL), ".\nHome: ", ("AU_ADDRESS", ADDRESS), ".\nTFN: ", ("AU_TFN", TFN), ".\nMedicare: ", ("AU_MEDICARE", MEDICARE), "."],
    ["To: ", ("EMAIL_ADDRESS", EMAIL), "\nFrom: ", ("EMAIL_ADDRESS", DESK), "\nWe have looked at claim ", ("INSURANCE_CLAIM_NUMBER", CLAIM), ", which reached us on ", ("DATE", DAY), ". It falls under policy ", ("POLICY_NUMBER", POLICY), ". Please ring ", ("AU_PHONE", LANDLINE), " with any question.\n\nKind regards,\n", ("PERSON", OTHER)],
    ["File of a business\nABN: ", ("AU_ABN", ABN), "\nACN: ", ("AU_ACN", ACN), "\nOwner: ", ("PERSON", PERSON), " (DOB ", ("DATE", BORN), ")\nOffice at ", ("AU_ADDRESS", ADDRESS), "\nReach us on ", ("AU_PHONE", LANDLINE), " or ", ("EMAIL_ADDRESS", EMAIL)],
    ["Letter of a clinic\nPatient: ", ("PERSON", PERSON), "\nDOB: ", ("DATE", BORN), "\nMedicare: ", ("AU_MEDICARE", MEDICARE), "\nSeen on ", ("DATE", DAY), " after a crash. The patient lives at ", ("AU_ADDRESS", ADDRESS), " and has the mobile ", ("AU_PHONE", MOBILE), ".\nSigned, Dr. ", ("PERSON", OTHER)],
    ["Rang ", ("PERSON", PERSON), " on ", ("AU_PHONE", MOBILE), " about the vehicle ", ("VEHICLE_REGISTRATION", PLATE), ". Policy ", ("POLICY_NUMBER", POLICY), " covers the home at ", ("AU_ADDRESS", ADDRESS), "."],
    ["Note on a client abroad\nClient: ", ("PERSON", PERSON), " (DOB: ", ("DATE", BORN), ")\nPolicy: ", ("POLICY_NUMBER", POLICY), "\nLogged at ", ("ISO_DATETIME", STAMP), " by the system. Number overseas: ", ("PHONE_INTL", ABROAD), ", at home ", ("AU_PHONE", MOBILE), ".\nMail: ", ("EMAIL_ADDRESS", EMAIL), ".\nSSN ", ("US_SSN", SSN), " is on file."],
    ["Payment of ", ("PERSON", PERSON), "\nPolicy: ", ("POLICY_NUMBER", POLICY), "\nCard on file: ", ("CREDIT_CARD_NUMBER", CARD), ", charged ", ("ISO_DATETIME", STAMP), ".\nNext due on ", ("DATE", DAY), " at ", ("TIME", CLOCK), ".\nCall ", ("AU_PHONE", LANDLINE), " or write to ", ("EMAIL_ADDRESS", EMAIL), "."],
    ["Claim of a traveller\nInsured: ", ("PERSON", PERSON), "\nClaim Reference: ", ("INSURANCE_CLAIM_NUMBER", CLAIM), "\nIt happened on ", ("DATE", DAY), " at ", ("TIME", CLOCK), ", when the insured could be rung on ", ("PHONE_INTL", ABROAD), ". The hospital asked for SSN: ", ("US_SSN", SSN), " and took the card ", ("CREDIT_CARD_NUMBER", CARD), "."],
]

LENGTH = max(map(len, TEMPLATES))


def _raw(words: str) -> str:
    return "concat(" + ", chr(10), ".join("'" + w.replace("'", "''") + "'" for w in words.split("\n")) + ")"


def _piece(i: int) -> str:
    arms = " ".join(f"when {t} then {_raw(x) if isinstance(x, str) else x[1]}" for t, row in enumerate(TEMPLATES) if i < len(row) for x in [row[i]])
    return f"case k % {len(TEMPLATES)} {arms} else '' end"


def _label(i: int) -> str:
    arms = " ".join(f"when {t} then '{row[i][0]}'" for t, row in enumerate(TEMPLATES) if i < len(row) and not isinstance(row[i], str))
    return f"case k % {len(TEMPLATES)} {arms} end" if arms else "cast(null as string)"


def _pieces(row: list[str | tuple[str, str]]) -> str:
    """A template's pieces as an array of (said, label)."""
    each = ", ".join(f"named_struct('said', {_raw(x)}, 'label', cast(null as string))" if isinstance(x, str) else f"named_struct('said', {x[1]}, 'label', '{x[0]}')" for x in row)
    return f"array({each})"


def _made() -> Column:
    """The pieces of key k's own template."""
    arms = " ".join(f"when {t} then {_pieces(row)}" for t, row in enumerate(TEMPLATES))
    return F.expr(f"coalesce(case k % {len(TEMPLATES)} {arms} end, cast(array() as array<struct<said:string,label:string>>))")


def in_pieces(keys: DataFrame, key: str) -> DataFrame:
    """(doc_id, pieces) of each key: labelled()'s texts for those who put them together themselves."""
    return keys.select(F.col(key).alias("k")).select(F.col("k").alias("doc_id"), _made().alias("pieces"))


def labelled(keys: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, spans: array of (start, end, label)) of each key: the text and where its personal data stands. One
    projection, nothing is shuffled; null and negative keys of no template give empty texts without spans.

    Only the pieces of the key's own template are made, each once: one fold over them gives both text and spans."""
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")

    def step(acc: Column, x: Column) -> Column:
        end = acc.at + F.char_length(x.said)
        span = F.struct(acc.at.alias("start"), end.alias("end"), x.label.alias("label"))
        return F.struct(end.alias("at"), F.concat(acc.text, x.said).alias("text"), F.when(x.label.isNull(), acc.spans).otherwise(F.concat(acc.spans, F.array(span))).alias("spans"))

    folded = F.aggregate(_made(), F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), none.alias("spans")), step)
    # exploded, as a column that two others refer to may be worked out for each
    return keys.select(F.col(key).alias("k")).select(F.col("k").alias("doc_id"), F.inline(F.array(folded))).select("doc_id", "text", "spans")


def gold_sql(source: str) -> str:
    """CTEs gold (doc_id, text) and gold_spans (doc_id, start, end, label), of {source} (k)."""
    names = [f"p{i}" for i in range(LENGTH)]
    starts = [" + ".join(f"length(p{j})" for j in range(i)) or "0" for i in range(LENGTH)]
    spans = " UNION ALL ".join(f"SELECT k AS doc_id, {starts[i]} AS s, {starts[i]} + length(p{i}) AS e, {_label(i)} AS label FROM pieces" for i in range(LENGTH) if "when" in _label(i))
    return f"""pieces AS MATERIALIZED (SELECT k, {', '.join(f'{_piece(i)} AS p{i}' for i in range(LENGTH))} FROM ({source})),
gold AS (SELECT k AS doc_id, {' || '.join(names)} AS text FROM pieces),
gold_spans AS (SELECT * FROM ({spans}) WHERE label IS NOT NULL)"""


def categories(spans: DataFrame, kind: str, table: dict[str, str]) -> DataFrame:
    """Spans with `label`, the category of their type, and each once more under ANY."""
    named = F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col(kind)]
    both = F.filter(F.array(named, F.lit("ANY")), lambda x: x.isNotNull())
    return spans.select("doc_id", "start", "end", F.explode(both).alias("label"))


def category_case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def scores(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of entities against labelled()'s spans, by category and ANY."""
    gold = texts.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")
    return report.char_scores(categories(gold, "label", GOLD_CATEGORY), categories(entities, "entity_type", FOUND_CATEGORY))


def errors(texts: DataFrame, entities: DataFrame, longest: int | None = 5) -> DataFrame:
    """The longest runs of characters that are found and aren't gold (fp) or are gold and aren't found (fn), by category."""
    gold = texts.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")
    return report.error_runs(categories(gold, "label", GOLD_CATEGORY), categories(entities, "entity_type", FOUND_CATEGORY), longest=longest)


# --- the same where the texts are made: each text is detected and scored within one pass, and only counts leave it ---
Spans = list[tuple[int, int]]
#: Texts whose candidates are held at once.
SLICE = 10_000


def merged(spans: Iterable[tuple[int, int]]) -> Spans:
    """The characters of spans as runs that don't touch."""
    out: Spans = []
    for a, b in sorted(spans):
        if b <= a:
            continue
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def less(these: Spans, those: Spans) -> Spans:
    """The runs of characters of these that aren't of those; both merged()."""
    out, i = [], 0
    for a, b in these:
        while i < len(those) and those[i][1] <= a:
            i += 1
        j = i
        while j < len(those) and those[j][0] < b:
            if those[j][0] > a:
                out.append((a, those[j][0]))
            a = those[j][1]
            j += 1
        if a < b:
            out.append((a, b))
    return out


def _sorted_out(spans: Iterable[tuple[str, int, int]], table: dict[str, str]) -> dict[str, Spans]:
    """Merged spans by category, and all of them under ANY."""
    by: dict[str, Spans] = {}
    for kind, a, b in spans:
        if b > a:
            by.setdefault("ANY", []).append((a, b))
            if kind in table:
                by.setdefault(table[kind], []).append((a, b))
    return {label: merged(x) for label, x in by.items()}


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(cleaned text, gold spans) of a batch of labelled() or in_pieces()."""
    if "pieces" in batch.schema.names:
        pieces = batch.column("pieces")
        said, labels, k = *(pieces.flatten().field(c).to_pylist() for c in ("said", "label")), 0
        for n in pieces.value_lengths().to_pylist():
            own, spans, at = said[k : k + n], [], 0
            for words, label in zip(own, labels[k : k + n]):
                end = at + len(words)
                if label is not None:
                    spans.append((label, at, end))
                at = end
            k += n
            yield clean("".join(own)), spans
        return
    spans = batch.column("spans")
    each, ends = spans.flatten(), spans.value_lengths().to_pylist()  # of the slice alone
    flat = list(zip(*(each.field(c).to_pylist() for c in ("label", "start", "end"))))
    at = 0
    for text, n in zip(batch.column("text").to_pylist(), ends):
        yield clean(text or ""), flat[at : at + (n or 0)]
        at += n or 0


def _compared(batches: Iterable[pa.RecordBatch], model: tagger.Model | None) -> Iterator[tuple[int, int, dict[str, Spans], dict[str, Spans], pa.RecordBatch]]:
    """(row, 0 for scans alone or 1 with the tagger, gold by category, found by category, batch)."""
    scanner, memo = whole.scanner(), {}
    gc.disable()  # a batch's candidates are many and hold no cycles
    try:
        yield from _each(scanner, memo, batches, model)
    finally:
        gc.enable()


def _each(scanner: whole.Scanner, memo: dict, batches: Iterable[pa.RecordBatch], model: tagger.Model | None) -> Iterator[tuple[int, int, dict[str, Spans], dict[str, Spans], pa.RecordBatch]]:
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        rows = list(_rows(batch))
        for i, ((text, spans), found) in enumerate(zip(rows, scanner.candidates([t for t, _ in rows]))):
            gold = _sorted_out(spans, GOLD_CATEGORY)
            alone = _sorted_out(scanner.entities(text, found), FOUND_CATEGORY)
            yield i, 0, gold, alone, batch
            if model is not None:
                more = whole.persons(scanner, text, tagger.spans(model, text, memo))
                yield i, 1, gold, _sorted_out(scanner.entities(text, found + more), FOUND_CATEGORY) if more else alone, batch


def counted(texts: DataFrame, model: tagger.Model | None = None) -> DataFrame:
    """(tagged 0 or 1, label, tp, fp, fn) of characters, a few rows a task: what detect() finds in labelled() or in_pieces() texts, and with
    a model of PERSON what it finds with the tagger's spans as extra. Texts count once each, so keys mustn't repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], list[int]] = {}
        size = lambda x: sum(b - a for a, b in x)
        for _, tagged, gold, found, _ in _compared(batches, model):
            for label in gold.keys() | found.keys():
                g, f = gold.get(label, []), found.get(label, [])
                total = sums.setdefault((tagged, label), [0, 0, 0])
                fp = 0 if g == f else size(less(f, g))
                tp = size(f) - fp
                total[0] += tp
                total[1] += fp
                total[2] += size(g) - tp
        rows = [(*k, *v) for k, v in sums.items()]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["tagged", "label", "tp", "fp", "fn"])

    return texts.mapInArrow(run, "tagged int, label string, tp long, fp long, fn long")


def scores_found(texts: DataFrame) -> DataFrame:
    """scores() of what detect() finds in labelled() or in_pieces() texts of unique keys."""
    return report.rated(counted(texts).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def scores_tagged(texts: DataFrame, model: tagger.Model) -> DataFrame:
    """(label, tp, fp, fn, f1 of scans, the same tagged) of what detect() finds without and with a tagger's spans."""
    sides = {"scans": 0, "tagged": 1}
    of = counted(texts, model).groupBy("label").agg(*[F.sum(F.when(F.col("tagged") == i, F.col(c))).alias(f"{c}_{name}") for name, i in sides.items() for c in ("tp", "fp", "fn")])
    rated = of
    for name in sides:
        one = report.rates(*(F.col(f"{c}_{name}") for c in ("tp", "fp", "fn")))["f1"]
        rated = rated.withColumn(f"f1_{name}", F.when(F.col(f"tp_{name}").isNotNull(), one))
    return rated.select("label", *[f"{c}_{name}" for name in sides for c in ("tp", "fp", "fn", "f1")])


def errors_found(texts: DataFrame, longest: int = 5) -> DataFrame:
    """errors() of what detect() finds in labelled() or in_pieces() texts of unique keys: each task passes on its `longest` of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], list[tuple[int, int, int, int]]] = {}
        for i, _, gold, found, batch in _compared(batches, None):
            if gold == found:
                continue
            for label in gold.keys() | found.keys():
                g, f = gold.get(label, []), found.get(label, [])
                for kind, runs in (("fp", less(f, g)), ("fn", less(g, f))):
                    if runs:
                        mine, key = best.setdefault((label, kind), []), batch.column("doc_id")[i].as_py()
                        mine += [(a - b, key, a, b) for a, b in runs]
                        if len(mine) > 1000:
                            mine[:] = heapq.nsmallest(longest, mine)
        rows = [(*k, key, a, b) for k, runs in best.items() for _, key, a, b in heapq.nsmallest(longest, runs)]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["label", "kind", "doc_id", "start", "end"])

    some = texts.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "label string, kind string, doc_id long, start int, end int")
    return report.longest_runs(some.withColumn("length", F.col("end") - F.col("start")), longest)


assert all(re.fullmatch(r"[A-Z_]+", x[0]) and x[0] in GOLD_CATEGORY for row in TEMPLATES for x in row if not isinstance(x, str))
