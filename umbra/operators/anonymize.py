"""Anonymisation: entities to rewritten texts.

Entities are shuffled once, by row: a sweep finds clusters of those that overlap, each cluster's entities become
replacement items, and an overlap fold picks among them. The join of items to texts is the only shuffle of texts; a splice
writes the items in.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import catalog as C
from umbra.functions.spans import let

AS_OF = datetime.date(2024, 1, 1)
ITEM = "array<struct<entity_type:string,start:int,end:int,original:string,replacement:string,operator:string>>"
Operator = str | Callable[[Column], Column]
#: Kept items that lie behind are gathered by so many; characters of a long text's pieces.
FULL, PIECE = 256, 4096


def age(text: Column, as_of: datetime.date = AS_OF) -> Column:
    """Whole years since the date in the text (d/m/y, y/m/d, d/m/yy), or the number after "Age:"; null without either."""
    today = F.lit(as_of.isoformat()).cast("date")

    def years(rx: str, y: int, m: int, d: int) -> Column:
        part = lambda g: F.regexp_extract(text, rx, g).cast("int")
        year = F.when(part(y) < 30, part(y) + 2000).when(part(y) < 100, part(y) + 1900).otherwise(part(y))
        born = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(m).cast("string"), 2, "0"), F.lpad(part(d).cast("string"), 2, "0")), "yyyy-MM-dd")
        return F.when(text.rlike(rx) & (year > 0), F.year(today) - F.year(born) - F.when(F.struct(F.month(today), F.dayofmonth(today)) < F.struct(F.month(born), F.dayofmonth(born)), 1).otherwise(0))

    four, first, two = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{2})"
    said = F.regexp_extract(text, r"Age:\s*(\d{1,9})", 1)
    return F.coalesce(years(four, 3, 2, 1), years(first, 1, 2, 3), years(two, 3, 2, 1), F.when(said != "", said.cast("int")))


def replacement(kind: Column, original: Column, operator: str, bracket: int = 5, as_of: datetime.date = AS_OF) -> Column:
    """What a span becomes. Operators that aren't known replace."""
    tag = F.concat(F.lit("<"), kind, F.lit(">"))
    if operator == "mask":
        return F.repeat(F.lit("*"), F.char_length(original))
    if operator == "redact":
        return F.lit("[REDACTED]")
    if operator == "hash":
        return F.concat(F.lit("HASH-"), F.substring(F.sha2(original, 256), 1, 10))
    if operator == "age_bracket":
        size = bracket if isinstance(bracket, int) and bracket > 0 else 5
        low = (F.floor(age(original, as_of) / size) * size).cast("int")
        return F.when((kind == "DATE_OF_BIRTH") & low.isNotNull(), F.concat_ws("-", low.cast("string"), (low + size - 1).cast("string"))).otherwise(tag)
    return tag


def replaced(kind: Column, original: Column, operators: dict[str, Operator], bracket: int = 5, as_of: datetime.date = AS_OF) -> tuple[Column, Column]:
    """Replacement and operator name, chosen by type; a callable makes a Column of the original's Column."""
    out, name = None, None
    for t, op in operators.items():
        new = op(original) if callable(op) else replacement(kind, original, op, bracket, as_of)
        label = F.lit("custom" if callable(op) else op)
        out = F.when(kind == t, new) if out is None else out.when(kind == t, new)
        name = F.when(kind == t, label) if name is None else name.when(kind == t, label)
    tag = replacement(kind, original, "replace")
    return (tag, F.lit("replace")) if out is None else (out.otherwise(tag), name.otherwise("replace"))


def items_of(entities: Column, operators: dict[str, Operator], bracket: int = 5, keep_postcode: bool = True, as_of: datetime.date = AS_OF) -> Column:
    """An array of entities as an array of replacement items."""
    codes = F.filter(entities, lambda e: e.entity_type == "AU_POSTCODE")
    homes = F.filter(entities, lambda e: e.entity_type == "AU_ADDRESS")

    def item(e: Column) -> Column:
        new, name = replaced(e.entity_type, e.text, operators, bracket, as_of)
        if keep_postcode:
            own = F.array_sort(F.filter(codes, lambda c: (c.start >= e.start) & (c.end <= e.end)), lambda a, b: b.start - a.start)
            kept = F.aggregate(own, new, lambda acc, c: F.concat(F.substring(acc, F.lit(1), c.start - e.start), F.lit(" "), c.text, F.lit(" "), F.substring(acc, c.end - e.start + 1, F.char_length(acc))))
            new = F.when(e.entity_type == "AU_ADDRESS", kept).otherwise(new)
        return F.struct(e.entity_type.alias("entity_type"), e.start.alias("start"), e.end.alias("end"), e.text.alias("original"), new.alias("replacement"), name.alias("operator"))

    shown = F.filter(entities, lambda e: ~((e.entity_type == "AU_POSTCODE") & F.exists(homes, lambda a: (a.start <= e.start) & (e.end <= a.end)))) if keep_postcode else entities
    return F.transform(shown, item)


def folded(items: Column, priority: dict[str, int] | None = None) -> Column:
    """Items without overlaps: in order of start, longest first, each against the first kept one that it overlaps.

    Kept items that end before the next one starts can't be met again; they leave the few that each item is compared
    with, in pieces of FULL, so that a step copies no long array."""
    ranks = F.create_map(*[x for t, p in {**C.PRIORITY, **(priority or {})}.items() for x in (F.lit(t), F.lit(p))])
    rank = lambda e: F.coalesce(ranks[e.entity_type], F.lit(0))
    ordered = F.array_sort(items, lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(b.end - a.end))
    none = F.array().cast(ITEM)

    def against(open_: Column, e: Column, met: Column) -> Column:
        better = ((rank(e) > rank(met)) & ~((e.start >= met.start) & (e.end <= met.end))) | ((rank(e) == rank(met)) & (e.end - e.start > met.end - met.start))
        others = F.filter(open_, lambda k: ~((k.start == met.start) & (k.end == met.end) & (k.entity_type == met.entity_type)))
        return F.when(met.isNull(), F.concat(open_, F.array(e))).when(better, F.concat(others, F.array(e))).otherwise(open_)

    def step(acc: Column, e: Column) -> Column:
        gone = F.filter(acc.open, lambda k: k.end <= e.start)
        left = F.filter(acc.open, lambda k: k.end > e.start)
        now = let(left, lambda o: let(F.get(F.filter(o, lambda k: (e.start < k.end) & (e.end > k.start)), F.lit(0)), lambda met: against(o, e, met)))
        whole = F.size(acc.part) >= FULL
        return F.struct(F.when(whole, F.concat(acc.full, F.array(acc.part))).otherwise(acc.full).alias("full"), F.concat(F.when(whole, none).otherwise(acc.part), gone).alias("part"), now.alias("open"))

    zero = F.struct(F.array().cast(f"array<{ITEM}>").alias("full"), none.alias("part"), none.alias("open"))
    return F.aggregate(ordered, zero, step, lambda acc: F.concat(F.flatten(acc.full), acc.part, acc.open))


def _cut(pieces: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text given in pieces of PIECE characters."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    some = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    within = F.substring(some(i), a - i * PIECE + 1, b - a)
    across = F.concat(F.substring(some(i), a - i * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(some(j), F.lit(1), b - j * PIECE))
    return F.when(i == j, within).otherwise(across)


def spliced(text: Column, items: Column) -> Column:
    """The text with items (last first) written in: pieces joined once, or one item after the other where items overlap.
    A long text is cut into pieces first, since finding a character of a text means counting from its beginning."""

    def joined(first: Column, cut) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(first, i - 1).end)
        parts = F.transform(first, lambda e, i: F.concat(cut(before(i), e.start), e.replacement))
        return F.concat(F.array_join(parts, ""), cut(F.element_at(first, -1).end, F.char_length(text)))

    ordered = lambda cut: let(F.reverse(items), lambda first: joined(first, cut))
    short = ordered(lambda a, b: F.substring(text, a + 1, b - a))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / PIECE).cast("int")), lambda j: F.substring(text, j * PIECE + 1, F.lit(PIECE)))
    long = let(pieces, lambda p: ordered(lambda a, b: _cut(p, a, b)))
    overlap = let(items, lambda x: F.exists(F.transform(x, lambda e, i: e.end > F.coalesce(F.get(x, i - 1).start, e.end)), lambda o: o))
    one_by_one = F.aggregate(items, text, lambda acc, e: F.concat(F.substring(acc, F.lit(1), e.start), e.replacement, F.substring(acc, e.end + 1, F.char_length(acc))))
    return F.when(F.size(items) == 0, text).when(overlap, one_by_one).when(F.char_length(text) <= PIECE, short).otherwise(long)


def clustered(entities: DataFrame, of: list[str]) -> DataFrame:
    """Entities with `cluster`: those of a row that overlap, directly or through others, or have one place share a number. A
    sweep by start with the running maximum of ends; all windows and groups after it share one shuffle, or none where
    entities are already dealt by the row."""
    whole = Window.partitionBy(*of).orderBy("start", F.desc("end"))
    reach = F.max("end").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    here = (F.lag("start").over(whole) == F.col("start")) & (F.lag("end").over(whole) == F.col("end"))
    new = entities.withColumn("__new", F.when((F.col("start") < reach) | here, 0).otherwise(1))
    return new.withColumn("cluster", F.sum("__new").over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def anonymize(docs: DataFrame, entities: DataFrame, operators: dict[str, Operator] | None = None, key: str = "doc_id", text: str = "text", bracket: int = 5, keep_postcode: bool = True, priority: dict[str, int] | None = None, as_of: datetime.date = AS_OF, unique: bool = False, sized: bool = False) -> DataFrame:
    """docs' rows as (key, text rewritten, items by descending start); with sized also original_length. A null text stays
    null, without items.

    Keys may be null or repeat: entities go to the rows of their key that have the text of their text_hash, which detect()
    gives. Entities without text_hash are an error unless `unique` says that no key is null or repeats; then they go by
    key alone. Rows alike in key and text come out alike. Other columns are ignored; empty tables give no rows.

    Postcodes, overlaps and replacements are settled within clusters of overlapping entities, so no step's work grows
    with the square of a row's entities unless all of them overlap.
    """
    exact = "text_hash" in entities.columns
    if not exact and not unique:
        raise ValueError("Entities need text_hash, as detect() gives it; without it keys must be unique: say so with unique=True.")
    of = ["__of", "__of_hash"] if exact else ["__of"]
    own = entities.select(F.col(key).alias("__of"), *([F.col("text_hash").alias("__of_hash")] if exact else []), "start", "end", "entity_type", "text", "score")
    each = clustered(own, of).groupBy(*of, "cluster").agg(F.array_sort(F.collect_set(F.struct("start", "end", "entity_type", "text", "score"))).alias("__entities"))
    descending = lambda x: F.when(F.size(x) <= 1, x).otherwise(F.array_sort(folded(x, priority), lambda a, b: b.start - a.start))
    kept = each.select(*of, "cluster", let(items_of(F.col("__entities"), operators or {}, bracket, keep_postcode, as_of), descending).alias("items"))
    last_first = F.sort_array(F.collect_list(F.struct("cluster", "items")), asc=False)
    grouped = kept.groupBy(*of).agg(F.flatten(F.transform(last_first, lambda c: c["items"])).alias("__items"))
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.col(text).alias("__said"), F.xxhash64(said).alias("__hash"))
    if exact:
        same = F.col(key).eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__of_hash"))
    else:  # plain equality leaves rows where they are if they are dealt by key
        same = F.col(key) == F.col("__of")
        rows = rows.where(F.col(key).isNotNull() | F.raise_error(F.lit("unique=True, but a key is null")).cast("boolean"))
    joined = rows.join(grouped, same, "left")
    out = joined.select(key, "__said", F.when(F.col("__said").isNotNull(), F.coalesce("__items", F.array().cast(ITEM))).otherwise(F.array().cast(ITEM)).alias("items"))
    size = [F.char_length(F.coalesce("__said", F.lit(""))).cast("bigint").alias("original_length")] if sized else []
    return out.select(key, spliced(F.col("__said"), F.col("items")).alias(text), "items", *size)
