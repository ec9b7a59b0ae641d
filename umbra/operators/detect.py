"""Detection: texts to typed, scored spans.

docs -> candidate spans of every scan (one narrow pass, no text carried on) -> arbitration between candidates of one
span -> absorption of spans inside wider ones -> context filter and boost. Only candidates are shuffled, once, by
row: the windows over a span and over a row's winners share that partitioning.

A row is told from others by its key, two hashes of its text and the partition it was scanned in, so keys may be null or
repeat: rows that share a key never see each other's spans. Rows alike in key and text are found alike and each gives its
entities; many such rows are dealt by the partitions they were scanned in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import catalog as C
from umbra.functions import validators as V
from umbra.functions.catalog import Catalogue
from umbra.functions.spans import candidates, clean, let

#: The year that date checks count from unless a caller says otherwise.
AS_OF_YEAR = 2024
#: Scans up to which they run inside the plan.
FEW = 16
ENTITIES = ["entity_type", "start", "end", "text", "score"]
#: What tells a row of documents from others beside its key.
IDENTITY = ["__hash", "__hash2", "__part"]


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, IDENTITY) of every row; a null text counts as empty."""
    said = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), F.col(text), F.xxhash64(said).alias("__hash"), F.xxhash64(F.lit(1), said).alias("__hash2"), F.spark_partition_id().alias("__part"))


def _any(column: Column, patterns: list[str]) -> Column:
    return column.rlike("(?iUd)" + "|".join(f"(?:{p})" for p in patterns))


def _by_type(entity_type: Column, table: dict[str, list[str]], test) -> Column:
    out = None
    for kind, values in table.items():
        out = F.when(entity_type == kind, test(values)) if out is None else out.when(entity_type == kind, test(values))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def stripped(text: Column) -> Column:
    """Lower case without white space of any kind at either end."""
    return F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")


def false_person(text: Column) -> Column:
    """Span texts that read like a person's name but aren't one."""
    low, up = stripped(text), F.upper(text)
    first = F.regexp_extract(low, r"(?U)^(\S+)", 1)
    return (
        low.startswith("policy") | low.startswith("ref") | low.startswith("claim")
        | up.startswith("POL-") | up.startswith("CL-") | up.startswith("CLM-")
        | F.contains(low, F.lit("number"))
        | low.rlike(f"({'|'.join(C.STREET_SUFFIXES)})$")
        | low.isin("medicare", *C.CITIES, *C.PERSON_ACRONYMS)
        | low.rlike(f"(?Ud){C.DATE_SHAPE}")
        | text.rlike(f"(?Ud){C.STATE_POSTCODE}")
        | (text.rlike(r"(?U)^\d") & F.contains(text, F.lit(" ")))
        | first.isin(*C.PERSON_LABELS)
    )


def scanned(docs: DataFrame, catalogue: Catalogue, key: str = "doc_id", text: str = "text", active: set[str] | None = None, threshold: float = C.THRESHOLD, adjust: dict[str, float] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, ordinal, entity_type, score, start, end, text, before, after) of every candidate, before arbitration."""
    scans = catalogue.scans(active, threshold, adjust)
    rows = docs.select(F.col(key), *carry, clean(F.col(text)).alias("__text"))
    found = candidates(F.col("__text"), F.col("__text").rlike(r"\p{Nd}"), scans)
    window = lambda x: F.transform(x, lambda c: F.struct(c.ordinal.alias("ordinal"), c.entity_type.alias("entity_type"), c.score.alias("score"), c.start.alias("start"), c.end.alias("end"), F.substring(F.col("__text"), c.start + 1, c.end - c.start).alias("text"), F.substring(F.col("__text"), F.greatest(c.start - C.CONTEXT_WINDOW, F.lit(0)) + 1, F.least(c.start, F.lit(C.CONTEXT_WINDOW))).alias("before"), F.substring(F.col("__text"), c.end + 1, F.lit(C.CONTEXT_WINDOW)).alias("after")))
    out = rows.select(key, *carry, F.explode(window(found)).alias("c")).select(key, *carry, "c.*")
    low = F.lower("text")
    skip = low.isin(*C.LABEL_TEXTS) | ((F.col("entity_type") == "PERSON") & (F.contains(low, F.lit("number")) | low.rlike("^(ref|policy|claim)")))
    catalogued = F.col("ordinal") < sum(len(d.patterns) for d in catalogue.definitions)
    return out.where(~(catalogued & skip))


def _labelled(kind: Column, before: Column) -> Column:
    near = F.substring(before, F.greatest(F.char_length(before) - C.LABEL_WINDOW, F.lit(0)) + 1, F.lit(C.LABEL_WINDOW))
    return _by_type(kind, {k: [v] for k, v in C.LABEL_BEFORE.items()}, lambda v: _any(near, v))


def arbitrated(found: DataFrame, catalogue: Catalogue, by: list[str], as_of_year: int = AS_OF_YEAR, strict_suffix: bool = True) -> DataFrame:
    """One winner at most for each span of a row (what `by` tells apart), with __copies, how many rows alike gave it.

    A lone candidate stays unless it is a false person. Of several: a span that ends like a label goes (strict_suffix);
    date shapes are no organisations or places; a false person gives way to the first other candidate; an explicit label
    before the span decides; else the candidate of highest priority that is valid. Winners must be valid or labelled.
    """
    kinds = F.create_map(*[x for t in sorted({*catalogue.types(), *C.PRIORITY}) for x in (F.lit(t), F.lit(catalogue.effective(t)))])
    span = Window.partitionBy(*by, "start", "end")
    alike = Window.partitionBy(*by, "start", "end", "ordinal")
    text = F.col("text")
    rows = found.withColumns({"__copies": F.count("*").over(alike), "__copy": F.row_number().over(alike.orderBy("ordinal"))}).where("__copy = 1").drop("__copy")
    # the many regexes in lambdas: written out in one stage they make a method too long for the JVM to compile
    valid = let(F.struct("entity_type", "text"), lambda x: V.valid(x.entity_type, x.text, as_of_year))
    labelled = let(F.struct("entity_type", "before"), lambda x: _labelled(x.entity_type, x.before))
    rows = rows.withColumns({"many": F.count("*").over(span) > 1, "fp": (F.col("entity_type") == "PERSON") & let(text, false_person), "ok": valid, "label": labelled, "rank": F.coalesce(kinds[F.col("entity_type")], F.lit(float(C.UNLISTED_PRIORITY))) + F.col("score")})
    if strict_suffix:
        rows = rows.where(~(F.col("many") & F.lower("text").rlike(f"({'|'.join(C.LABEL_SUFFIXES)})$")))
    rows = rows.where(~(F.col("many") & F.col("entity_type").isin("ORGANIZATION", "LOCATION") & text.rlike(f"(?Ud){C.DATE_SHAPE}")))
    rows = rows.withColumns({"person": F.max("fp").over(span), "named": F.max("label").over(span)})
    person = F.col("entity_type") == "PERSON"
    fits = F.when(~F.col("many"), ~(person & F.col("fp"))).when(F.col("person"), ~person).when(F.col("named"), F.col("label")).otherwise(F.col("ok"))
    order = span.orderBy(F.when(F.col("person"), 0.0).otherwise(-F.col("rank")), "ordinal")
    first = rows.where(fits).withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.where(F.col("ok") | F.col("label")).select(*by, "ordinal", "entity_type", "start", "end", "text", "score", "before", "after", "__copies")


def absorbed(winners: DataFrame, by: list[str]) -> DataFrame:
    """Winners without those inside a wider winner of a trusted type and no lower priority.

    A sweep over a row's winners by start, the wider first: whatever holds a span comes before it, so a running maximum
    of ends, one for each priority that containers have, says whether any does. One sort, no array of a row's winners.
    """
    base = F.create_map(*[x for t, p in C.PRIORITY.items() for x in (F.lit(t), F.lit(p))])
    priority = F.coalesce(base[F.col("entity_type")], F.lit(C.UNLISTED_PRIORITY))
    levels = sorted({C.PRIORITY.get(t, C.UNLISTED_PRIORITY) for t in C.CONTAINERS})
    earlier = Window.partitionBy(*by).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    wide = F.col("entity_type").isin(*C.CONTAINERS)
    reach = {f"__reach{i}": F.max(F.when(wide & (priority >= p), F.col("end"))).over(earlier) for i, p in enumerate(levels)}
    rows = winners.withColumns(reach)
    least = None  # of the levels that may hold a span of this priority, the lowest one counts them all
    for i, p in enumerate(levels):
        least = F.when(priority <= p, F.col(f"__reach{i}")) if least is None else least.when(priority <= p, F.col(f"__reach{i}"))
    inside = F.coalesce(least >= F.col("end"), F.lit(False))
    return rows.where(F.col("entity_type").isin(*C.NEVER_ABSORBED) | ~inside).select(*winners.columns)


def _refuted(kind: Column, text: Column, before: Column) -> Column:
    near = stripped(F.substring(before, F.greatest(F.char_length(before) - C.FALSE_WINDOW, F.lit(0)) + 1, F.lit(C.FALSE_WINDOW)))
    return _by_type(kind, C.CONTEXT_FALSE, lambda v: _any(near, v)) | ((kind == "DATE") & text.isin("NSW 2000", "VIC 3000", "QLD 4000")) | ((kind == "NUMBER") & (text == "#"))


def _boost(kind: Column, text: Column, before: Column, after: Column) -> Column:
    """What the context adds to a score; before and after are stripped."""
    whole = F.concat_ws(" ", before, text, after)
    shaped = _by_type(kind, C.CONTEXT_BEFORE, lambda v: _any(before, v)) | _by_type(kind, C.CONTEXT_AFTER, lambda v: _any(after, v)) | _by_type(kind, C.CONTEXT_WITHIN, lambda v: _any(whole, v))
    worded = _by_type(kind, C.CONTEXT_WORDS, lambda v: F.array_contains(F.array(*[F.contains(before, F.lit(w)) | F.contains(after, F.lit(w)) for w in v]), True))
    return F.when(shaped, C.PATTERN_BOOST).otherwise(0.0) + F.when(worded, C.WORD_BOOST).otherwise(0.0)


def in_context(winners: DataFrame) -> DataFrame:
    """Winners that what stands before them doesn't refute, with their score raised where the context speaks for them.

    The regexes stand in lambdas, as in arbitrated()."""
    told = sorted({*C.CONTEXT_BEFORE, *C.CONTEXT_AFTER, *C.CONTEXT_WITHIN, *C.CONTEXT_WORDS})
    false = let(F.struct("entity_type", "text", "before"), lambda x: _refuted(x.entity_type, x.text, x.before))
    near = F.struct("entity_type", "text", stripped(F.col("before")).alias("before"), stripped(F.col("after")).alias("after"))
    boost = F.when(F.col("entity_type").isin(*told), let(near, lambda x: _boost(x.entity_type, x.text, x.before, x.after))).otherwise(0.0)
    return winners.where(~false).withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + boost), 4))


def suggested(entities: DataFrame) -> DataFrame:
    """The entities with the type that their context speaks for most, null where it speaks for none."""
    before, after = stripped(F.col("before")), stripped(F.col("after"))
    both = F.concat_ws(" ", before, after)
    votes = []
    for kind, patterns in C.CONTEXT_BEFORE.items():
        score = F.when(_any(before, patterns), 2).otherwise(0)
        for w in C.CONTEXT_WORDS.get(kind, []):
            score = score + F.contains(both, F.lit(w)).cast("int")
        votes.append(F.struct(score.alias("score"), F.lit(-len(votes)).alias("turn"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*votes))
    return entities.withColumn("suggested", F.when(best.score > 0, best.kind))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", catalogue: Catalogue | None = None, active: set[str] | None = None, threshold: float = C.THRESHOLD, adjust: dict[str, float] | None = None, as_of_year: int = AS_OF_YEAR, strict_suffix: bool = True, extra: DataFrame | None = None, engine: str = "auto", hashed: bool = True, acronyms: dict[str, str] | None = None, once: bool = False) -> DataFrame:
    """(key, entity_type, start, end, text, score, text_hash) of every entity; start and end count code points, end exclusive.

    Keys may be null or repeat (see above); a null text has no entities; rows alike in key and text each give theirs;
    other columns are ignored, whatever their names; an empty table gives no rows. text_hash (xxhash64 of the row's text)
    says which of several rows of one key an entity is of; without `hashed` it's left out.

    once: texts that repeat are scanned once for all their rows and their entities joined back by the text's two hashes
    (umbra.operators.repeats); the result is the same.

    acronyms are written out in the text before it is scanned, so places count in the written-out text (rewrite that, see
    umbra.operators.process).

    extra: candidates of another source, such as a named-entity model (umbra.operators.named cleans its spans), with scanned()'s columns; they are subject to
    active, adjust and threshold, and hold for those rows of their key whose text has theirs in its place, or with a column
    text_hash for those whose text has that hash (umbra.operators.tagger gives it). engine:
    "native" for Catalyst scans, "arrow" for Python's regexes over Arrow batches; "auto" takes the first for few scans, as
    it needs no Python worker, and the second for many or for patterns that the in-plan form can't take: it is the faster
    one then.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("Threshold must be between 0 and 1.0")
    catalogue = catalogue or Catalogue()
    if acronyms:
        from umbra.operators.text import expanded

        docs = docs.withColumn(text, expanded(F.col(text), acronyms).text)
    if once:
        from umbra.operators.repeats import detect_once

        if extra is not None:
            raise ValueError("Candidates of another source belong to rows, so texts can't be scanned once for all their rows.")
        return detect_once(docs, key, text, catalogue=catalogue, active=active, threshold=threshold, adjust=adjust, as_of_year=as_of_year, strict_suffix=strict_suffix, engine=engine, hashed=hashed)
    if engine == "auto":
        scans = catalogue.scans(active, threshold, adjust)
        engine = "native" if len(scans) <= FEW and all(C.terminal_group(s.regex) for s in scans) else "arrow"
    rows, carry = identified(docs, key, text), tuple(IDENTITY)
    if engine == "arrow":
        from umbra.operators.arrow import scanned as by_arrow

        found = by_arrow(rows, catalogue, key, text, active, threshold, adjust, carry)
    else:
        found = scanned(rows, catalogue, key, text, active, threshold, adjust, carry)
    if extra is not None:
        more = F.coalesce(F.create_map(*[F.lit(x) for p in adjust.items() for x in p])[F.col("entity_type")], F.lit(0.0)) if adjust else F.lit(0.0)
        given = extra.withColumn("score", F.least(F.lit(1.0), F.col("score") + more)).where(F.col("score") >= threshold)
        given = (given.where(F.col("entity_type").isin(*active)) if active else given).withColumnsRenamed({key: "__of", "text": "__span"})
        if "text_hash" in extra.columns:  # rows alike give the same candidates once, and no text is shuffled
            texts, given = rows.select(key, *carry), given.distinct()
            here = F.col(key).eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("text_hash"))
        else:
            texts, here = rows, F.col(key).eqNullSafe(F.col("__of")) & (F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("__span"))
        placed = texts.join(given, here).select(key, *carry, "ordinal", "entity_type", "score", "start", "end", F.col("__span").alias("text"), "before", "after")
        found = found.unionByName(placed)
    by = [key, *IDENTITY]
    dealt = found.repartition(*[F.col(c) for c in by])
    out = in_context(absorbed(arbitrated(dealt, catalogue, by, as_of_year, strict_suffix), by))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(key, *ENTITIES, *([F.col("__hash").alias("text_hash")] if hashed else []))
