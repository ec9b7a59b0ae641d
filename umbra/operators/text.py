"""Text operators: acronyms, segments, claim notes, structured values. All are expressions on one row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.spans import OPEN, SHUT, clean

# What a segment is judged by.
RICH: dict[str, str] = {
    "PHONE": r"\b(?:\+?61|0)[2378]\s*\d{4}\s*\d{4}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "DATE": r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b",
    "ADDRESS": r"\b\d+\s+[A-Za-z]+\s+(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr)\b",
    "POSTCODE": r"\b\d{4}\b",
    "NAME": r"\b(?:Mr|Ms|Mrs|Dr|Professor|Prof)\.\s+[A-Z][a-z]+\b",
    "TFN": r"\b\d{3}\s*\d{3}\s*\d{3}\b",
    "MEDICARE": r"\b\d{4}\s*\d{5}\s*\d{1}\b",
}
KEYWORDS = ["customer", "patient", "client", "insured", "member", "policy", "claim"]
SECTIONS: dict[str, str] = {
    "claim": r"(?:Claim\s+Details|Incident\s+Details|Accident\s+Details)",
    "customer": r"(?:Customer\s+Details|Insured\s+Details|Policyholder\s+Details)",
    "vehicle": r"(?:Vehicle\s+Details|Car\s+Details|Vehicle\s+Information)",
    "assessment": r"(?:Assessment|Evaluation|Inspection)",
    "actions": r"(?:Actions|Next\s+Steps|Follow-up)",
}
METADATA: dict[str, str] = {
    "claim_number": r"Claim\s+(?:Number|#|Reference):\s+([A-Z0-9-]+)",
    "policy_number": r"Policy\s+(?:Number|#):\s+([A-Z0-9-]+)",
    "customer_name": r"(?:Customer|Insured|Policyholder):\s+([A-Za-z\s]+)",
    "incident_date": r"(?:occurred|happened|date)(?:\s+on)?\s+(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})",
}
SEGMENT, OVERLAP, KEYWORD_SCORE, MATCH_SCORE = 300, 50, 0.3, 0.2
# End of fixed values.

#: Characters of a bucket that segments and entities meet by.
BUCKET = 512
EXPANSION = "array<struct<acronym:string,expansion:string,original_start:int,original_end:int,expanded_start:int,expanded_end:int>>"


def expanded(text: Column, acronyms: dict[str, str], case_sensitive: bool = False) -> Column:
    """struct<text, expansions>: whole-word acronyms replaced in one pass from left to right, the longest first."""
    none = F.struct(text.alias("text"), F.array().cast(EXPANSION).alias("expansions"))
    if not acronyms:
        return none
    words = sorted(acronyms, key=len, reverse=True)
    rx = ("(?Ud)" if case_sensitive else "(?Udiu)") + r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"
    fold = (lambda c: c) if case_sensitive else F.lower
    table = F.create_map(*[F.lit(x) for pair in ({w: w for w in words} if case_sensitive else {w.lower(): w for w in words}).items() for x in pair])
    meaning = F.create_map(*[F.lit(x) for w, e in acronyms.items() for x in (w, e)])
    parts = F.split(F.regexp_replace(clean(text), F.lit(rx), F.lit(f"{OPEN}$0{SHUT}")), OPEN)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.array().cast(EXPANSION).alias("list"))

    def step(acc: Column, part: Column) -> Column:
        said, rest = F.substring_index(part, SHUT, 1), F.substring_index(part, SHUT, -1)
        name = table[fold(said)]
        new, size, begun = meaning[name], F.char_length(said), F.char_length(acc.out)
        row = F.struct(name.alias("acronym"), new.alias("expansion"), acc["at"].alias("original_start"), (acc["at"] + size).alias("original_end"), begun.alias("expanded_start"), (begun + F.char_length(new)).alias("expanded_end"))
        grown = F.struct(F.concat(acc.out, new, rest).alias("out"), (acc["at"] + size + F.char_length(rest)).alias("at"), F.concat(acc["list"], F.array(row)).alias("list"))
        return F.when(F.contains(part, F.lit(SHUT)), grown).otherwise(F.struct(F.concat(acc.out, part).alias("out"), (acc["at"] + F.char_length(part)).alias("at"), acc["list"].alias("list")))

    return F.when(text.isNotNull(), F.aggregate(parts, zero, step, lambda acc: F.struct(acc.out.alias("text"), acc["list"].alias("expansions"))))


def segments(text: Column, most: int = SEGMENT, overlap: int = OVERLAP) -> Column:
    """array<struct<text, start, end>>: paragraphs packed up to `most` characters, each segment starting with the end of
    the one before. A short text is one segment as it stands; an empty or null one has none."""
    kind = "array<struct<text:string,start:int,end:int>>"
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    zero = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("now"), F.lit(0).alias("at"))
    closed = lambda acc: F.concat(acc.out, F.array(F.struct(strip(acc.now).alias("text"), acc.at.alias("start"), (acc.at + F.char_length(acc.now)).alias("end"))))

    def step(acc: Column, para: Column) -> Column:
        full = (F.char_length(acc.now) + F.char_length(para) > most) & (acc.now != "")
        cut = F.greatest(F.lit(0), F.char_length(acc.now) - overlap)
        opened = F.struct(closed(acc).alias("out"), F.concat(F.substring(acc.now, cut + 1, F.char_length(acc.now)), F.lit("\n\n"), para).alias("now"), (acc.at + cut).alias("at"))
        joined = F.struct(acc.out.alias("out"), F.when(acc.now != "", F.concat(acc.now, F.lit("\n\n"), para)).otherwise(para).alias("now"), acc.at.alias("at"))
        return F.when(full, opened).otherwise(joined)

    packed = F.aggregate(F.split(text, r"(?Ud)\n\s*\n"), zero, step, lambda acc: F.when(acc.now != "", closed(acc)).otherwise(acc.out))
    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("start"), F.char_length(text).alias("end")))
    return F.when(text.isNull() | (text == ""), F.array().cast(kind)).when(F.char_length(text) <= most, whole.cast(kind)).otherwise(packed)


def likelihood(text: Column) -> tuple[Column, Column]:
    """How likely a segment holds personal data, and the score of each kind found."""
    scores = F.map_filter(F.create_map(*[x for k, rx in RICH.items() for x in (F.lit(k), F.round(F.least(F.lit(1.0), F.regexp_count(text, F.lit(f"(?Ud){rx}")) * MATCH_SCORE), 4))]), lambda _, v: v > 0)
    best = F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))
    word = F.lower(text).rlike("|".join(KEYWORDS))
    return F.when(best > 0, best).when(word, KEYWORD_SCORE).otherwise(0.0), F.when((best == 0) & word, F.create_map(F.lit("CONTEXT"), F.lit(KEYWORD_SCORE))).otherwise(scores)


def segmented(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SEGMENT, overlap: int = OVERLAP) -> DataFrame:
    """(key, segment number, text, start, end, pii_likelihood, pii_scores, text_hash) of every segment; text_hash is the
    whole text's. Keys may be null or repeat; null and empty texts have no segments; rows alike each give theirs."""
    rows = docs.select(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.posexplode(segments(F.col(text), most, overlap)).alias("segment", "s"))
    rows = rows.select(key, "segment", F.col("s.text").alias("text"), "s.start", "s.end", "text_hash")
    rate, scores = likelihood(F.col("text"))
    return rows.select(key, "segment", "text", "start", "end", rate.alias("pii_likelihood"), scores.alias("pii_scores"), "text_hash")


def sectioned(parts: DataFrame) -> DataFrame:
    """Segments with the sections of a claim note that they name, one row a section."""
    named = F.filter(F.array(*[F.when(F.col("text").rlike(f"(?Udiu){rx}"), F.lit(k)) for k, rx in SECTIONS.items()]), lambda x: x.isNotNull())
    return parts.withColumn("section", F.explode(named))


def claim_metadata(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Claim and policy number, customer name and incident date of each text; null where it names none."""
    found = [F.nullif(F.regexp_extract(F.col(text), f"(?Udiu){rx}", 1), F.lit("")).alias(k) for k, rx in METADATA.items()]
    return docs.select(key, *found)


def incident(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The incident's description: the likeliest segment that a claim section heads, without the heading."""
    parts = sectioned(segmented(docs, key, text)).where("section = 'claim'")
    first = parts.groupBy(key).agg(F.min_by("text", F.struct(-F.col("pii_likelihood"), F.col("segment"))).alias("text"))
    head = F.regexp_replace(F.col("text"), r"(?Udisu)\A.*?(?:Details|Information):\s*", "")
    return first.select(key, F.regexp_replace(head, r"(?U)^\s+|\s+$", "").alias("incident_description"))


def by_segment(parts: DataFrame, entities: DataFrame, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """(key, segment, entity_type, start, end, text, score) of the entities inside each segment, with offsets that count
    from its start.

    A range join on row and bucket of offsets: an entity meets those segments of its own row (key and text_hash, of
    segmented() and detect()) that reach into the bucket where it starts. So null and repeated keys never mix texts, and a
    text of very many segments and entities is dealt by its buckets. Rows alike in key and text each give theirs."""
    spans = entities.select(F.col(key).alias("__of"), F.col("text_hash").alias("__of_hash"), "entity_type", F.col("start").alias("e_start"), F.col("end").alias("e_end"), F.col("text").alias("e_text"), "score").distinct()
    spans = spans.withColumn("__at", F.floor(F.col("e_start") / bucket).cast("int"))
    reach = F.sequence(F.floor(F.col("start") / bucket).cast("int"), F.floor(F.col("end") / bucket).cast("int"))
    rows = parts.select(key, "text_hash", "segment", "start", "end", F.explode(reach).alias("__bucket"))
    same = F.col(key).eqNullSafe(F.col("__of")) & (F.col("text_hash") == F.col("__of_hash")) & (F.col("__bucket") == F.col("__at"))
    inside = rows.join(spans, same & (F.col("e_start") >= F.col("start")) & (F.col("e_end") <= F.col("end")))
    return inside.select(key, "segment", "entity_type", (F.col("e_start") - F.col("start")).alias("start"), (F.col("e_end") - F.col("start")).alias("end"), F.col("e_text").alias("text"), "score")


def structured(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, data): a map of each type in lower case to the texts found, in the order they stand in."""
    each = entities.groupBy(key, "entity_type").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("found"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lower("entity_type"), F.transform("found", lambda x: x.text))))).alias("data"))


def explained(entities: DataFrame, docs: DataFrame, catalogue, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """Entities with the regexes that match them, their type's context words, and the text around them.

    An entity goes to the rows of its key whose text has its text_hash, so null and repeated keys never mix texts; rows
    alike in key and text each give theirs."""
    regexes = {d.entity_type: [] for d in catalogue.definitions}
    context = {d.entity_type: d.context for d in catalogue.definitions}
    for d in catalogue.definitions:
        regexes[d.entity_type] += d.patterns
    matching = None
    for kind, rxs in regexes.items():
        hits = F.filter(F.array(*[F.when(F.col("text").rlike(f"(?Ud){r}"), F.lit(r)) for r in rxs]), lambda x: x.isNotNull())
        matching = F.when(F.col("entity_type") == kind, hits) if matching is None else matching.when(F.col("entity_type") == kind, hits)
    words = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]) if v else F.array().cast("array<string>"))])
    said = docs.select(F.col(key).alias("__of"), F.col(text).alias("__said"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash"))
    same = F.col(key).eqNullSafe(F.col("__of")) & (F.col("text_hash") == F.col("__hash"))
    around = F.substring(F.col("__said"), F.greatest(F.col("start") - window, F.lit(0)) + 1, F.least(F.col("start"), F.lit(window)) + F.col("end") - F.col("start") + window)
    return entities.distinct().join(said, same).select(key, "entity_type", "start", "end", F.col("text").alias("matched_text"), "score", matching.alias("matching_patterns"), words[F.col("entity_type")].alias("context_terms"), around.alias("context"))
