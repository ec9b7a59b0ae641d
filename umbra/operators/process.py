"""Whole results: a text's entities, rewritten text, segments and structured values in one row, by one detection.

Rows keep their place by key and text hash, so keys may be null or repeat. Everything after detection is array functions
on one row.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.catalog import Catalogue
from umbra.operators.anonymize import AS_OF, Operator, folded, items_of, spliced
from umbra.operators.arrow import scanned as by_arrow
from umbra.operators.detect import detect
from umbra.operators.text import expanded, likelihood, segments

ENTITY = "array<struct<start:int,end:int,entity_type:string,text:string,score:double>>"


def with_acronyms(docs: DataFrame, acronyms: dict[str, str] | None, text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """docs with whole-word acronyms of the text written out, the step before detection; nulls stay null."""
    return docs.withColumn(text, expanded(F.col(text), acronyms, case_sensitive).text) if acronyms else docs


def _clean(text: Column, entities: Column, operators: dict[str, Operator], bracket: int, keep_postcode: bool) -> Column:
    items = folded(items_of(entities, operators, bracket, keep_postcode, AS_OF))
    return spliced(text, F.array_sort(items, lambda a, b: b.start - a.start))


def process(docs: DataFrame, key: str = "doc_id", text: str = "text", operators: dict[str, Operator] | None = None, acronyms: dict[str, str] | None = None, content_type: str | None = None, bracket: int = 5, keep_postcode: bool = True, **detection: Any) -> DataFrame:
    """One row per row of docs: key (and content_type), entities, anonymized, segments, structured_data, entity_count,
    type_counts, expanded_acronyms.

    Segments hold text, start, end, pii_likelihood, pii_scores and their own anonymized text: entities that lie inside a
    segment are moved to its start; a segment that isn't found in the text as it stands (its blank lines differ) has
    every entity's text replaced. A null text has no entities and segments and stays null; repeated rows come out alike;
    other columns are ignored; an empty table gives no rows.
    """
    ops = operators or {}
    said = F.col("__said")
    rows = docs.select(F.col(key), *([F.col(content_type).alias("content_type")] if content_type else []), F.col(text).alias("__from"))
    new = expanded(F.col("__from"), acronyms or {})
    rows = rows.withColumn("__x", new).select("*", F.col("__x.text").alias("__said"), F.transform(F.col("__x.expansions"), lambda e: F.struct(e.acronym.alias("acronym"), e.expansion.alias("expansion"))).alias("expanded_acronyms")).drop("__from", "__x")
    found = detect(rows, key, "__said", hashed=True, **detection)
    grouped = found.groupBy(F.col(key).alias("__of"), F.col("text_hash").alias("__of_hash")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "entity_type", "text", "score"))).alias("entities"))
    rows = rows.withColumn("__hash", F.xxhash64(F.coalesce("__said", F.lit(""))))
    joined = rows.join(grouped, F.col(key).eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__of_hash")), "left").withColumn("entities", F.coalesce("entities", F.array().cast(ENTITY)))

    own = F.col("entities")
    parts = segments(said)

    def one(s: Column) -> Column:
        at = F.call_function("locate", s.text, said) - 1
        inside = F.transform(F.filter(own, lambda e: (e.start >= at) & (e.end <= at + F.char_length(s.text))), lambda e: F.struct((e.start - at).alias("start"), (e.end - at).alias("end"), e.entity_type.alias("entity_type"), e.text.alias("text"), e.score.alias("score")))
        anywhere = F.aggregate(own, s.text, lambda acc, e: F.replace(acc, e.text, F.concat(F.lit("<"), e.entity_type, F.lit(">"))))
        rate, scores = likelihood(s.text)
        return F.struct(s.text.alias("text"), s.start.alias("start"), s.end.alias("end"), rate.alias("pii_likelihood"), scores.alias("pii_scores"), F.when(at >= 0, _clean(s.text, inside, ops, bracket, keep_postcode)).otherwise(anywhere).alias("anonymized"))

    kinds = F.array_sort(F.array_distinct(F.transform(own, lambda e: e.entity_type)))
    of = lambda t: F.filter(own, lambda e: e.entity_type == t)
    return joined.select(
        F.col(key),
        *(["content_type"] if content_type else []),
        "entities",
        _clean(said, own, ops, bracket, keep_postcode).alias("anonymized"),
        F.transform(parts, one).alias("segments"),
        F.map_from_entries(F.transform(kinds, lambda t: F.struct(F.lower(t).alias("key"), F.transform(of(t), lambda e: e.text).alias("value")))).alias("structured_data"),
        F.size("entities").alias("entity_count"),
        F.map_from_entries(F.transform(kinds, lambda t: F.struct(t.alias("key"), F.size(of(t)).alias("value")))).alias("type_counts"),
        "expanded_acronyms",
    )


def process_files(spark: SparkSession, paths: list[str], target: str | None = None, operators: dict[str, Operator] | None = None, **options: Any) -> DataFrame:
    """One row per file: path, name, success, error, and process()'s columns. With a target each file's rewritten text is
    written to target/anonymized/name=<name>/ and its result as one JSON line to target/analysis/name=<name>/.

    A path that isn't there gives a row with success false and an error; the other files are processed."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    there, missing = [], []
    for p in paths:
        path = fs.Path(p)
        (there if path.getFileSystem(conf).exists(path) else missing).append(p)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    lost = spark.createDataFrame([(p,) for p in missing], "path string").select("path", name.alias("name"), F.lit(False).alias("success"), F.lit("No such file").alias("error"))
    if not there:
        return lost
    texts = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    done = process(texts, "path", "text", operators, **options).withColumns({"name": name, "success": F.lit(True), "error": F.lit(None).cast("string")})
    if target:
        done = done.persist()
        done.select("name", F.col("anonymized").alias("value")).write.mode("overwrite").partitionBy("name").text(f"{target}/anonymized")
        done.select("name", F.to_json(F.struct("path", "entities", "anonymized", "segments", "structured_data", "entity_count", "type_counts")).alias("value")).write.mode("overwrite").partitionBy("name").text(f"{target}/analysis")
    return done.unionByName(lost, allowMissingColumns=True)


def applied(docs: DataFrame, catalogue: Catalogue, key: str = "doc_id", text: str = "text", types: set[str] | None = None) -> DataFrame:
    """(key, entity_type, start, end, text, score) of every match of the definitions' regexes with the definition's own
    score; nothing is left out or arbitrated. Keys may be null or repeat; null texts match nothing."""
    scores, known = [], 0
    for d in catalogue.definitions:
        scores += [d.score] * len(d.patterns)
        known += len(d.patterns)
    found = by_arrow(docs, catalogue, key, text, types, 0.0, skip=False).where(F.col("ordinal") < known)
    own = F.element_at(F.array(*[F.lit(float(s)) for s in scores]), F.col("ordinal") + 1)
    return found.select(key, "entity_type", "start", "end", "text", own.alias("score"))


def claim_notes(docs: DataFrame, key: str = "doc_id", text: str = "text", **detection: Any) -> DataFrame:
    """(key, text, pii_entities, incident_description): the note's entities, and its first hundred characters."""
    done = detect(docs, key, text, hashed=True, **detection)
    found = done.groupBy(F.col(key).alias("__of"), "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "entity_type", "text", "score"))).alias("__all"))
    rows = docs.select(key, text)
    same = F.col(key).eqNullSafe(F.col("__of")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("text_hash"))
    joined = rows.join(found, same, "left")
    each = F.transform(F.coalesce("__all", F.array().cast("array<struct<start:int,entity_type:string,text:string,score:double>>")), lambda e: F.struct(e.entity_type.alias("entity_type"), e.text.alias("text"), e.score.alias("score")))
    short = F.when(F.char_length(text) > 100, F.concat(F.left(F.col(text), F.lit(100)), F.lit("..."))).otherwise(F.col(text))
    return joined.select(key, text, each.alias("pii_entities"), short.alias("incident_description"))
