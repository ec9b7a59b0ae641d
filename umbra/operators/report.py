"""Aggregations over entities, items and gold spans. Every one is a partial and a final aggregate; none collects."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_stats(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per type: count, mean, least and greatest score, rows that hold it, share of all entities in percent."""
    each = entities.groupBy("entity_type").agg(
        F.count("*").alias("count"), F.round(F.avg("score"), 4).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count_distinct(key).alias("unique_rows")
    )
    # a row a type: the window holds as many rows as there are types
    return each.withColumn("percentage", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))), 2))


def document_counts(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: entity_count and a map of counts by type."""
    each = entities.groupBy(key, "entity_type").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.sum("n").alias("entity_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("type_counts"))


def document_report(anonymized: DataFrame, key: str = "doc_id", seconds: str | None = None) -> DataFrame:
    """Per row of anonymize(sized=True): key, original_length, entity_count, anonymized_chars, anonymization_ratio, and with
    `seconds` (a column of the input) processing_time.

    One narrow pass over one table, so null and repeated keys give a row each; null and empty texts have length 0 and
    ratio 0; an empty table gives no rows."""
    cut = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, i: a + F.char_length(i.original))
    ratio = F.when(F.col("original_length") > 0, F.round(F.col("anonymized_chars") / F.col("original_length"), 6)).otherwise(0.0)
    time = [F.col(seconds).cast("double").alias("processing_time")] if seconds else []
    return anonymized.select(key, "original_length", F.size("items").cast("bigint").alias("entity_count"), cut.alias("anonymized_chars"), *time).withColumn("anonymization_ratio", ratio)


def summary(reports: DataFrame) -> DataFrame:
    """One row over document_report(): totals, entities a document, share of characters anonymised, and the mean
    processing_time where the reports have one. distribution() has the types."""
    timed = "processing_time" in reports.columns
    total = reports.agg(
        F.count("*").alias("total_documents"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("total_entities"), F.coalesce(F.sum("original_length"), F.lit(0)).alias("total_characters"),
        F.coalesce(F.sum("anonymized_chars"), F.lit(0)).alias("total_anonymized_characters"), *([F.round(F.coalesce(F.avg("processing_time"), F.lit(0.0)), 6).alias("avg_processing_time")] if timed else []),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return total.withColumns({"entities_per_document": ratio("total_entities", "total_documents"), "anonymization_rate": ratio("total_anonymized_characters", "total_characters")})


def distribution(anonymized: DataFrame) -> DataFrame:
    """(entity_type, count, share in percent of all items) of anonymize()'s items."""
    each = anonymized.select(F.explode("items").alias("i")).groupBy("i.entity_type").agg(F.count("*").alias("count"))
    # a row a type: the window holds as many rows as there are types
    return each.withColumn("share", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))), 4))


def operator_counts(anonymized: DataFrame) -> DataFrame:
    """Items by type and operator."""
    return anonymized.select(F.explode("items").alias("i")).groupBy("i.entity_type", "i.operator").agg(F.count("*").alias("count"))


def column_rates(docs: DataFrame, columns: list[str], entities_of, sample: int = 100, confidence: float = 0.7, key: str = "__row") -> DataFrame:
    """(column, sampled, detected, rate): the share of a sample's values that hold an entity of enough confidence.

    entities_of takes a (key, text) table and gives entities; all columns go through it at once. The sample is the
    feature here: the first `sample` rows decide which columns are looked at further."""
    kinds = dict(docs.dtypes)
    texts = [c for c in columns if kinds[c] in ("string",) or kinds[c].startswith(("varchar", "char"))]
    if not texts:
        return docs.sparkSession.createDataFrame([], "`column` string, sampled long, detected long, rate double")
    some = docs.select(*texts).limit(sample).withColumn(key, F.monotonically_increasing_id())
    long = some.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in texts])).alias("v")).select(F.concat_ws(":", F.col(key), F.col("v.column")).alias(key), "v.column", "v.text").where("text is not null")
    hit = entities_of(long.select(key, "text")).where(F.col("score") >= confidence).select(key).distinct().withColumn("hit", F.lit(1))
    return long.join(hit, key, "left").groupBy("column").agg(F.count("*").alias("sampled"), F.count("hit").alias("detected"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


def _swept(gold: DataFrame, found: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, start, end, g, f): runs of characters between span boundaries, with whether gold and found cover them.

    Each span is two events, +1 at its start and -1 at its end; running sums over a document's and label's events say what
    covers each stretch. The work follows the number of spans, not of characters; overlapping and repeated spans of one
    side cover a character once. Events at one place follow each other in any order: what lies between them is empty and
    dropped, so a task holds one sort of its events and no table of places."""
    sides = None
    for df, g, f in ((gold, 1, 0), (found, 0, 1)):
        some = df.where("end > start").select(key, label, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
        some = some.select(key, label, "e.at", (F.col("e.d") * g).alias("g"), (F.col("e.d") * f).alias("f"))
        sides = some if sides is None else sides.unionByName(some)
    dealt = sides.repartition(key, label)
    order = Window.partitionBy(key, label).orderBy("at")
    on = lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0
    return dealt.select(key, label, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), on("g").alias("g"), on("f").alias("f")).where("end > start")


def char_scores(gold: DataFrame, found: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over characters of (key, start, end, label) spans.

    Rows of one key are one document, null keys too; empty spans cover nothing; a label without any span has no row."""
    size = F.col("end").cast("bigint") - F.col("start")
    of = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).alias
    g, f = F.col("g"), F.col("f")
    counts = _swept(gold, found, key, label).groupBy(label).agg(of(g & f)("tp"), of(~g & f)("fp"), of(g & ~f)("fn"))
    return rated(counts)


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6)}


def rated(counts: DataFrame) -> DataFrame:
    """Rows of tp, fp and fn with precision, recall and f1."""
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def error_runs(gold: DataFrame, found: DataFrame, key: str = "doc_id", label: str = "label", longest: int | None = None) -> DataFrame:
    """(label, kind fp or fn, key, start, end, length) of contiguous wrong characters; longest keeps so many of each label and kind."""
    kind = F.when(F.col("f") & ~F.col("g"), "fp").when(F.col("g") & ~F.col("f"), "fn").otherwise("")
    order = Window.partitionBy(key, label).orderBy("start")
    rows = _swept(gold, found, key, label).withColumn("kind", kind)
    # a run's first and last stretch, side by side once the others are dropped: no table of runs beside the sort
    rows = rows.withColumns({"first": ~F.lag("kind").over(order).eqNullSafe(F.col("kind")), "last": ~F.lead("kind").over(order).eqNullSafe(F.col("kind"))}).where(F.col("first") | F.col("last"))
    rows = rows.withColumn("end", F.when(F.col("last"), F.col("end")).otherwise(F.lead("end").over(order))).where("first and kind <> ''")
    out = rows.select(label, "kind", key, "start", "end").withColumn("length", F.col("end") - F.col("start"))
    if longest is None:
        return out
    return longest_runs(out, longest, key, label)


def longest_runs(runs: DataFrame, longest: int, key: str = "doc_id", label: str = "label") -> DataFrame:
    """So many of error_runs() of each label and kind, the longest."""
    place = F.row_number().over(Window.partitionBy(label, "kind").orderBy(F.desc("length"), key, "start"))
    return runs.withColumn("place", place).where(F.col("place") <= longest).drop("place")


def export(reports: DataFrame, stats: DataFrame, path: str, format: str = "json") -> str:
    """Writes a report: json, html and txt of summary and types, csv of the documents (by Spark, as many files as it has)."""
    kind = format.lower()
    if kind == "csv":
        reports.write.mode("overwrite").csv(path, header=True)
        return path
    if kind not in ("json", "html", "txt"):
        raise ValueError(f"Unsupported format: {format}. Use 'json', 'csv', or 'html'.")
    whole, types = summary(reports).first().asDict(), [r.asDict() for r in stats.orderBy(F.desc("count"), "entity_type").collect()]  # a row a type
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if kind == "json":
        Path(path).write_text(json.dumps({**whole, "entities": types}, indent=2))
        return path
    if kind == "txt":
        lines = ["Processing Report", "=" * 50, "", *(f"{k.replace('_', ' ').title()}: {v}" for k, v in whole.items()), "", "Entities Found:", *(f"  - {t['entity_type']}: {t['count']}" for t in sorted(types, key=lambda t: t["entity_type"]))]
        Path(path).write_text("\n".join(lines) + "\n")
        return path
    rows = lambda cells: "".join(f"<tr>{''.join(f'<td>{html.escape(str(c))}</td>' for c in r)}</tr>" for r in cells)
    Path(path).write_text(f"<!doctype html><title>Report</title><h1>Summary</h1><table>{rows(whole.items())}</table><h1>Entities</h1><table>{rows([(t['entity_type'], t['count'], t['percentage']) for t in types])}</table>")
    return path
