"""Queries of what is scored, reported and joined by row: gold spans, reports, segments, overlaps, all types."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import catalog as C
from umbra.operators import report, tagger
from umbra.operators import text as T
from umbra.operators.anonymize import anonymize
from umbra.operators.detect import detect
from umbra.plans import gold
from umbra.plans import oracle as O
from umbra.plans import queries as Q
from umbra.plans.queries import CATALOGUE, CLAIMS_SQL, PLAIN, query, table

ALL = CATALOGUE.types()
_FROM_ORDERS = "SELECT o_orderkey AS k FROM orders"
_GOLD = f"WITH {gold.gold_sql(_FROM_ORDERS)}, {O.detect(CATALOGUE, ALL, 'gold')}"
_CHARS = f"""gc AS (SELECT DISTINCT doc_id, label, unnest(range(s, e)) AS at FROM (SELECT doc_id, s, e, {gold.category_case('label', gold.GOLD_CATEGORY)} AS label FROM gold_spans UNION ALL SELECT doc_id, s, e, 'ANY' FROM gold_spans)),
fc AS (SELECT DISTINCT doc_id, label, unnest(range("start", "end")) AS at FROM (SELECT doc_id, "start", "end", {gold.category_case('entity_type', gold.FOUND_CATEGORY)} AS label FROM entities UNION ALL SELECT doc_id, "start", "end", 'ANY' FROM entities) WHERE label IS NOT NULL)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.labelled(Q.keys(spark, sf_dir), "k")


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of _texts(), one a key: repeated keys have the same text, and scores count its characters once."""
    return gold.in_pieces(Q.keys(spark, sf_dir).distinct(), "k")


# --- the detector against gold spans ---
@query("gold_spans", f"WITH {gold.gold_sql(_FROM_ORDERS)} SELECT doc_id, s AS \"start\", e AS \"end\", label, substr(text, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS said FROM gold_spans JOIN gold USING (doc_id)")
def gold_spans(spark, sf_dir):
    each = _texts(spark, sf_dir).select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", "text", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), "s.label")
    return each.select("doc_id", "start", "end", "label", F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("said"))


@query("gold_f1", f"{_GOLD}, {_CHARS}, c AS (SELECT coalesce(gc.label, fc.label) AS label, count(*) FILTER (gc.at IS NOT NULL AND fc.at IS NOT NULL) AS tp, count(*) FILTER (gc.at IS NULL) AS fp, count(*) FILTER (fc.at IS NULL) AS fn FROM gc FULL JOIN fc ON gc.doc_id = fc.doc_id AND gc.label = fc.label AND gc.at = fc.at GROUP BY 1) SELECT label, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def gold_f1(spark, sf_dir):
    """Characters found right, by category and over all (ANY)."""
    return gold.scores_found(_once(spark, sf_dir))


_RUNS = "w AS (SELECT 'fp' AS kind, * FROM (SELECT * FROM fc EXCEPT SELECT * FROM gc) UNION ALL SELECT 'fn', * FROM (SELECT * FROM gc EXCEPT SELECT * FROM fc)), r AS (SELECT *, \"at\" - row_number() OVER (PARTITION BY kind, doc_id, label ORDER BY \"at\") AS run FROM w), x AS (SELECT label, kind, doc_id, CAST(min(\"at\") AS INT) AS \"start\", CAST(max(\"at\") + 1 AS INT) AS \"end\" FROM r GROUP BY label, kind, doc_id, run)"


@query("gold_errors", f'{_GOLD}, {_CHARS}, {_RUNS} SELECT label, kind, doc_id, "start", "end", "end" - "start" AS length FROM x QUALIFY row_number() OVER (PARTITION BY label, kind ORDER BY "end" - "start" DESC, doc_id, "start") <= 5')
def gold_errors(spark, sf_dir):
    """The five longest wrong runs of each category and kind."""
    return gold.errors_found(_once(spark, sf_dir))


#: A third of the templates are learnt from, texts of all others are tagged.
_LEARNT = f"doc_id % {len(gold.TEMPLATES)} in (0, 2, 5)"


@query("tagger_f1")
def tagger_f1(spark, sf_dir):
    """Characters found right without and with a tagger, over the texts of templates that it hasn't seen."""
    # the keys that the model is fitted on, those of smallest hash, are chosen before their texts are made
    learnt = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).where(_LEARNT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(1000)
    model = tagger.fit(gold.labelled(learnt, "doc_id"), {"PERSON"})
    return gold.scores_tagged(_once(spark, sf_dir).where(f"not {_LEARNT}"), model)


# --- reports of rows whose keys are null or repeat ---
def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = Q.claims(spark, sf_dir).select(F.col("doc_id").alias("k"), "text").select(F.expr(Q._ODD_KEY).alias("doc_id"), "text")
    return notes.unionByName(notes)


_ODD_DETECT = f"WITH {CLAIMS_SQL}, {O.detect(CATALOGUE, Q._SIMPLE, 'claims')}"
_PER_ROW = f"""e AS (SELECT doc_id, count(*) AS n, sum("end" - "start") AS a FROM entities GROUP BY doc_id),
rows AS (SELECT {Q._OF} AS doc_id, CAST(length(c.text) AS BIGINT) AS original_length, coalesce(n, 0) AS entity_count, CAST(coalesce(a, 0) AS BIGINT) AS anonymized_chars FROM claims c LEFT JOIN e ON c.doc_id = e.doc_id CROSS JOIN range(2))"""


@query("report_odd_rows", f"{_ODD_DETECT}, {_PER_ROW} SELECT *, round(anonymized_chars / original_length, 6) AS anonymization_ratio FROM rows")
def report_odd_rows(spark, sf_dir):
    """A report row for each of very many rows that share keys or have none."""
    twice = _twice(spark, sf_dir)
    return report.document_report(anonymize(twice, detect(twice, active=set(Q._SIMPLE)), sized=True))


@query("report_odd_summary", f"{_ODD_DETECT}, {_PER_ROW} SELECT count(*) AS total_documents, CAST(sum(entity_count) AS BIGINT) AS total_entities, CAST(sum(original_length) AS BIGINT) AS total_characters, CAST(sum(anonymized_chars) AS BIGINT) AS total_anonymized_characters, round(sum(entity_count) / count(*), 6) AS entities_per_document, round(sum(anonymized_chars) / sum(original_length), 6) AS anonymization_rate FROM rows")
def report_odd_summary(spark, sf_dir):
    return report.summary(report_odd_rows(spark, sf_dir))


@query("report_distribution", f"{_ODD_DETECT} SELECT entity_type, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM entities GROUP BY entity_type")
def report_distribution(spark, sf_dir):
    notes = Q.claims(spark, sf_dir)
    return report.distribution(anonymize(notes, detect(notes, active=set(Q._SIMPLE))))


# --- segments of letters made of several notes ---
def _shifted(i: int) -> str:
    return re.sub(r"\bk\b", f"(k + {i})", Q.CLAIM)


LETTER = "concat(" + ", chr(10), chr(10), ".join(_shifted(i) for i in range(5)) + ")"
_LETTERS_SQL = f"letters AS MATERIALIZED (SELECT k AS doc_id, {LETTER} AS text FROM ({_FROM_ORDERS}))"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): five notes, a blank line between."""
    return Q.keys(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(LETTER).alias("text"))


Q.ORACLE["segments"] = f'WITH RECURSIVE {O.segments("documents", T.SEGMENT, T.OVERLAP)} SELECT doc_id, segment, "start", "end", md5(text) AS digest FROM segments'
_IN_LETTERS = f"WITH RECURSIVE {_LETTERS_SQL}, {O.segments('letters', T.SEGMENT, T.OVERLAP)}, {O.detect(CATALOGUE, Q._SIMPLE, 'letters')}"
_OF_E = Q._ODD_KEY.replace(" k ", " s.doc_id ")


@query("segment_entities", f'{_IN_LETTERS} SELECT {_OF_E} AS doc_id, segment, entity_type, CAST(e."start" - s."start" AS INT) AS "start", CAST(e."end" - s."start" AS INT) AS "end", e.text, score FROM segments s JOIN entities e ON s.doc_id = e.doc_id AND e."start" >= s."start" AND e."end" <= s."end"')
def segment_entities(spark, sf_dir):
    """Entities inside each segment of letters whose keys are null or repeat."""
    rows = letters(spark, sf_dir).select(F.col("doc_id").alias("k"), "text").select(F.expr(Q._ODD_KEY).alias("doc_id"), "text")
    return T.by_segment(T.segmented(rows), detect(rows, active=set(Q._SIMPLE)))


_RX = {t: [r for d in CATALOGUE.definitions if d.entity_type == t for r in d.patterns] for t in Q._SIMPLE}
_HITS = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN " + " + ".join(f"CAST(regexp_matches(e.text, {O.q(r)}) AS INT)" for r in rs) for t, rs in _RX.items()) + " END"


@query("explained_entities", f'{_ODD_DETECT} SELECT {Q._OF} AS doc_id, entity_type, e.text AS matched_text, {_HITS} AS n_patterns, substr(c.text, greatest("start" - 50, 0) + 1, least("start", 50) + "end" - "start" + 50) AS context FROM entities e JOIN claims c ON e.doc_id = c.doc_id CROSS JOIN range(2)')
def explained_entities(spark, sf_dir):
    """Why each entity was found, of rows whose keys are null or repeat."""
    twice = _twice(spark, sf_dir)
    out = T.explained(detect(twice, active=set(Q._SIMPLE)), twice, CATALOGUE)
    return out.select("doc_id", "entity_type", "matched_text", F.size("matching_patterns").alias("n_patterns"), "context")


# --- overlaps ---
_KINDS = ["EMAIL_ADDRESS", "PERSON", "DATE", "AU_TFN", "AU_ADDRESS", "LOCATION"]
_SPAN = [(f"k * {7 + 4 * i} % 50", f"k * {5 + 2 * i} % 14 + 1", f"(k + {i}) % {len(_KINDS)}") for i in range(6)]
_OVERLAPS = " UNION ALL ".join(f"SELECT k AS doc_id, CAST({s} AS INT) AS s, CAST({s} + {n} AS INT) AS e, CAST({t} AS INT) AS t FROM ({_FROM_ORDERS})" for s, n, t in _SPAN)
_SAID = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ.,"
_ITEMS = f"""texts AS (SELECT k AS doc_id, '{_SAID}' AS text FROM ({_FROM_ORDERS})),
spans AS (SELECT DISTINCT doc_id, {{'s': s, 'e': e, 't': ['{"', '".join(_KINDS)}'][t + 1], 'r': '<' || ['{"', '".join(_KINDS)}'][t + 1] || '>'}} AS item FROM ({_OVERLAPS}))"""


@query("overlap_fold", f"WITH RECURSIVE {_ITEMS}, {O.folded('spans', C.PRIORITY)} SELECT doc_id, CAST(len(items) AS INT) AS n_items, array_to_string(list_transform(list_sort(list_transform(items, lambda x: {{'s': x.s, 'e': x.e, 't': x.t}})), lambda x: x.t || ':' || x.s || ':' || x.e), ',') AS items FROM folded")
def overlap_fold(spark, sf_dir):
    """Six spans a row, most of which overlap: which of them are written in."""
    k = Q.keys(spark, sf_dir)
    kind = lambda i: F.element_at(F.array(*map(F.lit, _KINDS)), F.expr(f"cast({i} as int)") + 1)
    spans = F.array(*[F.struct(F.expr(f"cast({s} as int)").alias("start"), F.expr(f"cast({s} + {n} as int)").alias("end"), kind(t).alias("entity_type")) for s, n, t in _SPAN])
    each = k.select(F.col("k").alias("doc_id"), F.explode(spans).alias("x")).select("doc_id", "x.*")
    entities = each.select("*", F.substr(F.lit(_SAID), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), F.lit(0.9).alias("score"))
    docs = k.select(F.col("k").alias("doc_id"), F.lit(_SAID).alias("text"))
    out = anonymize(docs, entities, unique=True)
    said = F.transform(F.array_sort(F.transform("items", lambda i: F.struct(i.start.alias("s"), i.end.alias("e"), i.entity_type.alias("t")))), lambda i: F.concat_ws(":", i.t, i.s, i.e))
    return out.select("doc_id", F.size("items").alias("n_items"), F.array_join(said, ",").alias("items"))


# --- every type of the catalogue ---
_EVERY = f"WITH {CLAIMS_SQL}, {O.detect(CATALOGUE, ALL, 'claims')}"
Q.ORACLE["detect_all_types"] = f'{_EVERY} SELECT doc_id, entity_type, "start", "end", text, score FROM entities'
# RE2's word boundary knows ASCII only: other letters are shown to it as underscores, one for one
_LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}\x{2C00}-\x{2FEF}\x{3040}-\x{D7FF}]"
Q.ORACLE["detect_documents"] = f'WITH said AS (SELECT doc_id, regexp_replace(coalesce(text, \'\'), \'{_LETTERS}\', \'_\', \'g\') AS text FROM documents), {O.detect(CATALOGUE, ALL, "said")} SELECT doc_id, entity_type, "start", "end", text, score FROM entities'
Q.ORACLE["detect_pages"] = f'WITH said AS (SELECT page_id AS doc_id, regexp_replace(coalesce(html, \'\'), \'{_LETTERS}\', \'_\', \'g\') AS text FROM pages), {O.detect(CATALOGUE, ALL, "said")} SELECT doc_id, entity_type, "start", "end", text, score FROM entities'


@query("detect_repeats_once", Q.ORACLE["detect_documents"])
def detect_repeats_once(spark, sf_dir):
    """Every document's entities, each distinct text being scanned once."""
    return detect(table(spark, sf_dir, "documents"), hashed=False, once=True)


_HOMES = """codes AS (SELECT a.doc_id, a."start" AS s, any_value(p."start") AS cs, any_value(p."end") AS ce, any_value(p.text) AS code FROM entities a JOIN entities p ON a.doc_id = p.doc_id AND a.entity_type = 'AU_ADDRESS' AND p.entity_type = 'AU_POSTCODE' AND a."start" <= p."start" AND p."end" <= a."end" GROUP BY 1, 2),
shown AS (SELECT e.doc_id, {'s': e."start", 'e': e."end", 't': e.entity_type, 'r': CASE WHEN code IS NULL OR e.entity_type <> 'AU_ADDRESS' THEN '<' || e.entity_type || '>' ELSE substr('<AU_ADDRESS>', 1, cs - e."start") || ' ' || code || ' ' || substr('<AU_ADDRESS>', ce - e."start" + 1) END} AS item
  FROM entities e LEFT JOIN codes ON e.doc_id = codes.doc_id AND e."start" = codes.s AND e.entity_type = 'AU_ADDRESS'
  WHERE e.entity_type <> 'AU_POSTCODE' OR NOT EXISTS (SELECT 1 FROM entities a WHERE a.doc_id = e.doc_id AND a.entity_type = 'AU_ADDRESS' AND a."start" <= e."start" AND e."end" <= a."end"))"""


@query("anonymize_all", f"{_EVERY.replace('WITH', 'WITH RECURSIVE', 1)}, {_HOMES}, {O.folded('shown', C.PRIORITY)}, {O.spliced('claims')}")
def anonymize_all(spark, sf_dir):
    """Every note with whatever was found in it replaced."""
    notes = Q.claims(spark, sf_dir)
    return anonymize(notes, detect(notes)).select("doc_id", "text", F.size("items").alias("n_items"))


_SAMPLE = f"""WITH {CLAIMS_SQL}, few AS (SELECT * FROM claims ORDER BY doc_id LIMIT 100),
long AS MATERIALIZED (SELECT doc_id || ':text' AS doc_id, text FROM few UNION ALL SELECT doc_id || ':seg', seg FROM few)"""
Q.ORACLE["pii_column_rate"] = f"""{_SAMPLE}, {O.detect(CATALOGUE, ALL, 'long')}, hit AS (SELECT DISTINCT doc_id AS of FROM entities WHERE score >= 0.7)
SELECT split_part(doc_id, ':', 2) AS "column", count(*) AS sampled, count(of) AS detected, round(count(of) / count(*), 6) AS rate FROM long LEFT JOIN hit ON doc_id = of GROUP BY 1"""

Q._scan_query("registration_spans", ["VEHICLE_REGISTRATION"])

assert set(PLAIN) < set(ALL)
