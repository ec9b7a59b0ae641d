"""The registered queries of the detection engine, each with the SQL that says the same."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import validators as V
from umbra.functions.catalog import Catalogue
from umbra.operators import report
from umbra.operators import text as T
from umbra.operators.anonymize import age, anonymize
from umbra.operators.detect import detect, scanned, suggested
from umbra.plans import oracle as O
from umbra.sources.tables import anonymize_columns
from umbra.streaming import streams

CATALOGUE = Catalogue()
PLAIN = [t for t in CATALOGUE.types() if t not in O.LOOKAROUND]
#: Claim notes made from orders and customers, the same expression in both engines.
_D = "lpad(cast((k * 7919 + 12345) % 1000000000 as string), 9, '0')"
_E = "lpad(cast((k * 104729 + 51824753556) % 100000000000 as string), 11, '0')"
CLAIM = f"""case k % 12
when 0 then concat('Email: user', cast(k as string), '@mail', cast(k % 7 as string), '.example.com or phone 0412 345 ', lpad(cast(k % 1000 as string), 3, '0'), ' for Jane Doe')
when 1 then concat('His TFN is ', substr({_D}, 1, 3), ' ', substr({_D}, 4, 3), ' ', substr({_D}, 7, 3), '. Reference ', substr({_D}, 1, 3), ' ', substr({_D}, 4, 3), ' ', substr({_D}, 7, 3))
when 2 then concat('ABN number is ', substr({_E}, 1, 2), ' ', substr({_E}, 3, 3), ' ', substr({_E}, 6, 3), ' ', substr({_E}, 9, 3), ' and ACN: ', substr({_E}, 1, 3), ' ', substr({_E}, 4, 3), ' ', substr({_E}, 7, 3))
when 3 then concat('Medicare: ', cast(k % 8 as string), substr({_D}, 1, 3), ' ', substr({_D}, 4, 5), ' ', cast(k % 10 as string), ' and card ', cast(2 + k % 5 as string), substr({_D}, 2, 8), cast(k % 7 as string))
when 4 then concat('DOB: ', lpad(cast(1 + k % 28 as string), 2, '0'), '/', lpad(cast(1 + k % 12 as string), 2, '0'), '/', cast(1940 + k % 70 as string), '. The loss on 15/01/2023 was reported 3/2/23')
when 5 then concat('Policy Number: POL-', substr({_D}, 1, 6), ' with claim CL-', substr({_D}, 1, 8), '. Claim Reference: AB', cast(k % 1000 as string))
when 6 then concat('Lives at ', cast(1 + k % 300 as string), ' Queen Street, Sydney NSW ', cast(2000 + k % 900 as string), '. Paid $', cast(1 + k % 900 as string), ',250.00 to Acme Smash Pty Ltd')
when 7 then concat('Card on file: 4111 1111 1111 ', lpad(cast(k % 10000 as string), 4, '0'), ' and 4539', substr({_E}, 1, 11), cast(k % 10 as string))
when 8 then concat('Customer: John Smith of Melbourne, VIC. Payee: Delta Motors. Contact Mary Brown or Sydney Road')
when 9 then concat('CRN: ', substr({_D}, 1, 3), ' ', substr({_D}, 4, 3), ' ', substr({_D}, 7, 3), 'A. Passport: N', substr({_D}, 1, 7), '. Licence: ', substr({_D}, 1, 8))
when 10 then concat('VIN 1HGCM82633A', lpad(cast(k % 1000000 as string), 6, '0'), ', a Toyota Corolla ', cast(1990 + k % 30 as string), ' seen at Western Australia Bank')
else concat('Logged 2024-05-', lpad(cast(1 + k % 28 as string), 2, '0'), 'T14:32:00Z. INV-', cast(10000 + k % 80000 as string), ', BSB: 062-', lpad(cast(k % 1000 as string), 3, '0'), ' Account: ', substr({_D}, 1, 8), ', broker BRK-', cast(1000 + k % 9000 as string)) end"""
CLAIMS_SQL = f"claims AS (SELECT k AS doc_id, {CLAIM} AS text, seg FROM (SELECT o_orderkey AS k, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey))"
#: Notes for the types whose regexes look around, with sections and places.
EXTRA = f"""case k % 6
when 0 then concat('Seen at ', lpad(cast(k % 24 as string), 2, '0'), ':', lpad(cast(k % 60 as string), 2, '0'), ' pm and 7:05:59 AM, not 12/10:30 but 9:', lpad(cast(k % 70 as string), 2, '0'))
when 1 then concat('Ring +', cast(1 + k % 900 as string), ' ', substr({_D}, 1, 3), '-', substr({_D}, 4, 3), '-', substr({_D}, 6, 4), ', 0013 408-555-', lpad(cast(k % 10000 as string), 4, '0'), ' or (', cast(100 + k % 9000 as string), ') 555-', lpad(cast(k % 90000 as string), 5, '0'), '.')
when 2 then concat('SSN: ', lpad(cast(k % 1000 as string), 3, '0'), '-', lpad(cast(k % 100 as string), 2, '0'), '-', lpad(cast(k * 7 % 10000 as string), 4, '0'), ' filed, 666-04-7100 and 818-04-7100 not both')
when 3 then concat('Lives in NSW ', cast(2000 + k % 900 as string), ', postcode 0830, Post Code ', lpad(cast(k % 10000 as string), 4, '0'), ' and WA 6', lpad(cast(k % 1000 as string), 3, '0'))
when 4 then concat('Diary Assigned To: Jane Doe Subject: hail. Agent: Tom Lee Status: open ', cast(k as string), '. Contact: Mary Brown')
else concat('Claim Details: hail on the roof ', cast(k as string), case k % 4 when 1 then '. Customer Details: none' when 3 then '. Next  Steps: call, Vehicle Information: none' else '' end) end"""
EXTRAS_SQL = f"extras AS (SELECT k AS doc_id, {EXTRA} AS text FROM (SELECT o_orderkey AS k FROM orders))"
AS_OF = datetime.date(2024, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(k, more columns) of each order, dealt to as many tasks as a shuffle makes: a file of a few bytes a key is read by
    one task or two, and the notes made from its keys would all be scanned there."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *more).repartition(tasks, *(more or ["k"]))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, seg): a claim note for each order."""
    orders = keys(spark, sf_dir, "o_custkey")
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("k").alias("doc_id"), F.expr(CLAIM).alias("text"), "seg")


def extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a second note for each order."""
    return keys(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(EXTRA).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _scan_query(name: str, types: list[str], source: str = "claims") -> None:
    columns = ["doc_id", "entity_type", "start", "end", "text"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = claims(spark, sf_dir) if source == "claims" else extras(spark, sf_dir) if source == "extras" else table(spark, sf_dir, source)
        return scanned(docs, CATALOGUE, active=set(types)).select(*columns, "score")

    with_ = f"WITH {CLAIMS_SQL}, " if source == "claims" else f"WITH {EXTRAS_SQL}, " if source == "extras" else "WITH "
    query(name, f'{with_}cand AS ({O.candidates(CATALOGUE, types, source)}) SELECT doc_id, entity_type, "start", "end", txt AS text, score FROM cand')(run)


_scan_query("email_spans", ["EMAIL_ADDRESS"], "documents")
_scan_query("credit_card_spans", ["CREDIT_CARD"], "documents")
_scan_query("au_phone_spans", ["AU_PHONE"])
_scan_query("medicare_spans", ["AU_MEDICARE"])
_scan_query("abn_acn_tfn_labelled", ["AU_ABN", "AU_ACN", "AU_TFN", "AU_CENTRELINK_CRN"])
_scan_query("policy_claim_ids", ["INSURANCE_POLICY_NUMBER", "INSURANCE_CLAIM_NUMBER", "INVOICE_NUMBER", "BROKER_CODE"])
_scan_query("address_spans", ["AU_ADDRESS", "LOCATION"])
_scan_query("vehicle_ids", ["VEHICLE_VIN", "VEHICLE_DETAILS"])
_scan_query("document_id_spans", ["AU_DRIVERS_LICENSE", "AU_PASSPORT", "AU_BSB", "AU_ACCOUNT_NUMBER"])
_scan_query("date_spans", ["DATE", "DATE_OF_BIRTH", "INCIDENT_DATE", "ISO_DATETIME"])
_scan_query("money_spans", ["MONEY_AMOUNT"])
_scan_query("person_spans", ["PERSON"])
_scan_query("organization_spans", ["ORGANIZATION"])


_scan_query("time_spans", ["TIME"], "extras")
_scan_query("phone_intl_spans", ["PHONE_INTL"], "extras")
_scan_query("ssn_spans", ["US_SSN"], "extras")
_scan_query("postcode_spans", ["AU_POSTCODE"], "extras")
_scan_query("consultant_names", ["NAME_CONSULTANT"], "extras")


# --- validators over numbers made from order keys ---
def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return k.select("k", F.expr(_D).alias("d9"), F.expr(_E).alias("d11"))


_NUMBERS_SQL = f"WITH n AS (SELECT k, {_D} AS d9, {_E} AS d11 FROM (SELECT o_orderkey AS k FROM orders))"


@query("tfn_checksum", f"{_NUMBERS_SQL} SELECT k, d9, {O.valid_tfn('d9')} AS valid FROM n")
def tfn_checksum(spark, sf_dir):
    return _numbers(spark, sf_dir).select("k", "d9", V.valid_tfn(F.col("d9")).alias("valid"))


@query("abn_checksum", f"{_NUMBERS_SQL} SELECT k, d11, {O.valid_abn('d11')} AS valid FROM n")
def abn_checksum(spark, sf_dir):
    return _numbers(spark, sf_dir).select("k", "d11", V.valid_abn(F.col("d11")).alias("valid"))


@query("medicare_check", f"{_NUMBERS_SQL} SELECT k, d9 || CAST(k % 10 AS VARCHAR) AS d, {O.valid_medicare('d9 || CAST(k % 10 AS VARCHAR)')} AS valid FROM n")
def medicare_check(spark, sf_dir):
    d = F.concat("d9", (F.col("k") % 10).cast("string"))
    return _numbers(spark, sf_dir).select("k", d.alias("d"), V.valid_medicare(d).alias("valid"))


_CARD_SQL = "'4111' || d11 || CAST(k % 10 AS VARCHAR)"


@query("luhn_valid_cards", f"{_NUMBERS_SQL} SELECT k, {_CARD_SQL} AS card, {O.valid_card(_CARD_SQL)} AS valid FROM n")
def luhn_valid_cards(spark, sf_dir):
    card = F.concat(F.lit("4111"), "d11", (F.col("k") % 10).cast("string"))
    return _numbers(spark, sf_dir).select("k", card.alias("card"), V.valid_card(card).alias("valid"))


_PHONE_SQL = "CASE k % 6 WHEN 0 THEN '04' || substr(d9, 1, 8) WHEN 1 THEN '(02) ' || substr(d9, 1, 4) || ' ' || substr(d9, 5, 4) WHEN 2 THEN '1300 ' || substr(d9, 1, 3) || ' ' || substr(d9, 4, 3) WHEN 3 THEN '+1 ' || d9 WHEN 4 THEN substr(d9, 1, 5) ELSE d9 END"


@query("phone_kind", f"{_NUMBERS_SQL}, p AS (SELECT k, {_PHONE_SQL} AS phone FROM n) SELECT k, phone, {O.phone_kind('phone')} AS kind FROM p")
def phone_kind(spark, sf_dir):
    rows = _numbers(spark, sf_dir).select("k", F.expr(_PHONE_SQL).alias("phone"))
    return rows.select("k", "phone", V.phone_kind(F.col("phone")).alias("kind"))


_DATE_SQL = "CASE k % 9 WHEN 0 THEN CAST(1 + k % 28 AS VARCHAR(9)) || '/02/2023' WHEN 1 THEN 'NSW ' || substr(d9, 1, 4) WHEN 2 THEN substr(d9, 1, 4) WHEN 3 THEN 'March ' || CAST(1 + k % 28 AS VARCHAR(9)) || ', 2020' WHEN 4 THEN '5 days' WHEN 5 THEN d9 || '1' WHEN 6 THEN 'next Monday' WHEN 7 THEN '1300 ' || substr(d9, 1, 3) || ' ' || substr(d9, 4, 3) ELSE 'Q3 2024' END"


@query("date_kind", f"{_NUMBERS_SQL}, p AS (SELECT k, {_DATE_SQL} AS said FROM n) SELECT k, said, {O.date_kind('said')} AS kind FROM p")
def date_kind(spark, sf_dir):
    rows = _numbers(spark, sf_dir).select("k", F.expr(_DATE_SQL.replace("VARCHAR(9)", "string")).alias("said"))
    return rows.select("k", "said", V.date_kind(F.col("said"), 2024).alias("kind"))


_STATE_SQL = "CASE " + " ".join(f"WHEN p BETWEEN {lo} AND {hi} THEN '{s}'" for s, rs in O.C.POSTCODES.items() for lo, hi in rs) + " END"


@query("postcode_state_range", f"WITH n AS (SELECT o_orderkey AS k, CAST(o_orderkey * 37 % 10000 AS INT) AS p FROM orders) SELECT k, lpad(CAST(p AS VARCHAR), 4, '0') AS postcode, {_STATE_SQL} AS state FROM n")
def postcode_state_range(spark, sf_dir):
    code = F.lpad((F.col("o_orderkey") * 37 % 10000).cast("string"), 4, "0")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), code.alias("postcode"), V.postcode_state(code).alias("state"))


@query("age_years", "WITH n AS (SELECT o_orderkey AS k, make_date(CAST(1930 + o_orderkey % 90 AS INT), CAST(1 + o_orderkey % 12 AS INT), CAST(1 + o_orderkey % 28 AS INT)) AS born FROM orders) SELECT k, strftime(born, '%d/%m/%Y') AS said, CAST(date_sub('year', born, DATE '2024-01-01') AS INT) AS age FROM n")
def age_years(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.date_format(F.make_date((1930 + k % 90).cast("int"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int")), "dd/MM/yyyy")
    return table(spark, sf_dir, "orders").select(k.alias("k"), said.alias("said"), age(said, AS_OF).alias("age"))


# --- detection ---
_DETECT = f"WITH {CLAIMS_SQL}, {O.detect(CATALOGUE, PLAIN, 'claims')}"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(claims(spark, sf_dir), active=set(PLAIN), hashed=False)


@query("detect_entities", f'{_DETECT} SELECT doc_id, entity_type, "start", "end", text, score FROM entities')
def detect_entities(spark, sf_dir):
    return entities(spark, sf_dir)


@query("detect_all_types")
def detect_all_types(spark, sf_dir):
    return detect(claims(spark, sf_dir), hashed=False)


@query("detect_documents")
def detect_documents(spark, sf_dir):
    return detect(table(spark, sf_dir, "documents"), hashed=False)


@query("detect_pages")
def detect_pages(spark, sf_dir):
    return detect(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), hashed=False)


@query("detect_native", f'{_DETECT} SELECT doc_id, entity_type, "start", "end", text, score FROM entities')
def detect_native(spark, sf_dir):
    return detect(claims(spark, sf_dir), active=set(PLAIN), engine="native", hashed=False)


_STRICT = ["EMAIL_ADDRESS", "AU_PHONE", "CREDIT_CARD"]


@query("detect_threshold", f'WITH {CLAIMS_SQL}, {O.detect(CATALOGUE, _STRICT, "claims").replace("cand AS (", "cand AS (SELECT * FROM (", 1).replace("),\nflagged", ") WHERE score >= 0.9),\nflagged", 1)} SELECT doc_id, entity_type, "start", "end", text, score FROM entities')
def detect_threshold(spark, sf_dir):
    return detect(claims(spark, sf_dir), active=set(_STRICT), threshold=0.9, hashed=False)


def _suggested_sql() -> str:
    """Votes of each type's phrases (two) and words (one each) in a candidate's context; the first type of most votes."""
    before, after = "trim(lower(before))", "trim(lower(after))"
    both = f"({before} || ' ' || {after})"
    votes = []
    for kind, phrases in O.C.CONTEXT_BEFORE.items():
        words = " + ".join(f"CAST(contains({both}, {O.q(w)}) AS INT)" for w in O.C.CONTEXT_WORDS.get(kind, [])) or "0"
        votes.append(f"CASE WHEN {' OR '.join(f'regexp_matches({before}, {O.q(p)})' for p in phrases)} THEN 2 ELSE 0 END + {words}")
    kinds = [*O.C.CONTEXT_BEFORE]
    best = f"[{', '.join(votes)}]"
    return f"WITH {CLAIMS_SQL}, cand AS ({O.candidates(CATALOGUE, ['AU_TFN', 'AU_CENTRELINK_CRN', 'AU_ABN'], 'claims')}), v AS (SELECT entity_type, {best} AS votes FROM cand) SELECT entity_type, CASE WHEN list_max(votes) > 0 THEN list_extract({kinds!r}, list_position(votes, list_max(votes))) END AS suggested, count(*) AS n FROM v GROUP BY 1, 2"


@query("suggested_types", _suggested_sql())
def suggested_types(spark, sf_dir):
    return suggested(scanned(claims(spark, sf_dir), CATALOGUE, active={"AU_TFN", "AU_CENTRELINK_CRN", "AU_ABN"})).groupBy("entity_type", "suggested").agg(F.count("*").alias("n"))


# --- aggregates over entities ---
@query("entity_stats", f"{_DETECT} SELECT entity_type, count(*) AS count, round(avg(score), 4) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(DISTINCT doc_id) AS unique_rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM entities GROUP BY entity_type")
def entity_stats(spark, sf_dir):
    return report.entity_stats(entities(spark, sf_dir))


@query("doc_entity_counts", f"{_DETECT} SELECT doc_id, CAST(count(*) AS BIGINT) AS entity_count, count(DISTINCT entity_type) AS types FROM entities GROUP BY doc_id")
def doc_entity_counts(spark, sf_dir):
    return report.document_counts(entities(spark, sf_dir)).select("doc_id", "entity_count", F.size("type_counts").cast("bigint").alias("types"))


def _by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the segment of their note's customer, which goes along in the key: notes aren't joined again."""
    notes = claims(spark, sf_dir).select(F.struct("doc_id", "seg").alias("of"), "text")
    return detect(notes, key="of", active=set(PLAIN)).select("of.seg", "entity_type")


@query("entities_by_segment", f"{_DETECT} SELECT seg, entity_type, count(*) AS n FROM entities JOIN claims USING (doc_id) GROUP BY seg, entity_type")
def entities_by_segment(spark, sf_dir):
    return _by_segment(spark, sf_dir).groupBy("seg", "entity_type").agg(F.count("*").alias("n"))


@query("entity_rollup", f"{_DETECT} SELECT coalesce(seg, 'ALL') AS seg, coalesce(entity_type, 'ALL') AS entity_type, count(*) AS n FROM entities JOIN claims USING (doc_id) GROUP BY ROLLUP (seg, entity_type)")
def entity_rollup(spark, sf_dir):
    rows = _by_segment(spark, sf_dir).rollup("seg", "entity_type").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("seg", F.lit("ALL")).alias("seg"), F.coalesce("entity_type", F.lit("ALL")).alias("entity_type"), "n")


@query("top_docs_by_pii", f"{_DETECT} SELECT doc_id, count(*) AS n FROM entities GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 20")
def top_docs_by_pii(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


@query("docs_without_pii", f"{_DETECT} SELECT doc_id FROM claims WHERE doc_id NOT IN (SELECT doc_id FROM entities)")
def docs_without_pii(spark, sf_dir):
    notes = claims(spark, sf_dir)
    return notes.join(detect(notes, active=set(PLAIN)), "doc_id", "left_anti").select("doc_id")


@query("structured_data", f"""{_DETECT}, s AS (SELECT doc_id, lower(entity_type) AS kind, string_agg(text, '|' ORDER BY "start", text) AS found FROM entities GROUP BY 1, 2) SELECT doc_id, kind, found FROM s""")
def structured_data(spark, sf_dir):
    data = T.structured(entities(spark, sf_dir))
    return data.select("doc_id", F.explode("data").alias("kind", "found")).select("doc_id", "kind", F.array_join("found", "|").alias("found"))


# --- rewriting ---
_SIMPLE = ["EMAIL_ADDRESS", "MONEY_AMOUNT", "AU_TFN", "DATE_OF_BIRTH"]
_OPS = {"EMAIL_ADDRESS": "mask", "MONEY_AMOUNT": "redact", "AU_TFN": "hash", "DATE_OF_BIRTH": "age_bracket"}
_AGE_SQL = "(CAST(floor(date_sub('year', strptime(text, '%d/%m/%Y')::DATE, DATE '2024-01-01') / 5) * 5 AS INT))"
_NEW_SQL = f"CASE entity_type WHEN 'EMAIL_ADDRESS' THEN repeat('*', length(text)) WHEN 'MONEY_AMOUNT' THEN '[REDACTED]' WHEN 'AU_TFN' THEN 'HASH-' || substr(sha256(text), 1, 10) ELSE {_AGE_SQL} || '-' || ({_AGE_SQL} + 4) END"


def _spliced_sql(types: list[str], new: str) -> str:
    return f"""WITH {CLAIMS_SQL}, {O.detect(CATALOGUE, types, 'claims')},
r AS (SELECT doc_id, "start" AS s, "end" AS e, {new} AS n, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "start") AS b FROM entities),
g AS (SELECT c.doc_id, string_agg(substr(c.text, r.b + 1, r.s - r.b) || r.n, '' ORDER BY r.s) || substr(any_value(c.text), max(r.e) + 1) AS text, count(*) AS n_items FROM claims c JOIN r ON c.doc_id = r.doc_id GROUP BY c.doc_id)
SELECT c.doc_id, coalesce(g.text, c.text) AS text, CAST(coalesce(n_items, 0) AS INT) AS n_items FROM claims c LEFT JOIN g ON c.doc_id = g.doc_id"""


@query("mixed_ops_text", _spliced_sql(_SIMPLE, _NEW_SQL))
def mixed_ops_text(spark, sf_dir):
    notes = claims(spark, sf_dir)
    out = anonymize(notes, detect(notes, active=set(_SIMPLE)), _OPS, as_of=AS_OF)
    return out.select("doc_id", "text", F.size("items").alias("n_items"))


@query("op_replace", _spliced_sql(_SIMPLE, "'<' || entity_type || '>'"))
def op_replace(spark, sf_dir):
    notes = claims(spark, sf_dir)
    return anonymize(notes, detect(notes, active=set(_SIMPLE))).select("doc_id", "text", F.size("items").alias("n_items"))


for _name, _new in {"mask": "repeat('*', length(text))", "redact": "'[REDACTED]'", "hash": "'HASH-' || substr(sha256(text), 1, 10)"}.items():

    def _one_operator(spark, sf_dir, name=_name):
        notes = claims(spark, sf_dir)
        return anonymize(notes, detect(notes, active=set(_SIMPLE)), dict.fromkeys(_SIMPLE, name)).select("doc_id", "text", F.size("items").alias("n_items"))

    query(f"op_{_name}", _spliced_sql(_SIMPLE, _new))(_one_operator)

#: Keys that are null, repeat with other texts, or repeat with the same text.
_ODD_KEY = "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 < 3 THEN k % 50 ELSE k END"


_ODD_SQL = _spliced_sql(_SIMPLE, "'<' || entity_type || '>'")
_ROWS = "SELECT c.doc_id, coalesce(g.text, c.text) AS text, CAST(coalesce(n_items, 0) AS INT) AS n_items FROM claims c LEFT JOIN g ON c.doc_id = g.doc_id"
_OF = _ODD_KEY.replace(" k ", " c.doc_id ")


@query("odd_keys", _ODD_SQL.replace(_ROWS, f"SELECT {_OF} AS doc_id, coalesce(g.text, c.text) AS text, CAST(coalesce(n_items, 0) AS INT) AS n_items FROM claims c LEFT JOIN g ON c.doc_id = g.doc_id CROSS JOIN range(2)"))
def odd_keys(spark, sf_dir):
    """Every note twice, under keys that are null or repeat: each row comes back with its own text rewritten."""
    notes = claims(spark, sf_dir).select(F.col("doc_id").alias("k"), "text").select(F.expr(_ODD_KEY).alias("doc_id"), "text")
    twice = notes.unionByName(notes)
    return anonymize(twice, detect(twice, active=set(_SIMPLE))).select("doc_id", "text", F.size("items").alias("n_items"))


@query("odd_columns", _ODD_SQL.replace(_ROWS, f"SELECT {_OF} AS id, coalesce(g.text, c.text) AS note, CASE WHEN c.doc_id % 3 <> 0 THEN coalesce(g.text, c.text) END AS other FROM claims c LEFT JOIN g ON c.doc_id = g.doc_id"))
def odd_columns(spark, sf_dir):
    """Two text columns of a table whose key is null or repeats."""
    notes = claims(spark, sf_dir).select(F.col("doc_id").alias("k"), F.col("text").alias("note")).select(F.expr(_ODD_KEY).alias("id"), "note", F.when(F.col("k") % 3 != 0, F.col("note")).alias("other"))
    return anonymize_columns(notes, ["note", "other"], key="id", detection={"active": set(_SIMPLE)})


@query("keep_postcode", f"WITH {CLAIMS_SQL} SELECT doc_id, CASE WHEN doc_id % 12 = 6 THEN regexp_extract(text, 'NSW (\\d{{4}})', 1) ELSE regexp_extract(text, ' (\\d{{4}}) ', 1) END AS postcode FROM claims")
def keep_postcode(spark, sf_dir):
    """The number that stands alone after rewriting: a note with an address keeps its postcode, others are as they were."""
    notes = claims(spark, sf_dir)
    out = anonymize(notes, detect(notes, active={"AU_ADDRESS", "AU_POSTCODE"}))
    return out.select("doc_id", F.regexp_extract("text", r" (\d{4}) ", 1).alias("postcode"))


@query("report_summary", f"""WITH {CLAIMS_SQL}, {O.detect(CATALOGUE, _SIMPLE, 'claims')}, d AS (SELECT doc_id, length(text) AS n FROM claims), e AS (SELECT doc_id, count(*) AS k, sum("end" - "start") AS a FROM entities GROUP BY doc_id)
SELECT count(*) AS total_documents, CAST(sum(coalesce(k, 0)) AS BIGINT) AS total_entities, CAST(sum(n) AS BIGINT) AS total_characters, CAST(sum(coalesce(a, 0)) AS BIGINT) AS total_anonymized_characters, round(sum(coalesce(k, 0)) / count(*), 6) AS entities_per_document, round(sum(coalesce(a, 0)) / sum(n), 6) AS anonymization_rate FROM d LEFT JOIN e USING (doc_id)""")
def report_summary(spark, sf_dir):
    notes = claims(spark, sf_dir)
    return report.summary(report.document_report(anonymize(notes, detect(notes, active=set(_SIMPLE)), sized=True)))


@query("pii_column_rate")
def pii_column_rate(spark, sf_dir):
    notes = claims(spark, sf_dir).orderBy("doc_id")
    return report.column_rates(notes, notes.columns, lambda long: detect(long, "__row"))


# --- scores against gold spans ---
_GOLD = "WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 40 AS INT) AS g, CAST(o_orderkey % 40 + o_orderkey % 9 + 1 AS INT) AS h, CAST(o_orderkey % 37 + 2 AS INT) AS f, CAST(o_orderkey % 37 + 2 + o_orderkey % 7 AS INT) AS i, o_orderpriority AS label FROM orders), gc AS (SELECT doc_id, label, unnest(range(g, h)) AS at FROM o), fc AS (SELECT doc_id, label, unnest(range(f, i)) AS at FROM o)"


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    gold = rows.select(k.alias("doc_id"), (k % 40).cast("int").alias("start"), (k % 40 + k % 9 + 1).cast("int").alias("end"), F.col("o_orderpriority").alias("label"))
    found = rows.select(k.alias("doc_id"), (k % 37 + 2).cast("int").alias("start"), (k % 37 + 2 + k % 7).cast("int").alias("end"), F.col("o_orderpriority").alias("label"))
    return gold, found


@query("char_f1", f"{_GOLD}, c AS (SELECT coalesce(gc.label, fc.label) AS label, count(*) FILTER (gc.at IS NOT NULL AND fc.at IS NOT NULL) AS tp, count(*) FILTER (gc.at IS NULL) AS fp, count(*) FILTER (fc.at IS NULL) AS fn FROM gc FULL JOIN fc ON gc.doc_id = fc.doc_id AND gc.label = fc.label AND gc.at = fc.at GROUP BY 1) SELECT label, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def char_f1(spark, sf_dir):
    return report.char_scores(*_gold(spark, sf_dir))


@query("fp_fn_runs", f"{_GOLD}, w AS (SELECT 'fp' AS kind, * FROM (SELECT * FROM fc EXCEPT SELECT * FROM gc) UNION ALL SELECT 'fn', * FROM (SELECT * FROM gc EXCEPT SELECT * FROM fc)), r AS (SELECT *, \"at\" - row_number() OVER (PARTITION BY kind, doc_id, label ORDER BY \"at\") AS run FROM w) SELECT label, kind, doc_id, CAST(min(\"at\") AS INT) AS \"start\", CAST(max(\"at\") + 1 AS INT) AS \"end\", CAST(max(\"at\") + 1 - min(\"at\") AS INT) AS length FROM r GROUP BY label, kind, doc_id, run")
def fp_fn_runs(spark, sf_dir):
    return report.error_runs(*_gold(spark, sf_dir))


# --- texts ---
_META = ", ".join(f"nullif(regexp_extract(text, {O.q('(?i)' + rx)}, 1), '') AS {k}" for k, rx in T.METADATA.items())


@query("claim_metadata", f"WITH {CLAIMS_SQL} SELECT doc_id, {_META} FROM claims")
def claim_metadata(spark, sf_dir):
    return T.claim_metadata(claims(spark, sf_dir))


_RATES = ", ".join(f"round(least(1.0, len(regexp_extract_all(text, {O.q(rx)})) * {T.MATCH_SCORE}), 4)" for rx in T.RICH.values())


@query("pii_rich_segments", f"WITH {CLAIMS_SQL}, s AS (SELECT doc_id, text, greatest({_RATES}) AS best FROM claims) SELECT doc_id, CASE WHEN best > 0 THEN best WHEN regexp_matches(lower(text), '{'|'.join(T.KEYWORDS)}') THEN 0.3 ELSE 0.0 END AS pii_likelihood FROM s")
def pii_rich_segments(spark, sf_dir):
    return T.segmented(claims(spark, sf_dir)).select("doc_id", "pii_likelihood")


@query("segments")
def segments(spark, sf_dir):
    return T.segmented(table(spark, sf_dir, "documents")).select("doc_id", "segment", "start", "end", F.md5("text").alias("digest"))


_SECTIONS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS section FROM extras WHERE regexp_matches(text, {O.q('(?i)' + rx)})" for k, rx in T.SECTIONS.items())


@query("claim_sections", f"WITH {EXTRAS_SQL} SELECT doc_id, section FROM ({_SECTIONS})")
def claim_sections(spark, sf_dir):
    return T.sectioned(T.segmented(extras(spark, sf_dir))).select("doc_id", "section")


# What each of these texts holds, written out.
_GOLDEN = [
    ("His TFN is 123 456 789.", [("AU_TFN", "123 456 789")]),
    ("Contact 123 456 789 for details", [("AU_CENTRELINK_CRN", "123 456 789")]),
    ("ABN number is 51 824 753 556", [("AU_ABN", "51 824 753 556")]),
    ("Medicare: 2123 45678 0", [("AU_MEDICARE", "2123 45678 0")]),
    ("the form shows 818-04-7100 as filed", [("US_SSN", "818-04-7100")]),
    ("the form shows 900-04-7100 as filed", []),
    ("the line 0013 408-555-2222 was logged", [("PHONE_INTL", "0013 408-555-2222")]),
    ("we met at 14:35 today", [("TIME", "14:35")]),
    ("write to a.b@x.example.com now", [("EMAIL_ADDRESS", "a.b@x.example.com")]),
    ("the postcode 2913 was given", [("AU_POSTCODE", "2913")]),
    ("she owes $1,250.00 to us", [("MONEY_AMOUNT", "$1,250.00")]),
    ("logged 2024-05-01T14:32:00Z by cron", [("ISO_DATETIME", "2024-05-01T14:32:00Z")]),
    ("", []),
    (None, []),
]


@query("golden_entities", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{x}')" for i, (_, found) in enumerate(_GOLDEN) for t, x in found) + ") v(doc_id, entity_type, text)")
def golden_entities(spark, sf_dir):
    """Short texts with their entities written out by hand, not derived from the catalogue."""
    return detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_GOLDEN)], "doc_id int, text string")).select("doc_id", "entity_type", "text")


@query("acronym_expand", f"WITH {CLAIMS_SQL} SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\bDOB\\b', 'Date of Birth', 'g'), '(?i)\\bTFN\\b', 'Tax File Number', 'g') AS text FROM claims")
def acronym_expand(spark, sf_dir):
    return claims(spark, sf_dir).select("doc_id", T.expanded(F.col("text"), {"DOB": "Date of Birth", "TFN": "Tax File Number"}).text.alias("text"))


@query("dedup_joinback", "WITH t AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT doc_id, n AS copies, length(text) - length(replace(text, '@', '')) AS ats FROM documents JOIN t USING (text)")
def dedup_joinback(spark, sf_dir):
    """What a text yields is found once for all its copies and joined back by hash and text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("h"))
    once = docs.groupBy("h", "text").agg(F.count("*").alias("copies")).withColumn("ats", (F.char_length("text") - F.char_length(F.replace("text", F.lit("@"), F.lit("")))).cast("bigint"))
    return docs.join(once, ["h", "text"]).select("doc_id", "copies", "ats")


# --- streams, as batches that plan the same ---
@query("window_counts", "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def window_counts(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events"))


@query("session_counts", "WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(spark, sf_dir):
    return streams.session_counts(table(spark, sf_dir, "events").where("user_id is not null"))


def shared_folder(spark: SparkSession) -> str:
    """A new path that driver and executors share: in spark.checkpoint.dir; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = f"file://{tempfile.mkdtemp(prefix='umbra-stream-')}"
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    kind = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/even[t]s.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs one with a zone


#: Rows up to the watermark: what append mode has settled when the stream has run dry.
_SETTLED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("stream_window_counts", f"SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3) WHERE window_end <= {_SETTLED}")
def stream_window_counts(spark, sf_dir):
    """Windows of the events stream that its watermark has passed, in append mode."""
    path = shared_folder(spark)
    streams.appended(streams.windowed_counts(_events(spark, sf_dir)), f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.schema("window_start timestamp, window_end timestamp, event_type string, n long").parquet(f"{path}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@query("stream_session_counts", f"WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k HAVING session_end <= {_SETTLED}")
def stream_session_counts(spark, sf_dir):
    """Sessions of the events stream that its watermark has passed, in append mode."""
    path = shared_folder(spark)
    streams.appended(streams.session_counts(_events(spark, sf_dir).where("user_id is not null")), f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.schema("user_id long, session_start timestamp, session_end timestamp, n long").parquet(f"{path}/out")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
