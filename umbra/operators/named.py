"""Candidates of a named-entity model, cleaned before they join the scan's: labels and everyday words that models take for names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import catalog as C

# Model labels and the words that are no person, organisation or place.
LABELS = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "DATE": "DATE", "TIME": "TIME", "MONEY": "MONEY", "CARDINAL": "NUMBER", "ORDINAL": "NUMBER", "QUANTITY": "NUMBER", "PERCENT": "PERCENT", "PRODUCT": "PRODUCT", "EVENT": "EVENT", "WORK_OF_ART": "WORK_OF_ART", "LAW": "LAW", "LANGUAGE": "LANGUAGE", "FAC": "FACILITY"}
NO_PERSON = [
    "balance", "outstanding", "await", "awaiting", "pending", "completed", "processed", "received", "submitted", "approved", "declined", "rejected",
    "cancelled", "closed", "open", "active", "inactive", "suspended", "terminated", "expired", "current", "previous", "ongoing", "finished",
    "review", "update", "check", "verify", "confirm", "validate", "process", "submit", "approve", "decline", "reject", "cancel", "close", "complete",
    "advised", "notify", "inform", "contact", "follow", "proceed", "continue",
    "excess", "premium", "deductible", "coverage", "liability", "claim", "policy", "payment", "invoice", "receipt", "refund", "credit", "debit",
    "assessment", "evaluation", "inspection", "investigation", "settlement",
    "repairer", "repairs", "service", "maintenance", "workshop", "garage", "parts", "replacement", "installation", "removal", "diagnostic", "estimate",
    "unreachable", "unavailable", "contactable", "available", "busy", "engaged",
    "drop", "pickup", "delivery", "collection", "dispatch", "arrival", "departure", "transfer", "forward", "return", "exchange", "replace",
    "form", "document", "report", "statement", "declaration", "certificate", "authorization", "approval", "confirmation", "acknowledgment", "notice",
    "today", "tomorrow", "yesterday", "daily", "weekly", "monthly", "yearly", "immediate", "urgent", "routine", "scheduled", "overdue",
    "new", "used", "damaged", "repaired", "replaced", "original", "genuine", "aftermarket", "compatible", "suitable", "adequate", "insufficient",
]
TRAILING = ["subject", "matter", "issue", "claim", "claims", "policy", "number", "date", "time", "amount", "status", "type", "category", "dob", "doi", "phone", "mobile", "email", "address", "tel", "fax", "ref", "reference"]
NO_ORGANIZATION = ["dob", "doi", "medicare", "abn", "tfn", "acn", "ssn", "tin", "nin", "vin", "crn", "bsb", "gst", "pol", "ref", "id"]
NO_LOCATION = [
    "await", "awaiting", "awaits", "awaited", "repair", "repairs", "repairing", "repaired", "service", "services", "servicing", "serviced",
    "process", "processing", "processed", "update", "updates", "updating", "updated", "review", "reviews", "reviewing", "reviewed",
    "submit", "submits", "submitting", "submitted", "pending", "complete", "completed", "completing",
    "open", "closed", "active", "inactive", "approved", "declined", "rejected", "cancelled", "available", "unavailable", "occupied", "vacant",
    "claim", "claims", "policy", "policies", "coverage", "liability", "excess", "premium", "payment", "balance", "outstanding", "overdue",
    "workshop", "workshops", "garage", "garages", "parts", "spares", "supplies", "inventory", "storage", "warehouse", "facility", "facilities",
    "drop", "drops", "pickup", "delivery", "arrival", "departure", "transit", "shipping",
]
NO_LOCATION_START = ["await", "repair", "serv", "proc", "updat", "review", "submit", "pend", "complet", "approv", "declin", "reject"]
MODEL_SCORE = 0.9
# End of fixed values.


def cleaned(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A model's spans (key, label, start, end, text, and before, after and text_hash where it has them) as candidates for detect(extra=).

    Labels become types, others go. Persons that are labels, streets or everyday words go, and label words at a person's
    end are cut off; so go organisations and places that are none."""
    kinds = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    typed = found.withColumn("entity_type", F.try_element_at(kinds, F.col("label"))).where("entity_type is not null")
    low, kind = F.lower("text"), F.col("entity_type")
    words = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    no_person = low.rlike(f"^(policy|ref|claim)|number|({'|'.join(C.STREET_SUFFIXES)})$") | F.arrays_overlap(words, F.array(*map(F.lit, NO_PERSON)))
    single = F.size(words) == 1
    no_place = low.isin(NO_LOCATION) | (single & low.rlike(f"^({'|'.join(NO_LOCATION_START)})")) | (low.endswith("s") & F.substring(low, F.lit(1), F.char_length(low) - 1).isin(NO_LOCATION))
    rows = typed.where(~(((kind == "PERSON") & no_person) | ((kind == "ORGANIZATION") & low.isin(NO_ORGANIZATION)) | ((kind == "LOCATION") & no_place)))
    tail = rf"(?iU)(?<=\S)(?:\s+(?:{'|'.join(TRAILING)}))+\s*$"
    rows = rows.withColumn("text", F.when(kind == "PERSON", F.regexp_replace("text", tail, "")).otherwise(F.col("text")))
    rows = rows.withColumn("end", (F.col("start") + F.char_length("text")).cast("int"))
    beside = [F.col(c) if c in found.columns else F.lit("").alias(c) for c in ("before", "after")]
    # ordinals beyond every scan's: the scan's own candidates come first among equals
    return rows.select(key, F.lit(1 << 20).alias("ordinal"), "entity_type", F.lit(MODEL_SCORE).alias("score"), F.col("start").cast("int"), "end", "text", *beside, *[c for c in ("text_hash",) if c in found.columns])
