"""Validators as Column expressions: checksums, shapes, and which kind a value is."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.catalog import ABN_WEIGHTS, POSTCODES, STATES, TFN_WEIGHTS

# Accepted and refused date shapes, in order.
MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DAYS = "(Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
DATE_SHAPES = [
    r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$",
    r"^\d{4}[/.-]\d{1,2}[/.-]\d{1,2}$",
    rf"^{MONTHS}\w*\s+\d{{1,2}},?\s+\d{{4}}$",
    rf"^\d{{1,2}}\s+{MONTHS}\w*\s+\d{{4}}$",
    rf"^{MONTHS}\w*\s+\d{{4}}$",
    rf"^{MONTHS}\w*[/.-]\d{{2,4}}$",
    rf"^{DAYS}\w*$",
    rf"^(next|last|this|every)\s+{DAYS}\w*$",
    r"^(next|last|this|every)\s+(day|week|fortnight|month|quarter|year|decade|century|morning|afternoon|evening|night|weekend)s?$",
    r"^Q[1-4]\s+\d{2,4}$",
    r"^(FY|H[12])\s*\d{2,4}$",
    r"^\d{1,2}:\d{2}(:\d{2})?(\s*[ap]\.?m\.?)?$",
    r"^(yesterday|today|tomorrow|tonight|noon|midnight)$",
    r"^the\s+(\d{2}s|\d{4}s|early|late|mid)(\s+\d{4}s)?$",
]
# End of fixed values.


def bare(text: Column, drop: str = r"\s+") -> Column:
    return F.regexp_replace(text, drop, "")


def _weighted(digits: Column, weights: list[int], less_first: int = 0) -> Column:
    terms = [(F.substring(digits, i + 1, 1).cast("int") - (less_first if i == 0 else 0)) * w for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def valid_tfn(text: Column) -> Column:
    d = bare(text)
    return F.when(d.rlike("^[0-9]{9}$"), _weighted(d, TFN_WEIGHTS) % 11 == 0).otherwise(False)


def valid_abn(text: Column) -> Column:
    d = bare(text)
    return F.when(d.rlike("^[0-9]{11}$"), _weighted(d, ABN_WEIGHTS, 1) % 89 == 0).otherwise(False)


def valid_medicare(text: Column) -> Column:
    return bare(text).rlike("^[2-6][0-9]{8}[1-9]$")


def valid_card(text: Column) -> Column:
    d = bare(text, r"[\s-]+")
    return F.when(d.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", d)).otherwise(False)


def phone_kind(text: Column) -> Column:
    """mobile, landline, service, emergency, international; partial or invalid where it's none."""
    d = bare(text, r"[\s\-()]+")
    return (
        F.when(d.rlike(r"^(\+61|0)4[0-9]{8}$"), "mobile")
        .when(d.rlike(r"^(\+61|0)[2378][0-9]{8}$"), "landline")
        .when(d.rlike(r"^(13[0-9]{4}|1300[0-9]{6}|1800[0-9]{6})$"), "service")
        .when(d.isin("000", "112", "106"), "emergency")
        .when(d.rlike(r"^\+[0-9]{1,3}[0-9]{7,14}$"), "international")
        .when(F.char_length(d) < 8, "partial")
        .otherwise("invalid")
    )


def valid_phone(text: Column) -> Column:
    return ~phone_kind(text).isin("partial", "invalid")


def date_kind(text: Column, as_of_year: int) -> Column:
    """date or year where it's accepted, else the reason why not. The year is a parameter: plans don't read clocks."""
    number = F.when(text.rlike("^[0-9]{4}$"), text.cast("int"))
    out = (
        F.when(text.rlike(rf"(?i)^({STATES})\s*[0-9]{{4}}$"), "state_postcode")
        .when(text.rlike("^0[0-9]{3}$"), "phone_prefix")
        .when(text.rlike("^[0-9]{4}-[0-9]{4}$"), "phone_suffix")
        .when(text.rlike(r"^0[0-9]{1,3}\s+[0-9]{3,4}(\s+[0-9]{3,4})?$"), "phone_fragment")
        .when(number.between(1900, as_of_year + 5), "year")
        .when(number.between(800, 9999), "postcode")
        .when(number.isNotNull(), "number")
        .when(text.rlike("^[0-9]{10}$"), "medicare_number")
    )
    for shape in DATE_SHAPES:
        out = out.when(text.rlike(f"(?iUd){shape}"), "date")
    return out.when(text.rlike(r"(?i)^[0-9]+\s+(day|week|month|year)s?$"), "duration").when(text.rlike(r"^(1[38]00\s+[0-9]{3}\s+[0-9]{3}|13[0-9]{2}\s+[0-9]{2})$"), "service_number").otherwise("unknown")


def valid_date(text: Column, as_of_year: int) -> Column:
    return date_kind(text, as_of_year).isin("date", "year")


def postcode_state(text: Column) -> Column:
    """The state of a four-digit postcode, null where there's none."""
    n = F.when(text.rlike("^[0-9]{4}$"), text.cast("int"))
    out = None
    for state, ranges in POSTCODES.items():
        for lo, hi in ranges:
            out = F.when(n.between(lo, hi), state) if out is None else out.when(n.between(lo, hi), state)
    return out


def number_kind(text: Column, as_of_year: int, context: Column | None = None) -> Column:
    """symbol, word or invalid for what is no number; else what sort of number it is."""
    low = F.lower(context) if context is not None else F.lit("")
    holds = lambda *words: low.rlike("|".join(re.escape(w) for w in words))
    return (
        F.when(text == "#", "symbol")
        .when(F.lower(text).isin("quarter", "half", "third"), "word")
        .when(F.when(text.rlike("^[0-9]{4}$"), text.cast("int")).between(1900, as_of_year + 5), "year")
        .when(holds("street", " st ", "road", " rd ", "avenue", " ave "), "street_number")
        .when(holds("medicare") & (F.char_length(text) == 10), "medicare_number")
        .when(holds("policy", "claim", "reference"), "reference_number")
        .when(holds("days", "weeks", "months", "years"), "duration_number")
        .when(text.rlike("^[0-9]+$"), "generic_number")
        .otherwise("invalid")
    )


def valid(entity_type: Column, text: Column, as_of_year: int) -> Column:
    """Whether a candidate passes its type's validator; types without one pass."""
    return (
        F.when(entity_type == "DATE", valid_date(text, as_of_year))
        .when(entity_type == "NUMBER", ~number_kind(text, as_of_year).isin("symbol", "word", "invalid"))
        .when(entity_type == "AU_PHONE", valid_phone(text))
        .when(entity_type == "AU_MEDICARE", valid_medicare(text))
        .when(entity_type == "AU_TFN", valid_tfn(text))
        .when(entity_type == "AU_ABN", valid_abn(text))
        .when(entity_type == "CREDIT_CARD", valid_card(text))
        .otherwise(True)
    )


def pattern_errors(definition: dict[str, Any]) -> dict[str, str]:
    """What is wrong with a pattern definition, by field; empty if nothing is."""
    errors = {}
    kind = definition.get("entity_type")
    if not kind or not str(kind).strip():
        errors["entity_type"] = "entity_type is required"
    elif kind != kind.upper():
        errors["entity_type"] = "entity_type must be uppercase"
    if not definition.get("patterns"):
        errors["patterns"] = "patterns is required"
    elif bad := [p for p in definition["patterns"] if not _compiles(p)]:
        errors["patterns"] = f"not a regex: {bad[0]}"
    if not all(isinstance(c, str) for c in definition.get("context") or []):
        errors["context"] = "context must be a list of strings"
    return errors


def _compiles(regex: Any) -> bool:
    try:
        return bool(re.compile(regex))
    except (re.error, TypeError):
        return False


def examined(pattern: str, positive: list[str], negative: list[str]) -> dict[str, Any]:
    """How a regex does on examples that it should and shouldn't find."""
    if not _compiles(pattern):
        return {"is_valid": False, "error": "not a regex"}
    found = re.compile(pattern).search
    hit, miss = [x for x in positive if found(x)], [x for x in positive if not found(x)]
    false, right = [x for x in negative if found(x)], [x for x in negative if not found(x)]
    precision, recall = len(hit) / max(1, len(hit) + len(false)), len(hit) / max(1, len(positive))
    return {
        "is_valid": not miss and not false, "positive_matches": hit, "positive_non_matches": miss, "negative_matches": false, "negative_non_matches": right,
        "metrics": {"true_positives": len(hit), "false_negatives": len(miss), "false_positives": len(false), "true_negatives": len(right), "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0},
    }
