"""The entity catalogue: types in registration order, their regexes, priorities and word lists.

A catalogue is plain data on the driver. Operators fold it into the plan as literals; pruning it prunes the plan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

# Results depend on these patterns, lists and numbers being exactly so, in this order.

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
AU_PHONE = [
    r"\b(?:\+61|0)4\d{2}[\s-]?\d{3}[\s-]?\d{3}\b",
    r"\b(?:\+61|0)[2378][\s-]?\d{4}[\s-]?\d{4}\b",
    r"\(\d{2}\)\s*\d{4}[\s-]?\d{4}\b",
    r"\b13\d{2}\s*\d{2}\b",
    r"\b1300\s*\d{3}\s*\d{3}\b",
    r"\b1800\s*\d{3}\s*\d{3}\b",
]
FILLER = r"(?:\s+(?:is|was|number|no\.?)){0,2}[\s:#]*"
TFN = rf"(?:TFN|Tax\s+File\s+Number){FILLER}(\d{{3}}\s*\d{{3}}\s*\d{{3}})\b"
MEDICARE = r"Medicare(?:\s+(?:card|number|no\.?|is|was)){0,2}[\s:#]*([2-6]\d{3}\s*\d{5}\s*\d{1})\b"
ABN = rf"(?:ABN|Australian\s+Business\s+Number){FILLER}(\d{{2}}\s*\d{{3}}\s*\d{{3}}\s*\d{{3}})\b"
ACN = rf"(?:ACN|Australian\s+Company\s+Number){FILLER}(\d{{3}}\s*\d{{3}}\s*\d{{3}})\b"
PASSPORT = rf"(?:Passport|Passport\s+Number){FILLER}([A-Z][0-9]{{7}})\b"
CRN = rf"(?:CRN|Centrelink\s+Reference\s+Number){FILLER}(\d{{3}}\s*\d{{3}}\s*\d{{3}}[A-Z]?)\b"
STATES = "NSW|VIC|QLD|WA|SA|TAS|NT|ACT"
STREETS = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Drive|Dr\.?|Lane|Ln\.?|Place|Pl\.?|Court|Ct\.?|Crescent|Cres\.?|Cr\.?|Boulevard|Blvd\.?|Parade|Pde\.?|Highway|Hwy\.?|Close|Cl\.?|Terrace|Tce\.?|Way)\.?,?"
POSTCODE = r"(?:0[289]\d{2}|[1-9]\d{3})\b"
MAKES = "Toyota|Honda|Mazda|Ford|Hyundai|Kia|Nissan|Volkswagen|BMW|Mercedes|Audi|Holden"
DAY = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}"
NAME = r"[A-Z][a-z]+\s+[A-Z][a-z]+"
AFTER_NAME = r"(?=\s+(?:Subject|Re|Regarding|For|About|Status|Case|Date|Time|Matter|Issue|Type|Category)(?:\s|:|$))"
FIRM = r"[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*"

DEFINITIONS: list[tuple[str, list[str], list[str]]] = [
    ("AU_TFN", [TFN], ["tax", "file", "number", "TFN"]),
    ("AU_PHONE", AU_PHONE, ["phone", "mobile", "call", "contact", "telephone", "ph", "tel"]),
    ("AU_MEDICARE", [r"\b[2-6]\d{3}\s*\d{5}\s*\d{1}\b", MEDICARE], ["medicare", "health", "card", "insurance"]),
    ("AU_DRIVERS_LICENSE", [r"\b[A-Z]{2,3}\d{5,8}\b", r"\b(?:License|Licence):\s*[A-Z0-9]{5,10}\b"], ["license", "licence", "driver", "driving"]),
    (
        "AU_ADDRESS",
        [
            rf"\b\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})?\s+(?:[A-Z][A-Za-z]*\s+){{1,4}}{STREETS}\s+(?:[A-Z][A-Za-z]*\s*){{1,3}},?\s*(?:{STATES})(?:\s+\d{{4}})?\b",
            rf"(?i)\b\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})?\s+(?:[A-Za-z]+\s+){{1,4}}{STREETS}\s+(?:[A-Za-z]+\s*){{1,3}},?\s*(?:{STATES})\s+\d{{4}}\b",
        ],
        ["address", "street", "road", "suburb", "live", "residence"],
    ),
    (
        "AU_POSTCODE",
        [
            rf"(?i)(?<=(?:NSW|VIC|QLD|TAS|ACT)\s){POSTCODE}",
            rf"(?i)(?<=(?:WA|SA|NT)\s){POSTCODE}",
            rf"(?i)(?<=postcode\s){POSTCODE}",
            rf"(?i)(?<=post\scode\s){POSTCODE}",
            rf"(?i)(?<=postal\scode\s){POSTCODE}",
        ],
        ["postcode", "postal", "code", "zip", "post code"],
    ),
    ("AU_BSB", [r"\b\d{3}-\d{3}\b", r"BSB\s*:\s*(\d{3}-\d{3})\b", r"BSB\s*(?:Number|#)?\s*:\s*(\d{3}-\d{3})\b", r"(?:Bank\s+State\s+Branch|BSB)\s*(?:Code|Number)?[:\s]*(\d{3}-\d{3})\b"], ["bsb", "bank", "branch", "payment", "transfer"]),
    ("AU_ACCOUNT_NUMBER", [r"Account\s*(?:Number|#)?\s*:\s*(\d{4,10})\b", r"(?:Bank\s+)?Account\s*(?:Number|No\.?|#)?\s*:\s*(\d{4}\s+\d{4})\b", r"(?:account|acct)\s*(?:number|#)?[:\s]*(\d{4,10})\b"], ["account", "bank", "payment", "deposit", "transfer"]),
    ("AU_ABN", [ABN], ["abn", "australian business number", "business", "company"]),
    ("AU_ACN", [ACN], ["acn", "australian company number", "company"]),
    ("AU_PASSPORT", [r"\b[A-Z][0-9]{7}\b", r"\b[A-Z]{2}[0-9]{6}\b", PASSPORT], ["passport", "travel", "document"]),
    ("AU_CENTRELINK_CRN", [r"\b\d{3}\s*\d{3}\s*\d{3}[A-Z]?\b", CRN], ["centrelink", "crn", "reference", "welfare"]),
    (
        "VEHICLE_REGISTRATION",
        [
            r"\b(?!AU-\d+\b)(?!NSW|VIC|QLD|WA|SA|TAS|NT|ACT\b)(?!(?:DOB|PLC|LLC|ABN|ACN|TFN|VIN|REF|POL|CRN|BSB|GST|SSN|TIN|NIN)(?:\b|\d))(?![A-Z]{1,3}\s+\d{3}-\d{2}-\d{4}\b)(?=[A-Z0-9-\s]*\d\b)[A-Z]{1,3}[-\s]?[A-Z0-9]{2,3}[-\s]?[A-Z0-9]{1,3}\b",
            r"\b(?:Registration|Rego)(?:\.|\:|\s)+\s*([A-Z0-9]{1,3}[-\s]?[A-Z0-9]{1,3}[-\s]?[A-Z0-9]{1,3})\b",
            r"\brego\s+([A-Z0-9]{1,3}[-\s]?[A-Z0-9]{1,3}[-\s]?[A-Z0-9]{1,3})\b",
            r"\b(?!(?:DOB|PLC|LLC|ABN|ACN|TFN|VIN|REF|POL|CRN|BSB|GST)\d)[A-Z]{2,3}\d{2,3}[A-Z]?\b",
            r"\b\d{1,3}[A-Z]{2,3}\b",
        ],
        ["registration", "rego", "vehicle", "car", "plate", "number plate"],
    ),
    ("INSURANCE_POLICY_NUMBER", [r"\b(?:POL|P|Policy)[- ]?\d{6,9}\b", r"\bAU[-\s]*\d{5,10}\b"], ["policy", "insurance", "coverage", "insured"]),
    ("INSURANCE_CLAIM_NUMBER", [r"\b(?:CLM|CL|C)[- ]?\d{6,9}\b"], ["claim", "incident", "accident", "reference"]),
    ("VEHICLE_VIN", [r"\b[A-HJ-NPR-Z0-9]{17}\b"], ["vin", "vehicle", "identification", "number", "chassis"]),
    ("INVOICE_NUMBER", [r"\bINV-\d{4,10}\b", r"\b(?:Quote|Invoice)\s*(?:#|Number):\s*[A-Za-z0-9-]{4,15}\b", r"\bQ-\d{4}\b"], ["invoice", "quote", "billing", "payment", "receipt"]),
    ("BROKER_CODE", [r"\bBRK-[0-9]{4}\b", r"\bBroker\s*(?:Code|ID):\s*[A-Z0-9-]{4,10}\b"], ["broker", "agent", "representative", "intermediary"]),
    ("VEHICLE_DETAILS", [rf"\b(?:{MAKES})\s+[A-Za-z0-9]+\s+\d{{4}}\b", rf"\b\d{{4}}\s+(?:{MAKES})\s+[A-Za-z0-9]+\b"], ["vehicle", "car", "make", "model", "year"]),
    ("INCIDENT_DATE", [rf"(?i)\bon\s+({DAY})\b", rf"(?i)\bDate of (?:incident|accident|loss|event):\s*({DAY})\b"], ["date", "occurred", "happened", "incident", "accident"]),
    (
        "NAME_CONSULTANT",
        [f"{who}\\s*:\\s*({NAME}){end}" for end in (AFTER_NAME, "$") for who in (r"(?:Diary\s+)?Assigned\s+To", "(?:Consultant|Agent|Handler|Officer)", "(?:Representative|Rep|Contact)")],
        ["assigned", "consultant", "agent", "handler", "officer", "representative"],
    ),
    ("PERSON", [rf"\b{NAME}\b", rf"\bName:\s*{NAME}\b", rf"\bCustomer:\s*{NAME}\b"], ["name", "person", "customer", "insured", "patient"]),
    ("EMAIL_ADDRESS", [EMAIL], ["email", "contact", "mail", "@"]),
    ("DATE_OF_BIRTH", [rf"\bDOB:\s*({DAY})\b", rf"\bDate of Birth:\s*({DAY})\b", rf"\bBirth Date:\s*({DAY})\b"], ["dob", "birth", "date", "born"]),
    (
        "LOCATION",
        [
            rf"\b(?:Sydney|Melbourne|Brisbane|Perth|Adelaide|Hobart|Canberra|Darwin)(?:,\s*(?:{STATES}))?\b",
            r"\b(?:New South Wales|Victoria|Queensland|Western Australia|South Australia|Tasmania|Northern Territory|Australian Capital Territory)\b",
        ],
        ["location", "city", "state", "place", "at"],
    ),
    ("DATE", [rf"\b{DAY}\b"], ["date", "on", "when", "time", "day"]),
    ("MONEY_AMOUNT", [r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b"], ["amount", "payment", "cost", "price", "value"]),
    (
        "ORGANIZATION",
        [
            r"\b(?:Insurance|Insurances|Bank|Financial|Services|Motors|Mechanics)\b",
            r"\b[A-Z][a-z]+\s+(?:Insurance|Bank|Financial|Services|Motors|Mechanics)\b",
            rf"\b{FIRM}\s+(?:Pty|Proprietary)\s+Ltd\b",
            rf"\b{FIRM}\s+Limited\b",
            rf"\b{FIRM}\s+(?:Inc|LLC|LLP|Corp|Corporation)\b",
            rf"Payee\s*(?:Name)?\s*:\s*({FIRM}(?:\s+(?:Pty\s+Ltd|Limited|Inc|LLC))?)\b",
            rf"(?:Company|Business|Firm)\s*(?:Name)?\s*:\s*({FIRM})\b",
        ],
        ["company", "organization", "business", "firm", "payee", "vendor", "supplier"],
    ),
    ("TIME", [r"(?<![/\d])\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s*[AaPp]\.?[Mm]\.?)?\b"], ["time", "at", "scheduled", "appointment", "by"]),
    ("ISO_DATETIME", [r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"], ["timestamp", "logged", "occurred", "audit", "event"]),
    ("PHONE_INTL", [r"(?<!\d)\+\d{1,3}[\s.\-()]*\d[\d\s.\-()]{6,18}\d(?!\d)", r"(?<!\d)00\d{1,3}[\s.\-()]+\d[\d\s.\-()]{6,16}\d(?!\d)", r"(?<!\d)\(\d{3,4}\)[\s.\-]?\d{3,4}[\s.\-]?\d{4,7}\b"], ["phone", "mobile", "tel", "contact", "international"]),
    ("US_SSN", [r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"], ["ssn", "social", "security", "tax id"]),
    ("CREDIT_CARD", [r"\b(?:\d[ -]?){12,18}\d\b"], ["card", "credit", "visa", "mastercard", "amex", "payment"]),
]
#: Well-known formats that are scanned beside the catalogue: type, regexes, score, ignoring case.
IDENTIFIER = r"([A-Z0-9-]*\d[A-Z0-9-]*)"
FORMATS: list[tuple[str, list[str], float, bool]] = [
    ("EMAIL_ADDRESS", [EMAIL], 0.95, False),
    ("AU_PHONE", AU_PHONE, 0.92, False),
    ("INSURANCE_CLAIM_NUMBER", [rf"(?:Claim|CL|CLM)[#:\-\s]+{IDENTIFIER}", rf"(?:Claim\s+(?:Number|Reference|ID|#))[#:\-\s]+{IDENTIFIER}"], 0.9, True),
    ("INSURANCE_POLICY_NUMBER", [rf"(?:Policy|POL)[#:\-\s]+{IDENTIFIER}", rf"(?:Policy\s+(?:Number|ID|#))[#:\-\s]+{IDENTIFIER}"], 0.9, True),
    ("VEHICLE_REGISTRATION", [rf"(?:Registration|Rego|REG)[#:\-\s]+{IDENTIFIER}", rf"(?:Vehicle\s+(?:Registration|Rego|REG))[#:\-\s]+{IDENTIFIER}"], 0.9, True),
    ("VEHICLE_VIN", [r"(?:VIN|Vehicle\s+Identification\s+Number)[#:\-\s]+([A-Z0-9]{17})"], 0.9, True),
    ("AU_TFN", [TFN], 0.93, True),
    ("AU_MEDICARE", [MEDICARE], 0.93, True),
    ("AU_ABN", [ABN], 0.93, True),
    ("AU_ACN", [ACN], 0.93, True),
    ("AU_DRIVERS_LICENSE", [r"(?:Driver\'?s?\s+License|Licence|DL)[:\s#]*([A-Z0-9]{6,10})\b", r"(?:NSW|VIC|QLD|SA|WA|TAS|NT|ACT)\s+License[:\s]*(\d{6,10})\b"], 0.93, True),
    ("AU_PASSPORT", [PASSPORT], 0.93, True),
    ("AU_CENTRELINK_CRN", [CRN], 0.93, True),
]
CATALOGUE_SCORE, THRESHOLD = 0.85, 0.7
PRIORITY: dict[str, int] = {
    "AU_MEDICARE": 100, "AU_TFN": 100, "AU_ABN": 100, "AU_ACN": 100, "US_SSN": 100, "INSURANCE_POLICY_NUMBER": 95, "INSURANCE_CLAIM_NUMBER": 95, "EMAIL_ADDRESS": 90, "AU_PHONE": 85, "PHONE_INTL": 85, "CREDIT_CARD": 85,
    "AU_DRIVERS_LICENSE": 80, "AU_PASSPORT": 80, "AU_CENTRELINK_CRN": 80, "PERSON": 70, "DATE_OF_BIRTH": 75, "AU_ADDRESS": 60, "ADDRESS": 60, "ISO_DATETIME": 55, "LOCATION": 50, "INCIDENT_DATE": 45, "DATE": 40, "TIME": 35,
    "AU_POSTCODE": 30, "NUMBER": 20, "VEHICLE_REGISTRATION": 15, "FACILITY": 10, "PRODUCT": 10,
}
UNLISTED_PRIORITY = 75
NEVER_ABSORBED = ["AU_POSTCODE"]
CONTAINERS = [
    "DATE_OF_BIRTH", "INCIDENT_DATE", "ISO_DATETIME", "AU_TFN", "AU_ABN", "AU_ACN", "AU_MEDICARE", "AU_CENTRELINK_CRN", "AU_PHONE", "PHONE_INTL", "US_SSN", "CREDIT_CARD", "EMAIL_ADDRESS", "AU_ADDRESS", "ADDRESS", "AU_PASSPORT",
    "AU_DRIVERS_LICENSE", "AU_BSB", "AU_ACCOUNT_NUMBER", "INSURANCE_POLICY_NUMBER", "INSURANCE_CLAIM_NUMBER", "VEHICLE_VIN", "VEHICLE_REGISTRATION",
]
LABEL_BEFORE: dict[str, str] = {
    "AU_TFN": r"(?:\btfn|\btax\s+file\s+number)(?:\s+(?:is|was|number|no\.?)){0,2}\s*[:#]?\s*$",
    "AU_CENTRELINK_CRN": r"(?:\bcrn|\bcentrelink(?:\s+reference)?(?:\s+number)?)(?:\s+(?:is|was)){0,1}\s*[:#]?\s*$",
    "AU_ABN": r"(?:\babn|\baustralian\s+business\s+number)(?:\s+(?:is|was|number|no\.?)){0,2}\s*[:#]?\s*$",
    "AU_ACN": r"(?:\bacn|\baustralian\s+company\s+number)(?:\s+(?:is|was|number|no\.?)){0,2}\s*[:#]?\s*$",
    "AU_MEDICARE": r"\bmedicare(?:\s+(?:card|number|no\.?|is|was)){0,2}\s*[:#]?\s*$",
    "US_SSN": r"(?:\bssn|\bsocial\s+security(?:\s+number)?)(?:\s+(?:is|was)){0,1}\s*[:#]?\s*$",
}
LABEL_WINDOW, FALSE_WINDOW, CONTEXT_WINDOW = 48, 30, 50
LABEL_TEXTS = ["ref number", "reference number", "policy number", "claim number"]
LABEL_SUFFIXES = ["number", "ref", "#", "id", "identifier"]
DATE_SHAPE = rf"^{DAY}$"
STATE_POSTCODE = rf"\b(?:{STATES})\s+\d{{3,4}}\b"
STREET_SUFFIXES = [" st", " street", " rd", " road", " ave", " avenue", " dr", " drive", " ln", " lane", " pl", " place", " ct", " court", " cr", " crescent", " mall"]
CITIES = ["sydney", "melbourne", "brisbane", "perth", "adelaide", "hobart", "canberra", "darwin", "newcastle", "wollongong", "geelong", "cairns", "townsville"]
PERSON_ACRONYMS = ["vin", "abn", "acn", "tfn", "plc", "llc", "gst", "bsb", "crn", "dob", "doi", "ref", "pol", "id"]
PERSON_LABELS = [
    "email", "phone", "mobile", "address", "subject", "tel", "fax", "claim", "claims", "policy", "vehicle", "residential", "patient", "customer", "insured", "director", "policyholder", "contact", "ref", "reference", "number",
    "date", "time", "dob", "doi", "medicare", "matter", "issue", "category", "type", "status",
]
CONTEXT_FALSE: dict[str, list[str]] = {
    "DATE": [rf"(?:{STATES})\s*$", r"(?:phone|mobile|contact|ph|tel)[\s:]*$", r"medicare[\s:]*$"],
    "NUMBER": [r"#\s*$", r"(?:quarter|half|third)\s+panel"],
    "PERSON": [r"(?:lives?\s+(?:at|on)|address)[\s:]*\d+\s*$", r"(?:policy|claim)[\s#:]*$"],
}
CONTEXT_BEFORE: dict[str, list[str]] = {
    "AU_MEDICARE": [r"medicare\s*(?:number|#|:)?\s*$", r"health\s+card\s*(?:number|#|:)?\s*$"],
    "AU_TFN": [r"(?:tfn|tax\s+file\s+number)\s*(?:#|:)?\s*$"],
    "AU_ABN": [r"(?:abn|australian\s+business\s+number)\s*(?:#|:)?\s*$"],
    "AU_PHONE": [r"(?:phone|ph|tel|telephone|mobile|mob|contact)\s*(?:number|#|:)?\s*$"],
    "INSURANCE_POLICY_NUMBER": [r"policy\s*(?:number|#|:)?\s*$"],
    "INSURANCE_CLAIM_NUMBER": [r"claim\s*(?:number|#|:)?\s*$"],
    "DATE_OF_BIRTH": [r"(?:dob|date\s+of\s+birth|birth\s+date)\s*(?:#|:)?\s*$"],
    "AU_POSTCODE": [r"(?:postcode|post\s+code|zip)\s*(?:#|:)?\s*$"],
    "EMAIL_ADDRESS": [r"(?:email|e-mail)\s*(?:address)?\s*(?:#|:)?\s*$"],
}
CONTEXT_AFTER: dict[str, list[str]] = {"AU_MEDICARE": [r"^\s*(?:for|is|was)"]}
CONTEXT_WITHIN: dict[str, list[str]] = {"AU_POSTCODE": [rf"\b(?:{STATES})\s+\d{{4}}\b"]}
CONTEXT_WORDS: dict[str, list[str]] = {
    "AU_MEDICARE": ["medicare", "health card", "medical"],
    "AU_TFN": ["tfn", "tax file", "tax number"],
    "AU_ABN": ["abn", "business number", "australian business"],
    "AU_ACN": ["acn", "company number", "australian company"],
    "AU_PHONE": ["phone", "mobile", "contact", "call", "tel", "ph"],
    "AU_DRIVERS_LICENSE": ["license", "licence", "driver", "driving"],
    "AU_POSTCODE": ["postcode", "postal", "zip"],
    "VEHICLE_REGISTRATION": ["rego", "registration", "vehicle", "car"],
    "DATE_OF_BIRTH": ["dob", "birth", "born"],
    "INSURANCE_POLICY_NUMBER": ["policy", "insurance"],
    "INSURANCE_CLAIM_NUMBER": ["claim", "case"],
    "EMAIL_ADDRESS": ["email", "mail"],
    "AU_BSB_ACCOUNT": ["bsb", "account", "bank"],
}
PATTERN_BOOST, WORD_BOOST = 0.2, 0.1
POSTCODES: dict[str, list[tuple[int, int]]] = {
    "NSW": [(1000, 2599), (2619, 2899), (2921, 2999)], "VIC": [(3000, 3999), (8000, 8999)], "QLD": [(4000, 4999), (9000, 9999)], "SA": [(5000, 5999)], "WA": [(6000, 6999)], "TAS": [(7000, 7999)], "NT": [(800, 899)],
    "ACT": [(200, 299), (2600, 2618), (2900, 2920)],
}
TFN_WEIGHTS, ABN_WEIGHTS = [1, 4, 3, 7, 5, 8, 6, 9, 10], [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]

# End of fixed values.

#: Types whose every catalogue regex needs a digit, so that texts without one skip their scans.
_LETTERS_ALLOWED = {"PERSON", "LOCATION", "ORGANIZATION", "NAME_CONSULTANT", "EMAIL_ADDRESS", "MONEY_AMOUNT", "VEHICLE_REGISTRATION", "AU_DRIVERS_LICENSE", "INVOICE_NUMBER", "BROKER_CODE", "VEHICLE_VIN"}


@dataclass(frozen=True)
class Scan:
    """One regex of one source, with the order in which its candidates count."""

    entity_type: str
    regex: str
    score: float
    ordinal: int
    ignore_case: bool = False
    gate: str | None = None  # "digit", or a literal that the text must hold

    @property
    def grouped(self) -> bool:
        return re.compile(self.regex).groups > 0


@dataclass(frozen=True)
class Definition:
    """A registered type: its regexes, context words, name, score and what it is about."""

    entity_type: str
    patterns: list[str]
    context: list[str] = field(default_factory=list)
    name: str = ""
    score: float = 0.85
    language: str = "en"
    description: str = ""


class Catalogue:
    """Definitions in registration order; a type's last place gives its priority bonus."""

    def __init__(self, definitions: list[Definition] | None = None):
        self.definitions = [Definition(t, list(p), list(c)) for t, p, c in DEFINITIONS] if definitions is None else list(definitions)

    def add(self, definition: Definition) -> Catalogue:
        """A catalogue with one more definition; the same regexes of a type are registered once."""
        known = {(d.entity_type, r) for d in self.definitions for r in d.patterns}
        valid = [r for r in definition.patterns if (definition.entity_type, r) not in known and compiles(r)]
        return Catalogue([*self.definitions, replace(definition, patterns=valid)]) if valid else self

    def types(self) -> list[str]:
        return sorted({d.entity_type for d in self.definitions} | {t for t, *_ in FORMATS})

    def effective(self, entity_type: str, base: dict[str, int] | None = None) -> float:
        """Priority with the bonus of later registration."""
        places = [i for i, d in enumerate(self.definitions) if d.entity_type == entity_type]
        bonus = places[-1] / max(len(self.definitions), 1) * 10 if places else 0.0
        return (base or PRIORITY).get(entity_type, UNLISTED_PRIORITY) + bonus

    def scans(self, active: set[str] | None = None, threshold: float = THRESHOLD, adjust: dict[str, float] | None = None) -> list[Scan]:
        """The scans that a plan needs: types that aren't asked for and sources whose score can't reach the threshold are left out."""
        out, ordinal = [], 0
        for d in self.definitions:
            for r in d.patterns:
                gate = None
                if (d.entity_type, d.patterns) in _BUILT_IN:
                    gate = {"EMAIL_ADDRESS": "@", "MONEY_AMOUNT": "$"}.get(d.entity_type, None if d.entity_type in _LETTERS_ALLOWED else "digit")
                out.append(Scan(d.entity_type, r, CATALOGUE_SCORE, ordinal, gate=gate))
                ordinal += 1
        for t, patterns, score, ignore in FORMATS:
            for r in patterns:
                gate = "@" if t == "EMAIL_ADDRESS" else None if t in ("AU_DRIVERS_LICENSE", "VEHICLE_VIN") else "digit"
                out.append(Scan(t, r, score, ordinal, ignore, gate))
                ordinal += 1
        adjust = adjust or {}
        scored = [replace(s, score=min(1.0, s.score + adjust[s.entity_type])) if s.entity_type in adjust else s for s in out]
        return [s for s in scored if (not active or s.entity_type in active) and s.score >= threshold]

    def save(self, path: str | Path) -> int:
        keys = ("entity_type", "patterns", "context", "name", "score", "language", "description")
        Path(path).write_text(json.dumps([{k: getattr(d, k) for k in keys} for d in self.definitions], indent=2))
        return len(self.definitions)

    def load(self, path: str | Path) -> tuple[Catalogue, int]:
        """This catalogue with a file's definitions, and how many it holds; a file that isn't there holds none."""
        if not Path(path).exists():
            return self, 0
        rows, out = json.loads(Path(path).read_text()), self
        for r in rows:
            out = out.add(Definition(**{k: v for k, v in r.items() if k in Definition.__dataclass_fields__}))
        return out, len(rows)


_BUILT_IN = [(t, p) for t, p, _ in DEFINITIONS]


def compiles(regex: str) -> bool:
    try:
        re.compile(regex)
    except (re.error, TypeError):
        return False
    return True


def terminal_group(regex: str) -> bool:
    """Whether a regex's only group ends it but for zero-width parts, which the in-plan scan relies on."""
    if re.compile(regex).groups == 0:
        return True
    if re.compile(regex).groups > 1:
        return False
    depth, start, k = 0, -1, 0
    while k < len(regex):
        if regex[k] == "\\":
            k += 2
            continue
        if regex[k] == "[":
            k = regex.index("]", k + 2)
        elif regex[k] == "(":
            if regex[k : k + 2] != "(?" and start < 0:
                start = depth
            depth += 1
        elif regex[k] == ")":
            depth -= 1
            if depth == start:
                return re.fullmatch(r"(\\b|\$|\(\?[=!].*\))*", regex[k + 1 :]) is not None
        k += 1
    return False
