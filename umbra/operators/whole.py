"""Detection of whole rows inside one Arrow pass: scan, arbitration, absorption and context of a text at once.

The same spans as umbra.operators.detect finds, row by row and without their scores; nothing is shuffled, so it serves what
is counted where it is found (umbra.plans.gold). Of texts of plain ASCII, RE2 says over a whole batch which regexes match at
all, where first and how often, and Python's regexes only look there; other texts go through all regexes that
umbra.operators.arrow would try.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from umbra.functions import catalog as C
from umbra.functions.catalog import Catalogue
from umbra.functions.validators import DATE_SHAPES
from umbra.operators import named
from umbra.operators.arrow import Gates
from umbra.operators.detect import AS_OF_YEAR

#: A candidate: start, end, ordinal, type, rank (priority with bonus and score).
Candidate = tuple[int, int, int, str, float]
#: Texts in which RE2 and Python mean the same by every class, border and case.
PLAIN = r"[^\n\t -~]"
#: Java's end of input without (?d): before a last line end of any kind, too.
_END = "(?=(?:\\r\\n|[\\n\\r\\u0085\\u2028\\u2029])?\\Z)"


def _java(regex: str, flags: int = re.ASCII) -> re.Pattern[str]:
    """A regex as Java takes it without flags: classes of ASCII, and all line ends before the end of input."""
    return re.compile(regex.replace("$", _END), flags)


def _any(patterns: list[str]) -> re.Pattern[str]:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE)


_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_SPACES = re.compile(rf"^{_SPACE}|{_SPACE}\Z")
_SUFFIX, _ENDS = _java(f"({'|'.join(C.LABEL_SUFFIXES)})$"), (*C.LABEL_SUFFIXES, *"\n\r\x85\u2028\u2029")
_STREET = _java(f"({'|'.join(C.STREET_SUFFIXES)})$")
_DATE_SHAPE, _STATE_POSTCODE, _DIGIT, _WORD = re.compile(C.DATE_SHAPE), re.compile(C.STATE_POSTCODE), re.compile(r"\d"), re.compile(r"\S+")
_NO_PERSON = {"medicare", *C.CITIES, *C.PERSON_ACRONYMS}
_LABELS = {k: _any([v]) for k, v in C.LABEL_BEFORE.items()}
_FALSE = {k: _any(v) for k, v in C.CONTEXT_FALSE.items()}
_GAP, _PHONE_GAP, _CARD_GAP = (re.compile(r, re.ASCII) for r in (r"\s+", r"[\s\-()]+", r"[\s-]+"))
_TFN, _ABN, _MEDICARE, _CARD = (_java(r) for r in ("^[0-9]{9}$", "^[0-9]{11}$", "^[2-6][0-9]{8}[1-9]$", "^[0-9]{13,19}$"))
_PHONES = [_java(r) for r in (r"^(\+61|0)4[0-9]{8}$", r"^(\+61|0)[2378][0-9]{8}$", r"^(13[0-9]{4}|1300[0-9]{6}|1800[0-9]{6})$")]
_ABROAD = _java(r"^\+[0-9]{1,3}[0-9]{7,14}$")
_NO_DATE = [_java(rf"^({C.STATES})\s*[0-9]{{4}}$", re.ASCII | re.IGNORECASE), *(_java(r) for r in ("^0[0-9]{3}$", "^[0-9]{4}-[0-9]{4}$", r"^0[0-9]{1,3}\s+[0-9]{3,4}(\s+[0-9]{3,4})?$"))]
_YEAR, _TEN = _java("^[0-9]{4}$"), _java("^[0-9]{10}$")
_DATES = [re.compile(s, re.IGNORECASE) for s in DATE_SHAPES]


def stripped(text: str) -> str:
    return _SPACES.sub("", text.lower())


@lru_cache(1 << 16)
def false_person(text: str) -> bool:
    low, up = stripped(text), text.upper()
    first = _WORD.match(low)
    return (
        low.startswith(("policy", "ref", "claim")) or up.startswith(("POL-", "CL-", "CLM-")) or "number" in low or _STREET.search(low) is not None or low in _NO_PERSON or _DATE_SHAPE.search(low) is not None
        or _STATE_POSTCODE.search(text) is not None or (_DIGIT.match(text) is not None and " " in text) or (first[0] if first else "") in C.PERSON_LABELS
    )


def _weighted(digits: str, weights: list[int], less: int = 0) -> int:
    return sum((int(d) - (less if i == 0 else 0)) * w for i, (d, w) in enumerate(zip(digits, weights)))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _valid_date(text: str, as_of_year: int) -> bool:
    if any(r.search(text) for r in _NO_DATE):
        return False
    if _YEAR.search(text):
        return 1900 <= int(text) <= as_of_year + 5
    return not _TEN.search(text) and any(r.search(text) for r in _DATES)


def _valid_phone(text: str) -> bool:
    d = _PHONE_GAP.sub("", text)
    return any(r.search(d) for r in _PHONES) or d in ("000", "112", "106") or _ABROAD.search(d) is not None


@lru_cache(1 << 16)
def valid(kind: str, text: str, as_of_year: int = AS_OF_YEAR) -> bool:
    """Whether a candidate passes its type's validator, as umbra.functions.validators.valid."""
    if kind == "DATE":
        return _valid_date(text, as_of_year)
    if kind == "AU_PHONE":
        return _valid_phone(text)
    if kind == "CREDIT_CARD":
        d = _CARD_GAP.sub("", text)
        return _CARD.search(d) is not None and _luhn(d)
    d = _GAP.sub("", text)
    if kind == "AU_MEDICARE":
        return _MEDICARE.search(d) is not None
    if kind == "AU_TFN":
        return _TFN.search(d) is not None and _weighted(d, C.TFN_WEIGHTS) % 11 == 0
    return _ABN.search(d) is not None and _weighted(d, C.ABN_WEIGHTS, 1) % 89 == 0


_CHECKED = {"DATE", "AU_PHONE", "CREDIT_CARD", "AU_MEDICARE", "AU_TFN", "AU_ABN"}
_LEVELS = sorted({C.PRIORITY.get(t, C.UNLISTED_PRIORITY) for t in C.CONTAINERS})
#: How many levels a container of a type reaches, from the lowest, and a type's own place among them.
_REACHES = {t: bisect_left(_LEVELS, C.PRIORITY.get(t, C.UNLISTED_PRIORITY)) + 1 for t in C.CONTAINERS}
_LEVEL: dict[str, int] = {}


def loose(regex: str) -> tuple[str | None, bool]:
    """A regex that RE2 takes and that matches wherever this one does, None where there is none; and whether it is the same.

    What a regex looks behind at where it begins is taken along; other look-around and ends of input are left out."""
    out, k, same = [], 0, True
    while k < len(regex):
        c = regex[k]
        if c == "\\":
            out.append(regex[k : k + 2])
            k += 2
        elif c == "[":
            end = regex.index("]", k + 2)
            out.append(regex[k : end + 1])
            k = end + 1
        elif c == "$":
            k, same = k + 1, False
        elif re.match(r"\(\?<?[=!]", regex[k:]):
            end = _closed(regex, k)
            if regex.startswith("(?<=", k) and "".join(out) in ("", "(?i)"):
                out.append(f"(?:{regex[k + 4 : end]})")
            k, same = end + 1, False
        else:
            out.append(c)
            k += 1
    said = "".join(out)
    try:
        pc.match_substring_regex(pa.array(["x"]), said)
    except pa.ArrowInvalid:
        return None, False
    return said, same


def _closed(regex: str, k: int) -> int:
    """Where the group that opens at k closes."""
    depth = 0
    while True:
        if regex[k] == "\\":
            k += 1
        elif regex[k] == "[":
            k = regex.index("]", k + 2)
        elif regex[k] in "()":
            depth += 1 if regex[k] == "(" else -1
            if depth == 0:
                return k
        k += 1


class Scanner:
    """All scans of a catalogue over batches of texts, and what is found of their candidates."""

    def __init__(self, catalogue: Catalogue | None = None, as_of_year: int = AS_OF_YEAR):
        catalogue = catalogue or Catalogue()
        self.as_of_year, scans = as_of_year, catalogue.scans()
        self.rank = {t: catalogue.effective(t) for t in {*catalogue.types(), *C.PRIORITY}}
        self.gates = Gates(scans)
        known = sum(len(d.patterns) for d in catalogue.definitions)
        #: Of each scan: ordinal, type, rank, and whether label words are dropped.
        self.marks = [(s.ordinal, s.entity_type, self.rank.get(s.entity_type, float(C.UNLISTED_PRIORITY)) + s.score, s.ordinal < known) for s in scans]
        groups: dict[tuple[str, bool], list[int]] = {}
        for k, s in enumerate(scans):
            groups.setdefault((s.regex, s.ignore_case), []).append(k)
        #: (scans' numbers, the regex, its form for RE2, whether that is the same); what matches passes its scans' gates
        self.groups = [(ks, re.compile(r, re.IGNORECASE if i else 0), *loose(f"(?i){r}" if i else r)) for (r, i), ks in groups.items()]
        self.group_of = {k: g for g, (ks, *_) in enumerate(self.groups) for k in ks}
        self.hits: list[int] | None = None

    def _tagged(self, out: list[Candidate], text: str, ks: Iterable[int], spans: Iterable[tuple[int, int]]) -> None:
        for a, b in spans:
            low = text[a:b].lower()
            label = low in C.LABEL_TEXTS
            for k in ks:
                ordinal, kind, rank, catalogued = self.marks[k]
                if not (catalogued and (label or (kind == "PERSON" and ("number" in low or low.startswith(("ref", "policy", "claim")))))):
                    out.append((a, b, ordinal, kind, rank))

    def candidates(self, texts: Sequence[str]) -> list[list[Candidate]]:
        """The candidates of each text (cleaned)."""
        out: list[list[Candidate]] = [[] for _ in texts]
        said = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(said, PLAIN).to_numpy(zero_copy_only=False)
        left: dict[int, list[int]] = {g: [] for g, x in enumerate(self.groups) if x[2] is None}
        for i in np.flatnonzero(odd).tolist():
            self._by_python(out[i], texts[i], None)
        plain = np.flatnonzero(~odd)
        said = said.take(pa.array(plain)) if len(plain) < len(texts) else said
        if left:
            for i in plain.tolist():
                self._by_python(out[i], texts[i], left)
        for g, rows in self._matching(said):
            ks, rx, form, same = self.groups[g]
            some = said if rows is None else said.take(pa.array(rows))
            first = pc.find_substring_regex(some, form).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(first >= 0)
            self.hits[g] += len(hit)
            if not len(hit):
                continue
            times = pc.count_substring_regex(some.take(pa.array(hit)), form).to_pylist() if same else [None] * len(hit)
            for i, at, n in zip(plain[hit if rows is None else rows[hit]].tolist(), first[hit].tolist(), times):
                text = texts[i]
                # a loose form takes along what is looked behind at, so no match begins before its own
                spans = [rx.match(text, at)] if n == 1 else islice(rx.finditer(text, at), n)
                self._tagged(out[i], text, ks, [m.span(1) if m.lastindex else m.span() for m in spans])
        return out

    def _by_python(self, out: list[Candidate], text: str, only: dict[int, list[int]] | None) -> None:
        opened: dict[int, list[int]] = {}
        for k in self.gates.open(text):
            if only is None or self.group_of[k] in only:
                opened.setdefault(self.group_of[k], []).append(k)
        for g, ks in opened.items():
            self._tagged(out, text, ks, [m.span(1) if m.lastindex else m.span() for m in self.groups[g][1].finditer(text)])

    def _matching(self, said: pa.Array, many: int = 8) -> Iterator[tuple[int, np.ndarray | None]]:
        """(group, rows that may match, None for all): groups that no batch before has had are asked for several at once."""
        every = [g for g, x in enumerate(self.groups) if x[2] is not None]
        first, self.hits = self.hits is None, self.hits or [0] * len(self.groups)
        rare = [] if first else [g for g in every if self.hits[g] == 0]
        for k in range(0, len(rare), many):
            some = rare[k : k + many]
            rows = np.flatnonzero(pc.match_substring_regex(said, "|".join(f"(?:{self.groups[g][2]})" for g in some)).to_numpy(zero_copy_only=False))
            if len(rows):
                yield from ((g, rows) for g in some)
        yield from ((g, None) for g in every if g not in rare)

    def entities(self, text: str, found: list[Candidate], strict_suffix: bool = True) -> list[tuple[str, int, int]]:
        """(type, start, end) of what is left of a text's candidates, by start and then the wider first."""
        spans: dict[tuple[int, int], list[Candidate]] = {}
        for c in found:
            spans.setdefault((c[0], -c[1]), []).append(c)
        reach, out = [-1] * len(_LEVELS), []
        for a, e in sorted(spans):
            b = -e
            best = self._winner(text, a, b, spans[a, e], strict_suffix)
            if best is None:
                continue
            i = _LEVEL.get(best)
            if i is None:
                i = _LEVEL[best] = bisect_left(_LEVELS, C.PRIORITY.get(best, C.UNLISTED_PRIORITY))
            inside = i < len(reach) and reach[i] >= b
            for j in range(_REACHES.get(best, 0)):
                if reach[j] < b:
                    reach[j] = b
            if (not inside or best in C.NEVER_ABSORBED) and not (best in _FALSE and self._refuted(best, text, a, b)):
                out.append((best, a, b))
        return out

    def _ok(self, kind: str, said: str) -> bool:
        return kind not in _CHECKED or valid(kind, said, self.as_of_year)

    @staticmethod
    def _label(kind: str, text: str, a: int) -> bool:
        return kind in _LABELS and _LABELS[kind].search(text[max(a - C.LABEL_WINDOW, 0) : a]) is not None

    def _winner(self, text: str, a: int, b: int, rows: list[Candidate], strict_suffix: bool) -> str | None:
        """The type that arbitration leaves of a span's candidates, of which no two share an ordinal."""
        said, kind = text[a:b], rows[0][3]
        many = len(rows) > 1
        if many and strict_suffix and (low := said.lower()).endswith(_ENDS) and _SUFFIX.search(low):
            return None
        if many and _DATE_SHAPE.search(said):
            rows = [c for c in rows if c[3] not in ("ORGANIZATION", "LOCATION")]
        elif all(c[3] == kind for c in rows):  # whichever comes first must be valid or labelled
            if kind == "PERSON":
                return None if false_person(said) else kind
            return kind if self._ok(kind, said) or self._label(kind, text, a) else None
        if any(c[3] == "PERSON" for c in rows) and false_person(said):
            other = min((c for c in rows if c[3] != "PERSON"), key=lambda c: c[2], default=None)
            return other[3] if other and (self._ok(other[3], said) or self._label(other[3], text, a)) else None
        told = [c for c in rows if self._label(c[3], text, a)] or [c for c in rows if self._ok(c[3], said)]
        return min(told, key=lambda c: (-c[4], c[2]))[3] if told else None

    @staticmethod
    def _refuted(kind: str, text: str, a: int, b: int) -> bool:
        if _FALSE[kind].search(stripped(text[max(a - C.FALSE_WINDOW, 0) : a])):
            return True
        return (kind == "DATE" and text[a:b] in ("NSW 2000", "VIC 3000", "QLD 4000")) or (kind == "NUMBER" and text[a:b] == "#")


@lru_cache(1)
def scanner() -> Scanner:
    """The catalogue's, once a process: it learns from batch to batch which regexes are rare, which changes no result."""
    return Scanner()


_NAME = _java(f"^(policy|ref|claim)|number|({'|'.join(C.STREET_SUFFIXES)})$")
_TAIL = re.compile(rf"(?<=\S)(?:\s+(?:{'|'.join(named.TRAILING)}))+\s*\Z", re.IGNORECASE)


def persons(scanner: Scanner, text: str, marked: Iterable[tuple[str, int, int]]) -> list[Candidate]:
    """Candidates of a tagger's PERSON spans, cleaned as umbra.operators.named.cleaned does."""
    out = {}
    for label, a, b in marked:
        said = text[a:b]
        if label != "PERSON" or _NAME.search(said.lower()) or not {w for w in re.split(r"\s+", said.lower()) if w}.isdisjoint(named.NO_PERSON):
            continue
        b = a + len(_TAIL.sub("", said))
        out[a, b] = (a, b, 1 << 20, "PERSON", scanner.rank["PERSON"] + named.MODEL_SCORE)
    return list(out.values())
