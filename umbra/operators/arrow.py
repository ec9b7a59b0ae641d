"""The Arrow way to scan: Python's own regexes over batches, for patterns that Java or the in-plan form can't take."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import catalog as C
from umbra.functions.catalog import Catalogue, Scan

#: Letters that match another letter when case is ignored though lower() leaves them apart.
_ODD_CASE = re.compile("[\u0130\u0131\u017f\u212a]")
_DIGIT = re.compile(r"\d")
_MARKERS = dict.fromkeys((0xE000, 0xE001, 0xE002), "\ufffd")
SCHEMA = "ordinal int, entity_type string, score double, start int, end int, text string, before string, after string"


def clean(text: str) -> str:
    """The text with the three marker characters replaced, as umbra.functions.spans.clean does."""
    return text.translate(_MARKERS) if any(chr(c) in text for c in _MARKERS) else text


def literals(regex: str, ignore_case: bool = False) -> frozenset[str]:
    """Strings in lower case of which every match holds at least one; empty where the regex promises none.

    Walks the parsed regex: in a sequence the part whose shortest string is longest decides, of alternatives all count."""
    found = _needed(re._parser.parse(regex, re.IGNORECASE if ignore_case else 0))  # type: ignore[attr-defined]
    return frozenset(found or ())


def _needed(parsed) -> set[str] | None:
    options: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            options.append({run})
        run = ""

    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(value).lower()
            continue
        close()
        inner = None
        if name == "SUBPATTERN":
            inner = _needed(value[3])
        elif name == "BRANCH":
            parts = [_needed(p) for p in value[1]]
            inner = set().union(*parts) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _needed(value[2])
        elif name == "ATOMIC_GROUP":
            inner = _needed(value)
        elif name == "IN" and len(value) <= 3 and all(str(o) == "LITERAL" for o, _ in value):
            inner = {chr(v).lower() for _, v in value}
        if inner:
            options.append(inner)
    close()
    # one space or dash tells nothing
    good = [o for o in options if min(len(x.strip()) for x in o) > 0 and len(o) <= 40]
    return max(good, key=lambda o: min(len(x) for x in o)) if good else None


def needs_digit(regex: str) -> bool:
    """Whether every match holds a digit, or looks ahead at one."""
    return _digit_in(re._parser.parse(regex))  # type: ignore[attr-defined]


def _digit_in(parsed) -> bool:
    for op, value in parsed:
        name = str(op)
        if name == "IN" and all(str(o) == "CATEGORY" and str(v) == "CATEGORY_DIGIT" or str(o) == "RANGE" and 48 <= v[0] <= v[1] <= 57 or str(o) == "LITERAL" and 48 <= v <= 57 for o, v in value):
            return True
        if name == "LITERAL" and 48 <= value <= 57 or name == "SUBPATTERN" and _digit_in(value[3]) or name == "ASSERT" and value[0] == 1 and _digit_in(value[1]):
            return True
        if name == "BRANCH" and all(_digit_in(p) for p in value[1]) or name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0 and _digit_in(value[2]):
            return True
    return False


def least_digits(regex: str) -> int:
    """Digits that every match takes at least; 1 where it only looks ahead at one."""
    parsed = re._parser.parse(regex)  # type: ignore[attr-defined]
    return max(_digits(parsed), int(_digit_in(parsed)))


def _digits(parsed) -> int:
    count = 0
    for op, value in parsed:
        name = str(op)
        if name in ("IN", "LITERAL"):
            count += _digit_in([(op, value)])
        elif name == "SUBPATTERN":
            count += _digits(value[3])
        elif name == "BRANCH":
            count += min(_digits(p) for p in value[1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            count += value[0] * _digits(value[2])
        elif name == "ATOMIC_GROUP":
            count += _digits(value)
    return count


class Gates:
    """Which scans a text can match at all, by one pass over it: an automaton of all literals that scans need finds those
    that the text holds, and only scans with one of theirs, or without any, are left; of these, those that need more
    digits than the text has can't match."""

    def __init__(self, scans: list[Scan]):
        self.scans, self.always, self.by = scans, [], []
        self.digits = [least_digits(s.regex) for s in scans]
        place: dict[str, int] = {}
        for k, s in enumerate(scans):
            needs = literals(s.regex, s.ignore_case)
            for word in needs:
                if word not in place:
                    place[word] = len(self.by)
                    self.by.append([])
                self.by[place[word]].append(k)
            if not needs:
                self.always.append(k)
        self.found = ahocorasick.Automaton()
        for word, i in place.items():
            self.found.add_word(word, i)
        if place:
            self.found.make_automaton()

    def open(self, said: str) -> list[int]:
        """Numbers of the scans that may match, ascending."""
        digits = len(_DIGIT.findall(said))
        if _ODD_CASE.search(said) is not None:  # lower() doesn't show every letter that matches
            some = range(len(self.scans))
        else:
            left = set(self.always)
            for i in {i for _, i in self.found.iter(said.lower())} if self.by else ():
                left.update(self.by[i])
            some = sorted(left)
        gated = lambda g: g is None or (digits > 0 if g == "digit" else g in said)
        return [k for k in some if digits >= self.digits[k] and gated(self.scans[k].gate)]


def scanned(docs: DataFrame, catalogue: Catalogue, key: str = "doc_id", text: str = "text", active: set[str] | None = None, threshold: float = C.THRESHOLD, adjust: dict[str, float] | None = None, carry: tuple[str, ...] = (), skip: bool = True) -> DataFrame:
    """The same candidates as umbra.operators.detect.scanned, in the same columns.

    A regex is run over texts only that hold one of the literals which any match of it must hold, found from the regex
    itself: most of the catalogue is led by words that most texts lack. One automaton looks for all of them at once. A
    regex that several scans have is run over a text once."""
    scans = catalogue.scans(active, threshold, adjust)
    known = sum(len(d.patterns) for d in catalogue.definitions)
    rows = docs.select(F.col(key), *carry, F.col(text).alias("__text"))
    labels, kept = set(C.LABEL_TEXTS), [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:-1]

    def skipped(kind: str, said: str) -> bool:
        low = said.lower()
        return low in labels or (kind == "PERSON" and ("number" in low or low.startswith(("ref", "policy", "claim"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gates = Gates(scans)
        same = {(s.regex, s.ignore_case): k for k, s in enumerate(scans)}
        compiled = [(s, re.compile(s.regex, re.IGNORECASE if s.ignore_case else 0), same[s.regex, s.ignore_case]) for s in scans]
        for batch in batches:
            keys, found = [], []
            for i, said in enumerate(batch.column(len(kept)).to_pylist()):
                said, known_spans = clean(said or ""), {}
                for k in gates.open(said):
                    s, rx, of = compiled[k]
                    if of not in known_spans:
                        known_spans[of] = [m.span(1) if m.lastindex else m.span() for m in rx.finditer(said)]
                    for a, b in known_spans[of]:
                        if skip and s.ordinal < known and skipped(s.entity_type, said[a:b]):
                            continue
                        keys.append(i)
                        found.append((s.ordinal, s.entity_type, s.score, a, b, said[a:b], said[max(0, a - C.CONTEXT_WINDOW) : a], said[b : b + C.CONTEXT_WINDOW]))
            types = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            place = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(place) for k in range(len(kept))), *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], names=[*batch.schema.names[:-1], *(x.split()[0] for x in SCHEMA.split(", "))])

    return rows.mapInArrow(run, f"{', '.join(kept)}, {SCHEMA}")
