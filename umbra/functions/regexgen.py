"""Regexes from examples, at four levels of generality: none, low, medium, high. Runs on the driver."""

from __future__ import annotations

import os
import re
from itertools import groupby

# Formats that are recognised as such, in the order they are tried.
FORMATS = [
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    r"(\+\d{1,3}|\(\d{1,3}\))?\s*\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"(\d{1,3}\.){3}\d{1,3}",
    r"https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(/[^\s]*)?",
    r"[A-Z]{2,3}-\d{4,7}",
    r"\$\d{1,3}(,\d{3})*(\.\d{2})?",
]
# End of fixed values.

_CLASSES = ((str.isdigit, r"\d"), (lambda s: s.isalpha() and s.isupper(), "[A-Z]"), (lambda s: s.isalpha() and s.islower(), "[a-z]"), (str.isalpha, "[A-Za-z]"))


def from_examples(examples: list[str], level: str = "none") -> str:
    """A regex that matches the examples; ValueError without examples or for a level that isn't known."""
    if not examples:
        raise ValueError("At least one example string is required")
    makers = {"none": _exact, "low": _low, "medium": _medium, "high": _high}
    if level not in makers:
        raise ValueError(f"Unsupported generalization level: {level}")
    return makers[level](list(examples))


def _exact(examples: list[str]) -> str:
    return "|".join(f"({re.escape(x)})" for x in examples)


def _known(examples: list[str]) -> str | None:
    return next((f for f in FORMATS if all(re.fullmatch(f, x) for x in examples)), None)


def _class_of(parts: list[str]) -> str | None:
    """The narrowest character class of all the parts together."""
    return next((name for test, name in _CLASSES if all(map(test, parts))), None)


def _ends(examples: list[str], apart: bool) -> tuple[str, str]:
    """Common start and end; apart: an end that would overlap the start counts as none."""
    start = os.path.commonprefix(examples)
    end = os.path.commonprefix([x[::-1] for x in examples])[::-1]
    if apart and len(start) + len(end) > min(map(len, examples)):
        end = ""
    return start, end


def _low(examples: list[str]) -> str:
    if len(examples) == 1:
        return re.sub(r"\d+", r"\\d+", re.escape(examples[0]))
    start, end = _ends(examples, apart=False)
    if max(len(start), len(end)) < 2:
        return _exact(examples)
    middles = ["" if start + end == x else x[len(start) : len(x) - len(end)] for x in examples]
    said = [m for m in middles if m]
    kind = _class_of(said) if said else r"\d"
    if kind:
        inner = f"{kind}+"
    elif len(set(middles)) <= 3:
        inner = "(" + "|".join(f"({re.escape(m)})" for m in sorted(set(middles))) + ")"
    else:
        inner = ".*?"
    return re.escape(start) + inner + re.escape(end)


def _medium(examples: list[str]) -> str:
    if known := _known(examples):
        return known
    if len(examples) == 1:
        return _runs(examples[0])
    sizes = [len(x) for x in examples]
    if max(sizes) > 30 or 0 < min(sizes) * 2 < max(sizes):
        return _low(examples)
    start, end = _ends(examples, apart=True)
    parts = [p for p in (x[len(start) : len(x) - len(end)] for x in examples) if p]
    return re.escape(start) + (_between(parts) if parts else "") + re.escape(end)


def _between(parts: list[str]) -> str:
    lo, hi = min(map(len, parts)), max(map(len, parts))
    if kind := _class_of(parts):
        return f"{kind}{{{lo}}}" if lo == hi else f"{kind}+"
    if all(p.isalnum() for p in parts):
        return rf"\w{{{lo},{hi}}}" if hi - lo <= 2 else r"\w+"
    if len(set(parts)) <= 5:
        return "(?:" + "|".join(map(re.escape, sorted(set(parts)))) + ")"
    return ".+?"


def _runs(example: str) -> str:
    """One example as runs of character classes."""
    out = []
    for kind, run in groupby(example, lambda c: r"\s" if c.isspace() else _class_of([c]) or re.escape(c)):
        n = len(list(run))
        out.append(kind * n if kind == r"\s" or kind.removeprefix("\\") not in ("d", "[A-Z]", "[a-z]", "[A-Za-z]") else kind + (f"{{{n}}}" if n > 1 else ""))
    return "".join(out)


def _high(examples: list[str]) -> str:
    if known := _known(examples):
        return known
    if any(len(x) > 15 for x in examples):
        return _by_token(examples)
    start = os.path.commonprefix(examples)
    rest = os.path.commonprefix([x[len(start) :][::-1] for x in examples])[::-1]
    if len(start) >= 2 and len(rest) >= 2:
        parts = [p for p in (x[len(start) : len(x) - len(rest)] for x in examples) if p]
        return re.escape(start) + (_between(parts) if parts else "") + re.escape(rest)
    return _medium(examples)


def _by_token(examples: list[str]) -> str:
    """Long examples token by token: what is equal stays, what varies becomes its class."""
    rows = [re.findall(r"\s+|\w+|[^\w\s]", x) for x in examples]
    out = []
    for k in range(max(map(len, rows))):
        seen = [r[k] for r in rows if k < len(r)]
        lo, hi = min(map(len, seen)), max(map(len, seen))
        if len(set(seen)) == 1:
            piece = re.escape(seen[0])
        elif all(map(str.isdigit, seen)):
            piece = rf"\d{{{lo}}}" if lo == hi else rf"\d{{{lo},{hi}}}"
        elif kind := _class_of(seen):
            piece = f"{kind}+"
        elif all(map(str.isspace, seen)):
            piece = r"\s+"
        elif all(re.fullmatch(r"[^\w\s]", s) for s in seen):
            piece = f"[{''.join(re.escape(c) for c in sorted(set(seen)))}]" if len(set(seen)) <= 3 else r"[^\w\s]"
        else:
            piece = f".{{{lo}}}" if lo == hi <= 2 else r"\S+"
        short = [r for r in rows if k >= len(r)]
        out.append(f"(?:{piece})?" if short else piece)
    return "".join(out)
