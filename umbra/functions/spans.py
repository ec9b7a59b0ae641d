"""Span extraction as one Catalyst expression: where a regex matches, in code points, without leaving the JVM.

regexp_replace brackets each match with private-use characters, a plain split cuts there, and a fold over the pieces
adds up their lengths. A capture group must end its regex but for zero-width parts (every built-in one does), so its
start is the match's end less its length; other regexes go the Arrow way (umbra.operators.arrow).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.catalog import Scan

OPEN, MID, SHUT = "\ue000", "\ue001", "\ue002"
SPAN = "array<struct<start:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, which an expression that names a Column twice doesn't promise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """The text with the three marker characters replaced one for one, so that offsets hold."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + MID + SHUT, "\ufffd" * 3)


def java(regex: str, ignore_case: bool = False) -> str:
    """The regex with Unicode classes and only line feeds as line ends, as the catalogue's patterns mean them."""
    return f"(?Ud{'iu' if ignore_case else ''}){regex}"


def spans(text: Column, regex: str, grouped: bool, ignore_case: bool = False) -> Column:
    """array<struct<start, end>> of a cleaned text's leftmost non-overlapping matches: of the group, else of the whole."""
    marked = F.regexp_replace(text, F.lit(java(regex, ignore_case)), F.lit(f"{OPEN}$0{MID}{'$1' if grouped else '$0'}{SHUT}"))
    parts = F.split(marked, OPEN)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        whole = F.char_length(F.substring_index(part, MID, 1))
        held = F.char_length(F.substring_index(F.substring_index(part, SHUT, 1), MID, -1))
        rest = F.char_length(F.substring_index(part, SHUT, -1))
        end = acc.at + whole
        hit = F.struct((end - held).alias("start"), end.alias("end"))
        return F.when(F.contains(part, F.lit(SHUT)), F.struct((end + rest).alias("at"), F.concat(acc.out, F.array(hit)).alias("out"))).otherwise(F.struct((acc.at + F.char_length(part)).alias("at"), acc.out.alias("out")))

    return F.aggregate(parts, zero, step, lambda acc: acc.out)


def gated(text: Column, found: Column, gate: str | None, digit: Column) -> Column:
    """The spans, looked for only in texts that can hold any."""
    none = F.array().cast(SPAN)
    if gate is None:
        return found
    return F.when(digit if gate == "digit" else F.contains(text, F.lit(gate)), found).otherwise(none)


CANDIDATE = "array<struct<ordinal:int,entity_type:string,score:double,start:int,end:int>>"


#: Letters that match another letter when case is ignored though lower() leaves them apart.
ODD_CASE = "[\u0130\u0131\u017f\u212a]"


def candidates(text: Column, digit: Column, scans: list[Scan]) -> Column:
    """All scans' candidates of a cleaned text as one array; scans of one regex and case share their evaluation.

    A regex is run only over texts that hold one of the literals which any match of it must hold and as many digits as it
    takes, as in umbra.operators.arrow."""
    from umbra.operators.arrow import least_digits, literals

    shared: dict[tuple, list[Scan]] = {}
    for s in scans:
        shared.setdefault((s.regex, s.ignore_case, s.gate), []).append(s)
    if not shared:
        return F.array().cast(CANDIDATE)

    def found(x: Column) -> Column:
        arrays = []
        for (regex, ignore, gate), group in shared.items():
            hits = F.transform(gated(x.text, spans(x.text, regex, group[0].grouped, ignore), gate, x.digit), _tagger(group))
            needs, least = literals(regex, ignore), least_digits(regex)
            may = x.digits >= least if least else F.lit(True)
            if needs and all(w.isascii() for w in needs):
                held = x.odd
                for w in sorted(needs):
                    held = held | F.contains(x.low, F.lit(w))
                may = may & held
            arrays.append(F.when(may, F.flatten(hits)).otherwise(F.array().cast(CANDIDATE)))
        return F.flatten(F.array(*arrays))

    return let(F.struct(text.alias("text"), digit.alias("digit"), F.lower(text).alias("low"), F.regexp_count(text, F.lit(r"\p{Nd}")).alias("digits"), text.rlike(ODD_CASE).alias("odd")), found)


def _tagger(group: list[Scan]):
    """A span as one candidate of each scan of a group."""

    def tag(x: Column) -> Column:
        return F.array(*[F.struct(F.lit(s.ordinal).alias("ordinal"), F.lit(s.entity_type).alias("entity_type"), F.lit(s.score).alias("score"), x["start"].alias("start"), x["end"].alias("end")) for s in group])

    return tag
