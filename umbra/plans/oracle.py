"""SQL that says what the queries say, built from the same catalogue for another engine."""

from __future__ import annotations

from umbra.functions import catalog as C
from umbra.functions.catalog import Catalogue, Scan
from umbra.functions.validators import DATE_SHAPES
from umbra.operators.detect import AS_OF_YEAR

#: Types with a regex that the other engine's RE2 can't take (look-around); they are said by hand in AROUND and AT.
LOOKAROUND = ["AU_POSTCODE", "VEHICLE_REGISTRATION", "NAME_CONSULTANT", "TIME", "PHONE_INTL", "US_SSN"]
O, M, S = "chr(57344)", "chr(57345)", "chr(57346)"


#: Look-around regexes said without it: what stands before (kept), the span, what stands after (kept), by type in order.
_STATE, _CODE = r"(?:NSW|VIC|QLD|TAS|ACT)\s", r"(?:0[289][0-9]{2}|[1-9][0-9]{3})\b"
_WHO = [r"(?:Diary\s+)?Assigned\s+To", "(?:Consultant|Agent|Handler|Officer)", "(?:Representative|Rep|Contact)"]
_NAME = r"[A-Z][a-z]+\s+[A-Z][a-z]+"
_AFTER = r"\s+(?:Subject|Re|Regarding|For|About|Status|Case|Date|Time|Matter|Issue|Type|Category)(?:\s|:|$)"
AROUND: dict[str, list[tuple[str, str, str]]] = {
    "TIME": [("^|[^/0-9]", r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:\s*[AaPp]\.?[Mm]\.?)?\b", "")],
    "PHONE_INTL": [
        ("^|[^0-9]", r"\+[0-9]{1,3}[\s.\-()]*[0-9][0-9\s.\-()]{6,18}[0-9]", "$|[^0-9]"),
        ("^|[^0-9]", r"00[0-9]{1,3}[\s.\-()]+[0-9][0-9\s.\-()]{6,16}[0-9]", "$|[^0-9]"),
        ("^|[^0-9]", r"\([0-9]{3,4}\)[\s.\-]?[0-9]{3,4}[\s.\-]?[0-9]{4,7}\b", ""),
    ],
    "US_SSN": [("", r"\b(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})\b", "")],
    "AU_POSTCODE": [(f"(?i:{pre})", _CODE, "") for pre in (_STATE, r"(?:WA|SA|NT)\s", r"postcode\s", r"post\scode\s", r"postal\scode\s")],
    "NAME_CONSULTANT": [(rf"{who}\s*:\s*", _NAME, after) for after in (_AFTER, "$") for who in _WHO],
}

#: Regexes with look-ahead at the first character only, said as tests of the text from each word's first letter on: what
#: must match there, what must not, and the span.
_STATES = r"(?:NSW|VIC|QLD|WA|SA|TAS|NT|ACT\b)"
_SHORT = "DOB|PLC|LLC|ABN|ACN|TFN|VIN|REF|POL|CRN|BSB|GST"
AT: dict[str, list[tuple[list[str], list[str], str]]] = {
    "VEHICLE_REGISTRATION": [
        ([r"[A-Z0-9\-\s]*[0-9]\b"], [r"AU-[0-9]+\b", _STATES, rf"(?:{_SHORT}|SSN|TIN|NIN)(?:\b|[0-9])", r"[A-Z]{1,3}\s+[0-9]{3}-[0-9]{2}-[0-9]{4}\b"], r"[A-Z]{1,3}[-\s]?[A-Z0-9]{2,3}[-\s]?[A-Z0-9]{1,3}\b"),
        ([], [rf"(?:{_SHORT})[0-9]"], r"[A-Z]{2,3}[0-9]{2,3}[A-Z]?\b"),
    ],
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan(s: Scan, source: str, key: str = "doc_id", around: tuple[str, str, str] | None = None) -> str:
    """Candidates of one scan: the regex brackets its matches, a split cuts there, a window adds up lengths."""
    rx = f"(?i){s.regex}" if s.ignore_case else s.regex
    group = "'\\1'" if s.grouped else "'\\0'"
    marked = f"regexp_replace(text, {q(rx)}, {O} || '\\0' || {M} || {group} || {S}, 'g')"
    if s.entity_type in AROUND:
        pre, body, post = around or ("", "", "")
        rx = f"({pre})({body})({post})"
        marked = f"regexp_replace(text, {q(rx)}, '\\1' || {O} || '\\2' || {M} || '\\2' || {S} || '\\3', 'g')"
    return f"""
SELECT {key}, {s.ordinal} AS ordinal, '{s.entity_type}' AS entity_type, CAST({s.score} AS DOUBLE) AS score, CAST(e - length(g) AS INT) AS "start", CAST(e AS INT) AS "end", g AS txt, text
FROM (SELECT {key}, text, i, split_part(split_part(p, {S}, 1), {M}, 2) AS g,
    coalesce(sum(CASE WHEN i = 1 THEN length(p) ELSE length(split_part(p, {M}, 1)) + length(split_part(p, {S}, 2)) END) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(split_part(p, {M}, 1)) AS e
  FROM (SELECT {key}, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT {key}, text, string_split({marked}, {O}) AS ps FROM {source} WHERE regexp_matches(text, {q(rx)}))))
WHERE i > 1"""


def scan_at(s: Scan, source: str, key: str, rule: tuple[list[str], list[str], str]) -> str:
    """Candidates of a regex whose look-aheads all stand at its beginning: every place is tried, and of the places that
    match each is taken that begins where the one taken before has ended."""
    must, never, body = rule
    at_once = lambda r: q("^(?:" + r + ")")
    tests = [f"regexp_matches(rest, {at_once(r)})" for r in must] + [f"NOT regexp_matches(rest, {at_once(r)})" for r in never]
    words = q(chr(92) + "b([A-Z])")
    return f"""
SELECT {key}, {s.ordinal} AS ordinal, '{s.entity_type}' AS entity_type, CAST({s.score} AS DOUBLE) AS score, CAST(x.s AS INT) AS "start", CAST(x.e AS INT) AS "end", substr(text, x.s + 1, x.e - x.s) AS txt, text
FROM (SELECT {key}, any_value(text) AS text, unnest(list_reduce(list([{{'s': i, 'e': i + length(hit)}}] ORDER BY i), lambda a, b: CASE WHEN b[1].s >= a[len(a)].e THEN list_concat(a, b) ELSE a END)) AS x
  FROM (SELECT *, substr(text, CAST(i + 1 AS INT)) AS rest FROM (SELECT {key}, text, i, regexp_extract(substr(text, CAST(i + 1 AS INT), 20), {at_once(body)}) AS hit
    FROM (SELECT {key}, text, k, CAST(coalesce(sum(length(p)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS i
      FROM (SELECT {key}, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT {key}, text, string_split(regexp_replace(text, {words}, {O} || '\\1', 'g'), {O}) AS ps FROM {source} WHERE regexp_matches(text, {q(chr(92) + 'b(?:' + body + ')')}))))
    WHERE k > 1) WHERE hit <> '') WHERE {' AND '.join(tests)} GROUP BY {key})"""


def folded(items: str, priority: dict[str, int]) -> str:
    """Recursive CTEs up to `folded` (doc_id, items): the overlap fold over {items} (doc_id, item struct s, e, t, o, r), one step an item."""
    rank = lambda c: f"(CASE {c}.t " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in priority.items()) + " ELSE 0 END)"
    return f"""listed AS MATERIALIZED (SELECT doc_id, list(item ORDER BY item.s, item.e DESC, item.t) AS items FROM {items} GROUP BY doc_id),
steps AS (
  SELECT doc_id, 0 AS i, items[1:0] AS kept FROM listed
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN met IS NULL THEN list_append(kept, x)
      WHEN ({rank('x')} > {rank('met')} AND NOT (x.s >= met.s AND x.e <= met.e)) OR ({rank('x')} = {rank('met')} AND x.e - x.s > met.e - met.s)
      THEN list_append(list_filter(kept, lambda k: NOT (k.s = met.s AND k.e = met.e AND k.t = met.t)), x) ELSE kept END
  FROM (SELECT *, list_filter(kept, lambda k: x.s < k.e AND x.e > k.s)[1] AS met FROM (SELECT steps.doc_id, i, kept, items[i + 1] AS x FROM steps JOIN listed ON steps.doc_id = listed.doc_id WHERE i < len(items)))),
folded AS (SELECT steps.doc_id, kept AS items FROM steps JOIN listed ON steps.doc_id = listed.doc_id AND i = len(items))"""


def spliced(source: str) -> str:
    """A query of (doc_id, text, n_items): {source}'s texts with the items of `folded`, which don't overlap, written in."""
    return f"""each AS (SELECT doc_id, unnest(items) AS x FROM folded),
ordered AS (SELECT doc_id, x.s AS s, x.e AS e, x.r AS r, lag(x.e, 1, 0) OVER (PARTITION BY doc_id ORDER BY x.s) AS b FROM each),
joined AS (SELECT c.doc_id, string_agg(substr(c.text, o.b + 1, o.s - o.b) || o.r, '' ORDER BY o.s) || substr(any_value(c.text), max(o.e) + 1) AS text, count(*) AS n FROM {source} c JOIN ordered o ON c.doc_id = o.doc_id GROUP BY c.doc_id)
SELECT c.doc_id, coalesce(joined.text, c.text) AS text, CAST(coalesce(n, 0) AS INT) AS n_items FROM {source} c LEFT JOIN joined ON c.doc_id = joined.doc_id"""


def segments(source: str, most: int, overlap: int) -> str:
    """Recursive CTEs up to `segments` (doc_id, segment, text, start, end) of {source}: paragraphs packed one after the other."""
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"""paras AS MATERIALIZED (SELECT doc_id, text, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM {source} WHERE length(text) > {most}),
packed AS (
  SELECT doc_id, 0 AS i, '' AS now, 0::BIGINT AS pos, 0 AS n, CAST(NULL AS VARCHAR) AS seg, 0::BIGINT AS a, 0::BIGINT AS b FROM paras
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN whole THEN substr(now, cut + 1) || chr(10) || chr(10) || para WHEN now <> '' THEN now || chr(10) || chr(10) || para ELSE para END,
    CASE WHEN whole THEN pos + cut ELSE pos END, CASE WHEN whole THEN n + 1 ELSE n END, CASE WHEN whole THEN now END, pos, pos + length(now)
  FROM (SELECT packed.doc_id, i, now, pos, n, ps[i + 1] AS para, length(now) + length(ps[i + 1]) > {most} AND now <> '' AS whole, greatest(0, length(now) - {overlap}) AS cut
    FROM packed JOIN paras ON packed.doc_id = paras.doc_id WHERE i < len(ps))),
segments AS (
  SELECT doc_id, n - 1 AS segment, {strip('seg')} AS text, a AS "start", b AS "end" FROM packed WHERE seg IS NOT NULL
  UNION ALL SELECT packed.doc_id, n, {strip('now')}, pos, pos + length(now) FROM packed JOIN paras ON packed.doc_id = paras.doc_id AND i = len(ps) WHERE now <> ''
  UNION ALL SELECT doc_id, 0, text, 0, length(text) FROM {source} WHERE text <> '' AND length(text) <= {most})"""


def candidates(catalogue: Catalogue, types: list[str], source: str, key: str = "doc_id") -> str:
    known = sum(len(d.patterns) for d in catalogue.definitions)
    scans = catalogue.scans(set(types))
    of = {t: iter(rows) for t, rows in AROUND.items()}
    at = {t: iter(rows) for t, rows in AT.items()}

    def said(s: Scan) -> str:
        if s.entity_type in AT and "(?!" in s.regex:
            return scan_at(s, source, key, next(at[s.entity_type]))
        return scan(s, source, key, next(of[s.entity_type]) if s.entity_type in AROUND else None)

    every = "\nUNION ALL\n".join(map(said, scans))
    labels = ", ".join(map(q, C.LABEL_TEXTS))
    return f"""SELECT {key}, ordinal, entity_type, score, "start", "end", txt,
  substr(text, greatest("start" - {C.CONTEXT_WINDOW}, 0) + 1, least("start", {C.CONTEXT_WINDOW})) AS before, substr(text, "end" + 1, {C.CONTEXT_WINDOW}) AS after
FROM ({every})
WHERE NOT (ordinal < {known} AND (lower(txt) IN ({labels}) OR (entity_type = 'PERSON' AND (lower(txt) LIKE '%number%' OR regexp_matches(lower(txt), '^(ref|policy|claim)')))))"""


def weighted(digits: str, weights: list[int], less: int = 0) -> str:
    return " + ".join(f"(CAST(substr({digits}, {i + 1}, 1) AS INT) - {less if i == 0 else 0}) * {w}" for i, w in enumerate(weights))


def luhn(digits: str) -> str:
    return f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substr({digits}, i, 1) AS INT) ELSE (CAST(substr({digits}, i, 1) AS INT) * 2) % 10 + (CAST(substr({digits}, i, 1) AS INT) * 2) // 10 END)) % 10 = 0)"


def valid_tfn(t: str) -> str:
    d = f"regexp_replace({t}, '\\s+', '', 'g')"
    return f"CASE WHEN regexp_matches({d}, '^[0-9]{{9}}$') THEN ({weighted(d, C.TFN_WEIGHTS)}) % 11 = 0 ELSE false END"


def valid_abn(t: str) -> str:
    d = f"regexp_replace({t}, '\\s+', '', 'g')"
    return f"CASE WHEN regexp_matches({d}, '^[0-9]{{11}}$') THEN ({weighted(d, C.ABN_WEIGHTS, 1)}) % 89 = 0 ELSE false END"


def valid_medicare(t: str) -> str:
    return f"regexp_matches(regexp_replace({t}, '\\s+', '', 'g'), '^[2-6][0-9]{{8}}[1-9]$')"


def valid_card(t: str) -> str:
    d = f"regexp_replace({t}, '[\\s-]+', '', 'g')"
    return f"CASE WHEN regexp_matches({d}, '^[0-9]{{13,19}}$') THEN {luhn(d)} ELSE false END"


def phone_kind(t: str) -> str:
    d = f"regexp_replace({t}, '[\\s\\-()]+', '', 'g')"
    return f"CASE WHEN regexp_matches({d}, '^(\\+61|0)4[0-9]{{8}}$') THEN 'mobile' WHEN regexp_matches({d}, '^(\\+61|0)[2378][0-9]{{8}}$') THEN 'landline' WHEN regexp_matches({d}, '^(13[0-9]{{4}}|1300[0-9]{{6}}|1800[0-9]{{6}})$') THEN 'service' WHEN {d} IN ('000', '112', '106') THEN 'emergency' WHEN regexp_matches({d}, '^\\+[0-9]{{1,3}}[0-9]{{7,14}}$') THEN 'international' WHEN length({d}) < 8 THEN 'partial' ELSE 'invalid' END"


def date_kind(t: str) -> str:
    year = f"TRY_CAST(CASE WHEN regexp_matches({t}, '^[0-9]{{4}}$') THEN {t} END AS INT)"
    shapes = " OR ".join(f"regexp_matches({t}, {q('(?i)' + s)})" for s in DATE_SHAPES)
    return f"""CASE WHEN regexp_matches({t}, '(?i)^({C.STATES})\\s*[0-9]{{4}}$') THEN 'state_postcode' WHEN regexp_matches({t}, '^0[0-9]{{3}}$') THEN 'phone_prefix' WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{4}}$') THEN 'phone_suffix'
WHEN regexp_matches({t}, '^0[0-9]{{1,3}}\\s+[0-9]{{3,4}}(\\s+[0-9]{{3,4}})?$') THEN 'phone_fragment' WHEN {year} BETWEEN 1900 AND {AS_OF_YEAR + 5} THEN 'year' WHEN {year} BETWEEN 800 AND 9999 THEN 'postcode' WHEN {year} IS NOT NULL THEN 'number'
WHEN regexp_matches({t}, '^[0-9]{{10}}$') THEN 'medicare_number' WHEN {shapes} THEN 'date' WHEN regexp_matches({t}, '(?i)^[0-9]+\\s+(day|week|month|year)s?$') THEN 'duration'
WHEN regexp_matches({t}, '^(1[38]00\\s+[0-9]{{3}}\\s+[0-9]{{3}}|13[0-9]{{2}}\\s+[0-9]{{2}})$') THEN 'service_number' ELSE 'unknown' END"""


def valid(kind: str, t: str) -> str:
    return f"""CASE {kind} WHEN 'DATE' THEN {date_kind(t)} IN ('date', 'year') WHEN 'AU_PHONE' THEN {phone_kind(t)} NOT IN ('partial', 'invalid') WHEN 'AU_MEDICARE' THEN {valid_medicare(t)}
WHEN 'AU_TFN' THEN {valid_tfn(t)} WHEN 'AU_ABN' THEN {valid_abn(t)} WHEN 'CREDIT_CARD' THEN {valid_card(t)} ELSE true END"""


def false_person(t: str) -> str:
    low = f"trim(lower({t}))"
    names = ", ".join(map(q, ["medicare", *C.CITIES, *C.PERSON_ACRONYMS]))
    return f"""(regexp_matches({low}, '^(policy|ref|claim)') OR regexp_matches(upper({t}), '^(POL-|CL-|CLM-)') OR {low} LIKE '%number%' OR regexp_matches({low}, '({'|'.join(C.STREET_SUFFIXES)})$')
OR {low} IN ({names}) OR regexp_matches({low}, {q(C.DATE_SHAPE)}) OR regexp_matches({t}, {q(C.STATE_POSTCODE)}) OR (regexp_matches({t}, '^[0-9]') AND {t} LIKE '% %') OR regexp_extract({low}, '^(\\S+)', 1) IN ({', '.join(map(q, C.PERSON_LABELS))}))"""


def _any(t: str, patterns: list[str]) -> str:
    return f"regexp_matches({t}, {q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def _table(table: dict[str, list[str]], test, types: list[str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {test(v)}" for k, v in table.items() if k in types)
    return f"(CASE entity_type {arms} ELSE false END)" if arms else "false"


def detect(catalogue: Catalogue, types: list[str], source: str, key: str = "doc_id") -> str:
    """CTEs up to `entities` ({key}, entity_type, start, end, text, score)."""
    rank = " ".join(f"WHEN '{t}' THEN {catalogue.effective(t)!r}" for t in types)
    base = lambda c: f"(CASE {c} " + " ".join(f"WHEN '{t}' THEN {C.PRIORITY.get(t, C.UNLISTED_PRIORITY)}" for t in types) + f" ELSE {C.UNLISTED_PRIORITY} END)"
    span = f'OVER (PARTITION BY {key}, "start", "end")'
    strip = lambda c: f"trim(lower({c}))"
    near, before, after = strip(f"right(before, {C.FALSE_WINDOW})"), strip("before"), strip("after")
    whole = f"{before} || ' ' || txt || ' ' || {after}"
    shaped = " OR ".join([_table(C.CONTEXT_BEFORE, lambda v: _any(before, v), types), _table(C.CONTEXT_AFTER, lambda v: _any(after, v), types), _table(C.CONTEXT_WITHIN, lambda v: _any(whole, v), types)])
    worded = _table(C.CONTEXT_WORDS, lambda v: "(" + " OR ".join(f"contains({before}, {q(w)}) OR contains({after}, {q(w)})" for w in v) + ")", types)
    return f"""cand AS ({candidates(catalogue, types, source, key)}),
flagged AS (SELECT *, count(*) {span} > 1 AS many, {false_person("txt")} AS fp, {valid("entity_type", "txt")} AS ok, {_table({k: [v] for k, v in C.LABEL_BEFORE.items()}, lambda v: _any(f"right(before, {C.LABEL_WINDOW})", v), types)} AS labelled,
  CASE entity_type {rank} END + score AS prio FROM cand),
fits0 AS (SELECT * FROM flagged WHERE NOT (many AND regexp_matches(lower(txt), '({'|'.join(C.LABEL_SUFFIXES)})$')) AND NOT (many AND regexp_matches(txt, {q(C.DATE_SHAPE)}) AND entity_type IN ('ORGANIZATION', 'LOCATION'))),
fits1 AS (SELECT *, bool_or(entity_type = 'PERSON' AND fp) {span} AS person, bool_or(labelled) {span} AS named FROM fits0),
fits2 AS (SELECT *, row_number() OVER (PARTITION BY {key}, "start", "end" ORDER BY CASE WHEN person THEN 0.0 ELSE -prio END, ordinal) AS place FROM fits1
  WHERE CASE WHEN NOT many THEN NOT (entity_type = 'PERSON' AND fp) WHEN person THEN entity_type <> 'PERSON' WHEN named THEN labelled ELSE ok END),
won AS (SELECT * FROM fits2 WHERE place = 1 AND (ok OR labelled)),
kept AS (SELECT * FROM won w WHERE entity_type IN ({', '.join(map(q, C.NEVER_ABSORBED))}) OR NOT EXISTS (SELECT 1 FROM won o WHERE o.{key} = w.{key} AND o.entity_type IN ({', '.join(map(q, C.CONTAINERS))})
  AND o."start" <= w."start" AND w."end" <= o."end" AND o."end" - o."start" > w."end" - w."start" AND {base('w.entity_type')} <= {base('o.entity_type')})),
entities AS (SELECT {key}, entity_type, "start", "end", txt AS text, round(least(1.0, score + CASE WHEN {shaped} THEN {C.PATTERN_BOOST} ELSE 0.0 END + CASE WHEN {worded} THEN {C.WORD_BOOST} ELSE 0.0 END), 4) AS score
  FROM kept WHERE NOT ({_table(C.CONTEXT_FALSE, lambda v: _any(near, v), types)}))"""
