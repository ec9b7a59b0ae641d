"""Secret scanning with DataFrame functions only: candidates by pattern, a random forest against false positives.

Candidates are the password of a URL (user:password@), a quoted value of 8 or more characters of any kind after = or :,
and runs of 16 or more characters of a key's alphabet with a digit, or with a capital after a small letter.
Each gets numbers: length, classes and transitions between them, how likely its letter pairs are in the corpus's words,
how much of it dictionary words cover, distinct characters, entropy, its path, and the words beside it. Dictionary and
letter pairs are counted over all documents. A forest is trained by Spark on labelled findings and scores every
candidate inside the JVM.

Labelled findings are the caller's, or planted ones: random keys and passwords, and things that look like them, set into
lines and files of either kind, each with the label it was planted with. A quarter of either label stands in the other's
lines and paths, so neither the line nor the path is the label.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.shared import drop, written

_USERINFO = r"(?<=://[^\s:@/]{1,64}:)[^\s:@/]{3,}(?=@)"
_QUOTED = r"(?<=[=:]\s{0,3}[\"'])[^\s\"']{8,}(?=[\"'])"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Za-z+/_-]*[a-z][A-Z])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_-])"
CANDIDATE = f"{_USERINFO}|{_QUOTED}|{_RUN}"
#: Characters of text kept on either side of a candidate.
BESIDE = 48
#: Labelled findings that a fit takes at most, those of the smallest hash.
FIT_ROWS = 20_000
TREES, DEPTH = 30, 8
#: Planted findings that are learnt from where the caller has none, and what is planted.
PLANTED = 6000
#: Words of the dictionary: at least this share of all words of the corpus and this many times, so a million at most.
SHARE, TIMES = 1e-6, 2
#: Rows of a table of candidates that is broadcast at most.
BROADCAST_ROWS = 500_000
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "transitions", "likely", "hexadecimal", "distinct", "entropy", "coverage", "repeats", "path_test", "path_code", "key_word", "assigned", "quoted", "digest_word", "url", "odd", "userinfo")
_OPEN, _SHUT = "\ue000", "\ue001"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, path, start, end, candidate, before, after, text_hash) of every candidate; code points, end exclusive.

    Texts are scanned whole. Null and empty texts have none; repeated rows give repeated rows; a null path is empty.
    """
    said = F.translate(F.col(text), _OPEN + _SHUT, "??")
    rows = docs.where(F.col(text).rlike(CANDIDATE)).select(F.col(key).alias(key), (F.coalesce(path, F.lit("")) if path else F.lit("")).alias("path"), said.alias("said"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.split(F.regexp_replace(said, CANDIDATE, f"{_OPEN}$0{_SHUT}"), _OPEN).alias("parts"))
    rows = rows.withColumn("ends", F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(F.replace(p, F.lit(_SHUT), F.lit("")))))))
    each = F.transform(
        F.sequence(F.lit(2), F.size("parts")),
        lambda i: F.struct(
            F.element_at("ends", i).alias("start"),
            F.substring_index(F.element_at("parts", i), _SHUT, 1).alias("candidate"),
            F.left(F.substring_index(F.element_at("parts", i), _SHUT, -1), F.lit(BESIDE)).alias("after"),
            F.substring("said", F.greatest(F.element_at("ends", i) - BESIDE, F.lit(0)) + 1, F.least(F.element_at("ends", i), F.lit(BESIDE))).alias("before"),  # a name before = may be a candidate too
        ),
    )
    rows = rows.where(F.size("parts") > 1).select(key, "path", "text_hash", F.explode(each).alias("c")).select(key, "path", "text_hash", "c.*")
    return rows.select(key, "path", "start", (F.col("start") + F.char_length("candidate")).alias("end"), "candidate", "before", "after", "text_hash")


#: Words that stand in code and settings more than in prose; part of every dictionary.
CODE_WORDS = ("user", "name", "data", "file", "path", "index", "class", "value", "string", "number", "default", "config", "version", "service", "request", "response", "handler", "example", "sample", "test", "dummy", "placeholder", "change", "your", "api", "key", "token", "secret", "here", "password", "factory", "manager", "controller", "client", "server", "session", "message", "update", "create", "delete", "report", "account", "number", "total", "count")


def planted(spark, rows: int = PLANTED, seed: int = 0) -> DataFrame:
    """(n, text, path, start, end, label): findings with known labels, made from hashes of their number.

    Keys: hexadecimal, base64, prefixed or upper-case ones and passwords with punctuation, assigned with or without
    quotes, in URLs, headers or alone. Others: digests, commits and ids, in their usual lines or alone; numbers; names in
    camel case, paths and slugs made of words, plain quoted words; placeholders where a key would stand. A quarter of each
    stands in the other's lines, and paths lean to code for keys and to tests for others without deciding."""
    h = lambda k: f"sha2(concat('{seed}:{k}:', n), 256)"
    pick = lambda k, n: f"pmod(xxhash64('{seed}:{k}', n), {n})"
    array = lambda xs: "array(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" for x in xs) + ")"
    one = lambda xs, k: f"element_at({array(xs)}, 1 + cast({pick(k, len(xs))} as int))"
    b64 = lambda k: f"translate(base64(unhex({h(k)})), '=\\n', '')"
    upper = f"translate(substr({h('u')}, 1, 32), '0123456789abcdef', 'QZ3K7XWB5TN2MVHJ')"
    mixed = f"translate(substr({h('m')}, 1, 40), '0123456789abcdef', 'aQ7zK3xWb5TnM2vH')"
    odd = f"translate({h('odd')}, '0123456789abcdef', 'Zx9!kQ2#pL7$wE5%')"
    word = lambda k: one(CODE_WORDS, k)
    title = lambda k: f"initcap({word(k)})"
    keys = [f"substr({h('a')}, 1, 32)", f"substr({h('b')}, 1, 40)", h("c"), f"substr({b64('d')}, 1, 40)", f"concat('AKIA', substr({upper}, 1, 16))", f"concat('ghp_', substr({mixed}, 1, 36))", f"concat('sk_live_', substr({mixed}, 1, 24))", f"concat('xoxb-', substr({h('e')}, 1, 12), '-', substr({mixed}, 1, 24))", f"substr({mixed}, 1, 24)", f"substr({odd}, 1, 8 + cast({pick('len', 9)} as int))", f"substr({odd}, 20, 8 + cast({pick('len', 5)} as int))", f"concat({title('pw')}, {pick('pn', 9000)}, '!', substr({odd}, 40, 4))"]
    others = [
        f"substr({h('f')}, 1, 40)", h("g"), f"substr({h('i')}, 1, 32)", f"concat_ws('-', substr({h('j')}, 1, 8), substr({h('j')}, 9, 4), substr({h('j')}, 13, 4), substr({h('j')}, 17, 4), substr({h('j')}, 21, 12))",
        f"concat(cast(100000000 + {pick('k', 900000000)} as string), cast(100000000 + {pick('l', 900000000)} as string))", f"concat({word('o')}, {title('p')}, {title('q')}, {title('r')})", f"concat({word('s')}, '/', {word('t')}, '/', {word('v')}, {pick('w', 100)}, '/', {word('x')})",
        f"concat({word('y')}, '-', {word('z')}, '-', {word('aa')}, '-', {pick('ab', 3000)})", f"concat('your-', {word('ac')}, '-key-here-', {pick('ad', 10)})", "concat(repeat('x', 20), '1')", f"concat('change', {word('as')}, '-', {word('at')})", f"concat({word('ae')}, '_', {word('af')}, '_', {word('ag')}, {pick('ah', 20)})",
        f"concat({word('ai')}, '.', {word('aj')}, '.example.com')", f"concat({word('ak')}, {word('al')}, {word('am')})", f"concat('{{', {word('an')}, '.', {word('ao')}, '}}')", f"concat('v', {pick('ap', 20)}, '.', {pick('aq', 20)}, '.', {pick('ar', 20)}, '-beta')",
    ]
    lines = ['{name} = "', "{name}: '", "{name}=", "export {name}=", '"{name}": "', "Authorization: Bearer ", "https://host.example.com/v1?page=2&{name}=", "{name}: ", "postgres://app:", "https://deploy:", '{name} = "', '"{name}": "', "amqp://queue:"]
    alone = ["use ", "see ", "with ", "and then ", "of the ", ", "]
    names = ["token", "api_key", "API_KEY", "secret", "password", "AWS_SECRET_ACCESS_KEY", "auth_token", "clientSecret", "GITHUB_TOKEN", "private_key", "credential", "passwd"]
    plain = ["commit ", "see commit ", "sha256: ", "md5 ", "checksum=", 'integrity="', "revision ", "id = ", "uuid: ", "https://host.example.com/", "path = ", "import ", "call ", "number ", "order ", "ref: ", 'version = "', '"host": "', "name: '", 'etag: "', '"language": "', "cache_key = '", 'session: "', 'module = "']
    shut = lambda xs: [x for x in xs if x.endswith(('"', "'")) or re.search("://[a-z]+:$", x)]  # noqa: E731  lines for values that need an end mark
    first = f"replace(case when run then {one(lines, 'line')} else {one(shut(lines), 'line')} end, '{{name}}', {one(names, 'name')})"
    second = f"case when run then {one(plain, 'plain')} else {one(shut(plain), 'plain')} end"
    is_key = f"{pick('label', 2)} = 0"
    places = [others.index(x) for x in others if x.startswith(("concat('your-", "concat(repeat(", "concat('change'"))]
    placeholder = f"{pick('other', len(others))} in ({', '.join(map(str, places))})"
    df = spark.range(rows).select(F.col("id").alias("n"))
    value = f"case when {is_key} then {_chosen(keys, pick('key', len(keys)))} else {_chosen(others, pick('other', len(others)))} end"
    # a tenth of either kind stands in plain prose, a quarter in the other's lines; placeholders stand where keys do
    turned = f"({pick('turn', 4)} = 0)"
    before = f"case when run and {pick('alone', 10)} = 0 then {one(alone, 'alone')} when {placeholder} or ({is_key}) <> {turned} then {first} else {second} end"
    code, tests = ["src/settings.py", "deploy/.env", "app/config.yaml", "lib/client.ts", "run.sh"], ["tests/test_client.py", "docs/example.md", "fixtures/sample.json", "mocks/server.js"]
    path = f"case when {pick('bare', 3)} = 0 then '' when ({is_key}) <> ({pick('file', 3)} = 0) then {one(code, 'code')} else {one(tests, 'test')} end"
    df = df.select("n", F.expr(value).alias("value")).withColumn("run", F.col("value").rlike("^" + _RUN))
    df = df.select("n", "value", F.expr(before).alias("lead"), F.expr(is_key).cast("int").alias("label"), F.expr(path).alias("path"), F.expr(one(["and so on\n", "we went\n", "", "thus "], "host")).alias("host"))
    tail = F.when(F.col("lead").endswith('"'), '"').when(F.col("lead").endswith("'"), "'").when(F.col("lead").rlike("://[a-z]+:$"), "@db.example.com").otherwise("")
    text = F.concat("host", "lead", "value", tail, F.lit(" and more"))
    start = F.char_length("host") + F.char_length("lead")
    return df.select("n", text.alias("text"), "path", start.alias("start"), (start + F.char_length("value")).alias("end"), "label")


def _chosen(values: list[str], which: str) -> str:
    return f"case {which} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def learnt(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, float]]:
    """The dictionary (word) and log2 of each letter pair's share after its first letter, from all words of all documents.

    Words are runs of a-z in the lower-case text. The dictionary is written and holds 1 / SHARE words at most; pairs are
    at most 26 * 26 numbers."""
    ws = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ws = written(ws, "words")
    total = ws.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = ws.where((F.char_length("word") >= 3) & (F.col("n") >= F.greatest(F.lit(float(TIMES)), F.lit(SHARE * total)))).select("word")
    dictionary = written(often.unionByName(docs.sparkSession.createDataFrame([(w,) for w in CODE_WORDS], "word string")).distinct(), "dictionary")
    pairs = ws.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    seen = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    drop(ws)
    after = Counter()
    for pair, n in seen.items():
        after[pair[0]] += n
    letters = "abcdefghijklmnopqrstuvwxyz"
    return dictionary, {a + b: math.log2((seen.get(a + b, 0) + 0.5) / (after[a] + 13.0)) for a in letters for b in letters}


def described(found: DataFrame, dictionary: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """The findings with the forest's numbers; distinct candidates meet the dictionary once."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.char_length(c)
    parts = F.transform(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), lambda x: F.lower(x))
    each = found.select("candidate").distinct().select("candidate", F.explode(parts).alias("word")).where(F.char_length("word") >= 3)
    covered = written(each.join(F.broadcast(dictionary), "word").groupBy("candidate").agg(F.sum(F.char_length("word")).alias("covered")), "covered")
    found = found.join(F.broadcast(covered) if covered.count() <= BROADCAST_ROWS else covered, "candidate", "left")
    share = lambda rx: F.regexp_count(c, F.lit(rx)) / n
    flag = lambda col, rx: col.rlike(rx).cast("double")
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    counts = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
    entropy = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    table = F.from_json(F.lit(json.dumps(pairs)), "map<string,double>")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(low, i, F.lit(2))), F.lit(-8.0)))
    last_line = F.substring_index("before", "\n", -1)
    numbers: dict[str, Column] = {
        "length": n.cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "symbols": share("[+/_=-]"),
        "transitions": F.regexp_count(c, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[+/_=-])")) / n,
        "likely": F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / (n - 1),
        "hexadecimal": flag(c, "^[0-9a-fA-F]+$"), "distinct": F.size(F.array_distinct(letters)).cast("double"), "entropy": entropy,
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "repeats": flag(c, r"(.)\1{3}"),
        "path_test": flag(F.col("path"), "(?i)test|example|sample|mock|fixture|spec|doc"), "path_code": flag(F.col("path"), r"(?i)\.(py|js|ts|java|go|rb|env|ya?ml|json|conf|cfg|ini|sh|tf)$"),
        "key_word": flag(last_line, "(?i)(secret|token|passw|api[_-]?key|auth|credential|private)"), "assigned": flag(last_line, "[=:]\\s*[\"'`]?$"),
        "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
        "digest_word": flag(last_line, "(?i)(commit|sha-?[0-9]*|md5|digest|checksum|uuid|revision|integrity)"), "url": flag(last_line, r"(?i)(https?://|www\.)\S*$"),
        "odd": share("[^A-Za-z0-9+/_=-]"), "userinfo": (F.col("before").rlike(r"://[^\s:@/]+:$") & F.col("after").startswith("@")).cast("double"),
    }
    return found.select("*", *(F.round(numbers[f], 6).cast("double").alias(f) for f in FEATURES)).drop("covered")


def train(labelled: DataFrame, label: str = "label", rows: int = FIT_ROWS) -> RandomForestClassificationModel | float:
    """A forest from at most `rows` described findings with 0/1 labels; where there's one label only, that label."""
    some = labelled.where(F.col(label).isNotNull()).select(*FEATURES, F.col(label).cast("double").alias("label"), F.xxhash64("candidate", "before").alias("h")).orderBy("h", *FEATURES).limit(rows).persist()
    seen = [r["label"] for r in some.select("label").distinct().collect()]
    if len(seen) < 2:
        some.unpersist()
        return seen[0] if seen else 0.0
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", subsamplingRate=0.8, seed=7, cacheNodeIds=False)
    model = forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(some))
    some.unpersist()
    return model


def judged(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """Described findings with score (the forest's share for a secret) and predicted (score at least a half)."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
        scored = scored.withColumn("score", F.element_at(vector_to_array("probability"), 2)).drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Every candidate of docs: key, start, end, candidate, score, predicted, text_hash (xxhash64 of the row's text).

    labelled has (text, path, start, end, label) findings judged before; without it the planted ones are learnt. Null and
    empty texts have no candidate; long texts are scanned whole; repeated rows give repeated findings; equal scores are
    told apart by nothing, as predicted is a threshold; a null key is a key like others; the key may have any name and
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"), (F.col(path) if path else F.lit("")).alias("path"))
    found = written(candidates(rows, "__key", "text", "path"), "candidates")
    dictionary, pairs = learnt(rows)
    known = planted(spark).drop("n") if labelled is None else labelled
    numbered = written(known.select(F.xxhash64("text", "start").alias("n"), "text", "path", "start", "end", "label"), "findings")
    marks = candidates(numbered.dropDuplicates(["n"]), "n", "text", "path").join(numbered.select("n", "start", "end", "label").dropDuplicates(["n"]), ["n", "start", "end"])
    model = train(described(marks, dictionary, pairs))
    return judged(described(found, dictionary, pairs), model).select(F.col("__key").alias(key), "start", "end", "candidate", F.round("score", 6).alias("score"), "predicted", "text_hash")


def redacted(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with its own columns, the predicted secrets of scan() replaced wherever they stand in their row's text.

    Findings go to the rows of their key that have their text_hash, so keys may be null or repeat; a null text stays null;
    columns of any name stay as they are; an empty table gives no rows."""
    bad = findings.where("predicted = 1").groupBy(F.col(key).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.char_length(b) - F.char_length(a)).alias("__bad"))
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__hash"))
    joined = docs.join(bad, same, "left")
    new = F.aggregate(F.coalesce("__bad", F.array().cast("array<string>")), F.col(text), lambda acc, c: F.replace(acc, c, F.lit(mark)))
    return joined.withColumn(text, new).select(*docs.columns)
