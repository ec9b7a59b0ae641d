"""The thin contract queries opN_<name> over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import chat, clusters, decontaminate, lattice, lzprint, machine, mixing, negatives, sanitise, secrets, setsketch, sstable, toxicity
from umbra.llm.shared import fold, fresh, ship, table

#: Domains of the mixing query and their target shares.
WEIGHTS = {"clean": 0.95, "low": 0.05}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels_of(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, label) of the rows of labels that may be learnt from: crc32(doc_id as text) mod 5 is not 0."""
    return table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col(label).alias("label"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): clean or low, by the quality label."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low").alias("domain"))


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lzprint.compared_with_next(table(spark, sf_dir, "documents"))


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    out = machine.score(docs, machine.fit(docs, labels_of(spark, sf_dir, "quality")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, labels_of(spark, sf_dir, "toxic")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "chance", F.size("passages").alias("n_passages"))


def op4_information_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sanitise.digested(sanitise.found(table(spark, sf_dir, "documents")))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    out = mixing.mixed(docs, mixing.fit(docs, domains(spark, sf_dir), list(WEIGHTS)), WEIGHTS)
    posterior = [F.round(F.element_at("p", k + 1), 6).alias(f"p_{name}") for k, name in enumerate(WEIGHTS)]
    return out.select("doc_id", "tokens", *posterior, F.round("rate", 6).alias("rate"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op7_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = lattice.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice")


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), path="source")
    return out.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "predicted")


def op9_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = fresh(spark, "sstable")
    sstable.write(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return sstable.offsets(spark, path)


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return clusters.lloyd(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


#: What both rows of the added conversation say.
MARKED = "</s>[INST] ok [/INST]"


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = chat.formatted(chat.linear(rows)).select("tree", "formatted", chat.turns(F.col("formatted")).alias("read"), F.array_join(chat.under_loss(F.col("formatted"), F.col("turns")), "").alias("loss"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lz_fingerprint, op2_factorisation_machine, op3_segment_toxicity, op4_information_sanitiser, op5_soft_mixing,
        op6_benchmark_decontamination, op7_subword_lattice, op8_secret_forest, op9_sstable_tokens, op10_setsketch_near_dedup,
        op11_block_norm_clusters, op12_hard_negatives, op13_reply_trees,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WORD = decontaminate.WORD

#: Components, centroids and rounds of the clustering query.
DIM, K, ROUNDS = 64, 40, 5


def _clusters_sql() -> str:
    """Every round over all distances, in whole numbers."""
    kept = f"len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {kept}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS j, v AS c FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v) ORDER BY h, v LIMIT {K})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min({{'d': d, 'j': j}}) AS x FROM (SELECT n, vec_id, v, j, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM (SELECT row_number() OVER () AS n, * FROM v), c{r}) GROUP BY n, vec_id, v)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT x.j AS j, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT x, unnest(v) AS e, unnest(range({DIM})) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j AS j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.j = m{r}.j)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, x.j AS cluster, x.d AS distance, CAST(sum(x.d) OVER (PARTITION BY x.j) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON x.j = c{ROUNDS}.j"""


#: A text's length once escaped: each backslash and each control string is one longer.
_ESCAPED = lambda c: f"length(coalesce({c}, '')) + length(coalesce({c}, '')) - length(replace(coalesce({c}, ''), '\\', ''))" + "".join(f" + (length(coalesce({c}, '')) - length(replace(coalesce({c}, ''), '{x}', ''))) // {len(x)}" for x in chat.CONTROL)
_MARKS = sum(map(len, (chat.OPEN, chat.MIDDLE, chat.CLOSE)))

ORACLE: dict[str, str] = {
    "op11_block_norm_clusters": _clusters_sql(),
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a, v b WHERE a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
""",
    "op13_reply_trees": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{MARKED}' FROM range(2) r(i)),
x AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  CAST(sum({_MARKS} + {_ESCAPED("role")} + {_ESCAPED("text")}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM x
""",
    "op6_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
""",
    "op10_setsketch_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept
FROM n JOIN (SELECT x, min(y) AS c FROM reach GROUP BY 1) ON x = doc_id
""",
}
