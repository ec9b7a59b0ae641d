"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token shards.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import decontaminate, mixing, setsketch, sstable, toxicity
from umbra.llm.queries import WEIGHTS, domains, labels_of, tokenizer_file
from umbra.llm.shared import drop, fresh, ship, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is a half or more. Every other row stays as it is: null and empty texts,
    repeated rows, null ids; an empty table stays empty."""
    ship(spark)
    return toxicity.rejected(docs, toxicity.fit(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir, "toxic")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: word 5-shingles, similarity 0.8 or more.

    Repeated rows of a kept id become one, the first by its columns' hash. Null, empty and blank texts stay, as do rows
    with a null id; an empty table stays empty."""
    ship(spark)
    classes = setsketch.near_duplicates(docs, width=5, percent=80)
    gone = written(classes.where("not kept").select("doc_id").distinct(), "gone")
    again = written(classes.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    few = lambda ids: F.broadcast(ids) if ids.count() <= setsketch.BROADCAST_ROWS else ids
    left = docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = left.join(few(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("x"))
    return left.join(few(again), "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("x.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents. Null and empty texts stay, as do repeated rows without hits; an empty table stays empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins documents to the target shares; no document is repeated, and rates of the first domain stay at 1 where they
    can. Null and empty texts are thinned like others of their posterior; repeated rows share one coin; an empty table
    stays empty."""
    ship(spark)
    model = mixing.fit(table(spark, sf_dir, "documents"), domains(spark, sf_dir), list(WEIGHTS))
    return mixing.mix(docs, model, WEIGHTS, most=1.0)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns each document's place in them, read back: one row for each row, null ids first,
    null and empty texts as the end id alone; an empty table gives no rows."""
    ship(spark)
    path = fresh(spark, "sstable")
    sstable.write(docs, path, tokenizer_file("word_bpe_49k.json"))
    return sstable.offsets(spark, path)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_shards", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is dropped once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs


#: The trained stages can't be said in SQL; tests hold run() against plain Python versions of the stages on planted rows.
ORACLE_SQL = None
