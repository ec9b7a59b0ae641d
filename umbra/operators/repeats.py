"""Texts that repeat, detected once.

Only hashes are shuffled to learn which texts repeat. Texts that don't are scanned where they stand. Of each text that does,
one is scanned, and what it yields is joined back to its rows by two hashes of the text. Rows of a text that very many
share are dealt to several tasks, each of which gets the text's entities.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.operators.detect import ENTITIES, detect

#: Rows of one text that one task joins to its entities, about.
SPREAD = 10_000
#: What rows and texts meet by.
BOTH = ["__hash", "__hash2"]


def detect_once(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: bool = True, spread: int = SPREAD, **options: Any) -> DataFrame:
    """detect()'s entities of every row, each distinct text being scanned once.

    Keys may be null or repeat; a null text has no entities; rows alike each give theirs; other columns are ignored; an
    empty table gives no rows."""
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__said"), F.xxhash64(said).alias("__hash"), F.xxhash64(F.lit(1), said).alias("__hash2"))
    often = rows.where("__said is not null").groupBy(*BOTH).agg(F.count("*").alias("__n")).where("__n > 1").select(*BOTH, F.ceil(F.col("__n") / spread).cast("int").alias("__salts"))
    lone = rows.join(often, BOTH, "left_anti").where("__said is not null")
    many = rows.join(often, BOTH)
    alone = detect(lone, "__key", "__said", hashed=True, **options)
    texts = many.select(F.struct(*BOTH, "__salts").alias("__of"), "__said").dropDuplicates(["__of"])
    found = detect(texts, "__of", "__said", hashed=True, **options).select("__of.*", *ENTITIES)
    found = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    dealt = many.select("__key", *BOTH, F.pmod(F.xxhash64("__key", F.monotonically_increasing_id()), F.col("__salts")).cast("int").alias("__salt"))
    back = dealt.join(found, [*BOTH, "__salt"]).select("__key", *ENTITIES, F.col("__hash").alias("text_hash"))
    out = alone.select("__key", *ENTITIES, "text_hash").unionByName(back).withColumnRenamed("__key", key)
    return out if hashed else out.drop("text_hash")
