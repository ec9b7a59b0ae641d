"""Sources and sinks: CSV files and folders, whole text files, any DataFrame; processed column by column.

A table's text columns are stacked to (row, column, text) rows, so that detection plans once for all of them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.catalog import Catalogue
from umbra.operators import report
from umbra.operators.anonymize import Operator, anonymize
from umbra.operators.detect import detect

# Operators by type where a caller names none.
WHOLE_FILE = {"PERSON": "replace", "EMAIL_ADDRESS": "mask", "PHONE_NUMBER": "mask", "AU_MEDICARE": "mask", "AU_TFN": "redact", "CREDIT_CARD": "redact", "AU_ACN": "mask", "AU_ABN": "mask"}
PREVIEW = {"PERSON": "replace", "EMAIL_ADDRESS": "mask", "PHONE_NUMBER": "mask"}
# End of fixed values.


@dataclass
class Config:
    """How to read and process CSV files; saved as JSON."""

    columns: list[str] | None = None
    operators: dict[str, str] = field(default_factory=dict)
    delimiter: str = ","
    encoding: str = "utf-8"
    operation: str = "anonymize"

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Config:
        return cls(**json.loads(Path(path).read_text()))


def read_csv(spark: SparkSession, path: str, config: Config | None = None, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """A CSV file, or all of a folder that match, with the file each row is from in __file."""
    c = config or Config()
    reader = spark.read.option("header", True).option("sep", c.delimiter).option("encoding", c.encoding).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path).withColumn("__file", F.col("_metadata.file_path"))


def read_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(doc_id, text) of whole text files; doc_id is the path."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def checked(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found: {missing}")


ROW = ["__row1", "__row2"]


def hashed(df: DataFrame) -> DataFrame:
    """The table with two hashes of each whole row: equal rows are equal work, and nothing depends on how rows are dealt."""
    every = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumns({"__row1": F.xxhash64(*every), "__row2": F.xxhash64(F.lit(1), *every)})


def numbered(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """The table with a key: the caller's, which may be null or repeat, else row_index, a number of each row."""
    return (df, key) if key else (df.withColumn("row_index", F.monotonically_increasing_id()), "row_index")


def stacked(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(__key, text) rows of the columns that aren't null; __key holds the keys and the column's name."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for c in columns])
    long = df.select(*(F.col(f"`{k}`") for k in keys), F.explode(pairs).alias("v")).where("v.text is not null")
    return long.select(F.struct(*(F.col(f"`{k}`") for k in keys), F.col("v.column").alias("column")).alias("__key"), F.col("v.text").alias("text"))


def detect_columns(df: DataFrame, columns: list[str], key: str | None = None, **options: Any) -> DataFrame:
    """Entities of every text column: key, column, entity_type, start, end, text, score. Keys may be null or repeat."""
    checked(df, columns)
    df, key = numbered(df, key)
    found = detect(stacked(df, columns, [key]), "__key", **options)
    return found.select(F.col(f"__key.{key}").alias(key), "__key.column", "entity_type", "start", "end", "text", "score")


def _rewritten(rows: DataFrame, columns: list[str], long: DataFrame, found: DataFrame, operators: dict[str, Operator] | None, options: dict[str, Any]) -> DataFrame:
    """The hashed rows with their text columns rewritten; found holds the entities of long."""
    new = anonymize(long, found, operators, "__key", "text", **options)
    wide = new.groupBy(*(F.col(f"__key.{r}").alias(r) for r in ROW)).agg(*[F.max(F.when(F.col("__key.column") == c, F.col("text"))).alias(f"__new_{i}") for i, c in enumerate(columns)])
    joined = rows.join(wide, ROW, "left")
    return joined.select(*[F.col(f"__new_{columns.index(c)}").alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns if c not in ROW])


def anonymize_columns(df: DataFrame, columns: list[str], operators: dict[str, Operator] | None = None, key: str | None = None, detection: dict[str, Any] | None = None, **options: Any) -> DataFrame:
    """The table with its text columns rewritten, by one detection; nulls stay null.

    Rows are told apart by hashes of all their columns, so no key is needed; a given one is ignored, and may be null or
    repeat. Equal rows come out equal, as many as they were. An empty table stays empty."""
    del key
    checked(df, columns)
    rows = hashed(df)
    long = stacked(rows, columns, ROW)
    return _rewritten(rows, columns, long, detect(long, "__key", hashed=True, **(detection or {})), operators, options)


def process_table(df: DataFrame, columns: list[str], operation: str = "process", operators: dict[str, Operator] | None = None, key: str | None = None, **options: Any) -> dict[str, DataFrame]:
    """detect: entities; anonymize: table; process: both, by one detection, whose entities are persisted until the caller
    unpersists "found". Another operation is an error."""
    match operation:
        case "detect":
            return {"entities": detect_columns(df, columns, key, **options)}
        case "anonymize":
            return {"table": anonymize_columns(df, columns, operators, key, options)}
        case "process":
            checked(df, columns)
            rows = hashed(df)
            long = stacked(rows, columns, ROW)
            found = detect(long, "__key", hashed=True, **options).persist()
            said = [F.col(f"__key.{r}").alias(r) for r in ROW] if key is None else []
            each = found.select(*said, *([F.col("__key.__row1"), F.col("__key.__row2")] if key else []), "__key.column", "entity_type", "start", "end", "text", "score")
            if key:  # the caller's key instead of the rows' hashes; equal rows gave their entities already
                of = rows.select(*ROW, F.col(f"`{key}`").alias(key)).dropDuplicates(ROW)
                each = each.join(of, ROW).select(key, "column", "entity_type", "start", "end", "text", "score")
            return {"entities": each, "table": _rewritten(rows, columns, long, found, operators, {}), "found": found}
        case _:
            raise ValueError(f"Unknown operation: {operation}")


def pii_columns(df: DataFrame, sample: int = 100, confidence: float = 0.7, least: float = 0.1, catalogue: Catalogue | None = None) -> list[str]:
    """Columns of whose sampled values at least a share `least` holds an entity."""
    names = [c for c in df.columns if not c.startswith("__")]
    rates = report.column_rates(df, names, lambda long: detect(long, "__row", catalogue=catalogue), sample, confidence)
    chosen = {r["column"] for r in rates.where(F.col("rate") >= least).collect()}  # a row a column
    return [c for c in names if c in chosen]


def process_csv(spark: SparkSession, source: str, target: str, config: Config | None = None, pattern: str | None = None, recursive: bool = False) -> dict[str, Any]:
    """Anonymises CSV files into a folder; columns are found where none are named. Returns what was done, with a table of
    entity counts by file and type."""
    c = config or Config()
    df = read_csv(spark, source, c, pattern, recursive)
    columns = c.columns if c.columns is not None else pii_columns(df)
    checked(df, columns)
    done: dict[str, Any] = {"columns_processed": columns, "target": target}
    if not columns:
        done["entities"] = None
        df.drop("__file").write.mode("overwrite").option("sep", c.delimiter).csv(target, header=True)
        return done
    rows = hashed(df)
    long = stacked(rows, columns, [*ROW, "__file"])
    found = detect(long, "__key", hashed=True).persist()
    if c.operation == "anonymize":
        new = _rewritten(rows, columns, long, found, c.operators or WHOLE_FILE, {})
        new.drop("__file").write.mode("overwrite").option("sep", c.delimiter).csv(target, header=True)
    done["entities"] = found.groupBy(F.col("__key.__file").alias("__file"), "entity_type").agg(F.count("*").alias("count"))
    done["found"] = found
    return done


def preview(df: DataFrame, columns: list[str] | None = None, operators: dict[str, Operator] | None = None, rows: int = 10) -> DataFrame:
    """(row, column, original, anonymized, entities_found) of the first rows that would change; long texts are shown in part."""
    some = df.limit(rows).withColumn("row", F.monotonically_increasing_id()).cache()
    columns = pii_columns(some.drop("row")) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "row long, `column` string, original string, anonymized string, entities_found int")
    long = stacked(some, columns, ["row"])
    new = anonymize(long, detect(long, "__key", hashed=True), operators or PREVIEW, "__key", "text").withColumnRenamed("text", "new")
    shown = lambda x: F.when(F.char_length(x) > 100, F.concat(F.left(x, F.lit(100)), F.lit("..."))).otherwise(F.col(x))
    both = long.join(new, "__key").where("text <> new")
    return both.select("__key.row", "__key.column", shown("text").alias("original"), shown("new").alias("anonymized"), F.size("items").alias("entities_found"))
