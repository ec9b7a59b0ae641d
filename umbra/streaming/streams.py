"""Structured Streaming: the same expressions over unbounded tables.

Scans and splices are narrow, so a stream of texts is rewritten row by row; counts by time window carry a watermark.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbra.operators.anonymize import Operator, anonymize
from umbra.operators.detect import detect


def stream(spark: SparkSession, path: str, schema: str, format: str = "csv", **options: Any) -> DataFrame:
    """A folder of files as a stream."""
    reader = spark.readStream.schema(schema).format(format)
    for k, v in ({"header": True} if format == "csv" else {}).items():
        reader = reader.option(k, v)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def anonymize_stream(rows: DataFrame, target: str, entities: str, checkpoint: str, key: str = "doc_id", text: str = "text", operators: dict[str, Operator] | None = None, **detection: Any) -> StreamingQuery:
    """Rewrites all that has come so far, batch by batch: rows to `target`, entities to `entities`, both Parquet."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        found = detect(df, key, text, hashed=True, **detection).persist()
        new = anonymize(df, found, operators, key, text)
        # the batch's number is a folder: a batch that is run again writes over its own rows
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        found.drop("text_hash").write.mode("overwrite").parquet(f"{entities}/batch={number}")
        found.unpersist()
        df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by time window and kind; sliding where a slide is given. On a stream, rows later than `late` are dropped."""
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    at = F.window(time, window, slide) if slide else F.window(time, window)
    return timed.groupBy(at.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")


def session_counts(rows: DataFrame, time: str = "ts", who: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each session: a user's events with less than `gap` between them."""
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    return timed.groupBy(F.session_window(time, gap).alias("w"), who).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_texts(rows: DataFrame, time: str = "ts", text: str = "text", late: str = "10 minutes") -> DataFrame:
    """Rows of a stream whose text came first within `late` of event time: repeats are dropped while the watermark
    remembers the text, so state stays bounded; rows later than the watermark are dropped."""
    return rows.withWatermark(time, late).withColumn("__said", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).dropDuplicatesWithinWatermark(["__said"]).drop("__said")


def appended(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stream settles, once and for all: append mode, so a window's or session's row comes when the watermark
    has passed its end, and no state is written again. Started anew with the same checkpoint it goes on where it was."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
