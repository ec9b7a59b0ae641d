"""What the corpus operators share: reading tables, and tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


#: Bytes of an Arrow batch at most: both the executor and its Python worker hold a batch while it goes over.
BATCH = 8 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers when it's neither installed nor on their path, and keeps the
    session's Arrow batches to BATCH bytes where they're allowed more."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(size).rstrip("b")) > BATCH:
        spark.conf.set(size, str(BATCH))
    root = Path(__file__).resolve().parents[2]
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in path or Path.cwd() == root or "site-packages" in str(root):
        return
    folder = tempfile.mkdtemp()
    with zipfile.ZipFile(f"{folder}/umbra.zip", "w") as z:
        for p in (root / "umbra").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/umbra.zip")
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it's unset in local mode, as in tests, a temporary one that is then set.

    On a cluster a machine's own folder would be read back in part or not at all, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = f"file://{tempfile.mkdtemp(prefix='umbra-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read from there: cuts lineage and survives lost executors."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._umbra_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_umbra_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fold(column: str, modulus: int):
    """crc32 of the id as decimal text, mod modulus; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def training(docs: DataFrame, labels: DataFrame | None, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(key, text, label) of at most `rows` labelled documents, those of the smallest key hash, the same on every run.

    The keys are chosen from the labels alone, before any text is read; the chosen ones (a key and a label each) are
    broadcast into one narrow scan of the texts. Without `labels` the documents hold the label themselves. Of a key's
    labels the greatest counts, of its texts the least; null keys and null labels don't count, a null text is empty.
    """
    marks = (docs if labels is None else labels).select(F.col(key).alias("key"), F.col(label).alias("label")).where("key is not null and label is not null")
    marks = marks.groupBy("key").agg(F.max("label").alias("label"))
    many = marks.count()
    place = F.xxhash64("key")
    if many > 2 * rows:  # so that a partition passes on its share of twice the rows at most, about
        marks = marks.where(place <= F.lit(int(-(2**63) + 2**64 * (2 * rows / many))))
    chosen = marks.orderBy(place, "key").limit(rows)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label")
