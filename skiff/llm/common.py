"""What the corpus operators share: tables in the shared folder, ranks inside classes, label folds."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_DIR: list[str] = []


#: Bytes of an Arrow batch. Spark's own bound counts rows, and some hold long texts.
BATCH_BYTES, _BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or an own one where a local session leaves it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that the executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    This cuts lineage: later stages survive lost executors without computing ``df`` again.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_BYTES``, which this sets in the session where nothing else is set."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task beside the tasks of the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)

    return map_batches(df, run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(_id, text, y) of ``max_rows`` labelled documents outside the held-out fold, or of all where there are fewer.

    The bound is taken by a hash of the id over the labels that a document with a text has, so a small
    table gives all its rows and a large one a uniform sample. Rows with a null id, label or text give
    nothing; an id with several labels takes the largest, one on several documents the least text.
    """
    docs = documents.select(F.col("doc_id").alias("_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("_id")) != 0))
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
        .join(docs.select("_id").distinct(), "_id")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # max_rows ids and ints: the size of this broadcast does not depend on the corpus.
    return docs.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("text").alias("text")).select("_id", "text", "y")


def rank_in_class(df: DataFrame, classes: list[str], order: list[str], rank: str) -> DataFrame:
    """Add ``rank``: the 0-based place of each row among the rows with equal ``classes``.

    Rows are dealt by range over (classes, order), so a class of any size spreads over many
    tasks. Rows are numbered within their range; the counts of (task, class) place the ranges.
    The numbered rows are written once, so that the numbers cannot change later.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*classes, *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    local = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = local.groupBy(part.alias("_p"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(classes)]).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row for each pair of a task and a class that meets it: at most tasks + classes rows,
    # as the ranges are contiguous; partitioned by class.
    before = Window.partitionBy(*[f"_c{i}" for i in range(len(classes))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    cond = part == F.col("_p")
    for i, c in enumerate(classes):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    return local.join(F.broadcast(starts), cond).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_start")).alias(rank))
