"""Places in a total order, without sending all rows to one task."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or an own one where a local session leaves it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named and not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that the executors of {master} share")
    if not named and not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{(named or _OWN[0]).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write once, read from there: cuts lineage and fixes values that depend on the dealing of rows."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, order: Sequence[Column], name: str = "_pos") -> DataFrame:
    """Add the 0-based place of each row in ``order``, which should be total.

    Rows are dealt by range and numbered inside their range; the sizes of the ranges before it, one
    row for each task, give the rest.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    local = materialize(dealt, "ranges")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, (F.col("_start") + inside).alias(name))
