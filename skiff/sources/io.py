"""Sources and sinks: Parquet and Arrow files, text lines, values in memory, pandas and Arrow results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet scan; only the named columns reach the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of a folder or glob, one task for each file: the reader hands out record batches."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").head()
    if first is None:
        raise ValueError(f"no Arrow file at {path}")
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(pa.ipc.open_file(first.content).schema)

    def read(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                reader = pa.ipc.open_file(content)
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return files.select("content").mapInArrow(read, schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def udf_scan(spark: SparkSession, path: str, columns: Sequence[str], name: str, expr) -> DataFrame:
    """One computed column over the named columns of a file; ``expr`` takes their Columns."""
    return scan(spark, path, columns).select(expr(*map(F.col, columns)).alias(name))


def from_columns(spark: SparkSession, data: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Values in memory, with their place as ``_pos``."""
    rows = [(i, *values) for i, values in enumerate(zip(*data.values(), strict=True))]
    return spark.createDataFrame(rows, ["_pos", *data])


def sequential(spark: SparkSession, n: int, name: str = "value") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def explode_array(df: DataFrame, array: Column, name: str = "value") -> DataFrame:
    """A column from a 1-D array cell, with the place of each value."""
    return df.select("*", F.posexplode(array).alias("_pos", name))


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
