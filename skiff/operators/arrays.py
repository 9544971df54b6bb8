"""Dense arrays over many rows: long form (coordinates, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Grid:
    """A 2-D array as rows (i, j, v)."""

    def __init__(self, df: DataFrame, rows: int, cols: int):
        self.df, self.rows, self.cols = df, rows, cols

    @staticmethod
    def filled(spark: SparkSession, rows: int, cols: int, value: float) -> Grid:
        flat = spark.range(rows * cols)
        return Grid(flat.select((F.col("id") / cols).cast("bigint").alias("i"), (F.col("id") % cols).alias("j"), F.lit(float(value)).alias("v")), rows, cols)

    @staticmethod
    def random(spark: SparkSession, rows: int, cols: int, seed: int) -> Grid:
        """Uniform values from [0, 1); the same for the same seed and number of partitions."""
        return Grid(Grid.filled(spark, rows, cols, 0.0).df.withColumn("v", F.rand(seed)), rows, cols)

    @staticmethod
    def from_flat(df: DataFrame, place: Column, value: Column, rows: int, cols: int) -> Grid:
        """Reshape numbered values: coordinates come from the place."""
        return Grid(df.select(F.call_function("div", place, F.lit(cols)).alias("i"), (place % cols).alias("j"), value.alias("v")), rows, cols)

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    def map(self, fn: Callable[[Column], Column]) -> Grid:
        return Grid(self.df.select("i", "j", fn(F.col("v")).alias("v")), self.rows, self.cols)

    def zip(self, other: Grid, fn: Callable[[Column, Column], Column]) -> Grid:
        if self.shape != other.shape:
            raise ValueError("arrays of different shapes")
        b = other.df.select("i", "j", F.col("v").alias("w"))
        return Grid(self.df.join(b, ["i", "j"]).select("i", "j", fn(F.col("v"), F.col("w")).alias("v")), self.rows, self.cols)

    def reshape(self, rows: int, cols: int) -> Grid:
        if rows * cols != self.rows * self.cols:
            raise ValueError("reshape keeps the number of values")
        return Grid.from_flat(self.df, F.col("i") * self.cols + F.col("j"), F.col("v"), rows, cols)

    def view(self, i: slice, j: slice) -> Grid:
        a, b = range(*i.indices(self.rows)), range(*j.indices(self.cols))

        def inside(c: str, r: range) -> Column:
            return (F.col(c) >= r.start) & (F.col(c) < r.stop) & ((F.col(c) - r.start) % r.step == 0)

        part = self.df.where(inside("i", a) & inside("j", b))
        return Grid(part.select(((F.col("i") - a.start) / a.step).cast("bigint").alias("i"), ((F.col("j") - b.start) / b.step).cast("bigint").alias("j"), "v"), len(a), len(b))

    def put(self, i: slice, j: slice, value: float) -> Grid:
        """The array with a value in a range of it; parents stay as they are."""
        a, b = range(*i.indices(self.rows)), range(*j.indices(self.cols))
        hit = F.col("i").between(a.start, a.stop - 1) & ((F.col("i") - a.start) % a.step == 0) & F.col("j").between(b.start, b.stop - 1) & ((F.col("j") - b.start) % b.step == 0)
        return Grid(self.df.withColumn("v", F.when(hit, float(value)).otherwise(F.col("v"))), self.rows, self.cols)

    def at(self, i: int, j: int) -> DataFrame:
        """The value of one cell, as a row."""
        i, j = range(self.rows)[i], range(self.cols)[j]
        return self.df.where((F.col("i") == i) & (F.col("j") == j)).select("v")

    def put_grid(self, i: slice, j: slice, other: Grid) -> Grid:
        """The array with the cells of a range of it replaced by those of an array of that shape."""
        a, b = range(*i.indices(self.rows)), range(*j.indices(self.cols))
        if other.shape != (len(a), len(b)):
            raise ValueError("arrays of different shapes")
        placed = other.df.select((F.col("i") * a.step + a.start).alias("i"), (F.col("j") * b.step + b.start).alias("j"), F.struct("v").alias("w"))
        out = self.df.join(placed, ["i", "j"], "left")
        return Grid(out.select("i", "j", F.when(F.col("w").isNotNull(), F.col("w.v")).otherwise(F.col("v")).alias("v")), self.rows, self.cols)

    def stencil(self, weights: dict[tuple[int, int], float]) -> Grid:
        """The weighted sum of neighbours of every inner cell; border cells keep their value.

        Each cell sends its value to its neighbours, so one shuffle on the coordinates does a step.
        """
        reach = max(max(abs(x), abs(y)) for x, y in weights)
        sends = F.explode(F.array(*[F.struct((F.col("i") - x).alias("i"), (F.col("j") - y).alias("j"), (F.col("v") * w).alias("part"), F.lit(None).cast("double").alias("own")) for (x, y), w in weights.items()], F.struct("i", "j", F.lit(None).cast("double").alias("part"), F.col("v").alias("own"))))
        got = self.df.select(sends.alias("s")).groupBy("s.i", "s.j").agg(F.sum("s.part").alias("part"), F.max("s.own").alias("own")).where("own IS NOT NULL")
        inner = F.col("i").between(reach, self.rows - 1 - reach) & F.col("j").between(reach, self.cols - 1 - reach)
        return Grid(got.select("i", "j", F.when(inner, F.col("part")).otherwise(F.col("own")).alias("v")), self.rows, self.cols)


def fused(columns: Sequence[Column], fn: Callable[..., Column]) -> Column:
    """One expression over several columns, compiled to one loop."""
    return fn(*columns)
