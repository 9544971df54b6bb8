"""End-to-end workloads as functions of DataFrames."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from skiff.functions import numeric, text
from skiff.operators.arrays import Grid
from skiff.operators.folds import fold_runs
from skiff.operators.position import materialize


def clean_listings(df: DataFrame) -> DataFrame:
    """Listing texts to typed columns: houses with fewer than 10 bedrooms, priced between bounds.

    Numbers that cannot be read are NULL, and filters on them drop the row.
    """
    facts, title = F.col("`facts and features`"), F.col("title")

    def number(pattern: str, of: Column = facts) -> Column:
        return numeric.to_int(F.replace(F.regexp_extract(of, pattern, 1), F.lit(","), F.lit("")))

    low = F.lower(title)
    offer = (
        F.when(F.contains(low, F.lit("foreclose")), "foreclosed")
        .when(F.contains(title, F.lit("SOLD")), "sold")
        .when(F.contains(title, F.lit("Rent")), "rent")
        .when(F.contains(title, F.lit("Sale")), "sale")
        .otherwise(title)
    )
    kind = F.when(F.contains(low, F.lit("house")), "house").when(F.contains(low, F.lit("condo")) | F.contains(low, F.lit("apartment")), "condo").otherwise("unknown")
    typed = df.select(
        "url", F.lpad(numeric.to_int(F.col("postal_code")).cast("string"), 5, "0").alias("zipcode"), "address",
        F.concat(F.upper(F.substring("city", 1, 1)), F.lower(F.expr("substring(city, 2)"))).alias("city"), "state",
        number("^(?:.*, )?([0-9]+) bd").alias("bedrooms"), number("^(?:.*?, )?([0-9]+) ba").alias("bathrooms"), number("([0-9,]*[0-9]) sqft").alias("sqft"),
        offer.alias("offer"), kind.alias("type"), number(r"Price/sqft:[^$]*\$([0-9]+)").alias("_each"), number(r"^\$([0-9,]+)", F.col("price")).alias("_asked"),
    )
    price = F.when(F.col("offer") == "sold", F.col("_each") * F.col("sqft")).otherwise(F.col("_asked"))
    priced = typed.withColumn("price", price).drop("_each", "_asked")
    return priced.where((F.col("bedrooms") < 10) & (F.col("type") == "house") & (F.col("price") > 100_000) & (F.col("price") < 2e7))


def parse_logs(df: DataFrame, line: str = "line") -> DataFrame:
    """Combined web log lines to fields; lines without an endpoint drop, and user names in endpoints are masked."""
    cols = F.split(line, " ")

    def part(i: int) -> Column:
        return F.coalesce(text.strip(F.get(cols, F.lit(i))), F.lit(""))

    def number(i: int) -> Column:
        return F.coalesce(numeric.to_int(part(i)), F.lit(0))

    date = F.when(F.size(cols) > 4, text.strip(F.concat_ws(" ", F.get(cols, F.lit(3)), F.get(cols, F.lit(4))))).otherwise("")
    out = df.select(
        F.col(line), cols.alias("cols"), part(0).alias("ip"), part(1).alias("client_id"), part(2).alias("user_id"), F.regexp_replace(part(6), "^/~[^/]+", "/~").alias("endpoint"),
        text.slice_(date, 1, -1).alias("date"), text.slice_(part(5), 1).alias("method"), text.slice_(part(7), None, -1).alias("protocol"),
        F.when(F.size(cols) > 8, number(8)).otherwise(-1).cast("bigint").alias("response_code"), number(9).cast("bigint").alias("content_size"),
    )
    return out.where(F.length("endpoint") > 0)


def crime_index(population: Column, adults: Column, robberies: Column) -> Column:
    """The index of one place, held to 0.005 below 0.01 and to 0.032 above 0.02; places sum."""
    small = F.when(population > 500_000, 0.0).otherwise(population)
    value = (adults * 2.0 + small - robberies * 2000.0) / 100_000.0
    return F.when(value > 0.02, 0.032).when(value < 0.01, 0.005).otherwise(value)


class Signal:
    """The state of ``peaks``: the last ``lag`` smoothed values and the band they give."""

    def __init__(self, lag: int, threshold: float, influence: float):
        self.lag, self.threshold, self.influence = lag, threshold, influence
        self.smooth: deque[float] = deque(maxlen=lag)
        self.center = self.spread = 0.0
        self.total = 0

    def push(self, value: float) -> int:
        x, lag, found = float(value), self.lag, 0
        if len(self.smooth) < lag:
            self.smooth.append(x)
            return 0
        out = abs(x - self.center) > self.threshold * self.spread
        if out:
            found = 1 if x > self.center else -1
        window = list(self.smooth)
        self.smooth.append(self.influence * x + (1 - self.influence) * window[-1] if out else x)
        self.center = sum(window) / lag
        self.spread = sum((v - self.center) ** 2 for v in window) / (lag - 1) if lag > 1 else 0.0
        self.total += found
        return found

    def then(self, value: float) -> Signal:
        self.push(value)
        return self


def peaks(volume: list[float], lag: int = 100, threshold: float = 10.0, influence: float = 0.5) -> list[int]:
    """1 or -1 where a value leaves the band about the mean of a window of smoothed values, else 0.

    The band of place i comes from the ``lag`` smoothed values before place i - 1; at the first
    place after the lead-in it is empty, about 0. Spread is the sample variance.
    """
    signal = Signal(lag, threshold, influence)
    return [signal.push(v) for v in volume]


def tick_peaks(ticks: DataFrame, symbol: str, time: Column, volume: Column, lag: int = 100, threshold: float = 10.0, influence: float = 0.5) -> DataFrame:
    """(symbol, peaks): the sum of the signals of each symbol's volume by second.

    The aggregation by second runs in the JVM; only the recurrence, which needs its own last
    results, runs in Python. It streams the sorted seconds of a symbol and holds the last ``lag`` values.
    """
    per_second = ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc("second", time).alias("second")).agg(F.sum(volume).alias("v"))
    value = F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))
    rows = per_second.repartition("symbol").sortWithinPartitions("symbol", F.col("second").asc_nulls_last()).select("symbol", value.alias("v"))
    return fold_runs(rows, ["symbol"], lambda v: Signal(lag, threshold, influence).then(v), Signal.then, lambda s: s.total, StructField("peaks", LongType()))


def preferences(ballots: DataFrame, voter: str, ranked: str) -> DataFrame:
    """(a, b, n): how many ballots rank a before b."""
    x = ballots.select(voter, F.posexplode(ranked).alias("p", "a"))
    y = ballots.select(voter, F.posexplode(ranked).alias("q", "b"))
    return x.join(y, voter).where("p < q").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def schulze_ranking(ballots: DataFrame, voter: str, ranked: str) -> DataFrame:
    """(candidate, wins) by the widest-path rule over the preference counts.

    The paths of the matrix of candidates come from repeated joins with the direct edges, the widest kept, until
    nothing changes.
    """
    n = preferences(ballots, voter, ranked)
    back = n.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    edges = n.join(back, ["a", "b"], "left").where("n > coalesce(m, 0)").select("a", "b", F.col("n").alias("w"))
    edges = materialize(edges, "edges")
    paths = edges
    while True:
        step = paths.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("x")), "b").where("a != c").select("a", F.col("c").alias("b"), F.least("w", "x").alias("w"))
        wider = paths.union(step).groupBy("a", "b").agg(F.max("w").alias("w"))
        wider = materialize(wider, "paths")
        changed = wider.join(paths.select("a", "b", F.col("w").alias("old")), ["a", "b"], "left").where("old IS NULL OR old < w")
        done = changed.isEmpty()
        paths = wider
        if done:
            break
    back = paths.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("w").alias("m"))
    wins = paths.join(back, ["a", "b"], "left").where("w > coalesce(m, 0)").groupBy("a").agg(F.count(F.lit(1)).alias("wins"))
    everyone = ballots.select(F.explode(ranked).alias("candidate")).distinct()
    return everyone.join(wins, everyone["candidate"] == wins["a"], "left").select("candidate", F.coalesce("wins", F.lit(0)).cast("bigint").alias("wins"))


def iban_valid(c: Column) -> Column:
    """Without spaces, dashes and dots: rotate by four, letters to numbers, remainder 1 modulo 97."""
    c = F.translate(c, " -.", "")
    turned = F.upper(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4)))
    digits = F.transform(text.letters(turned), lambda x: F.when(x.rlike("[0-9]"), x).otherwise((F.ascii(x) - 55).cast("string")))
    rest = F.aggregate(text.letters(F.array_join(digits, "")), F.lit(0), lambda s, x: ((s * 10 + F.ascii(x) - 48) % 97).cast("int"))
    return rest == 1


def prefix_flips(p: Column, most: int) -> Column:
    """How often the first p[0] items of a permutation of 1..n are reversed until 1 comes first; ``most`` bounds it.

    For n of 1 to 9 no permutation needs more than 0, 1, 2, 4, 7, 10, 16, 22 or 30.
    """

    def step(s: Column, _: Column) -> Column:
        p = s["p"]
        n = p[0]
        turned = F.concat(F.reverse(F.slice(p, F.lit(1), n)), F.slice(p, n + 1, F.size(p)))
        return F.when(n == 1, s).otherwise(F.struct(turned.alias("p"), (s["n"] + 1).alias("n")))

    start = F.struct(p.alias("p"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["n"])


def fannkuch(spark, n: int) -> DataFrame:
    """The largest number of prefix reversals over all permutations of 1..n, from their numbers."""

    def flips(k: pd.Series) -> pd.Series:
        out = []
        for number in k:
            left, p = list(range(1, n + 1)), []
            for i in range(n, 0, -1):
                f = math.factorial(i - 1)
                p.append(left.pop(number // f))
                number %= f
            count = 0
            while p[0] != 1:
                p[: p[0]] = p[: p[0]][::-1]
                count += 1
            out.append(count)
        return pd.Series(out)

    return spark.range(math.factorial(n)).select(F.max(F.pandas_udf(flips, "long")("id")).alias("flips"))


def black_scholes(price: Column, strike: Column, t: Column, rate: Column, vol: Column) -> tuple[Column, Column]:
    """(call, put) of European options."""
    spread = vol * F.sqrt(t)
    d1 = (numeric.log(price / strike) + (rate + vol * vol / 2) * t) / spread

    def normal(x: Column) -> Column:
        return (numeric.erf(x / math.sqrt(2)) + 1) / 2

    later = strike * F.exp(-rate * t)
    call = price * normal(d1) - later * normal(d1 - spread)
    return call, later - price + call


def haversine(lat: Column, lon: Column, from_lat: float = 0.70984286, from_lon: float = 1.2389197) -> Column:
    """Miles from a fixed point; all angles in radians."""
    a, b = F.sin((lat - from_lat) / 2), F.sin((lon - from_lon) / 2)
    return F.asin(F.sqrt(a * a + F.cos(lat) * math.cos(from_lat) * b * b)) * 2 * 3959.0


def laplace(grid: Grid, rounds: int) -> Grid:
    """Jacobi steps of the five-point mean; each step is written, which keeps the plan short."""
    quarter = {(1, 0): 0.25, (-1, 0): 0.25, (0, 1): 0.25, (0, -1): 0.25}
    for _ in range(rounds):
        step = grid.stencil(quarter)
        grid = Grid(materialize(step.df, "grid"), grid.rows, grid.cols)
    return grid


def centered_difference(grid: Grid, dx: float = 1.0) -> Grid:
    """The five-point Laplacian of the inner cells; only these are in the result."""
    around = {(1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0, (0, 0): -4.0}
    out = grid.stencil({k: v / dx**2 for k, v in around.items()})
    return Grid(out.df.where(F.col("i").between(1, grid.rows - 2) & F.col("j").between(1, grid.cols - 2)), grid.rows, grid.cols)
