"""An ordered, indexed frame over a Spark DataFrame: every operation only builds a plan."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StructField

from skiff.functions import dates, numeric, text
from skiff.operators.folds import fold_runs
from skiff.operators.position import materialize, with_position
from skiff.plans.values import RETURNS, Value, compile_row, compile_scalar, kind_of

NAN = float("nan")


def _listed(x: Any) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


class Frame:
    """Columns of a DataFrame, hidden index columns, and the order of the rows.

    ``order`` names a total order (column, ascending); operations on places need it, since the
    order of rows in files means nothing to Spark. Frames are immutable but for ``frame[c] = ...``,
    after which series taken before keep their values.
    """

    def __init__(self, df: DataFrame, index: Sequence[str] = (), order: Sequence[tuple[str, bool]] = ()):
        self.df, self.index, self.order = df, tuple(index), tuple(order)

    def _like(self, df: DataFrame, **changes: Any) -> Frame:
        return Frame(df, changes.get("index", self.index), changes.get("order", self.order))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.index]

    def _kinds(self) -> dict[str, str]:
        return {c: kind_of(t) for c, t in self.df.dtypes}

    def _sorts(self, reverse: bool = False) -> list[Column]:
        if not self.order:
            raise ValueError("this needs an order: sort first")
        out, kinds = [], self._kinds()
        for c, up in self.order:
            if reverse:
                up = not up
            if kinds[c] == "float":  # NaN stands last whichever way the values go
                out.append(F.isnan(c).desc() if reverse else F.isnan(c).asc())
            out.append(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last())
        return out

    def __getattr__(self, name: str) -> Series:
        if name.startswith("__") or name not in self.df.columns:
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, key: Any):
        if isinstance(key, str):
            return Series(self, F.col(f"`{key}`"), key, self._kinds()[key])
        if isinstance(key, Series):
            return self._like(self.df.where(key.col))
        if isinstance(key, slice):
            return self._slice(key)
        hidden = [c for c in dict.fromkeys([*self.index, *(c for c, _ in self.order)]) if c not in key]
        return Frame(self.df.select(*hidden, *key), dict.fromkeys([*self.index, *hidden]), self.order)

    def __setitem__(self, name: str, value: Any) -> None:
        self.df = self.df.withColumn(name, value.col if isinstance(value, Series) else F.lit(value))

    def assign(self, **values: Any) -> Frame:
        return self._like(self.df.withColumns({n: v.col if isinstance(v, Series) else F.lit(v) for n, v in values.items()}))

    def compute(self, **outputs: Callable) -> Frame:
        """Several computed columns from one pass over the rows."""
        return self._like(self.df.withColumns({n: compile_row(f, self._kinds()) for n, f in outputs.items()}))

    def apply(self, fn: Callable, axis: int = 0, strict: bool = False):
        """axis 1: a function of the row, as a series; axis 0: a function of each column, as a frame."""
        if axis == 1:
            return Series(self, compile_row(fn, self._kinds(), strict), None, "other")
        cols = {c: fn(self[c]) for c in self.columns}
        return self._like(self.df.select(*self.index, *[v.col.alias(c) for c, v in cols.items()]), order=())

    def filter_by(self, fn: Callable) -> Frame:
        """Rows for which a predicate over the row holds."""
        return self._like(self.df.where(compile_row(fn, self._kinds())))

    def sort_values(self, by: str | Sequence[str], ascending: bool | Sequence[bool] = True) -> Frame:
        """The frame in a new order. Nothing is sorted until an operation needs places or the rows are shown."""
        by = _listed(by)
        ups = _listed(ascending) * (len(by) if isinstance(ascending, bool) else 1)
        rest = [o for o in self.order if o[0] not in by]
        return self._like(self.df, order=[*zip(by, ups, strict=True), *rest])

    def ordered(self) -> DataFrame:
        """The rows in order."""
        return self.df.orderBy(*self._sorts()) if self.order else self.df

    def _slice(self, key: slice) -> Frame:
        if key.step not in (None, 1):
            raise ValueError("slices have no step")
        a, b = key.start or 0, key.stop
        if a >= 0 and b is not None and b >= 0:  # the k first rows of a sort
            return self._like(self.df.orderBy(*self._sorts()).offset(a).limit(max(0, b - a)))
        if a < 0 and b is None:
            return self._like(self.df.orderBy(*self._sorts(reverse=True)).limit(-a))
        n = self.df.count()
        lo, hi = (max(0, n + x) if x < 0 else x for x in (a, n if b is None else b))
        placed = with_position(self.df, self._sorts(), "_at")
        return self._like(placed.where((F.col("_at") >= lo) & (F.col("_at") < hi)).drop("_at"))

    @property
    def iloc(self) -> _Places:
        return _Places(self)

    def at_label(self, label: Any) -> Frame:
        return self._like(self.df.where(F.col(self.index[0]) == label))

    def add_index_column(self, name: str) -> Frame:
        return self._like(with_position(self.df, self._sorts(), name))

    def reset_index(self, name: str = "index") -> Frame:
        """A new index 0..n-1; the old index columns become data, an ``index`` in the way ``level_0``."""
        df = self.df
        if name in df.columns and name not in self.index:
            df, old = df.withColumnRenamed(name, "level_0"), "level_0"
        elif name in self.index:
            df, old = df.withColumnRenamed(name, "level_0"), "level_0"
        else:
            old = None
        placed = Frame(df, (), [("level_0" if old and c == name else c, up) for c, up in self.order])
        return Frame(with_position(placed.df, placed._sorts(), name), (name,), [(name, True)])

    def fillna(self, value: float) -> Frame:
        """NaN (and NULL) of float columns replaced."""
        floats = [c for c, k in self._kinds().items() if k == "float"]
        return self._like(self.df.withColumns({c: F.coalesce(F.nanvl(c, F.lit(float(value))), F.lit(float(value))) for c in floats}))

    def __len__(self) -> int:
        return self.df.count()

    def clone(self) -> Frame:
        return self._like(self.df)

    def groupby(self, by: str | Sequence[str]) -> Groups:
        return Groups(self, _listed(by))

    def merge(self, right: Frame, how: str = "inner", on: Any = None, left_on: Any = None, right_on: Any = None, left_index: bool = False, right_index: bool = False) -> Frame:
        """Inner or left equi-join. NaN keys match nothing; missing numbers of a left join are NaN.

        Spark chooses the side to broadcast from sizes it knows; the order of the left frame stays.
        """
        if how not in ("inner", "left"):
            raise ValueError(f"join type {how} is not supported")
        if left_index and right_index:
            lk, rk = list(self.index), list(right.index)
        elif on is not None:
            lk = rk = _listed(on)
        else:
            lk, rk = _listed(left_on), _listed(right_on)
        taken = [c for c in right.df.columns if not (c in rk and (on is not None or left_index))]
        clash = set(taken) & set(self.df.columns)
        if clash:
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        keys = {c: f"_k{i}" for i, c in enumerate(rk)}
        kinds = right._kinds()
        other = right.df
        for c in rk:
            if kinds[c] == "float":
                other = other.where(~F.isnan(c))
        other = other.select(*[F.col(c).alias(k) for c, k in keys.items()], *taken)
        cond = None
        for a, b in zip(lk, rk, strict=True):
            test = self.df[a] == other[keys[b]]
            cond = test if cond is None else cond & test
        joined = self.df.join(other, cond, how)
        if how == "left":
            for c in taken:
                if kinds[c] in ("int", "float"):
                    missing = F.col(next(iter(keys.values()))).isNull()
                    joined = joined.withColumn(c, F.when(missing, NAN).otherwise(F.col(c).cast("double")))
        return self._like(joined.drop(*keys.values()), index=() if not left_index else self.index)

    def distinct(self, by: Sequence[str]) -> Frame:
        return Frame(self.df.select(*by).distinct(), (), [(c, True) for c in by])

    def to_arrow(self):
        return self.ordered().toArrow()

    def to_pandas(self):
        out = self.ordered().toPandas()
        return out.set_index(list(self.index)) if self.index else out

    def write(self, path: str) -> None:
        self.df.write.parquet(path)


class _Places:
    def __init__(self, frame: Frame):
        self.frame = frame

    def __getitem__(self, key: Any) -> Frame | RowSeries:
        """Rows of a slice as a frame; the row at a place as a series, with an error where there is none."""
        if isinstance(key, slice):
            return self.frame[key]
        if key >= 0:
            one = self.frame[key : key + 1]
        else:  # the first of the last -key rows, if there are so many
            one = self.frame[key:]
            one = one._like(one.ordered().limit(1)) if len(one) == -key else one._like(one.df.limit(0))
        row = one.df.select(*one.columns).head()
        if row is None:
            raise IndexError(f"no row at place {key}")
        return RowSeries(list(row), one.columns, key, one.df)


class Literal:
    """Values in memory under labels: a literal series, and with its labels alone a literal index."""

    def __init__(self, values: Sequence[Any], index: Sequence[Any] | None = None, name: Any = None):
        self.values, self.name = list(values), name
        self.index = list(range(len(self.values))) if index is None else list(index)
        if len(self.index) != len(self.values):
            raise ValueError(f"{len(self.values)} values and {len(self.index)} labels")

    def __getitem__(self, label: Any) -> Any:
        if label not in self.index:
            raise KeyError(label)
        return self.values[self.index.index(label)]

    def __len__(self) -> int:
        return len(self.values)

    def to_frame(self, spark: SparkSession, name: str | None = None) -> Frame:
        """One column in the order of the values, with the labels as index; values and labels are of one type each."""
        rows = [(i, k, v) for i, (k, v) in enumerate(zip(self.index, self.values))]
        return Frame(spark.createDataFrame(rows, ["_place", "index", name or self.name or "value"]), ("index", "_place"), [("_place", True)])


class RowSeries(Literal):
    """A row, with its columns as labels; ``df`` is the same row as a DataFrame."""

    def __init__(self, values: Sequence[Any], index: Sequence[str], name: Any, df: DataFrame):
        super().__init__(values, index, name)
        self.df = df


class Series:
    """One column expression over a frame, as the frame was when the series was made."""

    def __init__(self, frame: Frame, col: Column, name: str | None, kind: str):
        self.frame, self.col, self.name, self.kind = Frame(frame.df, frame.index, frame.order), col, name, kind

    def _with(self, other: Any, op: Callable, kind: str | None = None) -> Series:
        if isinstance(other, Series) and not self.frame.df.sameSemantics(other.frame.df):
            return self._aligned(other, op, kind)
        b = other.col if isinstance(other, Series) else F.lit(other)
        up = "float" if isinstance(other, float) or getattr(other, "kind", "") == "float" else self.kind
        return Series(self.frame, op(self.col, b), self.name, kind or up)

    def _aligned(self, other: Series, op: Callable, kind: str | None) -> Series:
        """Series of different frames meet by place."""
        a = with_position(self.frame.df.withColumn("_a", self.col), self.frame._sorts(), "_at")
        b = with_position(other.frame.df.withColumn("_b", other.col), other.frame._sorts(), "_at").select("_at", "_b")
        joined = a.join(b, "_at").select(*self.frame.df.columns, op(F.col("_a"), F.col("_b")).alias("_value"))
        return Series(Frame(joined, self.frame.index, self.frame.order), F.col("_value"), self.name, kind or self.kind)

    def __add__(self, o):
        return self._with(o, F.concat if self.kind == "str" else lambda a, b: a + b)

    def __radd__(self, o):
        return self._with(o, lambda a, b: F.concat(b, a) if self.kind == "str" else b + a)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._with(o, lambda a, b: b - a)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._with(o, numeric.float_div, "float")

    def __rtruediv__(self, o):
        return self._with(o, lambda a, b: numeric.float_div(b, a), "float")

    add, sub, mul, div = __add__, __sub__, __mul__, __truediv__

    def _test(self, o, op):
        return self._with(o, op, "bool")

    def __eq__(self, o):
        return self._test(o, numeric.eq if self.kind == "float" else lambda a, b: a == b)

    def __ne__(self, o):
        return self._test(o, lambda a, b: a != b)

    def __lt__(self, o):
        return self._test(o, numeric.lt if self.kind == "float" else lambda a, b: a < b)

    def __le__(self, o):
        return self._test(o, lambda a, b: a <= b)

    def __gt__(self, o):
        return self._test(o, numeric.gt if self.kind == "float" else lambda a, b: a > b)

    def __ge__(self, o):
        return self._test(o, lambda a, b: a >= b)

    def __and__(self, o):
        return self._test(o, lambda a, b: a & b)

    def __or__(self, o):
        return self._test(o, lambda a, b: a | b)

    def __invert__(self):
        return Series(self.frame, ~self.col, self.name, "bool")

    __hash__ = None

    def apply(self, fn: Callable, strict: bool = False) -> Series:
        return Series(self.frame, compile_scalar(fn, [Value(self.col, self.kind)], strict), self.name, "other")

    def element_wise(self, other: Series, fn: Callable) -> Series:
        return self._with(other, lambda a, b: compile_scalar(fn, [Value(a, self.kind), Value(b, other.kind)]), "other")

    def mask(self, cond: Series, other: Any) -> Series:
        """``other`` where ``cond`` holds."""
        return Series(self.frame, F.when(cond.col, other.col if isinstance(other, Series) else F.lit(other)).otherwise(self.col), self.name, self.kind)

    def fillna(self, value: float) -> Series:
        return Series(self.frame, F.coalesce(F.nanvl(self.col, F.lit(value)), F.lit(value)), self.name, self.kind)

    def isin(self, values: Any) -> Series:
        """Membership in a list, or in another series by a join that keeps the rows."""
        if not isinstance(values, Series):
            return Series(self.frame, self.col.isin(list(values)), self.name, "bool")
        known = values.frame.df.select(values.col.alias("_known")).where("_known IS NOT NULL").distinct()
        joined = self.frame.df.join(known, self.col == F.col("_known"), "left")
        return Series(Frame(joined, self.frame.index, self.frame.order), F.col("_known").isNotNull(), self.name, "bool")

    def to_df(self, name: str | None = None) -> DataFrame:
        return self.frame.df.select(*self.frame.index, self.col.alias(name or self.name or "value"))

    def reset_index(self, name: str = "value") -> Frame:
        order = [c for c, _ in self.frame.order if c not in self.frame.index]
        df = self.frame.df.select(*self.frame.index, *order, self.col.alias(name))
        return Frame(df, self.frame.index, self.frame.order).reset_index()

    def unique(self) -> DataFrame:
        return self.frame.df.select(self.col.alias(self.name or "value")).distinct()

    def to_arrow(self):
        """The values in order as a pyarrow array."""
        return self.frame.ordered().select(self.col.alias("value")).toArrow().column(0).combine_chunks()

    def sum(self) -> DataFrame:
        """One row ``sum``: of numbers, 0 without rows; of texts, their concatenation in order.

        Texts are joined range by range of the order, each in a task of its own, then the ranges; only the
        result, which is one value, has to fit a row.
        """
        if self.kind == "str":
            sorts = self.frame._sorts()
            # Numbered in order within its range; the upper bits of a number are the range.
            dealt = self.frame.df.select(*dict.fromkeys(c for c, _ in self.frame.order), self.col.alias("_s")).repartitionByRange(*sorts).sortWithinPartitions(*sorts)
            local = materialize(dealt.select("_s", F.monotonically_increasing_id().alias("_at")), "ranges")
            return joined_text(joined_text(local, "_at", "_s", F.shiftright("_at", 33).alias("_range")), "_range", "_s").select(F.coalesce("_s", F.lit("")).alias("sum"))
        zero = F.lit(0.0) if self.kind == "float" else F.lit(0).cast("bigint")
        return self.frame.df.agg(F.coalesce(F.sum(self.col), zero).alias("sum"))

    def mean(self) -> DataFrame:
        return self.frame.df.agg(F.avg(self.col).alias("mean"))

    def stdev(self, variance_parity: bool = False) -> DataFrame:
        """Sample standard deviation, 0 for fewer than two values; with ``variance_parity`` the variance."""
        f = F.var_samp if variance_parity else F.stddev_samp
        return self.frame.df.agg(F.coalesce(f(self.col), F.lit(0.0)).alias("stdev"))

    def fold(self, start: Any, step: Callable, groups: Sequence[str] = (), returns: str | None = None) -> DataFrame:
        """An ordered fold of the values of each group with ``step(state, value)`` over Python values.

        The rows of a group are sorted and streamed through one task, which holds the state only.
        NULL values are left out; a group of nothing else gives NULL, no values without groups give ``start``.
        ``returns`` is the type of the result where ``start`` does not tell it.
        """
        return _ordered_fold(self.frame, list(groups), self.col, start, step, lambda s: s, StructField("fold", _type_of(start, returns)))

    @property
    def str(self) -> _Text:
        return _Text(self)

    @property
    def dt(self) -> _Dates:
        return _Dates(self)

    def to_datetime(self) -> Series:
        return Series(self.frame, dates.parse(self.col), self.name, "other")


class _Text:
    def __init__(self, series: Series):
        self.s = series

    def _as(self, col: Column, kind: str = "str") -> Series:
        return Series(self.s.frame, col, self.s.name, kind)

    def len(self):
        return self._as(F.char_length(self.s.col), "int")

    def lower(self):
        return self._as(F.lower(self.s.col))

    def upper(self):
        return self._as(F.upper(self.s.col))

    def contains(self, sub):
        """Literal, not a pattern."""
        return self._as(text.contains(self.s.col, sub), "bool")

    def slice(self, start=None, stop=None, step=None):
        return self._as(text.slice_(self.s.col, start, stop, step))


class _Dates:
    def __init__(self, series: Series):
        self.s = series

    @property
    def year(self):
        return Series(self.s.frame, F.year(self.s.col), self.s.name, "int")

    @property
    def hour(self):
        return Series(self.s.frame, F.hour(self.s.col), self.s.name, "int")


def joined_text(df: DataFrame, order: str, value: str, *by: Column) -> DataFrame:
    """The texts of each group in order, joined to one; null texts are left out."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: p[value]), "").alias(value))


class Groups:
    def __init__(self, frame: Frame, by: list[str], value: str | None = None):
        self.frame, self.by, self.value = frame, by, value

    def __getitem__(self, name: str) -> Groups:
        return Groups(self.frame, self.by, name)

    #: The order of the frame is dropped here: no sort runs below an aggregate.
    def agg(self, spec: dict[str, str] | None = None, **named: tuple[str, str]) -> Frame:
        """sum, min and mean by column, or ``out=(column, function)``; the result is in the order of the keys."""
        use = {"sum": F.sum, "min": F.min, "mean": F.avg}
        wanted = named or {c: (c, f) for c, f in (spec or {}).items()}
        bad = {f for _, f in wanted.values()} - set(use)
        if bad:
            raise ValueError(f"aggregates are sum, min and mean, not {sorted(bad)}")
        cols = [use[f](c).alias(o) for o, (c, f) in wanted.items()]
        df = self.frame.df.groupBy(*self.by).agg(*cols) if cols else self.frame.df.select(*self.by).distinct()
        return Frame(df, self.by, [(k, True) for k in self.by])

    def join_text(self, order: str) -> Frame:
        """The texts of each group joined in the order of a column; the text of one group has to fit a row."""
        return Frame(joined_text(self.frame.df, order, self.value, *map(F.col, self.by)), self.by, [(k, True) for k in self.by])

    def nunique(self) -> Frame:
        df = self.frame.df.groupBy(*self.by).agg(F.countDistinct(self.value).alias(self.value))
        return Frame(df, self.by, [(k, True) for k in self.by])

    def aggregate(self, init: Any, update: Callable, finalize: Callable = lambda s: s, combine: Callable | None = None, returns: str | None = None) -> DataFrame:
        """A user's aggregate over ``value``: functions of Python values, by ``update(state, value)`` from ``init``.

        With ``combine(state, state)`` every partition is folded before the shuffle, so a group of any size sends one
        state for each partition; the order of rows has no meaning then, and ``init`` must change nothing
        in ``combine``. Without it the rows of a group are folded in the frame's order, streamed through one task.
        NULL values are left out, and a group of nothing else gives NULL, as in SQL. ``returns`` is the
        type of the result where ``init`` does not tell it.
        """
        to = StructField(self.value, _type_of(init, returns))
        if combine is None:
            return _ordered_fold(self.frame, self.by, F.col(self.value), init, update, finalize, to)
        rows = self.frame.df.select(*self.by, F.col(self.value).alias("_v")).sortWithinPartitions(*self.by)
        partial = fold_runs(rows, self.by, lambda v: update(copy.deepcopy(init), v), update, pickle.dumps, StructField("_s", BinaryType()))
        met = partial.repartition(*self.by).sortWithinPartitions(*self.by)
        return fold_runs(met, self.by, pickle.loads, lambda s, t: combine(s, pickle.loads(t)), finalize, to)


def _type_of(start: Any, returns: str | None) -> DataType:
    if returns is None and type(start) not in RETURNS:
        raise TypeError("this state does not tell the type of the result: give returns")
    return DataType.fromDDL(returns or RETURNS[type(start)])


def _ordered_fold(frame: Frame, by: list[str], value: Column, start: Any, step: Callable, finish: Callable, to: StructField) -> DataFrame:
    """Values of equal place in the order, or without one, are folded by size."""
    rows = frame.df.select(*dict.fromkeys([*by, *(c for c, _ in frame.order)]), value.alias("_v"))
    sorts = [*(frame._sorts() if frame.order else ()), F.col("_v")]
    if by:
        dealt = rows.repartition(*by)
    else:  # a row without a value, so that there is a result without rows
        none = frame.df.sparkSession.range(1).select(F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"))
        dealt = rows.unionByName(none, allowMissingColumns=True).repartition(1)
    ordered = dealt.sortWithinPartitions(*by, *sorts).select(*by, "_v")
    empty = None if by else finish(copy.deepcopy(start))
    return fold_runs(ordered, by, lambda v: step(copy.deepcopy(start), v), step, finish, to, empty)
