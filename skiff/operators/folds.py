"""Folds over sorted rows that hold one state at a time, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def fold_runs(df: DataFrame, by: Sequence[str], begin: Callable, step: Callable, finish: Callable, to: StructField, empty: Any = None) -> DataFrame:
    """(by, to): a row for each run of equal ``by`` in a partition of ``df``, whose columns are ``by`` and one value.

    The first value of a run goes to ``begin(value)``, the others to ``step(state, value)``, the last
    state to ``finish``. NULL values are left out; a run of nothing else gives ``empty``.
    """
    by, n = list(by), len(by)
    kind = to_arrow_type(to.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        seen, types = False, []

        def made(out: list) -> pa.RecordBatch:
            cols = [pa.array([k[i] for k, _ in out], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([v for _, v in out], kind)], [*by, to.name])

        def result() -> tuple:
            return key, finish(state) if seen else empty

        for batch in batches:
            types, out = [f.type for f in batch.schema][:n], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(n))) if n else repeat(())
            for k, v in zip(keys, batch.column(n).to_pylist()):
                if key is None or not _same(k, key):
                    if key is not None:
                        out.append(result())
                    key, state, seen = k, None, False
                if v is not None:
                    state, seen = step(state, v) if seen else begin(v), True
            if out:
                yield made(out)
        if key is not None:
            yield made([result()])

    return df.select(*by, df.columns[-1]).mapInArrow(run, StructType([*[df.schema[c] for c in by], to]))
