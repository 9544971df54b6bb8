"""Scoring of trained models: their parameters become literals of column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(coef: Sequence[float], x: Sequence[Column], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, v in zip(coef, x, strict=True):
        out = out + v * float(c)
    return out


@dataclass
class LinearRegression:
    coef: Sequence[float]
    intercept: float

    def predict(self, x: Sequence[Column]) -> Column:
        return _dot(self.coef, x, self.intercept)


@dataclass
class LogisticRegression:
    """coef: one row for two classes, else one for each; predict gives the index of the class."""

    coef: Sequence[Sequence[float]]
    intercept: Sequence[float]

    def predict(self, x: Sequence[Column]) -> Column:
        scores = [_dot(c, x, i) for c, i in zip(self.coef, self.intercept, strict=True)]
        if len(scores) == 1:
            return F.when(scores[0] > 0, 1).otherwise(0)
        a = F.array(*scores)
        return (F.array_position(a, F.array_max(a)) - 1).cast("int")


@dataclass
class KMeans:
    """The nearest centre, the first of equals; for columns or for an array column."""

    centers: Sequence[Sequence[float]]

    def predict(self, x: Sequence[Column] | Column) -> Column:
        def distance(center):
            if isinstance(x, Column):
                point = F.array(*[F.lit(float(v)) for v in center])
                return F.aggregate(F.zip_with(x, point, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
            return sum(((v - float(c)) * (v - float(c)) for v, c in zip(x, center, strict=True)), F.lit(0.0))

        a = F.array(*map(distance, self.centers))
        return (F.array_position(a, F.array_min(a)) - 1).cast("int")


@dataclass
class MinMaxScaler:
    data_min: Sequence[float]
    scale: Sequence[float]

    def transform(self, x: Sequence[Column]) -> list[Column]:
        return [(v - float(m)) * float(s) for v, m, s in zip(x, self.data_min, self.scale, strict=True)]


@dataclass
class Pipeline:
    """Transformers, then a model."""

    steps: Sequence

    def predict(self, x: Sequence[Column]) -> Column:
        for step in self.steps[:-1]:
            x = step.transform(x)
        return self.steps[-1].predict(x)


#: Attributes of a fitted estimator, by the name of its class, in the order of the fields above.
FITTED = {
    "LinearRegression": (LinearRegression, ("coef_", "intercept_")),
    "LogisticRegression": (LogisticRegression, ("coef_", "intercept_")),
    "KMeans": (KMeans, ("cluster_centers_",)),
    "MinMaxScaler": (MinMaxScaler, ("data_min_", "scale_")),
}


def from_fitted(model: Any) -> Any:
    """The scorer of a fitted estimator in memory, read from its public attributes; a pipeline by its ``steps``."""
    name = type(model).__name__
    if name == "Pipeline":
        return Pipeline([from_fitted(step) for _, step in model.steps])
    kind, fields = FITTED[name]
    return kind(*(v.tolist() if hasattr(v, "tolist") else v for v in (getattr(model, f) for f in fields)))


def to_json(scorer: Any) -> str:
    """The parameters of a scorer as JSON: a form to store models in that, unlike a pickle, runs nothing when it is read."""
    if isinstance(scorer, Pipeline):
        return json.dumps({"model": "Pipeline", "steps": [json.loads(to_json(s)) for s in scorer.steps]})
    return json.dumps({"model": type(scorer).__name__, **vars(scorer)})


def from_json(text: str) -> Any:
    """The scorer that ``to_json`` wrote."""
    fields = json.loads(text)
    name = fields.pop("model")
    if name == "Pipeline":
        return Pipeline([from_json(json.dumps(s)) for s in fields["steps"]])
    return FITTED[name][0](**fields)
