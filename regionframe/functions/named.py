"""Operators by name: registries, metrics chosen by a specification, and losses with weights and reductions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Names:
    """Objects by name. A name is given once; ``find`` also tries the name with a suffix."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def add(self, thing, suffix: str | None = None):
        name = thing.__name__ if suffix is None else f"{thing.__name__}_{suffix}"
        if name in self.known:
            raise KeyError(f"{self.kind} {name!r} is there already")
        self.known[name] = thing
        return thing

    def find(self, name: str, suffix: str = "regionframe"):
        for one in (name, f"{name}_{suffix}"):
            if one in self.known:
                return self.known[one]
        raise KeyError(f"no {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")

    def __contains__(self, name: str) -> bool:
        return name in self.known


METRICS, LOSSES = Names("metric"), Names("loss")


def measure(df: DataFrame, by: list[str], *specs: dict) -> DataFrame:
    """One aggregation with a metric for each specification: ``type``, its arguments, and ``as`` for its name."""
    columns = [METRICS.find(s["type"])(**{k: v for k, v in s.items() if k not in ("type", "as")}).alias(s.get("as", s["type"])) for s in specs]
    return df.groupBy(*by).agg(*columns)


def reducible(elementwise: Callable[..., Column]) -> Callable[..., Column]:
    """A loss of columns from an element's loss: weighted, and reduced by ``mean`` (over the weights), ``sum`` or ``none``."""

    def loss(prediction: Column, target: Column, weight: Column | None = None, reduction: str = "mean", **options) -> Column:
        each = elementwise(prediction, target, **options)
        each = each if weight is None else each * weight
        if reduction == "none":
            return each
        if reduction == "sum":
            return F.sum(each)
        if reduction != "mean":
            raise ValueError("reduction is 'mean', 'sum' or 'none'")
        return F.avg(each) if weight is None else F.sum(each) / F.nullif(F.sum(weight), F.lit(0))

    loss.__name__ = elementwise.__name__
    return LOSSES.add(loss)


@reducible
def l1(prediction: Column, target: Column) -> Column:
    return F.abs(prediction - target)


@reducible
def mse(prediction: Column, target: Column) -> Column:
    return (prediction - target) * (prediction - target)


@reducible
def charbonnier(prediction: Column, target: Column, eps: float = 1e-12) -> Column:
    return F.sqrt((prediction - target) * (prediction - target) + eps)


@METRICS.add
def psnr(a: str, b: str, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio of two columns, infinite where they are equal."""
    error = F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return F.when(error == 0, float("inf")).otherwise(10 * F.log10(peak * peak / error))


@METRICS.add
def accuracy(a: str, b: str) -> Column:
    return F.avg((F.col(a) == F.col(b)).cast("double"))
