"""Scores of texts from scores of their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def top_mean(values: Column, share: float) -> Column:
    """The mean of the largest values: the given share of them, at least one."""
    k = F.greatest(F.ceil(F.size(values) * share), F.lit(1)).cast("int")
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def squared_distance(a: Column, b: Column) -> Column:
    """Of two vectors of one size."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def margin(vector: Column, against: list[Column], toward: list[Column], scale: float, limit: float = 30.0) -> Column:
    """How much nearer a vector is to each prototype of one kind than to the other kind's together: scaled squared distances, the log of the other kind's sum as reference, clamped.
    Combined over the kind's prototypes as the log of their sum."""
    near = lambda p: -scale * squared_distance(vector, p)
    reference = log_sum_exp(F.array(*map(near, against)))
    return log_sum_exp(F.transform(F.array(*map(near, toward)), lambda x: clamped(x - reference, -limit, limit)))


def log_sum_exp(values: Column) -> Column:
    most = F.array_max(values)
    return most + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - most)))
