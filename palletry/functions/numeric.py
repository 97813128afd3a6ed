"""Numeric column functions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def sorted_dims(l: Column, w: Column, h: Column) -> tuple[Column, Column, Column]:
    """Least, middle and greatest of three lengths."""
    low, high = F.least(l, w, h), F.greatest(l, w, h)
    return low, l + w + h - low - high, high


@F.pandas_udf(DoubleType())
def _exp(x: pd.Series) -> pd.Series:
    return pd.Series([math.exp(v) for v in x.to_numpy()], dtype="float64")  # a null comes and goes as NaN


def sigmoid(x: Column, exact: bool = False) -> Column:
    """1 / (1 + exp(-x)). `exact` takes the C library's exp, off by little more than half the last bit, where Spark's can be off by a whole
    one: where equal scores are counted as one, a wrong last bit splits or merges them."""
    power = -F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))
    return 1 / (1 + (_exp(power) if exact else F.exp(power)))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def clip(x: Column, low: float, high: float) -> Column:
    """x kept between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or `default` where b is zero."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def missing(c: Column) -> Column:
    """A number from text; blank and NaN are null."""
    number = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def scaled(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant column keeps its offset (range 0 counts as 1)."""
    return (x - low) / F.when(high == low, 1.0).otherwise(high - low)


def weighted_sum(terms: Iterable[tuple[float, Column]], intercept: float) -> Column:
    """One flat sum of products, which stays inside one generated stage."""
    out = F.lit(float(intercept))
    for w, c in terms:
        out = out + F.lit(float(w)) * c
    return out


def l2(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Euclidean distance; a null difference counts as zero."""
    total = F.lit(0.0)
    for a, b in pairs:
        d = a - b
        total = total + F.coalesce(d * d, F.lit(0.0))
    return F.sqrt(total)


def hash_fraction(*keys: Column, seed: int = 42) -> Column:
    """A reproducible uniform number in [0, 1) for each row, from an MD5 any engine can compute."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
