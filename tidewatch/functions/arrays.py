"""Expressions over array<double> columns; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def std_pop(x: Column) -> Column:
    return F.sqrt(F.try_divide(total(F.transform(x, lambda v: v * v)), F.size(x)) - mean(x) * mean(x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def moving_average(x: Column, window: int) -> Column:
    """Valid positions only: size - window + 1 values, in order of their last day."""
    ends = F.when(F.size(x) >= window, F.sequence(F.lit(window), F.size(x))).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: total(F.slice(x, i - window + 1, window)) / window)


def trim(x: Column, bound: Column) -> Column:
    """Zero where a value does not exceed the bound."""
    return F.transform(x, lambda v: F.when(v > bound, v).otherwise(0.0))


def divergence(p: Column, q: Column, sp: Column, sq: Column) -> Column:
    """KL divergence in bits after scaling both by their sums; infinite where q is 0 and p is not; null for a zero vector. The
    sums are columns of their own, as an expression within the lambda would be worked out for every element."""
    term = lambda a, b: F.when(a == 0, 0.0).when(b == 0, F.lit(float("inf"))).otherwise((a / sp) * F.log2((a / sp) / (b / sq)))
    return F.when((sp > 0) & (sq > 0), total(F.zip_with(p, q, term)))


def jensen_shannon(p: Column, q: Column, sp: Column, sq: Column) -> Column:
    """In bits, with the mixture taken before scaling (as event detection by clusters does), in one pass."""
    half = lambda a, b, s: F.when(a == 0, 0.0).otherwise((a / s) * F.log2((a / s) / ((a + b) / (sp + sq))))
    return F.when((sp > 0) & (sq > 0), total(F.zip_with(p, q, lambda a, b: half(a, b, sp) + half(b, a, sq))) / 2)
