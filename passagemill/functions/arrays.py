"""Array expressions whose cost stays near the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with value evaluated once whatever use does with it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of an array of longs without nulls: each element combined with all before it. ``combine`` is associative.

    A fold that appends to an array copies it at every step. So runs of about the square root of the length are folded one by one, and then their totals:
    n elements cost about n times the root of n, not n squared.
    """

    def fold(array: Column) -> Column:
        return F.aggregate(
            array, F.array().cast("array<bigint>"),
            lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(combine(F.element_at(done, -1), x)))),
        )

    def of_runs(runs: Column) -> Column:
        totals = fold(F.transform(runs, lambda r: F.element_at(r, -1)))
        return bind(totals, lambda t: F.flatten(F.transform(runs, lambda r, k: F.when(k == 0, r).otherwise(F.transform(r, lambda x: combine(F.get(t, k - 1), x))))))

    def of_values(own: Column) -> Column:
        length = F.ceil(F.sqrt(F.size(own))).cast("int")
        starts = F.sequence(F.lit(1), F.size(own), length)
        return F.when(F.size(own) == 0, F.array().cast("array<bigint>")).otherwise(bind(F.transform(starts, lambda s: fold(F.slice(own, s, length))), of_runs))

    return bind(F.transform(values, lambda x: x.cast("long")), of_values)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, F.greatest)
