"""Column helpers that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it.

    An expression that a lambda names is otherwise computed again for each element.
    """
    return F.transform(F.array(value), body).getItem(0)


def indexes(n: Column) -> Column:
    """The array 0 .. n-1, empty if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running_sums(values: Column) -> Column:
    """Sums of the elements up to each element of an array of int.

    Adds within chunks of 64 elements and over the chunks before them, so that no array grows
    element by element.
    """

    def over(xs: Column) -> Column:
        chunks = F.transform(indexes(F.ceil(F.size(xs) / CHUNK).cast("int")), lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))
        return let(
            chunks,
            lambda cs: let(
                F.transform(cs, total),
                lambda sums: F.flatten(
                    F.transform(
                        cs,
                        lambda c, k: let(
                            total(F.slice(sums, F.lit(1), k)),
                            lambda before: F.transform(c, lambda _, i: before + total(F.slice(c, F.lit(1), i + 1))),
                        ),
                    )
                ),
            ),
        )

    return let(values, over)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)
