"""Naming a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is written and computed once however often ``body`` names it.

    A plain Python variable would repeat the whole expression at each use, and nested uses multiply.
    """
    return F.transform(F.array(value), body).getItem(0)
