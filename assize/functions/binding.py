"""Evaluating an expression once where it is used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: projections would be merged, and each use in them computed anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
