"""Evaluating an expression once for all its uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once. Nested expressions name their parts many times, and projections would copy each of them."""
    return F.get(F.transform(F.array(value), use), 0)
