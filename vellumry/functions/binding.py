"""A value bound to a name inside an expression.

A lambda of a higher-order function evaluates every expression in its body anew for each element. An array that a lambda
looks into must therefore be a column or bound first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
