"""Evaluating a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once. What a lambda takes from outside is otherwise worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
