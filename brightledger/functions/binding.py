"""Values that an expression needs more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is mentioned; inside lambdas Spark else computes each mention anew."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
