"""Names for the results of steps inside one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """The last of ``steps``, each of the result before it, which is worked out once however often a step names it."""
    one = F.array(value)
    for step in steps:
        one = F.transform(one, step)
    return F.get(one, F.lit(0))


def struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))
