"""Arrays as columns: values computed once, and sums over what lies before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """Of each place the sum up to there: each round adds what lies twice as far back."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    back = lambda a, i, k: F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda x, i: x + back(acc, i, k)))
