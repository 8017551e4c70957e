"""Aggregate functions for ``group_by``: an input field, an output name, an expression.

``max_of`` is the engine's own; the others are further instances of the same
extension point.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    field: str
    name: str
    function: Callable[[Column], Column]

    def column(self) -> Column:
        return self.function(F.col(f"`{self.field}`")).alias(self.name)


def _instance(prefix: str, function: Callable[[Column], Column]) -> Callable[[str], Aggregate]:
    return lambda field: Aggregate(field, f"{prefix}of{field}", function)


max_of = _instance("max", F.max)
min_of = _instance("min", F.min)
count_of = _instance("count", F.count)
sum_of = _instance("sum", F.sum)
avg_of = _instance("avg", F.avg)
