"""Statements to DataFrames: one product, one filter, one projection; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sql import Constant, Expression, Field, Predicate, Query, SqlError


def kind(data_type: T.DataType) -> str:
    """Types of one kind can be equal; values of different kinds never are."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return data_type.simpleString()


class Scope:
    """Fields of a DataFrame by name, in any case; each name stands for one column."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.names: dict[str, list[str]] = {}
        for name in df.columns:
            self.names.setdefault(name.lower(), []).append(name)

    def column(self, name: str) -> str:
        found = self.names.get(name.lower(), [])
        if len(found) != 1:
            raise SqlError(f"field {name} is {'ambiguous' if found else 'unknown'}")
        return found[0]

    def typed(self, e: Expression) -> tuple[Column, str]:
        if isinstance(e, Constant):
            return F.lit(e.value), "number" if isinstance(e.value, int) else "text"
        name = self.column(e.name)
        return F.col(f"`{name}`"), kind(self.df.schema[name].dataType)

    def condition(self, predicate: Predicate) -> Column:
        """The conjunction; a term whose sides are of different kinds is false."""
        found = F.lit(True)
        for term in predicate.terms:
            (left, a), (right, b) = self.typed(term.left), self.typed(term.right)
            found = found & (left == right if a == b else F.lit(False))
        return found


def build(query: Query, resolve: Callable[[str], DataFrame], pruned: Callable[[Scope], list[Column]] = lambda scope: []) -> DataFrame:
    """The rows of ``query``. ``resolve`` gives the DataFrame of a table or view name, ``pruned``
    further conditions that all rows asked for meet."""
    if len({f.lower() for f in query.fields}) < len(query.fields):
        raise SqlError("a field is listed twice")
    if len({t.lower() for t in query.tables}) < len(query.tables):
        raise SqlError("a table is listed twice, and fields have no qualified names")
    rows = reduce(DataFrame.crossJoin, [resolve(t) for t in query.tables])
    scope = Scope(rows)
    condition = scope.condition(query.predicate)
    fields = [F.col(f"`{scope.column(f)}`").alias(f) for f in query.fields]
    for more in pruned(scope):
        condition = condition & more
    return rows.filter(condition).select(*fields) if query.predicate.terms else rows.select(*fields)


def assigned(df: DataFrame, field: str, value: Expression) -> tuple[str, Column]:
    """The stored name of ``field`` and the new value, refused if its kind differs."""
    scope = Scope(df)
    name = scope.column(field)
    (new, a), (_, b) = scope.typed(value), scope.typed(Field(field))
    if a != b:
        raise SqlError(f"field {field} takes a {b}, not a {a}")
    return name, new
