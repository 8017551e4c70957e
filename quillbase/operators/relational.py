"""The relational operators as functions on DataFrames.

All joins keep both sides' columns, left then right, the join fields included.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.build import Scope
from ..plans.sql import Predicate
from .aggregates import Aggregate

#: Bytes, as the optimizer estimates them, up to which a side may be broadcast.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the rows of ``df``: the files' bytes and the columns kept; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcastable(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is estimated at no more than ``limit`` bytes."""
    return estimated_bytes(df) <= limit


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """Named fields in the order given; duplicate rows stay."""
    scope = Scope(df)
    return df.select(*[F.col(f"`{scope.column(f)}`").alias(f) for f in fields])


def select(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.filter(Scope(df).condition(predicate))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows; empty if a side is."""
    return left.crossJoin(right)


def chunked_product(left: DataFrame, right: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A product that holds one side in memory where its estimated bytes allow it.

    The right side is broadcast within ``limit``, else the left; beyond it on both sides,
    partitions meet partitions.
    """
    if broadcastable(right, limit):
        return left.crossJoin(F.broadcast(right))
    if broadcastable(left, limit):
        return F.broadcast(left).crossJoin(right)
    return left.crossJoin(right)


def _on(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> Column:
    return left[Scope(left).column(left_field)] == right[Scope(right).column(right_field)]


def equi_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """Rows of equal fields; the optimizer chooses how."""
    return left.join(right, _on(left, right, left_field, right_field))


def merge_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """The same by sorting both sides; many rows of one value on both sides give all their pairs."""
    return left.hint("merge").join(right.hint("merge"), _on(left, right, left_field, right_field))


def sort(df: DataFrame, fields: list[str]) -> DataFrame:
    """Ascending by the fields in turn, strings by their bytes."""
    scope = Scope(df)
    return df.orderBy(*[F.col(f"`{scope.column(f)}`").asc() for f in fields])


def group_by(df: DataFrame, fields: list[str], aggregates: list[Aggregate] = ()) -> DataFrame:
    """One row a group. Without aggregates the distinct keys; without fields one group, none for no rows."""
    scope = Scope(df)
    keys = [F.col(f"`{scope.column(f)}`").alias(f) for f in fields]
    if not aggregates:
        return df.select(*keys).distinct()
    columns = [a.column() for a in aggregates]
    if keys:
        return df.groupBy(*keys).agg(*columns)
    return df.agg(*columns, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")


def materialize(df: DataFrame) -> DataFrame:
    """Kept in memory, and on disk beyond it; lost parts are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def temp_table(df: DataFrame, root: str) -> DataFrame:
    """Written to a folder of its own below ``root`` and read back: cuts the lineage."""
    path = f"{root.rstrip('/')}/temp-{os.urandom(8).hex()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
