"""Versioned tables: immutable Parquet parts named by a root manifest.

    <root>/manifest/<n>.json            the state of all tables, views and indexes after commit n
    <root>/parts/<id>/                  rows; never changed once written
    <root>/index/<index>/part=<id>/     a part's rows again, by hash bucket and value of the indexed field

A commit creates the next manifest, a single file that only one writer can create, so
it covers any number of tables at once. Inserting adds a part; deleting and updating
write again only the parts that hold rows concerned. Of parts of one order of magnitude,
MERGE are written again as one, so a table of n rows has some MERGE * log n of them.
Readers keep the manifest they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import value_bucket
from ..plans.sql import SqlError
from .files import Files


#: Parts of one order of magnitude that are merged, and manifests that are kept.
MERGE, KEEP = 16, 20


class Conflict(RuntimeError):
    """Another transaction has changed the same table, view or index meanwhile."""


@dataclass
class Table:
    #: (name, length): None for an int.
    fields: list[tuple[str, int | None]]
    #: Rows of each part.
    parts: dict[str, int] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.IntegerType() if length is None else T.StringType()) for n, length in self.fields])


@dataclass
class Manifest:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    #: index -> (table, field)
    indexes: dict[str, tuple[str, str]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self)) + "\n"

    @staticmethod
    def parse(text: str) -> Manifest:
        d = json.loads(text)
        tables = {n: Table([(f, length) for f, length in t["fields"]], t["parts"]) for n, t in d["tables"].items()}
        return Manifest(d["number"], tables, d["views"], {n: (t, f) for n, (t, f) in d["indexes"].items()})


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root

    def _numbers(self) -> list[int]:
        return sorted((int(n[:-5]) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _read(self, number: int) -> Manifest | None:
        """A whole manifest; one without its line end was torn by a writer that died."""
        text = self.files.read(f"{self.root}/manifest/{number}.json")
        return Manifest.parse(text) if text.endswith("\n") else None

    def current(self) -> Manifest:
        """The newest whole manifest."""
        return next((m for n in self._numbers() if (m := self._read(n))), Manifest())

    def publish(self, base: Manifest, mine: Manifest) -> Manifest:
        """Commit what ``mine`` changed since ``base`` on top of the newest manifest."""
        while True:
            now = self.current()
            merged = Manifest.parse(now.text())
            for kind in ("tables", "views", "indexes"):
                old, new, latest = getattr(base, kind), getattr(mine, kind), getattr(now, kind)
                for name in old.keys() | new.keys():
                    if old.get(name) != new.get(name):
                        if latest.get(name) != old.get(name):
                            raise Conflict(f"{name} has changed since this transaction began")
                        getattr(merged, kind)[name] = new[name]
            numbers = self._numbers()
            if any(n > now.number and self._read(n) for n in numbers):
                continue  # another commit came in between
            merged.number = max([now.number, *numbers]) + 1
            if self.files.create(f"{self.root}/manifest/{merged.number}.json", merged.text()):
                for n in numbers[KEEP - 1 :]:
                    self.files.delete(f"{self.root}/manifest/{n}.json")
                return merged

    def recover(self) -> None:
        """Remove torn manifests, and parts and index copies that the newest one doesn't name: what
        transactions that never committed, and older states, have left.

        For the start, before any other session reads or writes below this root."""
        now = self.current()
        for name in self.files.names(f"{self.root}/manifest"):
            if name != f"{now.number}.json":
                self.files.delete(f"{self.root}/manifest/{name}")
        alive = {p for t in now.tables.values() for p in t.parts}
        for part in self.files.names(f"{self.root}/parts"):
            if part not in alive:
                self.files.delete(f"{self.root}/parts/{part}")
        for index in self.files.names(f"{self.root}/index"):
            for folder in self.files.names(f"{self.root}/index/{index}"):
                if folder.removeprefix("part=") not in alive or index not in now.indexes:
                    self.files.delete(f"{self.root}/index/{index}/{folder}")

    def discard(self, part: str, indexes: Iterable[str]) -> None:
        """Remove a part that no manifest names, with its index copies."""
        self.files.delete(f"{self.root}/parts/{part}")
        for index in indexes:
            self.files.delete(f"{self.root}/index/{index}/part={part}")

    def read(self, table: Table, parts: Iterable[str] | None = None) -> DataFrame:
        parts = table.parts if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*[f"{self.root}/parts/{p}" for p in parts])

    def write(self, rows: DataFrame, indexes: dict[str, str], table: Table) -> tuple[str, int]:
        """A new part of ``rows``, with a copy for each index (name -> field), and its number of rows.

        Strings that are too long for their fields are found in the same pass and refuse the part.
        """
        part, seen = uuid.uuid4().hex, Observation()
        limited = [(n, length) for n, length in table.fields if length is not None]
        rows = rows.select([f.name for f in table.schema()])
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.max(F.length(F.col(f"`{n}`"))).alias(f"l{k}") for k, (n, _) in enumerate(limited)])
        rows.write.parquet(f"{self.root}/parts/{part}")
        found = seen.get
        for k, (n, length) in enumerate(limited):
            if (found.get(f"l{k}") or 0) > length:
                self.discard(part, ())
                raise SqlError(f"{n} has at most {length} characters")
        for index, name in indexes.items():
            self.write_index(index, name, table, part)
        return part, found["rows"]

    def merged(self, table: Table, indexes: dict[str, str]) -> dict[str, int]:
        """The parts of ``table``, of each order of magnitude at most MERGE: more are written again as one."""
        parts = dict(table.parts)
        while True:
            sizes: dict[int, list[str]] = {}
            for p, n in parts.items():
                sizes.setdefault(max(0, n - 1).bit_length() // (MERGE.bit_length() - 1), []).append(p)
            many = next((ps for ps in sizes.values() if len(ps) > MERGE), None)
            if many is None:
                return parts
            part, n = self.write(self.read(table, many), indexes, table)
            parts = {p: k for p, k in parts.items() if p not in many} | {part: n}

    def write_index(self, index: str, name: str, table: Table, part: str) -> None:
        """A part's rows in files of neighbouring values within one bucket.

        The ranges are of about equal size, however often a bucket or a value occurs: equal
        values are dealt by a hash of their rows. Files of sorted values are skipped by
        their least and greatest one.
        """
        rows = self.read(table, [part]).withColumn("_bucket", self.bucket(table, name, F.col(f"`{name}`")))
        columns = [F.col(f"`{f.name}`") for f in table.schema()]
        rows = rows.repartitionByRange(F.col("_bucket"), F.col(f"`{name}`"), F.xxhash64(*columns)).sortWithinPartitions("_bucket", F.col(f"`{name}`"))
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/index/{index}/part={part}")

    def bucket(self, table: Table, name: str, value: Column) -> Column:
        return value_bucket(value, dict(table.fields)[name] is not None)

    def read_index(self, index: str, table: Table) -> DataFrame:
        """The rows of the table with ``_bucket`` and ``part``, partition columns: one scan of all parts' copies."""
        partition = [T.StructField("part", T.StringType()), T.StructField("_bucket", T.IntegerType())]
        schema = T.StructType([*table.schema().fields, *partition])
        place = f"{self.root}/index/{index}"
        found = [p for p, n in table.parts.items() if n]  # of no rows there is no file
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", place).parquet(*[f"{place}/part={p}" for p in found])

    def touched(self, table: Table, condition: Column, index: DataFrame | None = None) -> dict[str, int]:
        """Rows that meet ``condition``, by part; looked up in ``index``, rows of the table with their part, if there is one."""
        if not table.parts:
            return {}
        rows = index
        if rows is None:
            rows = self.read(table).withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"/parts/([0-9a-f]{32})/", 1))
        return {r["part"]: r["count"] for r in rows.where(condition).groupBy("part").count().collect()}


def checked(value: int | str, length: int | None, name: str) -> int | str:
    """A value for a column of that length (None: int), or SqlError."""
    if isinstance(value, str) != (length is not None):
        raise SqlError(f"field {name} takes {'an int' if length is None else 'a string'}")
    if length is None and not -(2**31) <= value < 2**31:
        raise SqlError(f"{value} doesn't fit an int")
    if length is not None and len(value) > length:
        raise SqlError(f"{name} has at most {length} characters")
    return value
