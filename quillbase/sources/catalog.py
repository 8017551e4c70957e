"""The catalog as four queryable tables, made from the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.layout import layout
from .store import Manifest

#: The catalog's own tables, the longest name and the longest view text.
NAME_LENGTH, VIEW_LENGTH = 16, 100
TABLES: dict[str, list[tuple[str, int | None]]] = {
    "tblcat": [("tblname", NAME_LENGTH), ("slotsize", None)],
    "fldcat": [("tblname", NAME_LENGTH), ("fldname", NAME_LENGTH), ("type", None), ("length", None), ("offset", None)],
    "viewcat": [("viewname", NAME_LENGTH), ("viewdef", VIEW_LENGTH)],
    "idxcat": [("indexname", NAME_LENGTH), ("tablename", NAME_LENGTH), ("fieldname", NAME_LENGTH)],
}
#: Field types.
INT, VARCHAR = 0, 1


def frame(spark: SparkSession, name: str, manifest: Manifest) -> DataFrame:
    """One of the four, over itself and the manifest's tables."""
    tables = TABLES | {n: t.fields for n, t in manifest.tables.items()}
    if name == "tblcat":
        rows = [(n, layout(f).slot_size) for n, f in tables.items()]
    elif name == "fldcat":
        rows = [(n, f, INT if length is None else VARCHAR, length or 0, layout(fields).offsets[f]) for n, fields in tables.items() for f, length in fields]
    elif name == "viewcat":
        rows = list(manifest.views.items())
    else:
        rows = [(i, t, f) for i, (t, f) in manifest.indexes.items()]
    schema = ", ".join(f"`{n}` {'int' if length is None else 'string'}" for n, length in TABLES[name])
    return spark.createDataFrame(rows, schema)
