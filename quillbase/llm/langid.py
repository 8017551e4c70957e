"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (n = 1 to 3, with
word borders), by frequency over all training documents. A document's own list is
compared with each profile: an n-gram adds the distance between its two places, or the
length of a profile if the language lacks it. The least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_count import code_points

TOP = 300
U = np.uint64
_BI, _UNI = U(1 << 63), U(3 << 62)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case code point of each letter; 0 for what is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                table[point] = ord(char.lower()[0])
        _letters.append(table)
    return _letters[0]


def grams(points: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: packed n-grams, and their n + 1 offsets by document.

    Each run of other characters, and each end of a text, is one border (0).
    """
    n = len(ends) - 1
    ends = ends + 2 * np.arange(n + 1)
    codes = np.zeros(ends[-1], np.uint32)
    inside = np.ones(ends[-1], bool)
    inside[ends[:-1]] = inside[ends[1:] - 1] = False
    codes[inside] = letters()[points]
    kept = codes > 0
    kept[1:] |= codes[:-1] > 0
    kept[ends[:-1]] = True
    where = np.concatenate([[0], np.cumsum(kept)])[ends]
    codes = codes[kept].astype(np.uint64)
    last = np.zeros(len(codes) + 1, bool)
    last[where] = True  # a document begins here
    a, b = codes[:-1], codes[1:]
    two = ~last[1:-1] & ((a | b) > 0)
    three = ~last[1:-2] & ~last[2:-1] & (codes[1:-1] > 0)
    out = []
    for keys, ok in ((_UNI | codes, codes > 0), (_BI | a << U(21) | b, two), (codes[:-2] << U(42) | codes[1:-1] << U(21) | codes[2:], three)):
        sums = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(ok, out=sums[1 : len(ok) + 1])
        sums[len(ok) + 1 :] = sums[len(ok)]
        out.append((keys[ok], sums[where]))
    return out


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each stands."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def ranked(keys: np.ndarray) -> np.ndarray:
    """The TOP most frequent keys, most frequent first, of equal ones the smaller first."""
    keys, counts = counted(keys)
    if len(keys) > TOP:
        enough = counts >= np.partition(counts, -TOP)[-TOP]
        keys, counts = keys[enough], counts[enough]
    return keys[np.argsort(-counts, kind="stable")][:TOP]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        data, ends = common.utf8(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), object)
        for i, j in common.slices(ends, 2 << 20):
            found = grams(*code_points(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]))
            for lang in set(langs[i:j]):
                own = langs[i:j] == lang
                keys, counts = counted(np.concatenate([k[np.repeat(own, np.diff(at))] for k, at in found]))
                if lang in sums:
                    old, n = sums[lang]
                    both, back = np.unique(np.concatenate([old, keys]), return_inverse=True)
                    keys, counts = both, np.bincount(back, np.concatenate([n, counts])).astype(np.int64)
                sums[lang] = keys, counts
            if sum(len(k) for k, _ in sums.values()) > 1_000_000:
                yield from rows()
    yield from rows()


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """Packed n-grams by rank for each language of ``docs`` (text, lang), counted over all of them."""
    counts = docs.select("text", "lang").mapInArrow(common.lean(_tally), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), (F.col("gram") < 0), "gram")  # as unsigned numbers
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).toPandas().sort_values(["lang", "rank"])
    return {lang: rows["gram"].to_numpy(np.int64).view(np.uint64) for lang, rows in top.groupby("lang")}


def _predict(known: dict[str, np.ndarray]):
    names = sorted(known)
    table = np.unique(np.concatenate([np.zeros(0, np.uint64), *known.values()]))
    ranks = np.full((len(table) + 1, len(names)), -1, np.int32)
    for k, name in enumerate(names):
        ranks[np.searchsorted(table, known[name]), k] = np.arange(len(known[name]))

    def one(keys: np.ndarray) -> tuple[str, float]:
        own = ranked(keys)
        if not len(own) or not names:
            return "und", 0.0
        at = np.searchsorted(table, own)
        at[table[np.minimum(at, len(table) - 1)] != own] = len(table)
        place = ranks[at]
        far = np.where(place < 0, TOP, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0) / (TOP * len(own))
        best = int(np.argmin(far))
        second = np.partition(far, 1)[1] if len(far) > 1 else 1.0
        return names[best], float(min(1.0, max(0.0, 1 - far[best] / second))) if second > 0 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch.column(1))
            for i, j in common.slices(ends):
                found = grams(*code_points(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]))
                said = [one(np.concatenate([k[at[d] : at[d + 1]] for k, at in found])) for d in range(j - i)]
                columns = [batch.column(0).slice(i, j - i), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, known: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of ``docs``.

    ``score`` is 1 - least distance / second least, 0 to 1. A text that is null, empty
    or without a letter, or any text where no language is known, gets ``und`` and 0. Of
    languages at one distance the first by name wins.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(common.lean(_predict(known)), "doc_id long, lang_pred string, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = common.crc_fold(F.col("doc_id"), 3) == 1
    known = profiles(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return identify(docs, known).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
