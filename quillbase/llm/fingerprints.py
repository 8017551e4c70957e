"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint retains every hash of a distinct five-word shingle that falls below a
fixed fraction of the hash range. Its size follows the document's, equal hashes are
retained in every document or in none, so fingerprints can be merged (the union is the
sketch of the union) and estimate similarity and containment between documents of any
lengths. Format: ``shingles:digest:hashes``, the number of distinct shingles, a digest of
the whole set, and base64 of the retained hashes as ascending 32-bit numbers.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels

#: Part of the hash range that is retained, as a power of two: 1/4.
SCALE = 2
U = np.uint64


@dataclass(frozen=True)
class Sketch:
    shingles: int
    digest: int
    kept: np.ndarray  # ascending uint32

    def text(self) -> str:
        return f"{self.shingles}:{self.digest:016x}:{base64.b64encode(self.kept.astype('<u4').tobytes()).decode()}"

    @staticmethod
    def parse(text: str) -> Sketch:
        n, digest, kept = text.split(":")
        return Sketch(int(n), int(digest, 16), np.frombuffer(base64.b64decode(kept), "<u4"))

    def merged(self, other: Sketch) -> np.ndarray:
        """Retained hashes of the union of both documents."""
        return np.union1d(self.kept, other.kept)

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; where nothing was retained, 1 for equal sets and else 0."""
        if (self.shingles, self.digest) == (other.shingles, other.digest):
            return 1.0
        both = shared(self.kept, other.kept)
        union = len(self.kept) + len(other.kept) - both
        return both / union if union else 0.0

    def containment(self, other: Sketch) -> float:
        """Estimated part of this document's shingles that the other has too."""
        if (self.shingles, self.digest) == (other.shingles, other.digest):
            return 1.0
        return shared(self.kept, other.kept) / len(self.kept) if len(self.kept) else 0.0


def shared(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def sketches(texts: list[str]) -> list[Sketch]:
    """The sketch of each text."""
    data, ends = common.utf8(pa.array(texts, pa.large_string()))
    out: list[Sketch] = []
    for i, j in common.slices(ends):
        keys, bounds = kernels.shingles(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        sums = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(kernels.mix(keys ^ U(0x452821E638D01377)), out=sums[1:])
        digest = (sums[bounds[1:]] - sums[bounds[:-1]]).tolist()
        low = keys < U(1 << (64 - SCALE))
        at = np.concatenate([[0], np.cumsum(low)])[bounds]
        kept = (keys[low] >> U(32 - SCALE)).astype(np.uint32)
        size = np.diff(bounds).tolist()
        out += [Sketch(size[d], digest[d], kept[at[d] : at[d + 1]]) for d in range(j - i)]
    return out


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = sketches([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.text() for s in made], pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint for each row of ``docs``; null and empty texts have the empty sketch."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(common.lean(_plain), "doc_id long, fingerprint string")


#: Blocks of neighbouring ids: rows in one where the table is small, blocks at most, and knots between them.
BLOCK_ROWS, MOST_BLOCKS, KNOTS = 256, 100_000, 256
#: Parts into which the rows of one frequent id, or without an id, are dealt by a hash of their texts.
PARTS = 256
HASH_BITS = 62


def _search(value: Column, knots: list[int], first: int, last: int) -> Column:
    """Number of knots at or below ``value``, by a balanced tree of comparisons."""
    if first == last:
        return F.lit(first)
    mid = (first + last) // 2
    return F.when(value < F.lit(knots[mid]), _search(value, knots, first, mid)).otherwise(_search(value, knots, mid + 1, last))


def blocks(docs: DataFrame) -> Column:
    """A map of (doc_id, hash) to at most MOST_BLOCKS numbers of about equally many rows, and PARTS times as many for frequent ids.

    Monotone in the id and, among rows of one frequent id, falling with the hash. Piecewise
    linear between approximate quantiles; an id at which two quantiles lie is frequent. Rows
    without an id have the lowest blocks.
    """
    rows = docs.count()
    cells = min(MOST_BLOCKS, rows // BLOCK_ROWS + 1)
    parts = min(KNOTS, cells)
    found = Counter(int(q) for q in docs.approxQuantile("doc_id", [k / parts for k in range(parts + 1)], 0.2 / parts)) if rows else {}
    knots, often = sorted(found), [q for q, n in found.items() if n > 1]
    part = F.lit(PARTS - 1) - F.shiftright(F.col("hash"), HASH_BITS + 1 - PARTS.bit_length()).cast("int")
    if not knots:
        return F.when(F.col("doc_id").isNull(), part - PARTS).otherwise(F.lit(0)).cast("int")
    each = math.ceil(cells / parts)
    at = _search(F.col("doc_id"), knots, 0, len(knots))
    low = F.element_at(F.array(*map(F.lit, [knots[0], *knots])), at + 1)
    high = F.element_at(F.array(*map(F.lit, [*knots, knots[-1] + 1])), at + 1)
    inner = F.least(F.lit(each - 1), F.floor((F.col("doc_id") - low) * F.lit(float(each)) / (high - low)))
    inside = (at > 0) & (at < len(knots))
    block = at * each + F.when(inside, F.greatest(F.lit(0), inner)).otherwise(F.lit(0))
    block = block * PARTS + F.when(F.col("doc_id").isin(often), part).otherwise(F.lit(0))
    return F.when(F.col("doc_id").isNull(), part - PARTS).otherwise(block).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(block, copy, doc_id, text), each block in descending order of id, then by a hash of the
    text, and followed by a copy of the document that comes after it; after the last comes the first.

    The texts are shuffled once. Only each block's first document is needed elsewhere:
    one row a block, so that table has a proven bound and is broadcast.
    """
    docs = docs.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 64 - HASH_BITS))
    placed = docs.withColumn("block", blocks(docs))
    heads = placed.groupBy("block").agg(F.max(F.struct("doc_id", (-F.col("hash")).alias("less"))).alias("head"))
    up = Window.partitionBy(F.lit(0)).orderBy("block")
    lowest = F.min("block").over(Window.partitionBy(F.lit(0)))
    to = F.coalesce(F.lead("block").over(up), lowest).alias("to")
    heads = common.settle(heads.select(F.col("head.doc_id").alias("head"), (-F.col("head.less")).alias("head_hash"), to))
    same = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("head_hash"))
    copies = docs.join(F.broadcast(heads), same).groupBy("to", "doc_id", "hash").agg(F.min("text").alias("text"))
    copies = copies.select(F.col("to").alias("block"), F.lit(1).alias("copy"), "doc_id", "hash", "text")
    rows = placed.select("block", F.lit(0).alias("copy"), "doc_id", "hash", "text").union(copies).repartition("block")
    return rows.sortWithinPartitions("block", "copy", F.col("doc_id").desc_nulls_last(), "hash", "text").drop("hash")


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as much of the begin of ``after``."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[str] = []
    copy: list[int] = []
    for batch in batches:
        copy += batch.column(1).to_pylist()
        ids += batch.column(2).to_pylist()
        texts += batch.column(3).to_pylist()
        own = sketches(texts)
        at = [i for i in range(len(texts) - 1) if not copy[i]]
        changed = [edited(texts[i], texts[i + 1]) for i in at]
        other = sketches(changed)
        columns = [
            pa.array([ids[i] for i in at], pa.int64()),
            pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([own[i].text() for i in at], pa.string()),
            pa.array([s.text() for s in other], pa.string()),
            pa.array([own[i].likeness(s) for i, s in zip(at, other, strict=True)], pa.float64()),
            pa.array([own[i].likeness(own[i + 1]) for i in at], pa.float64()),
            pa.array([own[i].containment(s) for i, s in zip(at, other, strict=True)], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCHEMA.split(", ")])
        keep = -1 if not copy[-1] else len(copy)
        ids, texts, copy = ids[keep:], texts[keep:], copy[keep:]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"


def edit_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    One row for each row of ``docs``. The next document is that of the next lower id;
    rows of one id stand in the order of a hash of their texts, those without an id come
    last. Null texts are empty; a single row is its own next document. Only doc_id and text
    are read.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_next(rows).mapInArrow(common.lean(_compare), _SCHEMA)


def op2(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likenesses over all documents."""
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
