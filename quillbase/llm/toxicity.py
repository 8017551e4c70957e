"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are n-grams of 4, 6 and 8 characters (code points, lower-cased in A-Z), by a 64-bit
hash. Counted once a document over the labelled sample, each has a log ratio of its rates
in toxic and in other documents. The features that tell the classes apart best are kept,
scaled by their ratio, and a regularized logistic regression is fitted on them. A
document's score needs one look-up a character and n-gram length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .token_count import code_points

LENGTHS = (4, 6, 8)
#: Labelled rows to learn from at most (those of the smallest hash), and features kept: those furthest apart.
SAMPLE, FEATURES = 8000, 4096
#: Tasks that count the sample's n-grams: a few hundred documents each.
TASKS = 32
#: Standard errors that a feature's rates in the two classes must be apart: keeps chance out of small samples.
APART = 2.0
FILTER_BITS = 22
#: Places of a text that are looked up at a time.
PLACES = 1 << 18
U = np.uint64


def characters(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, lower-cased in A-Z, and their n + 1 offsets."""
    return code_points(kernels.LOWER[data], ends)


def packed(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, keys): a hash of the n code points from each place, for the LENGTHS; zeros follow the last one."""
    m = len(points)
    wide = np.concatenate([points.astype(np.uint64), np.zeros(8, np.uint64)])
    two = kernels.mix(wide[:-1] | wide[1:] << U(21))
    four = kernels.mix(two[: m + 4] * U(0xD6E8FEB86659FD93) + two[2 : m + 6])
    yield 4, four[:m]
    yield 6, kernels.mix(four[:m] * U(0x9FB21C651E98DF25) + two[4 : m + 4])
    yield 8, kernels.mix(four[:m] * U(0x9E3779B97F4A7C15) + four[4:])


def present(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each document: keys and n + 1 offsets."""
    parts: list[list[np.ndarray]] = [[] for _ in ends[1:]]
    for n, keys in packed(points):
        for d in range(len(ends) - 1):
            parts[d].append(keys[ends[d] : max(ends[d], ends[d + 1] - n + 1)])
    lists = [np.unique(np.concatenate(p)) for p in parts]
    return np.concatenate([np.zeros(0, np.uint64), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


@dataclass
class Model:
    """Sorted n-grams, their weights (log-count ratio included) and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def seen(self) -> np.ndarray:
        flags = np.zeros(1 << FILTER_BITS, bool)
        flags[self.slot(self.keys)] = True
        return flags

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> U(64 - FILTER_BITS)

    def found(self, points: np.ndarray, ends: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) once for each feature that a document holds, ordered."""
        pairs = [np.zeros(0, np.int64)]
        size = max(1, len(self.keys))
        for low in range(0, len(points) if len(self.keys) else 0, PLACES):
            for n, keys in packed(points[low : low + PLACES + max(LENGTHS)]):
                at = np.flatnonzero(seen[self.slot(keys[:PLACES])])
                own, at = keys[at], at + low
                doc = np.searchsorted(ends, at, "right") - 1
                feature = np.minimum(np.searchsorted(self.keys, own), size - 1)
                ok = (at + n <= ends[doc + 1]) & (self.keys[feature] == own)
                pairs.append(np.unique(doc[ok] * size + feature[ok]))
        both = np.unique(np.concatenate(pairs))
        return both // size, both % size


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = common.utf8(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in common.slices(ends, 1 << 19):
            keys, bounds = present(*characters(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]))
            yes = np.repeat(toxic[i:j], np.diff(bounds))
            both, back = np.unique(keys, return_inverse=True)
            n, pos = np.bincount(back, minlength=len(both)), np.bincount(back, yes, len(both)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(pos), pa.array(n - pos)], ["gram", "pos", "neg"])


def _lookup(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = model.seen()
        for batch in batches:
            data, ends = common.utf8(batch.column(0))
            doc, feature = model.found(*characters(data, ends), seen)
            bounds = np.searchsorted(doc, np.arange(len(ends))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))], ["toxic", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, left_out: int = 1, rounds: int = 150) -> Model:
    """Learn from at most ``sample`` labelled rows outside the left-out fold; null labels and ids don't count.

    Without both classes in the sample, the model says the share of toxic rows (0 for none).
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND id IS NOT NULL")
    marked = marked.where(common.crc_fold(F.col("id"), folds) != left_out).orderBy(F.xxhash64("id"), "id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("id")).select("text", "toxic")
    rows = common.settle(rows.repartition(TASKS))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    if pos in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if n and pos else -40.0)
    counts = rows.mapInArrow(common.lean(_presence), "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + 1) / (pos + 2), (F.col("neg") + 1) / (n - pos + 2)
    # How far the rates are apart, in standard errors of their difference.
    apart = F.abs(p - q) / F.sqrt(p * (1 - p) / (pos + 2) + q * (1 - q) / (n - pos + 2))
    best = counts.where("pos + neg >= 3").withColumns({"ratio": F.log(p) - F.log(q), "apart": apart})
    best = best.where(F.col("apart") >= APART).orderBy(F.desc("apart"), "gram").limit(FEATURES).select("gram", "ratio").toPandas()
    keys, ratio = best["gram"].to_numpy(np.int64).view(np.uint64), best["ratio"].to_numpy(float)
    order = np.argsort(keys)
    model = Model(keys[order], ratio[order], 0.0)
    table = rows.mapInArrow(common.lean(_lookup(model)), "toxic int, features array<int>").toArrow()
    lists = pc.list_value_length(table["features"]).to_numpy().astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in table["features"].chunks]])
    return regress(model, flat, lists, table["toxic"].to_numpy().astype(float), rounds)


def regress(model: Model, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int, decay: float = 1e-3) -> Model:
    """Logistic regression on the scaled features by full-batch Adam."""
    ratio, doc = model.weights, np.repeat(np.arange(len(sizes)), sizes)
    value = ratio[flat]
    w, b = np.zeros(len(ratio)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, rounds + 1):
        off = _sigmoid(np.bincount(doc, w[flat] * value, len(y)) + b) - y
        grad = np.append(np.bincount(flat, off[doc] * value, len(ratio)) / len(y) + decay * w, off.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(model.keys, w * ratio, b)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = model.seen()
        for batch in batches:
            data, ends = common.utf8(batch.column(0))
            out = np.zeros(len(ends) - 1)
            for i, j in common.slices(ends):
                doc, feature = model.found(*characters(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]), seen)
                out[i:j] = _sigmoid(np.bincount(doc, model.weights[feature], j - i) + model.bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[str(k) for k in range(batch.num_columns + 1)])

    return run


def toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with double ``out``: the probability that the text is toxic.

    A null or empty text holds no feature and gets the model's bias. Rows are scored
    one by one, whole texts; other columns pass through, a clash with ``out`` raises
    ValueError.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} exists")
    common.prepare(docs.sparkSession)
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[text], *[f for f in docs.schema.fields if f.name != text], T.StructField(out, T.DoubleType())])
    return docs.select([f.name for f in schema.fields[:-1]]).mapInArrow(common.lean(_score(model)), schema).select(*docs.columns, out)


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted over all documents."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity(docs.select("doc_id", "text"), model, out="score")
    held_out = common.crc_fold(F.col("doc_id"), 3) == 1
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
