"""Quality: a byte-level convolutional network in numpy.

Each of FILTERS learned filters looks at WIDTH bytes (one-hot, so a filter is a table of
WIDTH x 256 weights). Its responses, rectified, are max-pooled over overlapping chunks
that cover the whole document; a linear layer turns a chunk's pooled values into a
logit, and the mean of the chunk logits into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH, FILTERS = 4, 24
#: A chunk is two blocks long and begins at every block.
BLOCK = 512
#: Labelled documents to learn from at most, and bytes of their whole texts: those of the smallest hash.
SAMPLE, SAMPLE_BYTES = 3000, 16 << 20


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    offset: np.ndarray  # FILTERS
    weights: np.ndarray  # FILTERS
    bias: float


def constant(share: float) -> Network:
    """A network that says ``share`` for any text."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share))))


def padded(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with WIDTH zero bytes after each: bytes and offsets."""
    n, size = len(ends) - 1, np.diff(ends)
    out = np.zeros(len(data) + WIDTH * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * WIDTH, size)] = data
    return out, ends + WIDTH * np.arange(n + 1)


def responses(net: Network, data: np.ndarray) -> np.ndarray:
    """Filter responses at each place of ``data`` but the last WIDTH - 1, before the offset."""
    n = len(data) - WIDTH + 1
    out = net.filters[0][data[:n]]
    for k in range(1, WIDTH):
        out += net.filters[k][data[k : k + n]]
    return out


@dataclass
class Blocks:
    """Padded documents cut into blocks: a document has a place for each byte, and one more."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(data: np.ndarray, ends: np.ndarray) -> Blocks:
        own = np.diff(ends) // BLOCK + 1
        data, ends = padded(data, ends)
        doc = np.repeat(np.arange(len(own)), own)
        starts = ends[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)) * BLOCK
        return Blocks(data, starts, np.minimum(starts + BLOCK, ends[doc + 1] - WIDTH + 1), doc)

    def peaks(self, net: Network, places: bool = False, step: int = 128) -> tuple[np.ndarray, np.ndarray | None]:
        """The highest response of each filter in each block, and the place where it stands.

        ``step`` blocks at a time, so that the responses stay in cache."""
        peak = np.empty((len(self.doc), FILTERS), np.float32)
        where = np.empty((len(self.doc), FILTERS), np.int64) if places else None
        for a in range(0, len(self.doc), step):
            b = min(a + step, len(self.doc))
            first = self.starts[a]
            values = responses(net, self.data[first : self.stops[b - 1] + WIDTH - 1])
            if places:
                for k in range(a, b):
                    own = values[self.starts[k] - first : self.stops[k] - first]
                    at = own.argmax(axis=0)
                    peak[k], where[k] = own[at, np.arange(FILTERS)], at + self.starts[k]
            else:
                # What lies between two documents belongs to the pad: the odd cuts.
                cuts = np.stack([self.starts[a:b] - first, self.stops[a:b] - first], axis=1).ravel()
                peak[a:b] = np.maximum.reduceat(values, cuts[:-1], axis=0)[::2]
        return peak, where

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First block, last block and document of each chunk: two neighbouring blocks, or a document's only one."""
        pair = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        sizes = np.bincount(self.doc)
        alone = (np.cumsum(sizes) - 1)[sizes == 1]
        return np.concatenate([pair, alone]), np.concatenate([pair + 1, alone]), np.concatenate([self.doc[pair], self.doc[alone]])


def probabilities(net: Network, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One probability for each document."""
    n = len(ends) - 1
    blocks = Blocks.of(data, ends)
    peak, _ = blocks.peaks(net)
    first, last, owner = blocks.chunks()
    pooled = np.maximum(np.maximum(peak[first], peak[last]) + net.offset, 0)
    logit = pooled @ net.weights + net.bias
    mean = np.bincount(owner, logit.astype(float), n) / np.maximum(1, np.bincount(owner, minlength=n))
    return 1 / (1 + np.exp(-np.clip(mean, -40, 40)))


def train(texts: list[np.ndarray], y: np.ndarray, steps: int = 640, batch: int = 48) -> Network:
    """Fit by about ``steps`` of Adam, at most 100 passes, on the documents' mean chunk logits: all chunks of whole ``texts``."""
    rng = np.random.default_rng(3)
    if len(np.unique(y)) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), 0.0)
    params = [net.filters, net.offset, net.weights, np.zeros(1, np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    epochs = min(100, -(-steps * batch // len(y)))
    column = np.arange(FILTERS)
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.02 * (1 - epoch / epochs)
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            blocks = Blocks.of(np.concatenate([texts[d] for d in docs]), np.concatenate([[0], np.cumsum([len(texts[d]) for d in docs])]))
            peak, where = blocks.peaks(net, places=True)
            first, last, doc = blocks.chunks()
            later = peak[last] > peak[first]
            place = np.where(later, where[last], where[first])
            pooled = np.maximum(np.where(later, peak[last], peak[first]) + params[1], 0)
            logit = pooled @ params[2] + params[3][0]
            size = np.bincount(doc, minlength=len(docs))
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, logit, len(docs)) / size, -40, 40)))
            off = ((p - y[docs]) / len(docs) / size)[doc].astype(np.float32)
            back = off[:, None] * params[2] * (pooled > 0)
            cell = np.concatenate([((j * 256 + blocks.data[place + j].astype(np.int64)) * FILTERS + column).ravel() for j in range(WIDTH)])
            filters = np.bincount(cell, np.tile(back.ravel(), WIDTH), net.filters.size).reshape(net.filters.shape).astype(np.float32)
            grads = [filters, back.sum(axis=0), off @ pooled + 1e-4 * params[2], np.array([off.sum()], np.float32)]
            t += 1
            for value, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    net.bias = float(params[3][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, folds: int = 5, left_out: int = 0) -> Network:
    """Learn from labelled rows outside the left-out fold, whole texts; null labels and ids don't count.

    They are at most ``sample`` rows, in the order of a hash of their ids, while their texts
    have at most ``sample_bytes`` together, none more than a sixteenth of that: these reach
    the driver. Without both labels among them the network says the share of label 1 (0.5 for none).
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL AND id IS NOT NULL")
    marked = marked.where(common.crc_fold(F.col("id"), folds) != left_out).orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), F.col("doc_id") == F.col("id"))
    sized = rows.select("id", "quality", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("key")).orderBy(F.xxhash64("id"), "id", "quality", "key").limit(sample)
    sized = sized.toPandas()
    sized = sized[sized["bytes"] <= sample_bytes // 16]
    within = sized[sized["bytes"].cumsum() <= sample_bytes]
    if not len(within):
        return train([], np.zeros(0))
    chosen = docs.sparkSession.createDataFrame(within[["id", "quality", "key"]], "id long, quality int, key long").distinct()
    rows = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "quality", "key"]).select("id", "quality", F.col("text").cast("binary").alias("text"))
    found = rows.distinct().toPandas().sort_values(["id", "quality", "text"], kind="stable")
    return train([np.frombuffer(bytes(t), np.uint8) for t in found["text"]], found["quality"].to_numpy(float))


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch.column(0))
            parts = [probabilities(net, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]) for i, j in common.slices(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.zeros(0), *parts]))], names=[str(k) for k in range(batch.num_columns)])

    return run


def quality(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """doc_id and double ``out``, the probability of label 1, for each row of ``docs``.

    Null and empty texts are scored as the pad alone. Whole texts; rows one by one; other
    columns are not read.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(out, T.DoubleType())])
    return rows.mapInArrow(common.lean(_score(net)), schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted over all documents."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = common.crc_fold(F.col("doc_id"), 5) == 0
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
