"""The corpus pipeline: STAGES applied to documents, each one's output settled for the next.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm import byte_bpe, common, mixing, neardup, secret_scan
from quillbase.llm import toxicity as toxic

#: From this score on a document is rejected.
TOXIC = 0.7
#: Percent of common five-word shingles from which documents are near duplicates.
SIMILAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, rejects go."""
    common.prepare(spark)
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.fresh(docs, "_toxicity")
    return toxic.toxicity(docs, model, out=score).where(F.col(score) < TOXIC).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays.

    Rows of one id are one document; rows without an id stay. The ids that go are
    broadcast if they are few, else joined by a shuffle.
    """
    found = neardup.near_duplicates(docs, percent=SIMILAR)
    own = common.fresh(docs, "_gone")
    gone = common.settle(found.where(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(common.small(gone), F.col("doc_id") == F.col(own), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each span that a scan finds is replaced by a mark, and n_chars follows."""
    spans = common.fresh(docs, "_secrets")
    found = secret_scan.secret_spans(docs, out=spans)
    found = found.withColumn("text", secret_scan.redacted(found["text"], found[spans]))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as its source's budget takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token_ids in place of text, n_tokens, and whether the
    ids decode to the bytes of the text again. They replace columns of these three names."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = [c for c in docs.columns if c not in ("text", "token_ids", "n_tokens", "round_trip")]
    ids, decoded = common.fresh(docs, "_token_ids"), common.fresh(docs, "_decoded")
    rows = byte_bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, out=ids, decoded=decoded)
    same = F.col(decoded) == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(*kept, F.col(ids).alias("token_ids"), F.size(ids).cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: Learned scores, sketches and tokens are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.settle(docs)
    return docs
