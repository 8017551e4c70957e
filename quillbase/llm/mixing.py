"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. The words of each source are
summed by hash bucket; the bucket in which the running sum passes the source's
budget is the boundary, and only its documents are summed again by the next
twelve bits. What remains is one hash threshold a source: documents are then
filtered by comparing a number, without sorting.

A source whose budget exceeds its own words takes every document once (nested
budget: the whole part) and the documents below the threshold once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of the hash, and of each level of buckets.
BITS, LEVEL = 60, 12


def position(doc_id: Column) -> Column:
    """Place of a document in its source's fixed order: 60 bits of md5 over the decimal id."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def budgets(sized: DataFrame, share: float, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, target, whole, rest: one row a source.

    The targets divide ``share`` of all words by weight; a target above ``cap``
    times its source is cut there and the excess divided again by weight. With the
    sources in order of cap over weight, those cut are the first ones, so running
    sums decide it. The two windows without a key see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(1))
    by_room = everything.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    per = per.select("*", total.alias("total"), before.alias("before"), left.alias("left"))
    per = per.withColumn("cut", (F.col("total") - F.col("before")) * F.col("w") > F.col("cap") * F.col("left"))
    spent = F.sum(F.when(F.col("cut"), F.col("cap")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("cut"), 0.0).otherwise(F.col("w"))).over(everything)
    per = per.select("*", spent.alias("spent"), open_w.alias("open_w"))
    target = F.when(F.col("cut"), F.col("cap")).otherwise((F.col("total") - F.col("spent")) * F.col("w") / F.col("open_w"))
    per = per.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("whole", whole.cast("int"))
    return per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def _boundary(rows: DataFrame, shift: int) -> DataFrame:
    """For each source of ``rows`` (source, rest, before, h, size): the bucket where the sum passes ``rest``."""
    hist = rows.groupBy("source", "rest", "before", F.shiftright("h", shift).alias("prefix")).agg(
        F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    running = Window.partitionBy("source").orderBy("prefix")
    hist = hist.withColumn("until", F.col("before") + F.sum("words").over(running))
    first = F.min(F.when(F.col("until") > F.col("rest"), F.col("prefix"))).over(Window.partitionBy("source"))
    hist = hist.withColumn("first", first).where(F.col("prefix") == F.col("first"))
    return hist.select("source", "rest", (F.col("until") - F.col("words")).alias("before"), "words", "prefix", "low", "high")


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``edge``: documents whose hash is below it are taken once more.

    ``sized`` has source, size and h and is read once, then the boundary buckets only.
    """
    shift = BITS - LEVEL
    rows = sized.alias("d").join(common.small(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = rows.select("d.source", "p.rest", F.lit(0).cast("long").alias("before"), "d.h", "d.size")
    edge = common.settle(_boundary(rows, shift))
    inside = sized
    while shift > 0 and not edge.where("low < high").isEmpty():
        on = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright("d.h", shift) == F.col("e.prefix"))
        rows = inside.alias("d").join(common.small(edge).alias("e"), on)
        inside = common.settle(rows.select("d.source", "e.rest", "e.before", "d.h", "d.size"))
        shift -= LEVEL
        edge = common.settle(_boundary(inside, shift))
        inside = inside.select("source", "h", "size")
    # All words of the boundary hash are taken if that brings the source nearer to its target.
    near = F.col("before") + F.col("words") - F.col("rest") < F.col("rest") - F.col("before")
    edge = edge.select(F.col("source").alias("s"), (F.col("low") + near.cast("long")).alias("edge"))
    joined = plan.join(edge, plan["source"].eqNullSafe(edge["s"]), "left")
    return joined.select("source", "source_size", "target", "whole", F.coalesce("edge", F.lit(0)).alias("edge"))


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    cap: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): what each document may give, and each source's budget and threshold.

    ``sized`` has doc_id, source, size (words) and h; ``plan`` one row a source.
    ``taken_copies`` applies the plan to any frame that has the source and the hash.

    A null source is a source of its own, the last. A null text has size 0, a null id
    hashes as the empty string. Rows with equal ids share one hash and are taken
    together. An empty table gives empty frames. Other columns don't matter.
    """
    common.prepare(docs.sparkSession)
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), common.word_count(F.col(text)).alias("size"), position(F.col(doc_id)).alias("h")
    )
    sized = common.settle(sized)
    plan = common.settle(budgets(sized, share, weights, cap))
    return sized, common.settle(thresholds(sized, plan))


def taken_copies(h: Column) -> Column:
    """Copies of a document that the mix takes, in a frame joined with the plan."""
    return F.col("whole") + (h < F.col("edge")).cast("int")


def mixed(docs: DataFrame, **names) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns."""
    doc_id, source = names.get("doc_id", "doc_id"), names.get("source", "source")
    _, plan = mix_sources(docs, **names)
    own, turn = common.fresh(docs, "_mix_source"), common.fresh(docs, "_mix_copy")
    kept = plan.select(F.col("source").alias(own), "whole", "edge")
    rows = docs.alias("d").join(common.small(kept).alias("p"), F.col(f"d.`{source}`").eqNullSafe(F.col(f"p.{own}")))
    copies = F.col("p.whole") + (position(F.col(f"d.`{doc_id}`")) < F.col("p.edge")).cast("int")
    turns = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return rows.select("d.*", F.explode(turns).alias(turn)).drop(turn)


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken over all documents."""
    sized, plan = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = sized.alias("d").join(common.small(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    taken = F.col("d.size") * taken_copies(F.col("d.h"))
    return rows.select("d.doc_id", "d.size", "p.source_size", "p.target", taken.cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS w,
             source_size * 2.0::DOUBLE AS cap FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM w),
k AS (SELECT *, (total - before) * w > cap * remaining AS cut FROM c),
t AS (SELECT source, source_size,
             CASE WHEN cut THEN cap ELSE (total - sum(CASE WHEN cut THEN cap ELSE 0 END) OVER ()) * w
                  / sum(CASE WHEN cut THEN 0 ELSE w END) OVER () END AS target FROM k),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
u AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS until FROM g),
x AS (SELECT u.source, h, CASE WHEN until <= rest THEN 1
             WHEN until - words <= rest AND until - rest < rest - (until - words) THEN 1 ELSE 0 END AS extra
      FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, r.source_size, CAST(r.target AS DOUBLE) AS target,
       CAST(d.size * (r.whole + x.extra) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
       JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
