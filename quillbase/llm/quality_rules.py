"""Quality rules: text statistics and a decision list learned over them.

The statistics of a document come from array kernels, without a shuffle. Sequential
covering then learns, from the statistics of labelled documents, an ordered list of
threshold conjunctions for rejection: a rule is grown one condition at a time by
information gain on one part of the sample, pruned from its end on the other part,
and the rows it covers are taken away before the next. The list is emitted as one
chain of Spark ``when`` expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
_SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in STATS)

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.isin(np.arange(256), list(b"!?"))

#: Labelled rows the rules are learned from, at most: those of the smallest hash.
SAMPLE = 20_000


def statistics(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The STATS of each document in ``data``."""
    n, inside = len(ends) - 1, ~kernels.SEPARATOR[data]
    starts, stops, doc = kernels.spans(inside, ends)
    hashes = kernels.span_hashes(data, starts, stops)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = kernels.totals(inside & kernels.LEADS[data], ends)
    for name, table in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = kernels.totals(table[data], ends)
    a, b, line_doc = kernels.spans(data != 10, ends)
    words = np.concatenate([[0], np.cumsum(inside)])
    full = words[b] > words[a]
    a, b, line_doc = a[full], b[full], line_doc[full]
    _, later = kernels.repeated(kernels.span_hashes(data, a, b), line_doc)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    _, later = kernels.repeated(hashes, doc)
    out["n_distinct"] = out["n_words"] - np.bincount(doc[later], minlength=n)
    at, keys = kernels.windows(hashes, doc, 8)
    twice, _ = kernels.repeated(keys, doc[at])
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = common.utf8(batch.column(1))
        parts = [statistics(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]) for i, j in common.slices(ends)]
        columns = [pa.array(np.concatenate([p[name] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for name in STATS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *STATS])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and STATS, one row for each row of ``docs``; a null text counts as empty."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(common.lean(_measure), _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that the rules may test; a ratio over nothing is 0."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "n_words"),
        "capitals": ratio("n_upper", "word_chars"),
        "digits": ratio("n_digits", "word_chars"),
        "marks": ratio("n_marks", "n_words"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "distinct": ratio("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for condition in rule:
        hit &= condition.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule, hit = [], np.ones(len(bad), bool)
    while (~bad & hit).any():
        p0, n0 = (bad & hit).sum(), (~bad & hit).sum()
        best, best_gain = None, 1e-9
        for name, values in x.items():
            own = values[hit]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, 65)))
            order = np.argsort(own, kind="stable")
            below_p = np.concatenate([[0], np.cumsum(bad[hit][order])])
            at = np.searchsorted(own[order], cuts)
            for above, p, total in ((True, p0 - below_p[at], len(own) - at), (False, below_p[at], at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / total) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Condition(name, above, float(cuts[k])), gain[k]
        if best is None:
            break
        rule.append(best)
        hit &= best.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.8, support: int = 4) -> list[list[Condition]]:
    """Ordered conjunctions that reject. A rule is kept while, on the rows set aside for
    pruning, at least ``precision`` of what it covers is bad, and it covers ``support`` bad rows in all.

    A rule grows while a condition gains; rules are added while one is kept."""
    rules: list[list[Condition]] = []
    aside = np.arange(len(bad)) % 3 == 0
    open_ = np.ones(len(bad), bool)
    while (bad & open_).sum() >= support:
        g, p = open_ & ~aside, open_ & aside
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            break

        def worth(r: list[Condition], p=p) -> float:
            hit = _covers(r, {k: v[p] for k, v in x.items()}, int(p.sum()))
            good = (hit & bad[p]).sum()
            return (2 * good - hit.sum()) / max(1, hit.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _covers(rule, x, len(bad)) & open_
        good, on_side = (hit & bad).sum(), hit & aside
        if good < support or good < precision * hit.sum() or (on_side & bad).sum() < precision * on_side.sum():
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = rule[0].column()
        for condition in rule[1:]:
            test &= condition.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def learned_rules(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> list[list[Condition]]:
    """Rules from a settled ``measured`` and labels (doc_id, quality); ids of fold 0 are left for testing."""
    marked = labels.select(F.col("doc_id").alias("id"), "quality").where("quality IS NOT NULL AND id IS NOT NULL")
    marked = marked.where(common.crc_fold(F.col("id"), folds) != 0)
    marked = marked.orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    rows = measured.join(F.broadcast(marked), F.col("doc_id") == F.col("id")).where(~base_failed())
    names = features()
    table = rows.select("id", "quality", *[c.alias(name) for name, c in names.items()]).toPandas()
    table = table.sort_values(["id", "quality"], kind="stable")
    order = np.random.default_rng(7).permutation(len(table))
    return learn({name: table[name].to_numpy(float)[order] for name in names}, (table["quality"].to_numpy() == 0)[order])


def judge(measured: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``measured`` with base_failed, rule and kept."""
    rows = measured.select("*", base_failed().alias("base_failed"), *[c.alias(name) for name, c in features().items()])
    rows = rows.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return rows.drop(*features())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed, rule (0: none rejects) and kept for each row of ``docs``.

    A null text is empty, so it fails the base rules. Null labels and ids are not
    learned from; without labels there are no learned rules and the base decides. A
    repeated row is judged as often as it stands. Only doc_id and text are read.
    """
    measured = common.settle(measure(docs))
    return judge(measured, learned_rules(measured, labels))


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed, kept and the rejecting rule over all documents."""
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
