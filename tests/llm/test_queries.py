"""Registered queries that SQL can't express, over whole tables: brute force, libraries, held-out accuracy."""

import base64
import hashlib
import os
import re
from collections import Counter

import pytest

from quillbase.llm import queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, sf=SF):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}


def test_fingerprints(spark, texts):
    rows = run(spark, "op2_fingerprints")
    order = sorted(texts, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        n, k = len(texts[i]), len(texts[i]) // 3
        assert (rows[i].n_chars, rows[i].edited_sha256) == (n, sha(texts[i][: n - k] + texts[after][:k]))
        assert (rows[i].fingerprint == rows[after].fingerprint) == (rows[i].near_next == 1)
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t, set()).add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_token_counts(spark, texts):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    rows = run(spark, "op4_token_counts")
    for i, t in texts.items():
        n = len(library.encode(t))
        assert tuple(rows[i]) == (i, len(t.encode()), n, n > 4096)


def test_statistics(spark, texts):
    rows = run(spark, "op7_quality_rules")
    for i, t in texts.items():
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        cover = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
        r = rows[i]
        assert tuple(r)[:6] == (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(words) < 20 or 100 * len(cover) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_byte_bpe(spark, texts):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run(spark, "op10_byte_bpe")
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert tuple(rows[i]) == (i, len(ids), sha(" ".join(map(str, ids))), sha(t))


@pytest.mark.parametrize("name, column, least", [("op1_quality_cnn", "quality", 0.95), ("op3_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, column, least):
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if r[column] is not None}
    bar = 0.3 if column == "quality" else 0.7
    held = [r for i, r in run(spark, name, LARGER).items() if r.held_out and i in truth]
    assert all(r.predicted == (r.score >= bar) for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= least * len(held) > 0


def test_rules_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for i, r in run(spark, "op7_quality_rules", LARGER).items() if i in truth and not r.base_failed]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in rows) >= 0.95 * len(rows)


def test_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    held = [r for r in run(spark, "op5_language", LARGER).values() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 0
