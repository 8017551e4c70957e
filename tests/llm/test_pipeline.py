"""The pipeline's stages, and the registered queries on the smallest tables."""

import base64
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillbase.llm import common, queries, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_stages(spark, steps):
    start, toxic, dedup, secrets, mixed, encoded = steps
    assert all(d.columns == COLUMNS for d in steps[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in steps]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len([i for i in ids[0] - ids[1] if marked.get(i) == 0]) == 0
    texts = [r.text for r in dedup.collect()]
    assert len(texts) == len(set(texts))
    assert secrets.where("text LIKE '%[SECRET]%'").count() == secrets.join(dedup.withColumnRenamed("text", "old").select("doc_id", "old"), "doc_id").where("text <> old").count()
    assert encoded.where("not round_trip").count() == 0 and encoded.count() == mixed.count()


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.collect()]


def test_toxicity_by_hand(spark, steps):
    """Each document's score from its own substrings."""
    model = toxicity.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.keys.tolist(), model.weights, strict=True))
    stay = set()
    for i, text, _ in rows(steps[0]):
        low = (text or "").translate(LOWER)
        points = np.array([ord(c) for c in low], np.uint32)
        grams = set()
        for n, keys in toxicity.packed(points):
            grams |= set(keys[: max(0, len(low) - n + 1)].tolist())
        if 1 / (1 + math.exp(-sum(weight.get(g, 0.0) for g in grams) - model.bias)) < corpus_pipeline.TOXIC:
            stay.add(i)
    assert {i for i, *_ in rows(steps[1])} == stay


def test_near_dedup_by_hand(steps):
    """All pairs of full shingle sets."""
    def shingles(text):
        words = WORD.findall((text or "").translate(LOWER))
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

    sets = {i: shingles(t) for i, t, _ in rows(steps[1])}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.SIMILAR * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(i for i, *_ in rows(steps[2])) == sorted(i for i in sets if find(i) == i)


def secret_spans(text):
    """(start, end) of every span, from the patterns alone."""
    base = []
    for name, pattern, group, least in secret_scan.KINDS:
        base += [m.span() for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    found = list(base)

    def dense(run):
        bar = next(bits for _, p, bits in secret_scan.BARS if re.search(p, run))
        windows = [Counter(run[k : k + 20]) for k in range(len(run) - 19)]
        return max((-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows), default=0) >= bar - 1e-12

    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run, inside = m.group(), set(range(*m.span()))
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or any(re.search(p, run) for p in secret_scan.ALLOWED):
            continue
        for a, b in base:
            inside -= set(range(a, b))
        path = "/" in run and not re.search(secret_scan.NO_WORD, run) and not any(len(x) >= 20 and dense(x) for x in re.split("[-_/=+]+", run))
        if inside and dense(run) and not path:
            found.append(m.span())
    return found


def test_secrets_by_hand(steps):
    got = {i: t for i, t, _ in rows(steps[3])}
    for i, text, _ in rows(steps[2]):
        out, at = "", 0
        for a, b in sorted(secret_spans(text or "")):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[i] == (None if text is None else out + text[at:])
    assert all(r.n_chars == len(r.text or "") for r in steps[3].collect())


def test_mixing_by_hand(steps):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows(steps[3])}
    source = {i: s for i, _, s in rows(steps[3])}
    own = Counter()
    for i, s in source.items():
        own[s] += size[i]
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * own[s]]:
        for s in over:
            target[s] = 2.0 * own[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    copies = Counter(i for i, *_ in rows(steps[4]))
    assert max(copies.values()) <= 2 and set(copies) <= set(source)
    for s in names:
        taken = sum(n * size[i] for i, n in copies.items() if source[i] == s)
        assert abs(taken - target[s]) <= max(size[i] for i in source if source[i] == s) / 2 + 1
    text = {i: t for i, t, _ in rows(steps[3])}
    assert all(text[i] == t for i, t, _ in rows(steps[4]))


def test_tokens_by_hand(steps):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, library.encode_ordinary(t or "")) for i, t, _ in rows(steps[4]))
    assert sorted((r.doc_id, r.token_ids) for r in steps[5].collect()) == want
    assert all(r.n_tokens == len(r.token_ids) and r.round_trip for r in steps[5].collect())


def test_run(spark, steps):
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in steps[-1].collect())


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "no id", "en", "b", 5), (3, "word " * 30000, "en", "a", 5), (4, "token=abcdefghijklmnop x", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.where("false"), SF).collect()
        docs = common.settle(stage(spark, docs, SF))
    assert docs.where("not round_trip").count() == 0


def test_stages_keep_clashing_columns(spark):
    extra = {"_gone": 1, "_toxicity": 2, "_secrets": "s", "_mix_copy": 3, "_mix_source": "m", "_sha": "h", "_bytes": 4, "_decoded": 5, "_token_ids": 6, "n_tokens": 7, "kept": True, "hash": 8, "block": 9}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit(v).alias(k) for k, v in extra.items()])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.settle(stage(spark, docs, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() > 0
            assert out.select(*extra).distinct().collect() == docs.select(*extra).distinct().collect()
        else:
            assert set(docs.columns) - {"text"} <= set(out.columns) and len(set(out.columns)) == len(out.columns) and out.where("not round_trip or n_tokens = 7").count() < out.count()
        docs = out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    folds = {"op1_quality_cnn": (5, 0), "op3_toxicity": (3, 1), "op5_language": (3, 1)}
    if name in folds:
        n, k = folds[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) and 0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)
