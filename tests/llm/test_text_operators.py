"""Fingerprints, token counts, near duplicates and byte-level BPE against brute force and the libraries."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quillbase.llm import byte_bpe, fingerprints, kernels, neardup, quality_rules, token_count

tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def docs(spark, rows):
    return spark.createDataFrame([(t, i, 1, 2, "x", 3) for i, t in rows], "text string, doc_id long, n long, block int, bands string, copy int")


def random_texts(n=250, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("th", "on", "É", "日", "re", "X") for b in ("er", "an", "ß", "ING", "1")]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            words = (rng.choice(texts) or "").split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "  ", "\n"]).join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 20, 60, 120]))))
    return [*texts, None, "", " \t", "one", "ONE", "a b c d", "A b c d", "a b c d e", "w " * 30_000]


# Kernels


def test_shingle_sets():
    texts = [t or "" for t in random_texts()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    keys, bounds = kernels.shingles(data, ends)
    known = {}
    for k, text in enumerate(texts):
        own = shingles(text)
        assert bounds[k + 1] - bounds[k] == len(own)
        known.setdefault(frozenset(own), set()).add(tuple(keys[bounds[k] : bounds[k + 1]].tolist()))
    assert all(len(v) == 1 for v in known.values()) and len({v for s in known.values() for v in s}) == len(known)


def test_shingles_of_nothing():
    keys, bounds = kernels.shingles(np.zeros(0, np.uint8), np.zeros(4, np.int64))
    assert len(keys) == 0 and bounds.tolist() == [0, 0, 0, 0]


# Near duplicates


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = [(k * 3 - 100, t) for k, t in enumerate(random_texts(seed=percent))]
    rows.append(rows[5])
    got = neardup.near_duplicates(docs(spark, [*rows, (None, rows[0][1])]), percent=percent).collect()
    want = brute_components(rows, percent)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    by_id = dict(rows)
    assert all(r.n_shingles == len(shingles(by_id[r.doc_id])) for r in got if r.doc_id is not None)


def test_a_group_that_hangs_together_by_few_links(spark):
    """Variants of one text, many of which reach the threshold with few others."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"v{rng.randrange(6)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), percent=85).collect()}
    assert got == brute_components(rows, 85)


def test_no_documents(spark):
    assert neardup.near_duplicates(docs(spark, [(1, "a")]).where("false")).count() == 0
    assert neardup.near_duplicates(docs(spark, [(1, None), (2, ""), (3, " ")])).where("kept").count() == 3


def test_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 102), (102, 101), (200, 200)], "x long, p long")
    got = {r.u: r.v for r in neardup.components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100}


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_reject_links_no_oftener_than_bands(percent):
    samples, n = neardup.band_count(percent) * neardup.ROWS_PER_BAND, 1_000_000
    rng = np.random.default_rng(23)
    rejected = 0
    for _ in range(n // 50_000):
        apart = rng.binomial(samples, 1 - percent / 100, 50_000)
        worst = np.flatnonzero(2 * apart > neardup.most_flips(percent, samples))  # others can't flip as many bits
        owner = np.repeat(np.arange(len(worst)), 2 * apart[worst])
        flat = np.bincount(owner * neardup.SKETCH_BITS + rng.integers(0, neardup.SKETCH_BITS, len(owner)), minlength=len(worst) * neardup.SKETCH_BITS)
        rejected += ((flat & 1).reshape(len(worst), neardup.SKETCH_BITS).sum(axis=1) > neardup.most_flips(percent, samples)).sum()
    assert rejected <= 8  # one expected


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    bands = neardup.band_count(85)
    errors = []
    for share in (0.98, 0.9, 0.8):
        for _ in range(20):
            common, own = rng.integers(0, 1 << 63, int(500 * share), dtype=np.uint64), rng.integers(0, 1 << 63, 2 * (500 - int(500 * share)), dtype=np.uint64)
            half = len(own) // 2
            a, b = np.concatenate([common, own[:half]]), np.concatenate([common, own[half:]])
            _, s = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            flips = sum(int(x).bit_count() for x in (s[0] ^ s[1]))
            errors.append(neardup.estimate(flips, bands * neardup.ROWS_PER_BAND) - len(common) / (len(common) + len(own)))
            assert len(common) / (len(common) + len(own)) < 0.85 or flips <= neardup.most_flips(85, bands * neardup.ROWS_PER_BAND)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


# Fingerprints


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 3
        yield i, t, t[: len(t) - k] + after[:k], after


@pytest.mark.parametrize("n", [1, 2, 700])
def test_edit_likeness(spark, n):
    texts = random_texts(max(0, n - 9), seed=4)[-n:]
    ids = random.Random(3).sample([k * 97 for k in range(n)] + [10**12 + k for k in range(n)], len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = {r.doc_id: r for r in fingerprints.edit_likeness(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, text, changed, after in brute_edits(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (shingles(text) == shingles(changed))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(shingles(text)) > 30:
            errors += [r.near_edited - jaccard(shingles(text), shingles(changed)), r.near_next - jaccard(shingles(text), shingles(after))]
    assert not errors or (np.std(errors) < 0.1 and abs(np.mean(errors)) < 0.03)


def test_edits_of_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "x y z"), (9, None), (1, "z" * 9)]
    got = fingerprints.edit_likeness(docs(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "5", "5", "9", "None"]
    assert fingerprints.edit_likeness(docs(spark, rows).where("false")).count() == 0


def test_rows_of_one_id_and_without_ids_are_dealt(spark):
    rows = [(5, f"text {k}") for k in range(900)] + [(None, f"other {k}") for k in range(900)] + [(k * 1000, f"single {k}") for k in range(1, 100)] + [(5, None)]
    placed = fingerprints.with_next(docs(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    most = placed.where("copy = 0").groupBy("block").count().agg({"count": "max"}).first()[0]
    assert most <= fingerprints.BLOCK_ROWS
    got = fingerprints.edit_likeness(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    # The last third of each edited text comes from its successor: every text is followed by another one, in one circle.
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t for _, t in rows}
    assert not any(r.edited_sha256 in texts for r in got if r.n_chars > 20)


def test_sketches_rebuilt_by_hand():
    """A sketch holds the hashes below a quarter of the range of a text's shingles, each hashed alone."""
    texts = [t or "" for t in random_texts(80, seed=31)]
    for text, sketch in zip(texts, fingerprints.sketches(texts), strict=True):
        own = shingles(text)
        alone = []
        for gram in own:
            data = np.frombuffer(" ".join(gram).encode(), np.uint8)
            alone += kernels.shingles(data, np.array([0, len(data)]))[0].tolist()
        assert sketch.shingles == len(own) and sketch.kept.tolist() == sorted(k >> 30 for k in alone if k < 1 << 62)


def test_likeness_of_short_texts():
    a, b, c = fingerprints.sketches(["one two three", "ONE  two three", "one two four"])
    assert a.likeness(b) == 1 and a.likeness(c) in (0, 1) and a.text() == b.text() and a.text() != c.text()


def test_containment_of_unequal_documents(spark):
    words = [f"w{k}" for k in range(6000)]
    long, part, other = fingerprints.sketches([" ".join(words), " ".join(words[1000:1800]), " ".join(reversed(words))])
    assert part.containment(long) > 0.98 and long.containment(part) == pytest.approx(796 / 5996, abs=0.03) and part.containment(other) == 0
    assert fingerprints.Sketch.parse(long.text()).text() == long.text()
    a, b = fingerprints.sketches([" ".join(words[:3000]), " ".join(words[2996:])])
    assert np.array_equal(a.merged(b), long.kept)
    frame = fingerprints.fingerprints(docs(spark, [(1, " ".join(words)), (2, None)]))
    assert {r.doc_id: r.fingerprint.split(":")[0] for r in frame.collect()} == {1: "5996", 2: "0"}


# Token counts

ALPHABET = [*"abcdeeeinthorst     ", "▁", "\n", "\t", "\x00", "é", "日", "本", "𝒳", "<s>", "</s>", "<0x0A>", "the", "ing", " " * 15, " " * 17, "tion", "123", "{", "﻿"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def piece_texts(machine, n):
    rng, pieces = random.Random(2), list(machine.pieces.rank)
    return ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_transducer_against_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    machine = token_count.Transducer(byte_bpe.read_local(path))
    texts = ["", "a", " ", "ab" * 3000, "日本語のテキスト" * 300, "the" * 900, "x" * 2000, *(" " * k for k in range(1, 70)), *(" " * k + "the" for k in range(1, 40)), " " * 3000, *odd_texts(800, 1), *piece_texts(machine, 400)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [len(x) for x in library.encode(texts, num_threads=1)]
    assert machine.counts(*token_count.code_points(data, ends)).tolist() == want


def test_chunk_maps_compose(monkeypatch):
    """Chunks of few code points, with and without words that end in them, count as one run does."""
    machine = token_count.Transducer(byte_bpe.read_local(tokenizers.path("piece_bpe_32k.model")))
    texts = [*odd_texts(40, 9), "internationalization" * 20, "thethethe " * 30]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    points = token_count.code_points(data, ends)
    whole = machine.counts(*points)
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(token_count, "CHUNK", size)
        assert machine.counts(*points).tolist() == whole.tolist()
    for segment in (1, 10, 100):
        monkeypatch.setattr(token_count, "SEGMENT", segment)
        assert machine.counts(*points).tolist() == whole.tolist()
    monkeypatch.setattr(token_count, "MOST_CELLS", 10)
    assert machine.counts(*points).tolist() == whole.tolist() and machine.counts(*points).tolist() == whole.tolist()


def test_token_counts(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (None, "é")]
    got = sorted(map(tuple, token_counts(spark, rows)), key=str)
    assert got[0][:2] == (1, 11) and (2, 0, 0, False) in got and (3, 0, 0, False) in got and (None, 2, 1, False) in [g[:4] for g in got]
    assert [g[3] for g in got if g[0] == 4] == [True, True]
    assert token_counts(spark, []) == []


def token_counts(spark, rows):
    return token_count.token_counts(docs(spark, rows), tokenizers.path("piece_bpe_32k.model")).collect()


# Byte-level BPE

TIKTOKEN = "byte_bpe_50k.tiktoken"


def library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path(TIKTOKEN), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(words=()):
    vocabulary = byte_bpe.Vocabulary(byte_bpe.read_local(tokenizers.path(TIKTOKEN)))
    ids, counts = vocabulary.encode([w.encode() for w in words], vocabulary.ranks())
    return byte_bpe.Encoder(vocabulary, byte_bpe.Lexicon(pa.array(list(words), pa.string()), ids, counts), tokenizers.PATTERN)


@pytest.mark.parametrize("words", [(), ("the", " x", "internationalisation", "日本", " ")])
def test_merge_replay_against_the_library(words, monkeypatch):
    own, known = encoder(words), library()
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 2000)
    texts = ["", "a" * 700 + "b" * 301, "\n\n\n  \n x  y", "don't we'll 'S", "\x1c \x85 x", "<|endoftext|>", "internationalisation the the" * 100, *odd_texts(800, 5)]
    for _ in range(2):  # the second time from the cache
        flat, bounds = own.encode(texts)
        assert [flat[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))] == [known.encode_ordinary(t) for t in texts]


def by_class(texts):
    words, counts = [], []
    for found, own in byte_bpe.splitter(tokenizers.PATTERN)(pa.array(texts, pa.string())):
        words += found.to_pylist()
        counts += own.tolist()
    stops = np.cumsum([0, *counts]).tolist()
    assert stops[-1] == len(words) and len(counts) == len(texts)
    return [words[a:b] for a, b in zip(stops, stops[1:], strict=False)]


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_words_by_class_against_regex(size, monkeypatch):
    """Classes of code points split as the pattern does; texts over ``size`` bytes are cut first."""
    monkeypatch.setattr(byte_bpe, "SPLIT_BYTES", size)
    found, rng = regex.compile(tokenizers.PATTERN).findall, random.Random(3)
    some = "''''  \n\t\r\x0b\x1c\x1f\x85\u00a0\u3000\u200bsstmdrevellaZ09²½Ⅷé日ß!-_.\u0301\ufeff\U0010ffff"
    texts = ["".join(rng.choices(some, k=rng.choice([0, 1, 2, 3, 5, 9, 30, 80]))) for _ in range(6000)]
    texts += [None, "", "", "'s", "'", "'l", "'ll", "x'", "x'r", "it's've", "''s", " 's", "  're", "\n'd", "a" * 90, " " * 90]
    assert by_class(texts) == [found(t or "") for t in texts]


def test_every_code_point_by_class():
    found = regex.compile(tokenizers.PATTERN).findall
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = [c.join(points[k : k + 4000]) for k in range(0, len(points), 4000) for c in ("", "a", " ", "'")]
    assert by_class(texts) == [found(t) for t in texts]


def test_counting_words_takes_less_than_matching_the_pattern():
    """The words of a column are counted in less CPU time than a search a word takes alone."""
    rng = random.Random(4)
    known = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(known, k=500)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    found = regex.compile(tokenizers.PATTERN).findall

    def least(run):
        times = []
        for _ in range(4):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    assert least(lambda: list(byte_bpe._tally(tokenizers.PATTERN)(iter([batch])))) < 0.8 * least(lambda: [found(t) for t in texts])


def test_another_pattern(monkeypatch):
    """A pattern that the classes do not know, which leaves out white space."""
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 2000)
    pattern, texts = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+", ["", "a" * 3000 + " 1234 it's", " ", *odd_texts(200, 8)]
    vocabulary = byte_bpe.Vocabulary(byte_bpe.read_local(tokenizers.path(TIKTOKEN)))
    own = byte_bpe.Encoder(vocabulary, byte_bpe.Lexicon(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)), pattern)
    flat, bounds = own.encode(texts)
    known = library()
    words = regex.compile(pattern).findall
    assert [flat[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))] == [[i for w in words(t) for i in known._encode_single_piece(w)] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], ["text"])
    counted = list(byte_bpe._tally(pattern)(iter([batch])))
    assert sum((Counter(dict(zip(*b.to_pydict().values(), strict=True))) for b in counted), Counter()) == Counter(w for t in texts for w in words(t))


def test_a_cache_that_is_dropped(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 5)
    own, known = encoder(["the", " e"]), library()
    for text in odd_texts(20, 6):
        assert own.encode([text])[0].tolist() == known.encode_ordinary(text)
    assert len(own.place) < 60


def test_words_of_the_corpus(spark, monkeypatch):
    """The broadcast table holds the most frequent words of all texts, and no long ones."""
    monkeypatch.setattr(byte_bpe, "LEXICON", 3)
    shared = spark.sparkContext.broadcast(byte_bpe.Vocabulary(byte_bpe.read_local(tokenizers.path(TIKTOKEN))))
    rows = [(k, " one two two" + (" three" * 9 if k == 0 else "") + " " + "x" * 100) for k in range(40)] + [(99, None)]
    found = byte_bpe.lexicon(docs(spark, rows), shared, tokenizers.PATTERN)
    assert found.words.to_pylist() == [" two", " one", " three"]
    known = library()
    assert found.ids.tolist() == [i for w in found.words.to_pylist() for i in known.encode_ordinary(w)]
    monkeypatch.setattr(byte_bpe, "LEXICON", 2)
    assert byte_bpe.lexicon(docs(spark, rows), shared, tokenizers.PATTERN).words.to_pylist() == [" two", " one"]
    assert byte_bpe.lexicon(docs(spark, rows).where("false"), shared, tokenizers.PATTERN).counts.tolist() == []


def test_bpe_round_trip(spark):
    path = tokenizers.path(TIKTOKEN)
    rows = [(k, t) for k, t in enumerate([*odd_texts(60, 7), None, "", "long " * 30_000])] + [(None, "x"), (0, "twice")]
    frame = docs(spark, rows)
    out = byte_bpe.bpe_decode(byte_bpe.bpe_encode(frame, path, tokenizers.PATTERN), path)
    assert out.columns == [*frame.columns, "token_ids", "decoded"]
    at_once = byte_bpe.bpe_encode(frame, path, tokenizers.PATTERN, decoded="decoded")
    assert sorted(map(str, at_once.collect())) == sorted(map(str, out.collect()))
    known = library()
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode() and r.token_ids == known.encode_ordinary(r.text or "")
    with pytest.raises(ValueError):
        byte_bpe.bpe_encode(frame, path, tokenizers.PATTERN, out="BLOCK")
    assert byte_bpe.bpe_encode(frame.where("false"), path, tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, [5, 6]), (2, None), (3, [])], "k long, token_ids array<int>")
    assert [len(r.decoded) for r in byte_bpe.bpe_decode(ids, path).orderBy("k").collect()] == [2, 0, 0]


# Hashes and rows of one id


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_patterns_that_polynomial_hashes_confuse(spark):
    one = thue_morse(2048)
    two = one.translate({97: 98, 98: 97})
    data = np.frombuffer((one + two + one).encode(), np.uint8)
    a, b, c = kernels.span_hashes(data, np.arange(3) * 2048, np.arange(1, 4) * 2048).tolist()
    assert a != b and a == c
    rows = [(1, f"{one} {two}\n{two} {one}"), (2, f"{two} {one}\n{one} {two}")]
    got = {r.doc_id: r for r in quality_rules.measure(docs(spark, rows)).collect()}
    assert all(got[i].n_dup_lines == 0 and got[i].n_distinct == 2 for i in (1, 2))
    first, second = fingerprints.sketches([t for _, t in rows])
    assert first.text() != second.text() and first.likeness(second) < 1
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2}


@pytest.mark.parametrize("eights", [1, 3, 1 << 19])
def test_span_hashes_of_every_length(eights, monkeypatch):
    monkeypatch.setattr(kernels, "EIGHTS", 1 << 19)
    some = np.frombuffer(b"a longer text of which all ranges of bytes are hashed alike", np.uint8)
    a, b = map(np.array, zip(*[(i, j) for i in range(59) for j in range(i, 60)], strict=True))
    whole = kernels.span_hashes(some, a, b)
    monkeypatch.setattr(kernels, "EIGHTS", eights)
    assert np.array_equal(kernels.span_hashes(some, a, b), whole)
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 400, dtype=np.uint8)
    starts, stops = map(np.array, zip(*[(i, j) for i in range(0, 120, 1 if eights > 9 else 17) for j in range(i, i + 40)], strict=True))
    known = {}
    for a, b, h in zip(starts, stops, kernels.span_hashes(data, starts, stops).tolist(), strict=True):
        assert known.setdefault(h, data[a:b].tobytes()) == data[a:b].tobytes()
    assert len(known) == len({data[a:b].tobytes() for a, b in zip(starts, stops, strict=True)})


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = ("a " * 1 + f"one two three four five {x}" for x in ("six", "seven eight nine", "ten eleven twelve thirteen"))
    rows = [(5, a), (2, a), (5, b), (3, b), (9, c), (9, None), (4, "other words that stand alone here")]
    got = sorted((r.doc_id, r.component_id, r.n_shingles > 0) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert got == [(2, 2, True), (3, 2, True), (4, 4, True), (5, 2, True), (5, 2, True), (9, 9, False), (9, 9, True)]


def test_one_group_holds_most_rows(spark):
    """Copies of one text, near copies around one document of a high id, and a passage that many share."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(300, 600):
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join([*base[:60], *(f"y{k}_{j}" for j in range(90))])) for k in range(600, 900)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), percent=85).collect()}
    assert got == {k: 0 if k < 600 else k for k in range(900)}


def test_hot_keys_are_dealt_into_small_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEET", 2)
    monkeypatch.setattr(neardup.common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup.common.small, "__defaults__", (0,))
    rows = [(k, t) for k, t in enumerate(random_texts(120, seed=21))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), percent=85).collect()}
    assert got == brute_components(rows, 85)
