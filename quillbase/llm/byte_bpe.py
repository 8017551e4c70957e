"""Byte-level BPE by corpus-level merge replay.

1. One pass counts the words (matches of the split pattern) of all texts. The usual pattern is
   matched by array operations on the classes of the code points, any other one by ``regex``;
   words are ranges of the texts' own bytes, not Python strings.
2. The distinct words of the corpus, the most frequent ones if they are more than LEXICON,
   are laid out as one linked list of byte symbols. An inverted index maps the rank of
   each adjacent pair to the positions where it stands. The ranks are replayed in order
   over all words at once: each merge touches its positions and their two neighbours only,
   and enters the pairs that arise into the index.
3. The words with their ids, a table of bounded size, are broadcast, and a second pass puts
   each text together from them. Words beyond the table, rare ones or long ones, are
   replayed the same way, all new ones of SLICE_BYTES of text at once.

The ids do not depend on what the table holds.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

#: Words of the broadcast table and the bytes of its longest word: under 50 MB, however large the corpus.
LEXICON, LONGEST = 150_000, 64
#: Text bytes handled at a time, words beyond the table that a task remembers, and characters from which a text is split lazily.
SLICE_BYTES, CACHE_WORDS, LONG_TEXT = 8 << 20, 200_000, 1 << 20
#: Text bytes whose words are counted at once, and those that are split at once.
TALLY_BYTES, SPLIT_BYTES = 32 << 20, 1 << 20
#: The pattern that is matched by classes of code points.
BY_CLASS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of byte strings (one ``base64 rank`` a line) and what follows from them."""

    def __init__(self, content: bytes):
        lines = (line.split() for line in content.splitlines() if line.strip())
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.stops = np.cumsum([len(t) for t in tokens], dtype=np.int64)
        self.lengths = np.diff(self.stops, prepend=0)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        get, pairs, merged = ranks.get, [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs = np.append(np.array(pairs, np.int64)[order], np.int64((1 << 63) - 1))
        self.merged = np.append(np.array(merged, np.int64)[order], _NONE)

    def decoder(self) -> Vocabulary:
        """This vocabulary without what only encoding takes."""
        light = Vocabulary(b"")
        light.bytes, light.stops, light.lengths = self.bytes, self.stops, self.lengths
        return light

    def ranks(self) -> dict[bytes, int]:
        data, stops = self.bytes.tobytes(), self.stops.tolist()
        return {data[a:b]: k for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)) if b > a}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the concatenation of tokens a and b, _NONE where there is none."""
        keys = a << 32 | b
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.merged[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and the number of ids of each word."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        lengths = np.array([len(w) for w in words], np.int64)
        stops = np.cumsum(lengths)
        token = np.append(self.single[data], np.int64(1 << 30))  # the last stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[stops[lengths > 0] - 1] = n
        before[(stops - lengths)[lengths > 0]] = n
        alive = np.ones(n + 1, bool)
        rank = np.append(self.rank_of(token[:n], token[after[:n]]), _NONE)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[rank[places] < _NONE]
            if not len(places):
                return
            own = rank[places]
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, part in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = np.sort(at[rank[at] == r])
            if len(at) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]  # a place may have been entered twice
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # of overlapping pairs the leftmost, then every other one
                    turn = np.arange(len(at))
                    first = np.where(np.concatenate([[True], ~chained]), turn, 0)
                    at = at[(turn - np.maximum.accumulate(first)) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            token[at], after[at], before[beyond], alive[gone], rank[gone] = r, beyond, at, False, _NONE
            rank[at] = self.rank_of(token[at], token[beyond])
            left = before[at]
            rank[left] = self.rank_of(token[left], token[at])
            rank[n] = _NONE
            enter(np.concatenate([at, left]))
        kept = np.concatenate([[0], np.cumsum(alive[:n])])
        return token[:n][alive[:n]], kept[stops] - kept[stops - lengths]


    def encode(self, words: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and the number of ids of each. A word that is a token is that token."""
        whole = [ranks.get(w) for w in words]
        direct = np.array([r is not None for r in whole], bool)
        ids, counts = self.replay([w for w, r in zip(words, whole, strict=True) if r is None])
        size = np.ones(len(words), np.int64)
        size[~direct] = counts
        flat = np.zeros(int(size.sum()), np.int32)
        flat[np.repeat(~direct, size)] = ids
        flat[(np.cumsum(size) - size)[direct]] = [r for r in whole if r is not None]
        return flat, size

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Binary values, each of the next ``counts`` ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is outside the vocabulary")
        sizes = self.lengths[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        data = self.bytes[np.repeat((self.stops - self.lengths)[ids] - stops[:-1], sizes) + np.arange(stops[-1])]
        bounds = stops[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])


@dataclass
class Lexicon:
    """Words of the corpus with their ids."""

    words: pa.Array
    ids: np.ndarray
    counts: np.ndarray


@cache
def _classes() -> np.ndarray:
    """Class of each code point as ``regex`` has it: 1 letter, 2 number, 3 white space, 0 other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    text = points.tobytes().decode("utf-32-le")
    for k, kind in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(kind, text):
            table[points[m.start() : m.end()]] = k
    return table


@cache
def _doubtful() -> np.ndarray:
    """Bytes in which white space may end."""
    table = np.zeros(256, bool)
    table[[chr(c).encode()[-1] for c in np.flatnonzero(_classes() == 3).tolist()]] = True
    return table


def _pieces(data: np.ndarray, limit: int) -> list[int]:
    """Offsets that cut a text before white space after something else, where no word goes on."""
    bounds, size = [0], limit
    while len(data) - bounds[-1] > size:
        part = data[bounds[-1] : bounds[-1] + size]
        found = np.flatnonzero(kernels.SEPARATOR[part[1:]] & ~_doubtful()[part[:-1]])
        if len(found):
            bounds.append(bounds[-1] + int(found[-1]) + 1)
        size = limit if len(found) else 2 * size
    return [*bounds, len(data)]


def word_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets at which the matches of BY_CLASS begin, which leave out nothing of the texts.

    A word is a run of one class with the blank before it; white space before that is one
    word, or two if its last character is no blank and something follows.
    """
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    n, lead = len(point), None
    if n < len(data):
        lead = np.flatnonzero(kernels.LEADS[data])
        ends = np.searchsorted(lead, ends)
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    inner = ~edge[1:n]  # whether a character and the next one are of one text
    kind = _classes()[point]
    space = kind == 3
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | ~inner
    into = space[:-1] & ~space[1:] & inner
    start[:-1] |= into
    start[1:] &= ~(into & (point[:-1] == 32))
    at = np.flatnonzero(start & (point == 39))
    if len(at):
        padded, last = np.append(point, np.zeros(3, np.uint32)), np.append(edge, [True, True])
        one, two = padded[at + 1] * ~last[at + 1], padded[at + 2] * ~(last[at + 1] | last[at + 2])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        longer = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[at[short | longer] + 1] = False
        after = np.concatenate([at[short] + 2, at[longer] + 3])
        start[after[after < n]] = True
    at = np.flatnonzero(start)
    return at if lead is None else lead[at]


def _split_by_class(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    data, ends = common.utf8(texts)
    for i, j in common.slices(ends, SPLIT_BYTES):
        part, own = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        if len(part) > SPLIT_BYTES:  # a long text
            cuts = _pieces(part, SPLIT_BYTES)
            starts = np.concatenate([a + word_starts(part[a:b], np.array([0, b - a])) for a, b in zip(cuts, cuts[1:], strict=False)])
        else:
            starts = word_starts(part, own)
        offsets = np.append(starts, len(part)).astype(np.int32)
        yield pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(part)), np.diff(np.searchsorted(starts, own))


def splitter(pattern: str) -> Callable[[pa.Array], Iterator[tuple[pa.Array, np.ndarray]]]:
    """The matches of ``pattern`` in a column of texts, some texts at a time: all words, and their number in each text."""
    if pattern == BY_CLASS:
        return _split_by_class
    import regex

    compiled = regex.compile(pattern)

    def split(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for text in texts:
            text = text.as_py() or ""
            found = pa.array(compiled.findall(text) if len(text) < LONG_TEXT else (m.group() for m in compiled.finditer(text)), pa.string())
            yield found, np.array([len(found)])

    return split


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, pattern: str):
        self.vocabulary, self.split = vocabulary, splitter(pattern)
        self.base = lexicon
        self.ranks: dict[bytes, int] = {}
        self.place = lexicon.words
        self.ids, self.counts = lexicon.ids, lexicon.counts
        self.starts = np.cumsum(self.counts) - self.counts

    def learn(self, new: pa.Array) -> None:
        """Enter words that have no ids yet."""
        self.ranks = self.ranks or self.vocabulary.ranks()
        ids, counts = self.vocabulary.encode(new.cast(pa.binary()).to_pylist(), self.ranks)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.place = pa.concat_arrays([self.place, new])

    def forget(self) -> None:
        self.place = self.base.words
        self.ids, self.counts, self.starts = self.base.ids, self.base.counts, self.starts[: len(self.place)]

    def numbers(self, words: pa.ChunkedArray) -> np.ndarray:
        """Number of each word; new words get the next ones."""
        known, found = len(self.place), pc.index_in(words, value_set=self.place)
        k = pc.fill_null(found, -1).to_numpy().copy()
        if found.null_count:
            rest = words.filter(found.is_null())
            new = rest.unique()
            self.learn(new)
            k[k < 0] = known + pc.index_in(rest, value_set=new).to_numpy()
        return k

    def encode(self, texts: Sequence[str] | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 offsets of each text's ids."""
        if len(self.place) > len(self.base.words) + CACHE_WORDS:
            self.forget()
        column = texts if isinstance(texts, pa.ChunkedArray) else pa.chunked_array([pa.array(texts, pa.string())])
        parts = [part for chunk in column.chunks for part in self.split(chunk)]
        k = self.numbers(pa.chunked_array([words for words, _ in parts], pa.string()))
        counts = self.counts[k]
        stops = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[np.repeat(self.starts[k] - stops[:-1], counts) + np.arange(stops[-1])]
        return flat, stops[np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(own for _, own in parts)]))])].astype(np.int64)


def _tally(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, waiting, size = splitter(pattern), [], 0

        def rows() -> pa.RecordBatch:
            found = pa.chunked_array(waiting, pa.string()).value_counts()
            waiting.clear()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

        for batch in batches:
            for words, _ in split(batch.column(0)):
                waiting.append(words)
                size += words.buffers()[2].size if words.buffers()[2] else 0
                if size >= TALLY_BYTES:
                    yield rows()
                    size = 0
        yield rows()

    return run


def _replayed(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column(0).to_pylist()]
        ids, counts = vocabulary.value.encode([w.encode() for w in words], vocabulary.value.ranks())
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))], ["word", "ids"])

    return run


def lexicon(docs: DataFrame, vocabulary, pattern: str, text: str = "text") -> Lexicon:
    """The corpus's words with their ids: counted over all texts, replayed together in one task.

    Words that occur twice and have at most LONGEST bytes, the most frequent ones by whole levels
    (sixteenths of a doubling of their counts), LEXICON of them at most: so neither that task nor
    the driver, which gets them, grows with the corpus, and nothing is sorted. ``vocabulary``
    is a broadcast.
    """
    counts = docs.select(text).mapInArrow(common.lean(_tally(pattern)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(16 * F.log2("n")).cast("int")
    counts = common.settle(counts.where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)).withColumn("level", level))
    least, room = 1 << 30, LEXICON
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):
        room -= row["count"]
        least = row["level"] if room >= 0 else least
    words = counts.where(F.col("level") >= least).coalesce(1).sortWithinPartitions(F.desc("n"), "word").select("word")
    table = words.mapInArrow(common.lean(_replayed(vocabulary)), "word string, ids array<int>").toArrow()
    lists = table["ids"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    found = table["word"].combine_chunks()
    return Lexicon(found, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), sizes)


def _encode(state, pattern: str, at: int, drop: bool, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(*state.value, pattern)
        waiting, size = [], 0

        def encoded() -> Iterator[pa.RecordBatch]:
            flat, bounds = own.encode(pa.chunked_array([part.column(at) for part in waiting]))
            first = 0
            for part in waiting:
                own_bounds = bounds[first : first + part.num_rows + 1]
                ids, first = flat[own_bounds[0] : own_bounds[-1]], first + part.num_rows
                columns = [part.column(k) for k in range(part.num_columns) if not (drop and k == at)]
                columns.append(pa.ListArray.from_arrays(pa.array((own_bounds - own_bounds[0]).astype(np.int32)), pa.array(ids)))
                if decoded:
                    columns.append(own.vocabulary.decode(ids, np.diff(own_bounds)))
                yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])
            waiting.clear()

        for batch in batches:
            _, ends = common.utf8(batch.column(at))
            for i, j in common.slices(ends, SLICE_BYTES):
                waiting.append(batch.slice(i, j - i))
                size += int(ends[j] - ends[i])
                if size >= SLICE_BYTES:
                    yield from encoded()
                    size = 0
        if waiting:
            yield from encoded()

    return run


def _decode(vocabulary, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column(at), pa.scalar([], batch.column(at).type))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, vocabulary.value.decode(ids, counts)], names=[str(k) for k in range(batch.num_columns + 1)])

    return run


def _checked(df: DataFrame, out: str) -> None:
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {out} exists")


def read_local(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` with array<int> ``out``: the ids of each whole text by the ranks at ``path``.

    ``path`` is read on the driver and broadcast (a vocabulary, a few megabytes). Each
    match of ``pattern`` is encoded by itself; no special tokens. A null or empty text
    has no ids. With ``decoded``, a column of that name has the bytes that the ids decode
    to, made in the same pass. A clash with a new column raises ValueError; other columns
    pass through. The words are counted when this is called and the texts read again when
    the result is, so ``docs`` should be a stored table.
    """
    for name in (out, decoded):
        _checked(docs, name or out)
    common.prepare(docs.sparkSession)
    context, vocabulary = docs.sparkSession.sparkContext, Vocabulary(read_local(path))
    shared = context.broadcast(vocabulary)
    state = context.broadcast((vocabulary, lexicon(docs, shared, pattern, text)))
    at = docs.columns.index(text)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    fields.append(T.StructField(out, T.ArrayType(T.IntegerType())))
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []
    return docs.mapInArrow(common.lean(_encode(state, pattern, at, not keep_text, bool(decoded))), T.StructType(fields))


def bpe_decode(rows: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with binary ``out``: the bytes of their ids; null or no ids give no bytes.

    An id outside the vocabulary fails the job with ValueError.
    """
    _checked(rows, out)
    common.prepare(rows.sparkSession)
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(read_local(path)).decoder())
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])
    return rows.mapInArrow(common.lean(_decode(vocabulary, rows.columns.index(ids))), schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 over all documents."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = bpe_encode(docs, path, public_tokenizers.PATTERN, keep_text=False, decoded="decoded")
    listed = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
