"""Token counts by a finite-state transducer compiled from a BPE piece vocabulary.

A BPE encoding is a chain in which each two neighbours are compatible (together they
encode to just the two of them), and each prefix of a text has one such chain. What
may still change the last token depends on the longest suffix that begins some piece,
and, for the places inside it where a piece can begin, on the token that ends there
and the count up to it. These make a finite set of states. A transition by one code
point carries the change of the count: the transducer's output. States are compiled
when first met and kept in a table for all later texts.

Texts are cut into chunks of equal length anywhere. A chunk's state map says, for each
state in which it may be entered, in which one it is left and how the count changes. All
chunks run in step, one table look-up for a code point of each: first from the start
state, then from every other state in which some map of the chunk before leaves, until no
map lacks an entry. A run ends where it meets the first one of its chunk, mostly at the
next word. The maps are then composed by a parallel prefix scan: in each round every map
is joined with that of as many chunks again behind it, so that a text takes rounds by the
logarithm of its length.

Pieces of blanks only are merged after all others and from the left, so the tokens of a
run of blanks depend on its length alone, with the longest such piece as the period.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

BLANK = "▁"
CHUNK = 512
NEVER = 1 << 30
#: Code points that run at once, and compiled transitions after which the tables are begun anew: they bound a
#: worker's memory, whatever the texts (28 bytes a transition, and about a kilobyte a state, of which there are fewer).
SEGMENT, MOST_CELLS = 1 << 20, 1 << 19
#: Bits of a symbol's number in the key of a transition.
SYMBOL_BITS = 21


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, message[at : at + size]
        at += size


class Pieces:
    """Ranks of the mergeable pieces of a model file, and the checks this transducer relies on."""

    def __init__(self, content: bytes):
        scored, trainer, normalizer = [], {}, {}
        for number, value in fields(content):
            if number == 1:
                own = dict(fields(value))
                if own.get(3, 1) in (1, 4, 5):
                    scored.append((-struct.unpack("<f", own[2])[0] if 2 in own else 0.0, len(scored), own[1].decode()))
                    if own.get(3, 1) == 4:
                        raise ValueError("user-defined pieces are not supported")
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        plain = normalizer.get(1) == b"identity" and not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or not plain:
            raise ValueError("expected a BPE model with byte fallback, a leading blank and unchanged text")
        scored.sort()
        names = [p for _, _, p in scored]
        blanks = {len(p) for p in names if set(p) == {BLANK}}
        self.period = max(blanks)
        last = {s for s, _, p in scored if p.startswith(BLANK * 2)}
        if any(BLANK in p.lstrip(BLANK) or p.startswith(BLANK * 2) and set(p) != {BLANK} for p in names) or len(last) > 1 or any(s >= min(last) for s, _, p in scored if set(p) != {BLANK}):
            raise ValueError("pieces with inner blanks are not supported")
        runs = [self.blank_tokens(m, blanks) for m in range(3 * self.period + 1)]
        #: Change of the tokens of a run of blanks as it grows to a length of that remainder.
        self.blank_change = [runs[m] - runs[m - 1] for m in range(self.period, 2 * self.period)]
        if any(runs[m] - runs[m - 1] != self.blank_change[m % self.period] for m in range(1, len(runs))):
            raise ValueError("runs of blanks without a period are not supported")
        names = [p for p in names if not p.startswith(BLANK * 2)]
        self.rank = {p: k for k, p in enumerate(names)}
        self.letters = frozenset("".join(names))
        #: Tokens that are the left part of a merge, and the pieces that begin with a text.
        self.lefts = {p[:k] for p in names for k in range(1, len(p)) if (k == 1 or p[:k] in self.rank) and (k == len(p) - 1 or p[k:] in self.rank)}
        #: What may be merged behind a token, with the rank of the merge.
        self.behind: dict[str, dict[str, int]] = {}
        for p in names:
            for k in range(1, len(p)):
                if p[:k] in self.lefts:
                    self.behind.setdefault(p[:k], {})[p[k:]] = self.rank[p]
        self.edges: dict[str, tuple[list, list]] = {}
        self.whole: dict[str, bool] = {}
        self.first: dict[tuple, str] = {}
        self.alike: dict[tuple[str, str], str | None] = {}
        #: Left edges of the pieces that begin with a text.
        self.follow: dict[str, list[list]] = {}
        for p in names:
            if self.reached(p):
                for k in range(1, len(p)):
                    self.follow.setdefault(p[:k], []).append(self.spines(p)[0])
        self.begins = {"", *self.follow}

    @staticmethod
    def blank_tokens(length: int, sizes: set[int]) -> int:
        """Tokens of a run of blanks: any two neighbours that make a piece are merged, leftmost first."""
        parts, at = [1] * length, 0
        while at < len(parts) - 1:
            if parts[at] + parts[at + 1] in sizes:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = 0
            else:
                at += 1
        return len(parts)

    def spines(self, token: str) -> tuple[list, list]:
        """The tokens on the left and on the right edge while ``token`` is merged, from one
        code point up, each with the rank of the merge that takes it in."""
        if token not in self.edges:
            left, right = [], []
            parts, rank = list(token), self.rank
            while len(parts) > 1:
                best, at = min((rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                if best == NEVER:
                    break
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.edges[token] = ([*left, (parts[0], NEVER)], [*right, (parts[-1], NEVER)])
            self.whole[token] = len(parts) == 1
        return self.edges[token]

    def reached(self, piece: str) -> bool:
        """Whether ``piece`` is a token that its own text encodes to."""
        if len(piece) > 1 and piece not in self.rank:
            return False
        self.spines(piece)
        return self.whole[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether a + b encodes to a, b: no merge across the border comes before both sides have grown on.

        Of equal ranks the leftmost merge is first."""
        rank = self.rank
        for r, r_until in self.spines(a)[1]:
            for l, l_until in self.spines(b)[0]:  # noqa: E741
                merge = rank.get(r + l, NEVER)
                if merge < r_until and merge <= l_until and merge < NEVER:
                    return False
        return True

    def stand_in(self, token: str, begun: str) -> str | None:
        """A token that meets every piece beginning with ``begun`` as ``token`` does; None if it meets none.

        Fewer tokens in the states make fewer states."""
        key = (token, begun)
        if key not in self.alike:
            spine = tuple(x for x in self.spines(token)[1] if x[0] in self.lefts)
            found = self.first.setdefault(spine, token)
            follow = self.follow.get(begun, ())
            if begun and len(follow) <= 64:
                fits = self.fits(found, follow)
                found = self.first.setdefault((begun, fits), found) if any(fits) else None
            if len(self.alike) > 1 << 20:
                self.alike.clear()
            self.alike[key] = found
        return self.alike[key]

    def fits(self, token: str, edges: list[list]) -> tuple[bool, ...]:
        """Which of the pieces with these left edges are compatible behind ``token``."""
        earliest: dict[str, int] = {}  # the first merge with anything on the right edge of the token
        heads = {x for edge in edges for x, _ in edge}
        for r, r_until in self.spines(token)[1]:
            own = self.behind.get(r, {})
            for l in heads if len(heads) < len(own) else own.keys() & heads:  # noqa: E741
                merge = own.get(l, NEVER)
                if merge < r_until and merge < earliest.get(l, NEVER):
                    earliest[l] = merge
        return tuple([not any(l in earliest and earliest[l] <= until for l, until in edge) for edge in edges])  # noqa: E741

    def cost(self, token: str) -> int:
        return 1 if token in self.rank else len(token.encode())


class Cells:
    """Transitions by state and symbol, in an open-addressed table: its size follows their number."""

    def __init__(self, room: int = 1 << 14):
        self.room, self.used = room, 0
        self.keys, self.next, self.out = np.full(room, -1, np.int64), np.zeros(room, np.int32), np.zeros(room, np.int16)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free place where it would."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.room.bit_length() + 1)).astype(np.int64)
        there = self.keys[at]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (self.room - 1)
            there = self.keys[at[other]]
            other = other[(there != keys[other]) & (there >= 0)]
        return at

    def enter(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        """Add transitions whose keys, all different, the table lacks."""
        if 2 * (self.used + len(keys)) > self.room:
            old = self.keys >= 0
            held = self.keys[old], self.next[old], self.out[old]
            self.__init__(self.room * 2 ** max(1, int(np.ceil(np.log2(2 * (self.used + len(keys)) / self.room)))))
            self.enter(*held)
        self.used += len(keys)
        while len(keys):
            at = self.places(keys)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.next[at[first]], self.out[at[first]] = keys[first], to[first], change[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, change = keys[rest], to[rest], change[rest]


class Transducer:
    """Compiled states and transitions, extended while texts run through.

    A state is (blanks, suffix, entries). ``suffix`` begins some piece; entry j tells
    of the place before its j-th code point the token that ends there ("" at a
    barrier) and the count up to it, from the current count. ``blanks`` is the length
    of the run of blanks just read, modulo the longest piece of blanks, else None.
    """

    def __init__(self, content: bytes):
        self.pieces = Pieces(content)
        self.class_of = np.full(0x110000, -1, np.int32)
        self.reset()

    def reset(self) -> None:
        self.class_of[:] = -1
        self.symbols: list[str | int] = []
        self.symbol_numbers: dict[str | int, int] = {}
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.cells = Cells()
        self.start = self.number(self.blank_state(1))

    def blank_state(self, blanks: int) -> tuple:
        k = blanks % self.pieces.period
        alone = self.pieces.blank_change[k]  # a last blank that no letter takes belongs to the run
        return (k, BLANK, (("", -alone), (BLANK, 0)))

    def number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Symbol numbers of code points; unknown ones share a number by their length in bytes."""
        own = self.class_of[points]
        if (own < 0).any():
            for point in np.unique(points[own < 0]).tolist():
                char = BLANK if point == 32 else chr(point)
                symbol = char if char in self.pieces.letters else len(char.encode())
                if symbol not in self.symbol_numbers:
                    self.symbol_numbers[symbol] = len(self.symbols)
                    self.symbols.append(symbol)
                self.class_of[point] = self.symbol_numbers[symbol]
            own = self.class_of[points]
        return own

    def step(self, state: tuple, symbol: str | int) -> tuple[tuple, int]:
        """(next state, change of the count)"""
        blanks, suffix, entries = state
        if symbol == BLANK:
            if blanks is None:
                return self.blank_state(1), self.pieces.blank_change[1 % self.pieces.period]
            to = self.blank_state(blanks + 1)
            return to, self.pieces.blank_change[to[0]]
        if isinstance(symbol, int):
            return (None, "", (("", 0),)), symbol
        text, pieces = suffix + symbol, self.pieces
        for j in range(len(text)):
            token, entry = text[j:], entries[j]
            if entry and pieces.reached(token) and (not entry[0] or pieces.compatible(entry[0], token)):
                break
        else:
            raise AssertionError("a prefix has no encoding")
        change = entry[1] + pieces.cost(token)
        kept = []
        for k, entry in enumerate([*entries, (token, change)]):
            begun, place = text[k:], None
            if entry and begun in pieces.begins:
                before = entry[0] and pieces.stand_in(entry[0], begun)
                place = None if before is None else (before, entry[1] - change)
            if kept or place:
                kept.append(place)
        return (None, text[len(text) + 1 - len(kept) :], tuple(kept)), change

    def compile(self, keys: np.ndarray) -> None:
        """Enter the transitions of ``keys``: state and symbol."""
        keys = np.unique(keys)
        found = [self.step(self.states[key >> SYMBOL_BITS], self.symbols[key & ((1 << SYMBOL_BITS) - 1)]) for key in keys.tolist()]
        self.cells.enter(keys, np.array([self.number(to) for to, _ in found], np.int32), np.array([change for _, change in found], np.int16))

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray, path: np.ndarray, sums: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Run chunks in step. Returns leaving states and counts.

        ``path`` and ``sums`` (steps x chunks) get the states and counts before each step. With
        ``known``, the leaving states and counts of the runs that they already hold, they
        are only read, and a chunk ends its run where it meets that one.
        """
        state, count = entry.copy(), np.zeros(len(entry), np.int32)
        leave, total = entry.copy(), np.zeros(len(entry), np.int64)
        lanes = np.arange(len(entry))
        for k in range(int(lengths.max(initial=0))):
            ended = lengths[lanes] <= k
            if known is None:
                path[k, lanes], sums[k, lanes] = state, count
            else:
                met = ~ended & (path[k, lanes] == state)
                there = lanes[met]
                leave[there], total[there] = known[0][there], count[met] + known[1][there] - sums[k, there]
            there = lanes[ended]
            leave[there], total[there] = state[ended], count[ended]
            if known is not None:
                ended |= met
            if ended.any():
                lanes, state, count = lanes[~ended], state[~ended], count[~ended]
            if not len(lanes):
                return leave, total
            key = state.astype(np.int64) << SYMBOL_BITS | symbols[starts[lanes] + k]
            at = self.cells.places(key)
            missing = self.cells.keys[at] != key
            if missing.any():
                self.compile(key[missing])
                at = self.cells.places(key)
            state, count = self.cells.next[at], count + self.cells.out[at]
        leave[lanes], total[lanes] = state, count
        return leave, total

    def scan(self, points: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, leaving state) of each text of ``points``, none of them empty, entered in the states ``first``."""
        size = np.diff(ends)
        own = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(size)), own)
        heads = np.cumsum(own) - own
        turn = np.arange(len(doc)) - heads[doc]
        starts = ends[:-1][doc] + turn * CHUNK
        lengths = np.minimum(CHUNK, ends[1:][doc] - starts)
        symbols = self.classes(points)
        # The entries of all maps: chunk << 32 | entering state, with leaving state and count.
        state = np.full(len(doc), self.start, np.int32)
        state[heads] = first
        path, sums = np.zeros((CHUNK, len(doc)), np.int32), np.zeros((CHUNK, len(doc)), np.int32)
        chunk = np.arange(len(doc))
        leave, total = base = self.run(symbols, starts, lengths, state, path, sums, None)
        entries = chunk << 32 | state
        inner = np.append(doc[1:] == doc[:-1], False)  # another chunk of the text follows
        new = chunk, leave
        while True:
            ahead = inner[new[0]]
            need = np.setdiff1d((new[0][ahead] + 1) << 32 | new[1][ahead], entries)
            if not len(need):
                break
            at, state = need >> 32, (need & 0xFFFFFFFF).astype(np.int32)
            new_leave, new_total = self.run(symbols, starts[at], lengths[at], state, path[:, at], sums[:, at], (base[0][at], base[1][at]))
            entries, leave, total = np.concatenate([entries, need]), np.concatenate([leave, new_leave]), np.concatenate([total, new_total])
            new = at, new_leave
        order = np.argsort(entries)
        entries, leave, total = entries[order], leave[order], total[order]
        # The scan: entry e stands for the map of its chunk and those up to ``after``, where it goes on.
        chunk = entries >> 32
        after = np.where(inner[chunk], np.searchsorted(entries, (chunk + 1) << 32 | leave), -1)
        while (going := np.flatnonzero(after >= 0)).size:
            to = after[going]
            total[going], leave[going], after[going] = total[going] + total[to], leave[to], after[to]
        at = np.searchsorted(entries, heads << 32 | first)
        return total[at], leave[at]

    def counts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each document of ``points`` (code points, with n + 1 offsets).

        SEGMENT code points run at once; a longer document goes on in the state it has reached.
        """
        out = np.zeros(len(ends) - 1, np.int64)
        full = np.flatnonzero(np.diff(ends))
        out[full] = 1
        stops = ends[full + 1]
        i, reached = 0, ends[full[0]] if len(full) else 0
        state = None
        while i < len(full):
            if self.cells.used > MOST_CELLS:
                self.reset()
            j = max(i + 1, int(np.searchsorted(stops, reached + SEGMENT, "right")))
            bounds = np.concatenate([[reached], stops[i:j]])
            bounds[-1] = min(bounds[-1], reached + SEGMENT) if j == i + 1 else bounds[-1]
            first = np.full(j - i, self.start, np.int32)
            if state is not None:
                first[0] = self.number(state)
            total, leave = self.scan(points[reached : bounds[-1]], bounds - reached, first)
            out[full[i:j]] += total
            reached = bounds[-1]
            state = self.states[leave[-1]] if reached < stops[j - 1] else None
            i = j if state is None else i
        return out


_compiled: dict[str, Transducer] = {}


def transducer(content: bytes) -> Transducer:
    key = hashlib.sha256(content).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(content)
    return _compiled[key]


def code_points(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 ``data`` and the offsets of its documents among them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(kernels.LEADS[data])])[ends]


def _count(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(content.value)
        for batch in batches:
            data, ends = common.utf8(batch.column(1))
            for i, j in common.slices(ends, SEGMENT):
                points, bounds = code_points(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(ends[i : j + 1])), pa.array(machine.counts(points, bounds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs``.

    ``path``: a piece model (BPE, byte fallback, identity normalizer), read on the
    driver and broadcast. Counts are those of its library without added tokens. A null
    or empty text has none. Repeated rows are counted one by one; only doc_id and text
    are read.
    """
    common.prepare(docs.sparkSession)
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(common.lean(_count(content)), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op4(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit over all documents."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
