"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. One pass over the texts gives each document its MinHash samples, folded into
   band keys and into an odd sketch: a bitmap in which each sample flips one bit, so
   that the population count of the XOR of two sketches estimates how many samples
   differ, and precisely so for high similarities.
2. Documents of equal shingle sets form a class; one of them stands for it.
3. Each band's bucket has a pivot, and every member is a candidate with its pivot:
   never all pairs of a bucket.
4. Candidates whose sketches agree are confirmed on the full sets. Confirmed links
   give components; candidates within a component need no test.
5. Members of one bucket may still be in different components. Of these documents,
   each lists its shingles that another one has too, rarest first. Two documents that
   reach the threshold share a shingle so early in both lists that enough of either
   list is left for their intersection. Each is tested with the most central document of
   its early shingles first; the pairs that are left between components are confirmed
   last. So no link that shares a bucket is lost but by its sketches, and no bucket's
   pairs are all made.

A pair at the threshold or above escapes all buckets with probability MISS at most, and
its sketches reject it with probability MISS at most: a link is lost with at most twice that.

A join on a key that may be hot (a document with many candidates, a shingle of many
documents, the smallest node of a large component) deals the key's rows over as many
places as they need and copies the other side to those places (``attach``, ``cells``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

ROWS_PER_BAND = 5
SKETCH_BITS = 512
WORDS = SKETCH_BITS // 64
#: Probability with which a pair at the threshold escapes all buckets, and with which its sketches reject it.
MISS = 1e-6
#: Rows of one key that meet in one place, and places among which a key's rows are dealt while their number is unknown.
MEET, PLACES = 256, 32


def band_count(percent: int, miss: float = MISS) -> int:
    """Bands with which a pair at the threshold shares no bucket with probability ``miss`` or less."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** ROWS_PER_BAND))


def most_flips(percent: int, samples: int, miss: float = MISS) -> int:
    """The XOR population count that a pair at the threshold exceeds with probability ``miss`` or less.

    Each sample differs with the same probability, and each that does flips two bits.
    """
    apart, bits = 1 - percent / 100, np.arange(SKETCH_BITS + 1)
    odd, total = (bits == 0).astype(float), np.zeros(SKETCH_BITS + 1)
    for k in range(samples + 1):
        ways = math.lgamma(samples + 1) - math.lgamma(k + 1) - math.lgamma(samples - k + 1)
        total += math.exp(ways + k * math.log(apart) + (samples - k) * math.log(1 - apart)) * odd
        for _ in range(2):
            odd = np.append(0, (odd * (SKETCH_BITS - bits))[:-1] / SKETCH_BITS) + np.append((odd * bits)[1:] / SKETCH_BITS, 0)
    beyond = np.append(np.cumsum(total[::-1])[::-1], 0)
    return int(np.flatnonzero(beyond[1:] <= miss)[0])


def estimate(flips: float, samples: int) -> float:
    """Similarity that an XOR population count stands for."""
    inside = max(1e-9, 1 - 2 * flips / SKETCH_BITS)
    return max(0.0, 1 + SKETCH_BITS * math.log(inside) / (4 * samples))


def _constants(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    return rng.integers(0, 1 << 32, samples, dtype=np.uint32), rng.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)


def signatures(keys: np.ndarray, bounds: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x bands) and odd sketches (documents x WORDS) of non-empty shingle sets."""
    n, samples = len(bounds) - 1, bands * ROWS_PER_BAND
    xors, factors = _constants(samples)
    low = (keys >> np.uint64(32)).astype(np.uint32)
    mins = np.empty((samples, n), np.uint32)
    first = bounds[:-1].astype(np.int64)
    for p in range(samples):
        mins[p] = np.minimum.reduceat((low ^ xors[p]) * factors[p], first)
    wide = mins.astype(np.uint64)
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(n, b + 1, np.uint64)
        for r in range(ROWS_PER_BAND):
            h = kernels.mix(h ^ wide[b * ROWS_PER_BAND + r])
        out[:, b] = h
    bit = kernels.mix(wide + (np.arange(samples, dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(SKETCH_BITS)
    flat = bit.astype(np.int64) + np.arange(n)[None, :] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return out, np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.uint64)


def _set_keys(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share, whatever the order."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(kernels.mix(keys ^ np.uint64(salt)), out=sums[1:])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def _fixed_lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _sign(bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch.column(1))
            for i, j in common.slices(ends):
                keys, bounds = kernels.shingles(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                marks, sketch = np.zeros((j - i, bands), np.uint64), np.zeros((j - i, WORDS), np.uint64)
                if len(full):
                    marks[full], sketch[full] = signatures(keys, np.concatenate([bounds[full], bounds[-1:]]), bands)
                hi, lo = _set_keys(keys, bounds)
                columns = [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), _fixed_lists(marks), _fixed_lists(sketch)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "hi", "lo", "bands", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch.column(1))
            for i, j in common.slices(ends):
                keys, bounds = kernels.shingles(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], width)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["node", "set"])

    return run


def _flips(a: str, b: str) -> Column:
    out = F.lit(0)
    for k in range(WORDS):
        out = out + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return out


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def attach(rows: DataFrame, key: str | list[str], other: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (key, ...; few rows a key), where a key may have a great part of the rows.

    A key's rows are dealt by ``other`` over PLACES, and its rows of ``table`` are copied to
    the places in use.
    """
    key = [key] if isinstance(key, str) else key
    dealt = rows.withColumn("_place", F.pmod(F.xxhash64(other), F.lit(PLACES)).cast("int"))
    used = dealt.groupBy(*key).agg(F.collect_set("_place").alias("_places"))
    copies = table.join(used, key).withColumn("_place", F.explode("_places")).drop("_places")
    return dealt.join(copies, [*key, "_place"], how).drop("_place")


def attach_settled(rows: DataFrame, key: str | list[str], other: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """The same with a settled ``table``, which is broadcast if its counted rows allow it."""
    if table.count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    return attach(rows, key, other, table, how)


def cells(rows: DataFrame, key: str, other: str, meet: int = MEET) -> DataFrame:
    """``rows`` with ``_cells``: into how many parts of about ``meet`` rows a key's rows are to be dealt."""
    dealt = rows.select(key, F.pmod(F.xxhash64(other), F.lit(PLACES)).cast("int").alias("_place"))
    sizes = dealt.groupBy(key).agg(F.ceil(F.count("*") / meet).cast("int").alias("_cells"), F.collect_set("_place").alias("_places"))
    sizes = sizes.select(key, "_cells", F.explode("_places").alias("_place"))
    return rows.withColumn("_place", F.pmod(F.xxhash64(other), F.lit(PLACES)).cast("int")).join(sizes, [key, "_place"]).drop("_place")


def _cell(other: str, count: str = "_cells") -> Column:
    return F.pmod(F.xxhash64(other), F.col(count)).cast("int")


def confirm(docs: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """The settled ``pairs`` (x, p) whose full shingle sets reach the threshold.

    Either end of a pair may have many partners: its pairs are dealt over places of about
    MEET, and its set is copied to each, so that no task gathers all of a hub's pairs.
    """
    nodes = common.settle(pairs.select(F.explode(F.array("x", "p")).alias("node")).distinct())
    texts = docs.join(common.small(nodes), F.col("doc_id") == F.col("node"), "left_semi")
    sets = common.settle(texts.mapInArrow(common.lean(_sets(width)), "node long, set array<long>"))
    hubs = pairs.count() > MEET
    for end, other in (("x", "p"), ("p", "x")) if hubs else ():
        pairs = cells(pairs, end, other).withColumn(f"_cell_{end}", _cell(other)).drop("_cells")
    pairs = common.settle(pairs) if hubs else pairs
    for end in ("x", "p"):
        key = [end, f"_cell_{end}"] if hubs else [end]
        places = pairs.select(*key).distinct()
        own = sets.join(places, F.col("node") == F.col(end)).select(*key, F.col("set").alias(f"set_{end}"))
        pairs = pairs.join(own, key)
    shared = F.size(F.array_intersect("set_x", "set_p"))
    return pairs.where(100 * shared >= percent * (F.size("set_x") + F.size("set_p") - shared)).select("x", "p")


def components(links: DataFrame) -> DataFrame:
    """(u, v): every node of ``links`` (x, p) but the smallest of its component, with that smallest node.

    Edges lead from the greater node u to the smaller v. Alternating large-star and
    small-star steps each rewire edges to the least neighbour, until every node has one
    edge, to a node without any. A graph of few edges, counted here, is rewired in one task.
    """
    edges = links.select(F.greatest("x", "p").alias("u"), F.least("x", "p").alias("v")).where("u > v").distinct()
    edges = common.settle(edges)
    few = edges.count() <= common.BROADCAST_ROWS
    kept = lambda df: common.settle(df).coalesce(1) if few else common.settle(df)
    edges = edges.coalesce(1) if few else edges
    while True:
        least = kept(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # Large star: what hangs on a node that has smaller neighbours itself hangs on the least of them.
        inner = least.select(F.col("u").alias("v"), "m").join(common.small(edges.select("v")), "v", "left_semi")
        inner = common.settle(inner)
        if not inner.isEmpty():
            edges = attach_settled(edges, "v", "u", inner, "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
            edges = kept(edges)
            least = kept(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # Small star: the smaller neighbours of a node hang on the least of them.
        many = common.settle(least.where("n > 1").select("u", "m"))
        if not many.isEmpty():
            moved = attach_settled(edges, "u", "v", many).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            moved = moved.union(least.select("u", F.col("m").alias("v")))
            edges = kept((moved.coalesce(1) if few else moved).distinct())
        elif inner.isEmpty():
            return edges


def _crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (x, p, ...) whose ends are in different components."""
    for end in ("x", "p"):
        own = common.small(roots.select(F.col("u").alias("_u"), F.col("v").alias(f"_{end}")))
        pairs = pairs.join(own, F.col(end) == F.col("_u"), "left").drop("_u").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_x <> _p").drop("_x", "_p")


def _mixed(own: DataFrame, key: str, other: str) -> DataFrame:
    """The rows (key, root, ...) of keys that occur in more than one component."""
    ends = own.groupBy(key).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select(key)
    return attach(own, key, other, ends)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("x"), F.least(a, b).alias("p")]


def _enough(shared: Column, sizes: Column, percent: int) -> Column:
    """Whether sets of ``sizes`` elements in all can be linked with ``shared`` of them in common."""
    return (100 + percent) * shared >= percent * sizes


def _lists(docs: DataFrame, own: DataFrame, percent: int, width: int) -> DataFrame:
    """Of each document of ``own`` (rep, root, sketch) its shingles that another one has too, rarest first.

    Rows (node, n, size, shingle, left, root, sketch): ``left`` of the ``size`` listed
    shingles are at this one and behind it. Rows with too little left for any partner go
    (the least one allowed has ``percent`` of a document's size), and shingles of a single
    component.
    """
    texts = docs.join(common.small(own.select("rep")), F.col("doc_id") == F.col("rep"), "left_semi")
    sets = common.settle(texts.mapInArrow(common.lean(_sets(width)), "node long, set array<long>"))
    each = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    both = each.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
    lists = attach(each, "shingle", "node", both).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("list"))
    lists = lists.select("node", "n", F.posexplode("list").alias("at", "item"), F.size("list").alias("size"))
    lists = lists.select("node", "n", "size", F.col("item.shingle").alias("shingle"), (F.col("size") - F.col("at")).alias("left"))
    lists = lists.where(_enough(F.col("left"), F.col("n") + F.ceil(F.col("n") * percent / 100), percent))
    lists = common.settle(lists.join(own, F.col("node") == F.col("rep")).drop("rep"))
    return common.settle(_mixed(lists, "shingle", "node"))


def _renamed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    new = lists.drop("root").join(common.small(roots), F.col("node") == F.col("u"), "left")
    return new.withColumn("root", F.coalesce("v", "node")).drop("u", "v")


_END = ("node", "root", "n", "left", "sketch")


def _possible(percent: int, flips: int) -> Column:
    """Whether ends _x and _p may be linked: sizes, the shingles left behind a common one, and sketches allow it.

    All common shingles of a pair are at its first common one or behind it in both
    lists, so the less of both ``left`` there bounds the intersection.
    """
    enough = _enough(F.least("left_x", "left_p"), F.col("n_x") + F.col("n_p"), percent)
    return _sizes_allow("n_x", "n_p", percent) & enough & (_flips("sketch_x", "sketch_p") <= flips)


def _central(lists: DataFrame, percent: int, flips: int) -> DataFrame:
    """Pairs (x, p) of each document and two others of each of its shingles: the one that
    shares most of its own, and one by hash. At most two a list entry."""
    every = F.struct(*_END)
    most = F.max_by(every, F.struct(F.col("size") / F.col("n"), F.xxhash64("node")))
    any_ = F.max_by(every, F.xxhash64("node", "shingle"))
    pivots = lists.groupBy("shingle").agg(F.array(most, any_).alias("p")).select("shingle", F.explode("p").alias("p"))
    pivots = pivots.select("shingle", *[F.col(f"p.{c}").alias(f"{c}_p") for c in _END])
    pairs = attach(lists.select("shingle", *[F.col(c).alias(f"{c}_x") for c in _END]), "shingle", "node_x", pivots)
    return pairs.where((F.col("root_x") != F.col("root_p")) & _possible(percent, flips)).select(*_ordered("node_x", "node_p")).distinct()


def _meetings(lists: DataFrame, percent: int, flips: int) -> DataFrame:
    """Pairs (x, p, root_x, root_p, flips) of different components that a shingle rare enough leads to.

    A shingle's documents are dealt into parts of about MEET, and each two parts meet in a place of their own."""
    dealt = cells(lists, "shingle", "node").withColumn("_own", _cell("node"))
    every = F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    a = dealt.select("shingle", F.col("_own").alias("_i"), every.alias("_j"), *[F.col(c).alias(f"{c}_x") for c in _END])
    b = dealt.select("shingle", every.alias("_i"), F.col("_own").alias("_j"), *[F.col(c).alias(f"{c}_p") for c in _END])
    pairs = a.join(b, ["shingle", "_i", "_j"]).where((F.col("root_x") < F.col("root_p")) & _possible(percent, flips))
    return pairs.select(*_ordered("node_x", "node_p"), "root_x", "root_p", _flips("sketch_x", "sketch_p").alias("flips")).distinct()


def _same_rows(signed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (x, p) and those between the classes of rows that have one id but different texts."""
    differ = " OR ".join(f"min({c}) <> max({c})" for c in ("hi", "lo"))
    ids = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.expr(differ).alias("differ")).where("differ").select("doc_id")
    ids = common.settle(ids)
    if ids.isEmpty():
        return links
    rows = signed.where("n > 0").join(common.small(ids), "doc_id").select("doc_id", "hi", "lo")
    rows = rows.join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).select(F.col("doc_id").alias("x"), F.col("rep").alias("p"))
    return links.union(rows)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    ``width``-word shingles. Null and empty texts, and texts without words, have an
    empty set and are linked with nothing. Rows of one id are one document, whatever their
    texts: those with words get one component. A row without an id gets a null component and is kept. Only
    doc_id and text are read; an empty table gives an empty result.
    """
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands = band_count(percent)
    flips = most_flips(percent, bands * ROWS_PER_BAND)
    signed = common.settle(docs.mapInArrow(common.lean(_sign(bands, width)), "doc_id long, n long, hi long, lo long, bands array<long>, sketch array<long>"))
    one = lambda c: F.first(c).alias(c)  # noqa: E731  equal within a class
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), one("n"), one("bands"), one("sketch"))
    classes = common.settle(classes)

    members = classes.select("rep", F.explode("bands").alias("bucket"))
    # The least member in one of four orders: near copies meet the same few pivots in all their buckets.
    salt = F.xxhash64(F.pmod("bucket", F.lit(4)))
    buckets = members.groupBy("bucket").agg(F.min(F.col("rep").bitwiseXOR(salt)).alias("low"), F.count("*").alias("c")).where("c > 1")
    buckets = common.settle(buckets.select("bucket", F.col("low").bitwiseXOR(salt).alias("pivot")))
    hot = common.settle(attach_settled(members, "bucket", "rep", buckets))
    sketches = classes.select("rep", "n", "sketch").join(common.small(common.settle(hot.select("rep").distinct())), "rep", "left_semi")
    sketches = common.settle(sketches)
    star = hot.where("rep <> pivot").select(F.col("rep").alias("x"), F.col("pivot").alias("p")).distinct()
    of = lambda end: sketches.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}"))
    star = attach_settled(star.join(common.small(of("x")), "x"), "p", "x", of("p"))
    star = star.where(_sizes_allow("n_x", "n_p", percent) & (_flips("s_x", "s_p") <= flips))
    star = common.settle(star.select(*_ordered("x", "p")).distinct())  # of two orders' pivots each may be the other's member
    roots = components(_same_rows(signed, classes, confirm(docs, star, percent, width)))

    own = hot.join(common.small(roots), F.col("rep") == F.col("u"), "left").select("bucket", "rep", F.coalesce("v", "rep").alias("root"))
    open_ = common.settle(_mixed(common.settle(own), "bucket", "rep").select("rep", "root").distinct())
    if not open_.isEmpty():
        lists = _lists(docs, open_.join(common.small(sketches.drop("n")), "rep"), percent, width)
        tried = common.settle(_central(lists, percent, flips).join(common.small(star), ["x", "p"], "left_anti"))
        if not tried.isEmpty():
            roots = components(_union(roots, confirm(docs, tried, percent, width)))
            lists = common.settle(_mixed(_renamed(lists, roots), "shingle", "node"))
        met = _meetings(lists, percent, flips).join(common.small(star.union(tried)), ["x", "p"], "left_anti")
        met = common.settle(met)
        # One pair of two components may join them: the likeliest first, then what still crosses.
        first = met.groupBy("root_x", "root_p").agg(F.min_by(F.struct("x", "p"), F.struct("flips", "x", "p")).alias("e"))
        first = common.settle(first.select("e.x", "e.p"))
        if not first.isEmpty():
            roots = components(_union(roots, confirm(docs, first, percent, width)))
            rest = common.settle(_crossing(met.select("x", "p").join(first, ["x", "p"], "left_anti"), roots))
            if not rest.isEmpty():
                roots = components(_union(roots, confirm(docs, rest, percent, width)))

    # A row of a class of its own without links keeps its id; the others look theirs up.
    named = classes.join(common.small(roots), F.col("rep") == F.col("u"), "left").where("rows > 1 OR v IS NOT NULL")
    named = common.settle(named.select("hi", "lo", F.coalesce("v", "rep").alias("root")))
    out = attach_settled(signed.select("doc_id", "n", "hi", "lo"), ["hi", "lo"], "doc_id", named, "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("root")), F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _union(roots: DataFrame, links: DataFrame) -> DataFrame:
    return roots.select(F.col("u").alias("x"), F.col("v").alias("p")).union(links)


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept over all documents, linked from 85 % on."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


#: Exact sets and all pairs that share a shingle: for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, y FROM r JOIN both_ways ON x = seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) AS m USING (doc_id)
"""
