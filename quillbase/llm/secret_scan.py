"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Everything is Spark SQL. A kind's spans come from cutting the text at its pattern:
the pieces between the matches and the matches themselves alternate, so their
lengths give every start and end in code points.

The method's own kind, ``entropy``, looks at maximal runs of base64 letters that
hold a digit. A window of ``WINDOW`` characters slides over the run; the counts of
its characters are kept and changed by one character out and one in, and with them
the sum of c * log2(c), from which the window's Shannon entropy follows. Each
character class has its own bar. Runs on the allow list (identifiers, paths,
numbers, dashed words, runs that begin or end as placeholders do) and runs that base
spans cover add nothing; a run that reaches beyond them is a span of its own, whole.

Running sums over a text's matches are taken in blocks of about the root of their
number, so a text of many matches costs little more than their count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The base kinds in their order, with pattern, measured group and least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same matches, without those that would be dropped: a run is maximal, so a shorter one never holds a longer.
LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

WINDOW = 20
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that some window of a run must reach, by character class: the narrowest class that holds the run.
BARS = (("hex", r"^[0-9A-Fa-f]+$", 2.9), ("alnum", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: Runs that are not secrets, whatever their entropy.
ALLOWED = (
    r"^[0-9+/_=-]+$",  # numbers, dates, phone numbers
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUID
    r"(?i:^(example|sample|dummy|placeholder|changeme|lorem|test|xxxx|000000|1234567|abcdef)|(example|sample|dummy|placeholder|changeme|lorem|test|xxxx|000000|1234567|abcdef)$)",  # placeholders
    r"^([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))+$",  # dashed words and numbers
    r"^[A-Za-z][a-z]+[0-9]{1,4}$",  # a long word and a number
)
#: What no word, number, or word with a number behind it holds. A run with a slash and without these is a path or address.
NO_WORD = r"[0-9][A-Za-z]|[A-Za-z][0-9]{5}|[a-z][A-Z]([^a-z]|$)|([A-Z][a-z]){2}[A-Z]|[A-Z]{2}[a-z]"


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers ``values``, 0 combined with all that stand before it: a running sum or maximum.

    In blocks of the root of their number: an array that grows by one entry at a time is
    copied each time, so one fold over n of them would take n^2.
    """
    empty = F.array().cast("array<int>")

    def fold(items: Column, start: Column) -> Column:
        step = lambda s, v: F.struct(combine(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    def blocked(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(values), width), lambda k: F.slice(values, k, width))
        totals = lambda blocks: fold(F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), combine)), F.lit(0))
        return once(blocks, lambda blocks: F.flatten(F.zip_with(blocks, totals(blocks), fold)))

    return once(values, lambda v: F.when(F.size(v) <= 16, fold(v, F.lit(0))).otherwise(blocked(v)))


def spans_of(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, body>> of the matches whose ``group`` has ``least`` characters or more."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), bodies.alias("body"))
    empty = F.array().cast("array<struct<start:int,end:int,body:string>>")

    def placed(parts: Column) -> Column:
        starts = before(F.transform(parts, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))), lambda a, b: a + b)

        def span(part: Column, at: Column) -> Column:
            start = at + F.length(part["gap"])
            return F.struct(start.alias("start"), (start + F.length(part["hit"])).alias("end"), part["body"].alias("body"))

        return F.filter(F.zip_with(parts, starts, span), lambda s: s["end"].isNotNull() & (F.length(s["body"]) >= least))

    return F.when(text.rlike(pattern), once(parts, placed)).otherwise(empty)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def peak_entropy(run: Column) -> Column:
    """The highest Shannon entropy, in bits a character, of any window of ``run``."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    f = lambda c: F.element_at(table, c + 1)

    def lowest(chars: Column, own: Column) -> Column:
        """The least sum of c * log2(c) over the windows of ``chars``, whose distinct characters are ``own``."""
        codes = F.transform(chars, lambda c: F.array_position(own, c).cast("int"))
        head = F.slice(chars, 1, WINDOW)
        counts = F.transform(own, lambda k: F.size(F.filter(head, lambda c: c == k)))
        total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + f(c))
        start = F.struct(counts.alias("counts"), total.alias("total"), total.alias("least"))

        def slides(codes: Column) -> Column:
            pairs = F.when(F.size(codes) > WINDOW, F.arrays_zip(F.slice(codes, 1, F.size(codes) - WINDOW).alias("out"), F.slice(codes, WINDOW + 1, F.size(codes)).alias("into")))
            return F.coalesce(pairs, F.array().cast("array<struct<out:int,into:int>>"))

        def step(s: Column, p: Column) -> Column:
            lost, won = F.element_at(s["counts"], p["out"]), F.element_at(s["counts"], p["into"])
            total = s["total"] - f(lost) + f(lost - 1) - f(won) + f(won + 1)
            counts = F.transform(s["counts"], lambda c, i: c - (i + 1 == p["out"]).cast("int") + (i + 1 == p["into"]).cast("int"))
            moved = F.struct(counts.alias("counts"), total.alias("total"), F.least(s["least"], total).alias("least"))
            return F.when(p["out"] == p["into"], s).otherwise(moved)

        return F.aggregate(once(codes, slides), start, step, lambda s: s["least"])

    chars = F.filter(F.split(run, ""), lambda c: c != "")
    least = once(chars, lambda c: once(F.array_distinct(c), lambda own: lowest(c, own)))
    return F.lit(math.log2(WINDOW)) - least / F.lit(float(WINDOW))


def reaches_bar(run: Column) -> Column:
    bar = F.lit(None).cast("double")
    for _, pattern, bits in reversed(BARS):
        bar = F.when(run.rlike(pattern), F.lit(bits)).otherwise(bar)
    return F.coalesce(peak_entropy(run) >= bar, F.lit(False))


def is_path(run: Column) -> Column:
    """Whether a slash parts ``run`` into words and numbers (dashed ones too), of which none reaches its own bar.

    '/' is a letter of base64 too, so the slashes alone say nothing.
    """
    dense = F.exists(F.split(run, "[-_/=+]+"), lambda part: (F.length(part) >= WINDOW) & reaches_bar(part))
    return F.when(run.contains("/") & ~run.rlike(NO_WORD), ~dense).otherwise(F.lit(False))


def suspicious(run: Column) -> Column:
    return ~run.rlike("|".join(ALLOWED)) & run.rlike("[A-Za-z]") & reaches_bar(run) & ~is_path(run)


def secret_spans(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with a column ``out``: array<struct<start, rank, end, kind>>, by start, then kind as listed.

    Starts and ends are code points, the end exclusive. The kinds are ``assign``,
    ``access``, ``hex`` and ``entropy``; spans may overlap, but an
    ``entropy`` span is not covered by base spans. A null or empty text has no spans; rows,
    repeated ones too, are handled one by one; a column that ``out`` clashes with
    raises ValueError.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} exists")
    body = F.coalesce(F.col(text), F.lit(""))
    raw, taken = common.fresh(docs, "_raw"), common.fresh(docs, "_base")
    kinds = [*((name, LONG.get(name, pattern), group, least) for name, pattern, group, least in KINDS), ("entropy", RUN, 0, WINDOW)]
    rows = docs.withColumn(raw, F.struct(*[spans_of(body, pattern, group, least).alias(name) for name, pattern, group, least in kinds]))

    def ranked(name: str, rank: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))

    base = F.concat(*[ranked(name, rank, F.col(raw)[name]) for rank, (name, *_) in enumerate(KINDS)])
    rows = rows.withColumn(taken, F.array_sort(base))
    covered = lambda s: F.aggregate(F.col(taken), s["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)) >= s["end"]
    new = F.filter(F.col(raw)["entropy"], lambda s: ~covered(s) & suspicious(s["body"]))
    new = F.when(F.size(F.col(raw)["entropy"]) > 0, ranked("entropy", len(KINDS), new)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    return rows.withColumn(out, F.array_sort(F.concat(F.col(taken), new))).drop(raw, taken)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones joined, replaced by ``mark``. A null text stays null."""

    def pieces(spans: Column) -> Column:
        reach = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        gap = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit(""))
        tail = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(spans, reach, gap), ""), tail)

    return F.when(F.size(spans) > 0, once(spans, pieces)).otherwise(text)


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans over all documents."""
    rows = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("secrets", lambda s: s["kind"] != "entropy"))
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    """The query in the oracle's SQL. It has no lookaround, so runs are cut first and tested after."""
    pattern = {
        "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "entropy": "[A-Za-z0-9+/_=-]{20,}",
    }
    least = {name: n for name, _, _, n in KINDS} | {"entropy": WINDOW}
    parts = []
    for rank, (name, p) in enumerate(pattern.items()):
        group = 2 if name == "assign" else 0
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{name}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a,
         hits[i] AS hit, bodies[i] AS body
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS bodies, regexp_split_to_array(text, '{p}') AS gaps FROM d))
  WHERE length(bodies[i]) >= {least[name]}""")
    bar = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {bits}" for _, p, bits in BARS) + " END"
    windows = lambda x: f"list_max(list_transform(range(1, length({x}) - {WINDOW} + 2), lambda j: list_aggregate(string_split(substr({x}, j, {WINDOW}), ''), 'entropy')))"
    dense = f"len(list_filter(regexp_split_to_array(body, '[-_/=+]+'), lambda x: length(x) >= {WINDOW} AND {windows('x')} >= {bar('x')})) > 0"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
every AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, CAST(a + length(hit) AS BIGINT) AS b, body FROM every),
runs AS (SELECT * FROM s WHERE kind = 'entropy' AND regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]') AND NOT regexp_matches(body, '{"|".join(ALLOWED)}')),
joined AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (
  SELECT *, sum(CASE WHEN a <= until THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, rank) AS part FROM (
    SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM s WHERE kind <> 'entropy')) GROUP BY doc_id, part),
odd AS (SELECT * FROM runs WHERE {windows("body")} >= {bar("body")} AND NOT (contains(body, '/') AND NOT regexp_matches(body, '{NO_WORD}') AND NOT {dense})
  AND NOT EXISTS (SELECT 1 FROM joined AS o WHERE o.doc_id = runs.doc_id AND o.a <= runs.a AND runs.b <= o.b)),
spans AS (SELECT doc_id, rank, kind, a, b FROM s WHERE kind <> 'entropy' UNION ALL SELECT doc_id, rank, kind, a, b FROM odd),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind <> 'entropy') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
      FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
