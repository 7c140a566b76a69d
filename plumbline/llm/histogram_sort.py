"""Sharding by a histogram sort: rows are sorted by key into shards of near equal bytes, moved once.

The key of a row is (60 bits of the text's md5, 60 bits of the id's md5, a row number), so equal texts lie
next to each other and a group of them is cut only where a shard ends, however large it is. Between the shards
lie *splitters*. They are found by counting, not by sampling: every round takes a sorted list of candidate
boundaries (probes) and counts, in one aggregate over all partitions, the exact bytes and rows between each
two. Prefix sums then say which interval holds each splitter; its probes of the next round divide that interval,
between the least and greatest key that it really holds. A splitter is settled when a probe lies within
the tolerance of its target, or when its interval is down to one row; with tolerance 0 a row thus goes to the
shard in which its middle byte falls. Only then are rows exchanged, once, by the interval they lie in.

A shard may be far more than a task can sort, so it is cut into buckets by further, loosely settled splitters
of the same rounds. Row counts below each splitter are exact and known by then: the place of a row in its shard
is its place in its bucket plus a constant.
"""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.util import stored, whole_text

KEYS = ("_k_text", "_k_id", "_k_row")
PROBES = 256  # new candidate boundaries a round for each splitter that is still open
BUCKET_BYTES = 256 << 20  # a bucket is sorted by one task
MAX_BUCKETS = 8192  # bounds what the driver holds: two longs per probe and bucket; beyond it buckets grow and sorts spill
OVERHEAD = 8  # bytes a row counts for besides its text
END = (1 << 62, 0, 0)  # above every key

Key = tuple[int, int, int]


@dataclass
class Splitter:
    """A boundary: rows with a key of at least ``key`` lie behind it; ``rows`` lie before it."""

    target: int  # numerator of the bytes wanted below it; the denominator is the number of parts
    slack: int  # settled when that near, same unit
    key: Key | None = None
    rows: int = 0
    low: Key = (0, 0, 0)  # the interval that holds it, while open
    high: Key = END
    inner: tuple[Key, ...] = ()


def _md5_bits(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def _intervals(rows: DataFrame, probes: list[Key], out: str) -> DataFrame:
    """``out``: the number of ``probes`` (sorted) not above the row's key, by an unrolled binary search."""
    for i, k in enumerate(KEYS):
        values = F.split(F.lit(",".join(str(p[i]) for p in probes)), ",").cast("array<bigint>")
        rows = rows.withColumn(f"_p{i}", values)
    rows = rows.withColumn(out, F.lit(0))
    step = 1 << (len(probes).bit_length() - 1) if probes else 0
    while step:
        to = F.col(out) + step
        a, b, c = (F.get(F.col(f"_p{i}"), to - 1) for i in range(3))
        x, y, z = (F.col(k) for k in KEYS)
        reached = (a < x) | ((a == x) & ((b < y) | ((b == y) & (c <= z))))
        rows = rows.withColumn(out, F.when((to <= len(probes)) & reached, to).otherwise(F.col(out)))
        step >>= 1
    return rows.drop("_p0", "_p1", "_p2")


def _between(low: list[int], high: list[int], n: int) -> tuple[Key, ...]:
    """At most ``n`` keys that divide the interval of keys whose parts run from ``low`` to ``high``."""
    at = next(i for i in range(3) if low[i] < high[i])  # parts before it are the same in all rows
    values = sorted({low[at] + -(-(high[at] - low[at]) * k // n) for k in range(1, n + 1)})
    return tuple((*low[:at], v, *[0] * (2 - at)) for v in values)


def find_splitters(slim: DataFrame, parts: int, size: str, tolerance: float, every: int = 1, probes: int = PROBES) -> list[Splitter]:
    """The ``parts`` - 1 splitters of the rows of ``slim`` (key columns and ``size`` > 0), by rounds of exact counts.

    ``tolerance``: a share of a part. Only every ``every``-th splitter is held to it, the others to half a part.
    """
    total, least = slim.agg(F.sum(size), F.min(size)).first()
    if total is None:
        return []
    if least <= 0:
        raise ValueError("sizes must be positive")
    found = [Splitter(total * i, int(total * (0.5 if i % every else tolerance * every)), inner=()) for i in range(1, parts)]
    for s in found:
        s.inner = _between([0, 0, 0], [1 << 60, 0, 0], 4 * max(parts, probes))
    while open_ := [s for s in found if s.key is None]:
        edges = sorted({k for s in open_ for k in (s.low, s.high, *s.inner)} - {(0, 0, 0), END})
        counted = _intervals(slim, edges, "_at").groupBy("_at").agg(
            F.sum(size).alias("bytes"), F.count("*").alias("rows"),
            *[f(k).alias(f"{n}{i}") for i, k in enumerate(KEYS) for n, f in (("low", F.min), ("high", F.max))])
        bins = {r["_at"]: r for r in counted.collect()}
        below = list(accumulate((bins[j].bytes if j in bins else 0 for j in range(len(edges) + 1)), initial=0))
        rows = list(accumulate((bins[j].rows if j in bins else 0 for j in range(len(edges) + 1)), initial=0))
        start = [(0, 0, 0), *edges, END]
        for s in open_:
            j = max(bisect_right(below, s.target // parts) - 1, 0)
            while below[j + 1] * parts <= s.target:
                j += 1
            before, behind = s.target - below[j] * parts, below[j + 1] * parts - s.target
            if before <= s.slack or behind <= s.slack:
                j += behind < before
                s.key, s.rows = start[j], rows[j]
            elif bins[j].rows == 1:
                j += before > behind  # its middle byte lies before the target
                s.key, s.rows = start[j], rows[j]
            else:
                s.low, s.high = start[j], start[j + 1]
                s.inner = _between([bins[j][f"low{i}"] for i in range(3)], [bins[j][f"high{i}"] for i in range(3)], probes)
    return found


def sharded(docs: DataFrame, ident: str = "doc_id", text: str = "text", shards: int = 24, tolerance: float = 0.0, with_text: bool = True, bucket_bytes: int = BUCKET_BYTES, probes: int = PROBES) -> DataFrame:
    """All columns of ``docs`` (the text if asked for), then size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    size: UTF-8 bytes of the text plus 8; a null text has none and counts as empty. law is ``bytes``: shards hold
    near equal sizes, each splitter within ``tolerance`` of a shard, or at the row boundary nearest to
    it; with 0 always the latter. slot numbers the rows of a shard from 0 in key order. grown_shard is null, since
    under this law one more shard moves all boundaries. Null ids are ids of their own kind; rows with equal id
    and text are interchangeable, lie side by side and may be cut apart like any others. A text longer
    than a shard's share fills a shard alone or nearly so, and others may stay empty. An empty table gives an
    empty table. Old columns with the names of the results are replaced.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c not in {*new, *KEYS, "_bucket"} and (with_text or c != text)]
    t = whole_text(F.col(f"`{text}`"))
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in kept], (F.octet_length(t) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        _md5_bits(t).alias(KEYS[0]), _md5_bits(F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit(""))).alias(KEYS[1]), F.monotonically_increasing_id().alias(KEYS[2]))
    keyed = stored(keyed, "shard-keys")  # the row numbers are frozen here
    slim = keyed.select(*KEYS, "size")
    total = slim.agg(F.sum("size")).first()[0] or 0
    each = min(max(-(-total // (shards * bucket_bytes)), 1), max(MAX_BUCKETS // shards, 1))
    splitters = sorted(find_splitters(slim, shards * each, "size", tolerance, each, probes), key=lambda s: s.target)
    # Cuts come in the order of their targets: each is the row boundary nearest to its own, or within half a part of it.
    cuts = [s.key for s in splitters]
    first = [0, *[s.rows for s in splitters]]
    offsets = [n - first[i - i % each] for i, n in enumerate(first)]
    rows = _intervals(keyed, cuts, "_bucket")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*KEYS))
    offset = F.get(F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>"), F.col("_bucket"))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], "size", "text_crc32", F.lit("bytes").alias("law"),
        F.floor(F.col("_bucket") / each).cast("int").alias("shard"), (offset + place - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH step AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size FROM documents),
k AS (
    SELECT doc_id, size, ('0x' || substr(md5(t), 1, 15))::BIGINT AS k1, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k2,
           regexp_extract_all(hex(encode(t)), '..') AS bytes
    FROM d),
r AS (
    SELECT k.* EXCLUDE (bytes), xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(bytes, lambda b: ('0x' || b)::BIGINT)),
               lambda c, x: xor(c // 256, step.t[(xor(c, x) % 256) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM k, step),
c AS (SELECT *, sum(size) OVER (ORDER BY k1, k2 ROWS UNBOUNDED PRECEDING) - size AS below, sum(size) OVER () AS total FROM r),
s AS (SELECT *, ((2 * below + size) * 24 // (2 * total))::INTEGER AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1, k2) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
