"""Exact threshold join of sets: prefix against prefix, with length, count and positional bounds.

The elements of every set are put in one global order, rarest first. Two sets of n and m elements with Jaccard
similarity t or more have at least a = ceil(t / (1 + t) * (n + m)) elements in common, and the first ``MORE`` + 1 of
these (all, if there are fewer) stand among the first n - ceil(t * n) + 1 + MORE elements of the one set and likewise of the other: their
prefixes. Only prefixes are joined, as slim rows (element, set, size, place). Per pair of sets the join is
counted, and a pair is dropped unless

- the sizes allow the similarity (checked on every joined row),
- every match leaves room for a common elements: min(i, j) before it, min(n - i, m - j) from it on (per row),
- the prefixes hold min(MORE + 1, a) common elements, and these with the shorter rest behind the last one reach a.

What passes is few; the sketches of the sets (parity bitmaps) drop most of what is not similar, the rest is verified on the
whole sets. The order needs no exact frequencies, since any order gives
the same result: elements are counted in ``2 ** SKETCH_BITS`` buckets, a table of fixed size, so the sets are never
exploded for it. A bucket counted once holds an element of one set only, which cannot match.

An element that many prefixes share is split: its rows are dealt over s groups on both sides and meet in
s x s sub-keys, each of bounded size, every pair in exactly one of them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.core import settle

MORE = 2  # common elements asked for beyond the first
SKETCH_BITS = 20  # 8 MB of counts
ROWS_PER_KEY = 2_000
SKETCH_PLACES = 4  # bits of a set's sketch per element, at least
_EPS = 1e-9


def _bucket(els: np.ndarray) -> np.ndarray:
    """Multiplicative hash of int64 elements to ``SKETCH_BITS`` bits."""
    return (els.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a batch, and the number of elements of each set."""
    lists = batch.column("els")
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]], np.diff(ends)


def element_counts(*sets: DataFrame) -> np.ndarray:
    """How many elements of all sets fall into each bucket: an upper bound of the frequency of each of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(_flat(batch)[0]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for s in sets:
        counted = s.select("els").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
        got = counted.toArrow()  # at most 2 ** SKETCH_BITS rows
        out[got["bucket"].to_numpy()] += got["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, counts: np.ndarray, min_sim: float, more: int = MORE) -> DataFrame:
    """(el, id, n, pos): the prefix of every set (rid, els), without elements that occur once in all."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            els, n = _flat(batch)
            of = np.repeat(np.arange(len(n)), n)
            freq = counts[_bucket(els)]
            order = np.lexsort((els, freq, of))
            els, freq = els[order], freq[order]
            pos = np.arange(len(els)) - np.repeat(np.cumsum(n) - n, n)
            length = n - np.ceil(min_sim * n - _EPS).astype(np.int64) + 1 + more
            keep = (pos < length[of]) & (freq > 1)
            ids = batch.column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(els[keep]), pa.array(ids[of[keep]], pa.int64()), pa.array(n[of[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["el", "id", "n", "pos"])

    return sets.select(F.col("rid").cast("bigint").alias("rid"), "els").mapInArrow(run, "el bigint, id bigint, n int, pos int")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], ident: str, on: Column, rows_per_key: int = ROWS_PER_KEY) -> DataFrame:
    """Inner join on ``keys`` under the further condition ``on``, no sub-key with much more than ``rows_per_key`` rows of a side.

    Columns of the right side other than the keys must have names of their own; ``ident`` names the column of either side
    (``ident`` and ``ident`` + '_r') by whose hash the rows of a hot key are dealt.
    """
    counted = left.groupBy(*keys).agg(F.count("*").alias("_a")).join(right.groupBy(*keys).agg(F.count("*").alias("_b")), keys)
    hot = settle(counted.select(*keys, F.ceil(F.greatest("_a", "_b") / rows_per_key).cast("int").alias("_s")).where("_s > 1"))
    deal = lambda c: F.pmod(F.xxhash64(c), F.col("_s")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    a = left.join(hot, keys, "left").withColumn("_s", F.coalesce("_s", F.lit(1))).withColumn("_x", deal(ident)).withColumn("_y", every).drop("_s")
    b = right.join(hot, keys, "left").withColumn("_s", F.coalesce("_s", F.lit(1))).withColumn("_y", deal(f"{ident}_r")).withColumn("_x", every).drop("_s")
    b = b.withColumnsRenamed({k: f"_{k}" for k in (*keys, "_x", "_y")})
    same = on
    for k in (*keys, "_x", "_y"):
        same = same & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, same)


def sketches(sets: DataFrame) -> DataFrame:
    """(rid, n, bits): size and parity bitmap of every set (rid, els), ``SKETCH_PLACES`` to twice as many places an element.

    A place holds the parity of the elements hashed to it. Elements of both sets cancel out, so two bitmaps differ in at
    most as many places as the sets differ in elements. The places are a power of two: halves xored give the shorter bitmap.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            els, n = _flat(batch)
            ends, out = np.cumsum(n), []
            mixed = els.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
            for end, size in zip(ends.tolist(), n.tolist()):
                width = max(64, 1 << (SKETCH_PLACES * size - 1).bit_length())
                place = (mixed[end - size:end] & np.uint64(width - 1)).astype(np.int64)
                out.append(np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(n.astype(np.int32)), pa.array(out, pa.binary())], names=["rid", "n", "bits"])

    return sets.select(F.col("rid").cast("bigint").alias("rid"), "els").mapInArrow(run, "rid bigint, n int, bits binary")


def places_apart(a: bytes, b: bytes) -> int:
    """In how many places two bitmaps differ, the longer one folded to the width of the shorter."""
    if len(a) > len(b):
        a, b = b, a
    x, y, width = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while width > 8 * len(a):
        width >>= 1
        y = (y >> width) ^ (y & ((1 << width) - 1))
    return (x ^ y).bit_count()


def sketched(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(q, r, n, m, apart): sizes of the sets of each pair, and a number of elements that they differ in at least."""
    a = sketches(left).withColumnsRenamed({"rid": "q", "bits": "a"})
    b = sketches(right).withColumnsRenamed({"rid": "r", "n": "m", "bits": "b"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [places_apart(x, y) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "r", "n", "m")), pa.array(apart, pa.int32())], names=["q", "r", "n", "m", "apart"])

    both = pairs.select(F.col("q").cast("bigint").alias("q"), F.col("r").cast("bigint").alias("r")).join(a, "q").join(b, "r")
    return both.select("q", "r", "n", "m", "a", "b").mapInArrow(run, "q bigint, r bigint, n int, m int, apart int")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, min_sim: float) -> DataFrame:
    """(q, r, sim): the pairs (q, r) whose whole sets are similar enough.

    Whole sets travel only for pairs that their sketches allow: common elements are at most half of what ``apart`` leaves.
    """
    most = (F.col("n") + F.col("m") - F.col("apart")) / 2
    pairs = sketched(pairs, left, right).where(most >= min_sim * (F.col("n") + F.col("m") - most) - _EPS)
    a = left.select(F.col("rid").alias("q"), F.col("els").alias("qe"))
    b = right.select(F.col("rid").alias("r"), F.col("els").alias("re"))
    common = F.size(F.array_intersect("qe", "re"))
    sim = common / (F.size("qe") + F.size("re") - common)
    return pairs.select("q", "r").join(a, "q").join(b, "r").select("q", "r", sim.alias("sim")).where(F.col("sim") >= min_sim - _EPS)


def candidate_pairs(left: DataFrame, right: DataFrame | None, min_sim: float, more: int = MORE, rows_per_key: int = ROWS_PER_KEY) -> DataFrame:
    """(q, r): a superset of the pairs with similarity ``min_sim`` or more; unordered and without (q, q) if ``right`` is none."""
    counts = element_counts(left) if right is None else element_counts(left, right)
    a = settle(prefixes(left, counts, min_sim, more))  # read several times below
    b = a if right is None else settle(prefixes(right, counts, min_sim, more))
    b = b.select("el", F.col("id").alias("id_r"), F.col("n").alias("m"), F.col("pos").alias("at"))
    least = F.ceil(F.lit(min_sim / (1 + min_sim)) * (F.col("n") + F.col("m")) - _EPS)
    room = F.least("pos", "at") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    fits = (F.least("n", "m") >= min_sim * F.greatest("n", "m") - _EPS) & (room >= least)
    if right is None:
        fits = fits & (F.col("id") < F.col("id_r"))
    met = split_join(a, b, ["el"], "id", fits, rows_per_key)
    # One row per pair: sizes are the same in all its rows, and the last match has the greatest places in both sets.
    pairs = met.groupBy(F.col("id").alias("q"), F.col("id_r").alias("r")).agg(
        F.count("*").alias("c"), F.max("n").alias("n"), F.max("m").alias("m"), F.max("pos").alias("pos"), F.max("at").alias("at"))
    rest = F.least(F.col("n") - 1 - F.col("pos"), F.col("m") - 1 - F.col("at"))
    return pairs.where((F.col("c") >= F.least(F.lit(more + 1), least)) & (F.col("c") + rest >= least)).select("q", "r")


def similar_pairs(left: DataFrame, right: DataFrame | None, min_sim: float, more: int = MORE, rows_per_key: int = ROWS_PER_KEY) -> DataFrame:
    """(q, r, sim): all pairs of distinct sets (rid, els) with Jaccard similarity ``min_sim`` (0 to 1, not 0) or more.

    ``rid`` is an integer and unique, ``els`` distinct longs. With ``right`` none the table is joined with itself, each
    unordered pair once, q < r. Empty sets match nothing.
    """
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must lie in (0, 1]")
    live = lambda s: s.where(F.size("els") > 0).select("rid", "els")
    left, right = live(left), None if right is None else live(right)
    pairs = candidate_pairs(left, right, min_sim, more, rows_per_key)
    return verified(pairs, left, left if right is None else right, min_sim)
