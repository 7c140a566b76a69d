"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The rows of a source are dealt by a hash over a fixed number of blocks, so blocks are random parts of about
equal size and their order is already a permutation. A source whose target is r times its size gives every
block floor(r) times, and for the rest its first blocks and the first rows (by hash) of one more. The exact
number of block copies each source owes is then split among the output shards: a tree halves the shards, and
each node draws the left half's share of all sources at once from the multivariate hypergeometric
distribution, so every shard has its exact number of blocks and every quota adds up. Shards draw disjoint runs
of each source's permuted block copies, and rows are ordered by a hash inside their shard.

The driver sees per source and per block sums only: sources x ``BLOCKS`` numbers, with ``MAX_SOURCES`` checked.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.core import running_total
from plumbline.llm.util import WORD, whole_text

BLOCKS, MAX_SOURCES, UNIT = 512, 4096, 1 << 40


@dataclass
class Plan:
    """What one source gives: ``full`` copies of each block, and once more its blocks below ``part_block``
    and the rows of ``part_block`` whose order value is at most ``part_upto``. ``shards``: for each copy
    number, the shard of each block."""

    source: str | None
    size: int
    target: float
    full: int
    part_block: int
    part_upto: int
    shards: list[list[int]]


def word_count(text: Column | str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``limit`` times its size; the excess goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * unit > limit * sizes[i]}
        for i in over or free:
            out[i] = limit * sizes[i] if i in over else weights[i] * unit
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards x sources) block counts: a tree of multivariate-hypergeometric draws with exact sums."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = rng.multivariate_hypergeometric(have, total * (mid - lo) // (hi - lo), method="marginals")
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


def _keyed(docs: DataFrame, ident: str, source: str, size: Column, seed: int) -> DataFrame:
    """All rows with _size, _block and _order; the hash sees the id and the size, so repeats stay together."""
    h = F.xxhash64(F.lit(seed), F.col(ident).cast("string"), F.col(source), F.lit("block"))
    o = F.xxhash64(F.lit(seed), F.col(ident).cast("string"), F.col(source), F.lit("order"))
    return docs.withColumns({"_size": size, "_block": F.pmod(h, F.lit(BLOCKS)).cast("int"), "_order": F.pmod(o, F.lit(UNIT))})


def plan(keyed: DataFrame, source: str, weights: Sequence[float], limit: float, shards: int, seed: int) -> list[Plan]:
    """One entry per source, sources by code point with null last, ``weights`` repeating in that order."""
    sums = keyed.groupBy(source, "_block").agg(F.sum("_size").alias("words")).orderBy(F.col(source).asc_nulls_last(), "_block").limit(MAX_SOURCES * BLOCKS + 1).collect()
    if len(sums) > MAX_SOURCES * BLOCKS:
        raise ValueError(f"more than {MAX_SOURCES} sources; merge some before mixing")
    by: dict[str | None, np.ndarray] = {}
    for r in sums:
        by.setdefault(r[0], np.zeros(BLOCKS, np.int64))[r[1]] = r[2]
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in by)
    size = [int(by[s].sum()) for s in names]
    aim = targets(size, [weights[i % len(weights)] for i in range(len(names))], sum(size), limit)
    full, block, rest = [], [], []
    for s, n, t in zip(names, size, aim):
        copies = min(int(t / n + 1e-12), int(limit)) if n else 0
        left = max(t - copies * n, 0.0)
        upto = np.cumsum(by[s])
        b = int(np.searchsorted(upto, left + 1e-9, side="right")) if left > 0 else 0
        full.append(copies)
        block.append(b)
        rest.append(left - (upto[b - 1] if 0 < b else 0) if b < BLOCKS else 0.0)
    cuts = _cuts(keyed, source, {s: (b, r) for s, b, r in zip(names, block, rest) if r > 0})
    copies_of = [[BLOCKS] * f + ([min(b + (s in cuts), BLOCKS)] if b or s in cuts else []) for s, f, b in zip(names, full, block)]
    quota = split_quotas(np.array([sum(c) for c in copies_of], np.int64), shards, np.random.Generator(np.random.PCG64(seed))) if names else np.zeros((shards, 0), np.int64)
    out = []
    for i, s in enumerate(names):
        owner = np.repeat(np.arange(shards), quota[:, i])
        order = np.random.Generator(np.random.PCG64([seed, i])).permutation(len(owner))
        place = np.empty(len(owner), np.int64)
        place[order] = owner  # block copy number -> shard that draws it
        ends = np.cumsum([0, *copies_of[i]])
        out.append(Plan(s, size[i], aim[i], full[i], block[i], cuts.get(s, -1), [place[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]))
    return out


def _cuts(keyed: DataFrame, source: str, wanted: dict) -> dict:
    """For each source the order value up to which its part block comes nearest to the words still owed."""
    if not wanted:
        return {}
    spark = keyed.sparkSession
    rows = [(s, b, float(r)) for s, (b, r) in wanted.items()]
    need = spark.createDataFrame(rows, T.StructType([T.StructField("_s", T.StringType()), T.StructField("_b", T.IntegerType()), T.StructField("_need", T.DoubleType())]))
    part = keyed.select(F.col(source).alias("_s0"), "_block", "_order", "_size").groupBy("_s0", "_block", "_order").agg(F.sum("_size").alias("_size"))
    part = part.join(F.broadcast(need), part._s0.eqNullSafe(need._s) & (part._block == need._b))
    upto = running_total(part.select("_s", "_order", "_size", "_need"), ["_s"], ["_order"], "_size", "_upto")  # a block may be long
    near = upto.withColumn("_off", F.col("_upto") - F.col("_need")).groupBy("_s").agg(
        F.min_by("_order", F.struct(F.abs("_off"), "_order")).alias("cut"), F.min(F.abs("_off")).alias("off"), F.first("_need").alias("need"))
    return {r._s: r.cut for r in near.collect() if r.off < r.need}


def mixed(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), limit: float = 3.0, shards: int = 32, seed: int = 9) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, copies (array of (shard, position)): one row per input row.

    size is the number of words (null text: 0). Targets share the sum of all sizes by weight and stop at
    ``limit`` times a source's size. A row is taken as often as it has copies; ``emit`` lists them shard by
    shard. Rows with the same id and source are taken alike, null ids too; a null source is a source of its
    own. A source without words gives nothing. Equal input and seed give equal output however the rows are
    partitioned. Columns with the names of the results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ("size", "source_size", "target", "copies") if c in docs.columns])
    keyed = _keyed(docs, ident, source, word_count(text), seed)
    plans = plan(keyed.select(ident, source, "_size", "_block", "_order"), source, weights, limit, shards, seed)
    fields = [("_s", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("_full", T.IntegerType()), ("_part", T.IntegerType()), ("_upto", T.LongType()), ("_shards", T.ArrayType(T.ArrayType(T.IntegerType())))]
    table = spark.createDataFrame([(p.source, p.size, p.target, p.full, p.part_block, p.part_upto, p.shards) for p in plans], T.StructType([T.StructField(*f) for f in fields]))
    rows = keyed.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("_s")), "left")  # one row per source, at most MAX_SOURCES
    part = ((F.col("_block") < F.col("_part")) | ((F.col("_block") == F.col("_part")) & (F.col("_order") <= F.col("_upto")))).cast("int")
    n = F.col("_full") + part
    position = lambda c: F.xxhash64(F.lit(seed), F.col(ident).cast("string"), F.col(source), c)
    copy = lambda c: F.struct(F.element_at(F.element_at("_shards", c), F.col("_block") + 1).alias("shard"), position(c).alias("position"))
    copies = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), copy)).otherwise(F.array().cast("array<struct<shard:int,position:bigint>>"))
    return rows.withColumn("copies", copies).withColumnRenamed("_size", "size").drop("_s", "_block", "_order", "_full", "_part", "_upto", "_shards")


def emit(mix: DataFrame, shards: int = 32) -> DataFrame:
    """One row per taken copy with its shard, shards apart and each shuffled locally by hash."""
    rows = mix.withColumn("_copy", F.explode("copies")).withColumn("shard", F.col("_copy.shard")).withColumn("_position", F.col("_copy.position"))
    # A shard may exceed a task's memory: cut it by position, which is uniform.
    return rows.drop("_copy", "copies").repartitionByRange("shard", "_position").sortWithinPartitions("shard", "_position").drop("_position")


def mixed_query(docs: DataFrame) -> DataFrame:
    """One row per document; ``shards``: the shard that the splitting tree gives each of its copies, comma-joined."""
    mix = mixed(docs.select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("bigint").alias("taken"), F.size("copies").alias("n_copies"),
                      F.array_join("copies.shard", ",").alias("shards"))
