"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are cut into ``parts`` groups of bits, correlated bits together. If two fingerprints differ in
at most ``k`` bits, then for any thresholds t_1..t_m, each at least -1, that add up to k - m + 1, there is a
group i in which they differ in at most t_i bits. So every fingerprint may choose its own thresholds: a
dynamic programme gives it those with the fewest estimated candidates, and a group whose value is common
gets a lower threshold or none (-1). The fingerprint probes the values within t_i of its own; what it meets
is verified by the bits. Completeness holds for every choice, the estimates only decide the cost.

Equal fingerprints are collapsed before anything is compared. A value met by more than ``CELL`` fingerprints
is dealt over cells of at most about ``CELL`` x ``CELL`` comparisons, and a cell returns links that span its
groups, never all pairs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.util import lookup, salt, stored, whole_text, with_group
from plumbline.operators.graph import connected_components

BITS, SEED, CELL, NODES, PER_PROBE = 64, 42, 1000, 65536, 500


def _fingerprint(text: str, width: int) -> int:
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space are meant
    if not words:
        return 0
    line = b" ".join(words)
    last = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))).tolist()
    first = [0, *last[:-1]]
    n = max(len(words) - width + 1, 1)
    ends = last[width - 1:] or last[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, NODES):
        h = np.fromiter((digest(line[a:b - 1], SEED) for a, b in zip(first[at:at + NODES], ends[at:at + NODES])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def simhash(text: Column, width: int) -> Column:
    """64-bit fingerprint (as a signed long): a bit is one if it is set in over half of the shingles' XXH64."""

    @F.pandas_udf("bigint")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return fingerprint(text)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(fps: DataFrame, parts: int) -> list[list[int]]:
    """Bits 0..63 in ``parts`` groups of nearly equal size, each grown from a bit by its strongest correlations.

    The sums come from all fingerprints; the driver sees 64 x 64 of them.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy().astype(np.int64)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["cell", "s"])

    got = fps.select("fp").mapInArrow(sums, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    s = np.zeros(BITS * BITS + 1)
    for r in got:
        s[r.cell] = r.s
    n = max(s[-1], 1.0)
    both = s[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    dev = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both - np.outer(mean, mean)) / np.outer(dev, dev))
    free, out = list(range(BITS)), []
    for p in range(parts):
        size = -(-len(free) // (parts - p))
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    v = np.zeros(len(fp), np.int64)
    u = fp.view(np.uint64)
    for j, b in enumerate(bits):
        v |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return v


def _choose(counts: np.ndarray, widths: list[int], k: int) -> np.ndarray:
    """Thresholds (rows x parts) of least estimated cost that add up to k - parts + 1.

    ``counts``: rows with the same value in each part. Within t bits of a value, the candidates are
    estimated as that count for the value itself plus one for each other value probed; a probe costs as
    much as ``PER_PROBE`` comparisons.
    """
    n, m = counts.shape
    around = [[_ball(w, t) for t in range(k + 1)] for w in widths]
    want = k + 1  # what the t + 1 add up to
    best = np.full((n, want + 1), np.inf)
    best[:, 0] = 0.0
    taken = np.zeros((m, n, want + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for t in range(-1, k + 1):
            cost = np.zeros(n) if t < 0 else around[i][t] + (counts[:, i] + around[i][t] - 1) / PER_PROBE
            for s in range(t + 1, want + 1):
                c = best[:, s - t - 1] + cost
                better = c < new[:, s]
                new[better, s] = c[better]
                taken[i][better, s] = t
        best = new
    out, s = np.zeros((n, m), np.int8), np.full(n, want)
    for i in range(m - 1, -1, -1):
        out[:, i] = taken[i][np.arange(n), s]
        s = s - out[:, i] - 1
    return out


def _ball(width: int, t: int) -> int:
    total = term = 1
    for j in range(1, t + 1):
        term = term * (width - j + 1) // j
        total += term
    return total


def _masks(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << j for j in c) for r in range(t + 1) for c in combinations(range(width), r)], np.int64)


def near_links(fps: DataFrame, k: int, parts: int) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``k`` bits of each other, directly or in steps."""
    groups = correlated_parts(fps, parts)
    widths = [len(g) for g in groups]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().astype(np.int64)
            for i, g in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.full(len(fp), i, np.int32)), pa.array(_part_value(fp, g))], names=["fp", "part", "value"])

    table = fps.select("fp").mapInArrow(index, "fp bigint, part int, value bigint")
    counted = with_group(table, ["part", "value"], salt("fp"), n=(F.lit(1), "sum"))
    chosen = stored(counted.groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m")).select("fp", *[F.col("m")[i].alias(f"n{i}") for i in range(parts)]), "simhash-counts")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().astype(np.int64)
            t = _choose(np.stack([b.column(i + 1).to_numpy().astype(float) for i in range(parts)], axis=1), widths, k)
            for i, g in enumerate(groups):
                for radius in range(k + 1):
                    mine = fp[t[:, i] == radius]
                    if len(mine):
                        value, masks = _part_value(mine, g), _masks(len(g), radius)
                        for at in range(0, len(masks), 64):
                            some = masks[at:at + 64]
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, len(some))), pa.array(np.full(len(mine) * len(some), i, np.int32)), pa.array((value[:, None] ^ some).ravel())], names=["fp", "part", "value"])

    probes = chosen.mapInArrow(probe, "fp bigint, part int, value bigint")
    rows = table.withColumn("kind", F.lit(0)).unionByName(probes.withColumn("kind", F.lit(1)))
    rows = with_group(rows, ["part", "value"], salt("fp"), n_index=(1 - F.col("kind"), "sum"), n_probe=(F.col("kind"), "sum"), low=(F.col("fp"), "min"), high=(F.col("fp"), "max"))
    rows = rows.where("n_index > 0 and n_probe > 0 and low < high")  # else a fingerprint meets nothing but itself
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("fp", F.lit(n)), cells(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
    dealt = rows.where("kind = 0").select("fp", "part", "value", "kind", mine("n_index").alias("x"), other("n_probe").alias("y")).unionByName(
        rows.where("kind = 1").select("fp", "part", "value", "kind", other("n_index").alias("x"), mine("n_probe").alias("y")))
    key = ["part", "value", "x", "y"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "kind")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def links(rows: list) -> pa.RecordBatch | None:
            kind, fp = np.concatenate([r[1] for r in rows]), np.concatenate([r[0] for r in rows])
            a, b = _spanning(fp[kind == 0], fp[kind == 1], k)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in key]
            fp, kind = batch.column("fp").to_numpy().astype(np.int64), batch.column("kind").to_numpy()
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if len(fp) else []
            edges = [0, *change, len(fp)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                this = tuple(int(c[s]) for c in cols)
                if this != held and rows:
                    if (out := links(rows)) is not None:
                        yield out
                    rows = []
                held = this
                rows.append((fp[s:e], kind[s:e]))
        if rows and (out := links(rows)) is not None:
            yield out

    return dealt.mapInArrow(verify, "a bigint, b bigint")


def _spanning(index: np.ndarray, probes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, representative) that connect what lies within k bits in one cell."""
    nodes = np.unique(np.concatenate([index, probes]))
    left, right = [], []
    for at in range(0, len(probes), 256):
        near = np.bitwise_count(probes[at:at + 256, None].view(np.uint64) ^ index[None, :].view(np.uint64)) <= k
        p, q = np.nonzero(near)
        a, b = np.searchsorted(nodes, probes[at + p]), np.searchsorted(nodes, index[q])
        left.append(a[a != b])
        right.append(b[a != b])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def best_parts(n: int, k: int) -> int:
    """How many groups of bits probe ``n`` fingerprints with the least work; every number finds the same links.

    A value of w bits meets n / 2^w rows.
    """

    def cost(m: int) -> float:
        widths = [-(-BITS // m)] * m
        t = _choose(np.full((1, m), n / 2.0 ** widths[0]), widths, k)[0]
        return sum(_ball(w, r) * (1 + n / 2.0**w / PER_PROBE) for w, r in zip(widths, t.tolist()) if r >= 0)

    return min(range(2, 2 * k + 4), key=cost)


def _resolved(docs: DataFrame, ident: str, text: str, width: int, k: int, parts: int | None) -> DataFrame:
    """(doc_id, th, fp, best): best is the first (id, text hash) of the row's component."""
    rows = stored(docs.select(F.col(ident).alias("doc_id"), F.xxhash64(whole_text(text)).alias("th"), simhash(whole_text(text), width).alias("fp")), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("least")
    fps = stored(rows.groupBy("fp").agg(first), "simhash-fps")
    links = near_links(fps, k, parts or best_parts(fps.count(), k)).distinct()
    label = connected_components(links).withColumnsRenamed({"id": "fp"})
    named = fps.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = with_group(named, ["component"], salt("fp"), best=(F.col("least"), "min")).select("fp", "best")
    return lookup(rows, stored(named, "simhash-named"), ["fp"], salt("doc_id", "th"))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 3, k: int = 2, parts: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    Words are runs without white space, A-Z in lower case, shingles ``width`` words with repeats; a shorter
    text is one shingle, a text without words (or null) has fingerprint 0 and is linked like any other.
    Fingerprints link at ``k`` or fewer differing bits; component_id is the smallest id that can be reached,
    the row's own included (null only if every id in the component is null). Repeated rows and ids each
    keep their row. Other columns are ignored; an empty table gives an empty table.
    """
    out = _resolved(docs, ident, text, width, k, parts)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def place_key(docs: DataFrame, ident: str) -> Callable[[Column, Column], list[Column]]:
    """From an id of ``docs`` and a text hash, the columns that name a document; they are never null."""
    kind = docs.schema[ident].dataType
    zero = F.lit("").cast(kind) if kind.simpleString() == "string" else F.lit(0).cast(kind)
    return lambda i, th: [i.isNull().alias("_no"), F.coalesce(i, zero).alias("_kid"), th.alias("_kth")]


def keep_first(docs: DataFrame, ident: str, text: str, best: DataFrame) -> DataFrame:
    """One row of ``docs`` for each document (doc_id, th) in ``best``."""
    key = ["_no", "_kid", "_kth"]  # the same for the join and the window: texts are shuffled once
    place = place_key(docs, ident)
    stay = best.select(*place(F.col("best.doc_id"), F.col("best.th"))).distinct()
    rows = docs.select("*", *place(F.col(ident), F.xxhash64(whole_text(text)))).join(stay, key, "left_semi")
    one = Window.partitionBy(*key).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in (ident, text)] or [F.lit(1)])
    return rows.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def representatives(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 3, k: int = 2, parts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, with the smallest id (null ids last, then by text hash)."""
    return keep_first(docs, ident, text, _resolved(docs, ident, text, width, k, parts).select("best"))
