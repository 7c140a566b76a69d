"""Row bootstraps with Poisson weights, drawn where they are used.

In a bootstrap of many rows every row's weight is Poisson(1) and independent of the others. The weight of a row in resample b
is a function of the row's key and b: md5 of the key gives the coefficients of a quadratic over a prime field, its
value at b is the row's uniform draw (three-wise independent over resamples, independent over rows), and
the Poisson quantile of that is the weight. So no weights are stored, joined or exploded: tasks draw them as matrices
of rows x resamples and return arrays of B partial sums, and any engine can draw the same ones.

Rank statistics need every row's rank in every resample. Rows are sorted once per score, by range, and a vector of B
running weights is carried over the ranges: range totals first, their prefix sums, then the ranks.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.core import settle, with_totals

PRIME = 2**31 - 1
#: A draw reaches the k-th bound where the distribution function of k - 1 ends: its weight is the number of bounds reached.
BOUNDS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
COEFFICIENTS = ("_h0", "_h1", "_h2")
SUMS = ("s0", "sy", "syy", "see", "sae")
_CELLS = 1 << 21  # weights drawn at once
_GROUPS = 256  # groups whose sums a task holds
_RANKS_PER_RANGE = 1 << 24  # ranks (rows x resamples) of a range, of four bytes each


def coefficients(seed: int, *parts: Column | str) -> list[Column]:
    """Three columns, the coefficients of a row's draws, from md5 of the seed and key columns."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    return [(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") % PRIME).alias(c) for i, c in enumerate(COEFFICIENTS)]


def weights(h: np.ndarray, b: int) -> np.ndarray:
    """(rows x b) Poisson(1) weights from (rows x 3) coefficients."""
    k = np.arange(b, dtype=np.int64)
    u = (h[:, 2:] + k * ((h[:, 1:2] + k * h[:, :1] % PRIME) % PRIME)) % PRIME
    return np.searchsorted(BOUNDS, u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def _groups(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """Distinct value tuples of the columns, and the number of each row's tuple."""
    seen: dict[tuple, int] = {}
    of = np.fromiter((seen.setdefault(t, len(seen)) for t in zip(*[c.to_pylist() for c in columns])), np.int64, len(columns[0]))
    return list(seen), of


def _spread(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Arrays of one value per resample, added up over all rows of the keys: (keys, b, one column per array)."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("b", "_z"))
    return rows.groupBy(*keys, F.col("b").cast("bigint").alias("b")).agg(*[F.sum(f"_z.{a}").alias(a) for a in arrays])


def poisson_scores(preds: DataFrame, keys: Sequence[str], b: int, seed: int, unit: str = "id") -> DataFrame:
    """(keys, model, b, r2, rmse, mae) on every one of ``b`` resamples of the rows ``unit`` within the keys.

    All models of the keys see the same resamples. Rows of a unit share its weight. r2 is null on a resample without variance,
    all three are null on one without rows.
    """
    centre = preds.groupBy(*keys).agg(F.avg("y").alias("_c"))
    yc, e = F.col("y") - F.col("_c"), F.col("y") - F.col("pred")
    by = [*keys, "model"]
    rows = with_totals(preds, centre, keys).select(
        *by, *coefficients(seed, *keys, unit), F.lit(1.0).alias("s0"), yc.alias("sy"), (yc * yc).alias("syy"), (e * e).alias("see"), F.abs(e).alias("sae"))
    arrays = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in by], *[T.StructField(s, T.ArrayType(T.DoubleType())) for s in SUMS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            cols = [pa.array([g[i] for g in held], batch.schema.field(k).type) for i, k in enumerate(by)]
            cols += [pa.array([list(v[i]) for v in held.values()], pa.list_(pa.float64())) for i in range(len(SUMS))]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*by, *SUMS])

        for batch in batches:
            groups, of = _groups([batch.column(k) for k in by])
            h = np.stack([batch.column(c).to_numpy() for c in COEFFICIENTS], axis=1)
            stats = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in SUMS])
            order = np.lexsort((h[:, 0], h[:, 1], h[:, 2]))  # rows of a unit together: its weights are drawn once
            step = max(_CELLS // b, 1)
            for lo in range(0, len(order), step):
                part = order[lo:lo + step]
                own, inverse = np.unique(h[part], axis=0, return_inverse=True)
                w = weights(own, b)
                for g in np.unique(of[part]):
                    mine = of[part] == g
                    add = stats[:, part[mine]] @ w[inverse.ravel()[mine]]
                    held[groups[g]] = held[groups[g]] + add if groups[g] in held else add
                if len(held) > _GROUPS:
                    yield flush()
        if held:
            yield flush()

    t = _spread(rows.mapInArrow(run, arrays), by, SUMS)
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.nullif(F.col("s0"), F.lit(0.0))
    n = F.nullif(F.col("s0"), F.lit(0.0))
    return t.select(*by, "b", F.when(sst > 1e-12, 1 - F.col("see") / sst).alias("r2"), F.sqrt(F.col("see") / n).alias("rmse"), (F.col("sae") / n).alias("mae"))


# ---------------------------------------------------------------- rank statistics
def _runs(h: np.ndarray, starts: np.ndarray, b: int, cells: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of ties in pieces of bounded size: (first row, last row, weights, run of each row from 0, weight of each run).

    ``starts``: first row of each run, with the end. A run longer than a piece comes in several, each with the weight of the whole.
    """
    step = max(cells // b, 1)
    i = 0
    while i < len(starts) - 1:
        j = max(int(np.searchsorted(starts, starts[i] + step, side="right")) - 1, i + 1)
        lo, hi = int(starts[i]), int(starts[j])
        if hi - lo <= step:
            w = weights(h[lo:hi], b)
            yield lo, hi, w, np.repeat(np.arange(j - i), np.diff(starts[i:j + 1])), np.add.reduceat(w, starts[i:j] - lo, axis=0)
        else:  # one long run
            whole = sum(weights(h[k:min(k + step, hi)], b).sum(axis=0) for k in range(lo, hi, step))[None, :]
            for k in range(lo, hi, step):
                end = min(k + step, hi)
                yield k, end, weights(h[k:end], b), np.zeros(end - k, np.int64), whole
        i = j


def _placed(rows: DataFrame, keys: Sequence[str], order: list[Column], value: str, ranges: int) -> DataFrame:
    """Rows sorted by range with the number of their range; rows with equal keys and value share one."""
    placed = rows.repartitionByRange(ranges, *[F.col(k) for k in keys], F.col(value)).sortWithinPartitions(*keys, *order)
    return settle(placed.withColumn("_part", F.spark_partition_id()))


def _matrix(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].to_numpy() for c in COEFFICIENTS], axis=1).reshape(-1, 3)


def _offsets(placed: DataFrame, keys: Sequence[str], b: int) -> DataFrame:
    """(_part, keys, before, n): per range and keys the weights of the ranges before, and of all, in every resample."""
    fields = T.StructType([T.StructField("_part", T.IntegerType()), *[T.StructField(k, placed.schema[k].dataType) for k in keys], T.StructField("w", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, of = _groups([batch.column(c) for c in ("_part", *keys)])
            h = np.stack([batch.column(c).to_numpy() for c in COEFFICIENTS], axis=1)
            total = np.zeros((len(groups), b))
            step = max(_CELLS // b, 1)
            for lo in range(0, len(h), step):
                np.add.at(total, of[lo:lo + step], weights(h[lo:lo + step], b))
            cols = [pa.array([g[i] for g in groups], batch.schema.field(c).type) for i, c in enumerate(("_part", *keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([list(x) for x in total], pa.list_(pa.float64()))], names=["_part", *keys, "w"])

    each = _spread(placed.select("_part", *keys, *COEFFICIENTS).mapInArrow(run, fields), ["_part", *keys], ["w"])
    whole = Window.partitionBy(*keys, "b")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.select("_part", *keys, "b", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("x"), F.sum("w").over(whole).alias("n"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("b", c))), lambda s: s[c])  # noqa: E731  one entry per resample
    return sums.groupBy("_part", *keys).agg(listed("x").alias("before"), listed("n").alias("n"))


def _tied(rows: pa.Table, offsets: pa.Table, keys: Sequence[str], value: str, b: int, cells: int):
    """For every group of keys in a range: (its first row, n, pieces). A piece holds consecutive rows as

    (first, last, weights, weight of all rows with a smaller value, of those with the same, of those of the same before the row).
    """
    groups, _ = _groups([offsets[k].combine_chunks() for k in keys] or [offsets["_part"].combine_chunks()])
    at = {g: i for i, g in enumerate(groups)}
    mine, own = _groups([rows[k].combine_chunks() for k in keys] or [rows["_part"].combine_chunks()])
    h, v = _matrix(rows), rows[value].to_numpy()
    edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    for lo, hi in zip(edges[:-1], edges[1:]):
        k = at[mine[own[lo]]]
        starts = np.flatnonzero(np.r_[True, v[lo + 1:hi] != v[lo:hi - 1], True])

        def pieces(below=np.array(offsets["before"][k].as_py()), lo=lo, hi=hi, starts=starts):
            carried = np.zeros(b)
            for a, z, w, tie, weight in _runs(h[lo:hi], starts, b, cells):
                upto = below + np.cumsum(weight, axis=0)
                first = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
                inside = np.cumsum(w, axis=0) - w
                inside += carried - inside[first][tie]
                yield lo + a, lo + z, w, (upto - weight)[tie], weight[tie], inside
                if starts[np.searchsorted(starts, z)] == z:  # else more of this run follows
                    below, carried = upto[-1], np.zeros(b)
                else:
                    carried = inside[-1] + w[-1]

        yield lo, np.array(offsets["n"][k].as_py()), pieces()


def bootstrap_rank(preds: DataFrame, keys: Sequence[str], b: int, seed: int, active: str, frac: float) -> DataFrame:
    """(keys, b, spearman, hit_rate, ef): rank statistics on every resample of the rows.

    Ranks and the top fraction are taken over weighted rows, ties have mid ranks, equal scores enter the top by id. Resamples without an active row
    have null hit rate and enrichment, resamples without variation a null correlation.
    """
    keys = list(keys)
    rows = preds.select(*keys, "id", F.col("y").cast("double").alias("y"), F.col("pred").cast("double").alias("pred"), F.col(active).cast("int").alias("act"), *coefficients(seed, *keys, "id"))
    ranges = max(-(-rows.count() * b // _RANKS_PER_RANGE), 1)
    first = _placed(rows, keys, [F.col("y"), F.col("id")], "y", ranges)
    fields = T.StructType([*rows.schema.fields, T.StructField("_rx", T.ArrayType(T.IntegerType()))])

    def rank_y(t: pa.Table, offsets: pa.Table) -> pa.Table:
        ranks = []
        for _, _, pieces in _tied(t, offsets, keys, "y", b, _CELLS):
            for _, _, _, below, tie, _ in pieces:
                twice = (2 * below + tie + 1).astype(np.int32)  # twice the mid rank is an integer
                ranks.append(pa.ListArray.from_arrays(pa.array(np.arange(len(twice) + 1) * b, pa.int32()), pa.array(twice.ravel())))
        return t.drop_columns(["_part"]).append_column("_rx", pa.chunked_array(ranks))

    ranked = first.groupBy("_part").cogroup(_offsets(first, keys, b).groupBy("_part")).applyInArrow(rank_y, fields)
    # By falling id within a tie, so that the rows above a row are all but those below it, those before it in its tie, and itself.
    second = _placed(ranked, keys, [F.col("pred"), F.col("id").desc()], "pred", ranges)
    names = ["n", "sxx", "syy", "sxy", "hits", "n_act"]
    out = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]])

    def add_up(t: pa.Table, offsets: pa.Table) -> pa.Table:
        act, rx = t["act"].to_numpy().astype(float), t["_rx"].combine_chunks()
        found = []
        for lo, n, pieces in _tied(t, offsets, keys, "pred", b, _CELLS):
            top, middle = np.maximum(1.0, np.rint(n * frac)), (n + 1) / 2
            sums = np.zeros((5, b))
            for a, z, w, below, tie, inside in pieces:
                x = rx.slice(a, z - a).flatten().to_numpy().reshape(z - a, b) / 2 - middle
                y = below + (tie + 1) / 2 - middle
                taken = np.clip(top - (n - below - inside - w), 0, w)
                g = act[a:z, None]
                sums += np.stack([(w * x * x).sum(0), (w * y * y).sum(0), (w * x * y).sum(0), (taken * g).sum(0), (w * g).sum(0)])
            found.append(([t[c][lo].as_py() for c in keys], [n, *sums]))
        cols = [pa.array([f[0][i] for f in found], t.schema.field(c).type) for i, c in enumerate(keys)]
        return pa.table([*cols, *[pa.array([list(f[1][i]) for f in found], pa.list_(pa.float64())) for i in range(6)]], names=[*keys, *names])

    parts = second.groupBy("_part").cogroup(_offsets(second, keys, b).groupBy("_part")).applyInArrow(add_up, out)
    sums = parts.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("b", "_z"))
    # n is the same in every range: that of the whole table
    t = sums.groupBy(*keys, F.col("b").cast("bigint").alias("b")).agg(F.max("_z.n").alias("n"), *[F.sum(f"_z.{c}").alias(c) for c in names[1:]])
    rate = F.col("hits") / F.greatest(F.lit(1.0), F.rint(F.col("n") * frac))
    some = F.col("n_act") > 0
    spread = F.sqrt(F.col("sxx") * F.col("syy"))
    return t.select(
        *keys, "b", F.when(spread > 0, F.col("sxy") / spread).alias("spearman"),
        F.when(some, 100 * rate).alias("hit_rate"), F.when(some, rate / (F.col("n_act") / F.col("n"))).alias("ef"))
