"""All pairs of sets, tile against tile, without sending a set to every tile that it meets.

1. A sample names the common elements. A set travels packed, two bytes for a common element and eight for another, once:
   when equal sets are brought together. The sample decides the size of the rows only, every element is kept.
2. The sets of a task are cut into tiles of bounded size, one row and one file each, in the shared scratch folder.
3. Tiles meet in a product of the table of tiles with itself or another. Its tasks read both sides from the scratch folder, so
   the pairs are quadratic, but what is shuffled and stored grows with the sets.
4. In a task, the overlaps of two tiles are a matrix product over the ``DENSE`` most common elements, the others are added
   from posting lists. Each pair of a table with itself is computed once and serves both sets; only the best of a task, or
   sums per label, leave it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import scratch_path

SAMPLE, COMMON_FROM, COMMON = 32, 4, 1 << 16  # common elements: met so often in one of SAMPLE sets, and so many of them at most
DENSE = 1024
SKETCH = 64  # words of a parity bitmap
SETS_PER_TILE = 1 << 14  # so that a tile's matrix has at most 64 MB
PAIRS_AT_ONCE = 1 << 20
ELEMENTS_PER_TASK = 16_000_000  # of either side
TASKS_PER_CORE = 4
TILES_HELD = 8  # of either side, unpacked without a matrix
NO_ID = np.iinfo(np.int64).max  # stands for a null id, last among equal similarities
_BELOW = np.float32(1 - 2e-6)  # similarities are sifted in single precision
TILE = "tile bigint, rid array<bigint>, sig array<string>, n array<int>, weights array<array<bigint>>, n_codes array<int>, n_others array<int>, codes binary, others binary"


def common_elements(*sets: DataFrame) -> np.ndarray:
    """Elements that many sampled sets hold, most frequent first."""
    some = None
    for s in sets:
        part = s.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select(F.explode("els").alias("el"))
        some = part if some is None else some.unionByName(part)
    top = some.groupBy("el").agg(F.count("*").alias("n")).where((F.col("n") >= COMMON_FROM) & F.col("el").isNotNull()).orderBy(F.desc("n"), "el").limit(COMMON)
    return top.select("el").toArrow()["el"].to_numpy().astype(np.int64)


def _ends(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def packed(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(id, sig, n, n_codes, data): the sets (id, sig, els), common elements as two-byte numbers before the others."""
    by_value = np.argsort(common)
    sent = sets.sparkSession.sparkContext.broadcast((common[by_value], by_value.astype(np.uint16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, number = sent.value
        for batch in batches:
            lists = batch.column("els")
            ends = _ends(lists)
            els = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.int64)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(values, els), max(len(values) - 1, 0))
            known = values[at] == els if len(values) else np.zeros(len(els), bool)
            codes, others = number[at[known]] if len(values) else np.zeros(0, np.uint16), els[~known]
            here = np.concatenate(([0], np.cumsum(known)))[ends]
            codes, others = codes.tobytes(), others.tobytes()
            data = [codes[2 * a:2 * b] + others[8 * (s - a):8 * (t - b)] for a, b, s, t in zip(here[:-1].tolist(), here[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("sig"), pa.array(np.diff(ends).astype(np.int32)), pa.array(np.diff(here).astype(np.int32)), pa.array(data, pa.binary())],
                names=["id", "sig", "n", "n_codes", "data"])

    rows = sets.select(F.col("id").cast("bigint").alias("id"), "sig", "els")
    return rows.mapInArrow(run, "id bigint, sig string, n int, n_codes int, data binary")


def tiles(sets: DataFrame, common: np.ndarray, limit: int, weights: DataFrame | None = None) -> DataFrame:
    """One row per tile (``TILE``) of distinct sets with ``limit`` elements at most (or one larger set), from (id, sig, els), stored.

    Equal sets are one, named by their smallest id. ``weights`` (sig, weights) goes with the sets; those without are left out.
    """
    reps = packed(sets, common).groupBy("sig").agg(
        F.min("id").alias("rid"), F.first("n").alias("n"), F.first("n_codes").alias("n_codes"), F.first("data").alias("data"))
    reps = reps.withColumn("weights", F.lit(None).cast("array<bigint>")) if weights is None else reps.join(weights, "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            get = lambda c: rows[c].to_numpy()
            data, n, n_codes = rows["data"].to_pylist(), get("n"), get("n_codes")
            one = lambda v, t: pa.array([v], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), one(rows["rid"].to_pylist(), pa.int64()), one(rows["sig"].to_pylist(), pa.string()), one(n, pa.int32()), one(rows["weights"].to_pylist(), pa.list_(pa.int64())),
                 one(n_codes, pa.int32()), one(n - n_codes, pa.int32()),
                 pa.array([b"".join(d[:2 * c] for d, c in zip(data, n_codes.tolist()))], pa.binary()), pa.array([b"".join(d[2 * c:] for d, c in zip(data, n_codes.tolist()))], pa.binary())],
                names=[f.split()[0] for f in TILE.split(", ")])

        for batch in batches:
            ends, lo = np.cumsum(batch.column("n").to_numpy().astype(np.int64)), 0
            while lo < batch.num_rows:  # a set larger than the limit is a tile of its own
                before = ends[lo - 1] if lo else 0
                hi = max(int(np.searchsorted(ends, before + limit - size, side="right")), lo + (not held))
                hi = min(hi, lo + SETS_PER_TILE - sum(b.num_rows for b in held))
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    size, lo = size + int(ends[hi - 1] - before), hi
                if lo < batch.num_rows:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    cut = reps.where("n > 0").select("rid", "sig", "n", "weights", "n_codes", "data").mapInArrow(run, TILE)
    path = scratch_path(sets.sparkSession, "set-tiles")
    cut.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    return sets.sparkSession.read.schema(cut.schema).parquet(path)


def distinct_sets(table: DataFrame) -> DataFrame:
    """(rid, sig, n): the sets of a table of tiles, without their elements."""
    return table.select(F.inline(F.arrays_zip("rid", "sig", "n")))


def tile_limit(sets: DataFrame, most: int) -> int:
    """Elements per tile: ``most``, or fewer where there would not be enough tiles to use every core."""
    total = sets.agg(F.sum(F.size("els").cast("bigint"))).first()[0] or 0
    wanted = (2 * TASKS_PER_CORE * sets.sparkSession.sparkContext.defaultParallelism) ** 0.5
    return max(1, min(most, max(-(-total // int(wanted)), most // 20)))


# ---------------------------------------------------------------- two tiles
class Tile:
    """The sets of a tile, unpacked."""

    def __init__(self, row: dict, matrix: bool = True):
        self.ids = row["rid"].fill_null(NO_ID).to_numpy().astype(np.int64)
        self.size = row["n"].to_numpy().astype(np.float64)
        self.weights = row["weights"]
        n_codes, n_others = row["n_codes"].to_numpy().astype(np.int64), row["n_others"].to_numpy().astype(np.int64)
        codes, others = np.frombuffer(row["codes"], np.uint16), np.frombuffer(row["others"], np.int64)
        of, who = np.arange(len(self.ids)), np.repeat(np.arange(len(self.ids)), n_codes)
        self._whole = codes, who, others, n_codes, n_others
        top = codes < DENSE
        if matrix:
            self.dense = np.zeros((len(self.ids), DENSE), np.float32)
            self.dense[who[top], codes[top]] = 1
        self.codes, self.code_of = codes[~top].astype(np.int64), who[~top]
        self.others, self.other_of = others, np.repeat(of, n_others)
        self.code_ends = np.append(0, np.cumsum(np.bincount(self.code_of, minlength=len(of))))
        self.other_ends = np.append(0, np.cumsum(n_others))
        self._lists = None

    def elements(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of all sets one after the other, and their numbers."""
        codes, who, others, n_codes, n_others = self._whole
        n = n_codes + n_others
        begin, out = np.cumsum(n) - n, np.empty(n.sum(), np.int64)
        out[np.arange(len(codes)) + (begin - np.cumsum(n_codes) + n_codes)[who]] = common[codes]
        out[np.arange(len(others)) + (begin + n_codes - np.cumsum(n_others) + n_others)[self.other_of]] = others
        return out, n

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posting lists of what is not in the matrix: starts by code, other elements, their starts, and the sets."""
        if self._lists is None:
            by_code, by_other = np.argsort(self.codes, kind="stable"), np.argsort(self.others, kind="stable")
            starts = np.append(0, np.cumsum(np.bincount(self.codes, minlength=COMMON)))
            uniq, first = np.unique(self.others[by_other], return_index=True)
            owner = np.concatenate([self.code_of[by_code], self.other_of[by_other]])
            self._lists = starts, uniq, np.append(first, len(self.others)) + len(self.codes), owner
        return self._lists


def overlaps(left: Tile, right: Tile) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices (first, last, common elements) of the sets of ``left`` with all of ``right``."""
    starts, uniq, first, owner = right.lists()
    width = len(right.ids)
    step = max(1, PAIRS_AT_ONCE // width)
    for a in range(0, len(left.ids), step):
        b = min(a + step, len(left.ids))
        out = left.dense[a:b] @ right.dense.T
        flat = out.reshape(-1)
        c, o = slice(left.code_ends[a], left.code_ends[b]), slice(left.other_ends[a], left.other_ends[b])
        codes, els = left.codes[c], left.others[o]
        at = np.searchsorted(uniq, els)
        at[at == len(uniq)] = 0
        hit = uniq[at] == els if len(uniq) else np.zeros(len(els), bool)
        at = at[hit]
        begin = np.concatenate([starts[codes], first[at]])
        lens = np.concatenate([starts[codes + 1], first[at + 1]]) - begin
        who = (np.concatenate([left.code_of[c], left.other_of[o][hit]]) - a) * width
        # posting lists in batches, so that what they expand to stays in memory bounds
        edges = np.unique(np.append(np.searchsorted(np.cumsum(lens), np.arange(0, lens.sum() + 1, PAIRS_AT_ONCE)), len(lens)))
        lo = 0
        for hi in edges.tolist():
            if hi > lo:
                n = lens[lo:hi]
                ahead = np.cumsum(n)
                place = np.repeat(begin[lo:hi] - ahead + n, n) + np.arange(ahead[-1])
                np.add.at(flat, np.repeat(who[lo:hi], n) + owner[place], np.float32(1))
            lo = hi
        yield a, b, out


def _kth(sim: np.ndarray, k: int, axis: int) -> np.ndarray:
    """At most the k-th greatest value along the axis; 0 if that is not known."""
    if k == 1:
        return sim.max(axis=axis)
    length = sim.shape[axis]
    cuts = np.arange(0, length, max(1, min(64, length // (4 * k))))
    if len(cuts) < k:
        return np.zeros(sim.shape[1 - axis], np.float32)
    return np.partition(np.maximum.reduceat(sim, cuts, axis=axis), len(cuts) - k, axis=axis).take(len(cuts) - k, axis=axis)


class _Best:
    """The k most similar sets of every set of a tile so far, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts = k, np.full(n, np.float32(1e-30)), []

    def add(self, of: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        if len(of):
            self.parts.append((of, ids, sim))

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        of, ids, sim = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -sim, of))
        of, ids, sim = of[order], ids[order], sim[order]
        best = np.arange(len(of)) - np.searchsorted(of, of) < self.k
        self.parts = [(of[best], ids[best], sim[best])]
        of, ids, sim = self.parts[0]
        last = np.arange(len(of)) - np.searchsorted(of, of) == self.k - 1
        self.least[of[last]] = np.maximum(self.least[of[last]], sim[last].astype(np.float32))
        return self.parts[0]


def _compare(left: Tile, right: Tile, mine: _Best, theirs: _Best | None, skip_same: bool) -> None:
    """Bring the best of ``left``, and of ``right`` if asked for, up to date."""
    n, m = left.size.astype(np.float32)[:, None], right.size.astype(np.float32)[None, :]
    shared = skip_same and (left is right or bool(np.isin(left.ids, right.ids).any()))
    for a, b, both in overlaps(left, right):
        sim = both / (n[a:b] + m - both)
        if shared:
            sim[left.ids[a:b, None] == right.ids[None, :]] = -1
        sides = [(mine, np.maximum(mine.least[a:b], _kth(sim, mine.k, 1))[:, None], False)]
        if theirs is not None:
            sides.append((theirs, np.maximum(theirs.least, _kth(sim, theirs.k, 0))[None, :], True))
        for best, least, turned in sides:
            i, j = np.divmod(np.flatnonzero(sim >= np.maximum(least * _BELOW, np.float32(1e-30))), sim.shape[1])
            common = np.rint(both[i, j].astype(np.float64))
            exact = common / (left.size[a + i] + right.size[j] - common)
            if turned:
                best.add(j, left.ids[a + i], exact)
            else:
                best.add(a + i, right.ids[j], exact)
            if len(best.parts) > 64:
                best.settle()
    mine.settle()
    if theirs is not None:
        theirs.settle()


# ---------------------------------------------------------------- tables of tiles
def _product(left: DataFrame, right: DataFrame | None, run: Callable, schema: str) -> DataFrame:
    """``run`` over the pairs of tiles as (tile, …, tile_r, …); of a table with itself (``right`` none) every pair once."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    size = lambda t: t.select(F.count("*").alias("c"), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("s")).first()
    a = size(left)
    b = a if right is None else size(right)
    # as many groups of tiles as use every core, or as keep the elements of a task in bounds
    wanted = TASKS_PER_CORE * cores * (2 if right is None else 1)
    groups = [max(1, -(-(x.s or 0) // ELEMENTS_PER_TASK), min(x.c, round(wanted**0.5))) for x in (a, b)]
    if right is not None:
        for i, x, j in ((0, a, 1), (1, b, 0)):
            groups[i] = max(groups[i], min(x.c, -(-wanted // max(groups[j], 1))))
    names = [f.split()[0] for f in TILE.split(", ") if f.split()[0] != "sig"]
    l = left.select(*names).coalesce(groups[0])
    r = (left if right is None else right).select(*[F.col(c).alias(f"{c}_r") for c in names]).coalesce(groups[1])
    pairs = l.hint("shuffle_replicate_nl").crossJoin(r.hint("shuffle_replicate_nl"))
    if right is None:
        # every other pair of tiles is taken from either side, so that no task gets all of its pairs or none
        odd = F.xxhash64("tile").bitwiseXOR(F.xxhash64("tile_r")).bitwiseAND(1) == 1
        pairs = pairs.where((F.col("tile") == F.col("tile_r")) | ((F.col("tile") < F.col("tile_r")) == odd))
    return pairs.mapInArrow(run, schema)


def _pairs(batches: Iterator[pa.RecordBatch], alone: bool, matrix: bool = True) -> Iterator[tuple[int, Tile, int, Tile]]:
    """The pairs of tiles of a task, of one table if ``alone``; a tile is unpacked again only after others (``TILES_HELD`` without a matrix)."""
    held: dict[str, dict[int, Tile]] = {"": {}, "_r": {}}
    for batch in batches:
        for i in range(batch.num_rows):
            found = []
            for side in ("", "_r"):
                number = batch.column(f"tile{side}")[i].as_py()
                if number not in held[side]:
                    get = lambda c: batch.column(f"{c}{side}")[i]  # noqa: E731,B023
                    row = {c: get(c).values for c in ("rid", "n", "weights", "n_codes", "n_others")} | {c: get(c).as_py() for c in ("codes", "others")}
                    if len(held[side]) >= (1 if matrix else TILES_HELD):
                        held[side].pop(next(iter(held[side])))
                    held[side][number] = Tile(row, matrix)
                found += [number, held[side][number]]
            if alone and found[0] == found[2]:
                found[3] = found[1]
            yield tuple(found)


def nearest_in_tiles(left: DataFrame, right: DataFrame | None, k: int) -> DataFrame:
    """(q, r, sim): a superset of the k most similar sets of ``right`` for each set of ``left``, ties by id; only sets with a common element.

    ``right`` none: the others of the same table, by id.
    """
    alone = right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, _Best]] = {}
        of = lambda number, tile: best.setdefault(number, (tile.ids, _Best(len(tile.ids), k)))[1]
        for a, x, b, y in _pairs(batches, alone):
            _compare(x, y, of(a, x), of(b, y) if alone and a != b else None, alone)
        for ids, found in best.values():
            who, r, sim = found.settle()
            who = ids[who]
            keep = who != NO_ID
            yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(r[keep], mask=r[keep] == NO_ID), pa.array(sim[keep])], names=["q", "r", "sim"])

    return _product(left, right, run, "q bigint, r bigint, sim double")


def sketch(els: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parity bitmaps of ``SKETCH`` words: two sets differ in no more places than in elements."""
    mixed = els.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros((len(n), 8 * SKETCH), np.uint8)
    place, of = (mixed >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), np.repeat(np.arange(len(n)), n)
    for lo in range(0, len(n), 256):  # a table of counts for some sets at a time
        hi = min(lo + 256, len(n))
        s, t = np.searchsorted(of, [lo, hi])
        counts = np.bincount((of[s:t] - lo) * 64 * SKETCH + place[s:t], minlength=(hi - lo) * 64 * SKETCH)
        out[lo:hi] = np.packbits((counts & 1).astype(np.uint8).reshape(hi - lo, -1), axis=1)
    return out.view(np.uint64)


def _verified(x: Tile, y: Tile, i: np.ndarray, j: np.ndarray, min_sim: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of those pairs that are similar enough; whole sets are compared where the sketches allow it."""
    for tile in (x, y):
        if not hasattr(tile, "whole"):
            els, n = tile.elements(common)
            tile.whole, tile.bits = np.split(els, np.cumsum(n)[:-1]), sketch(els, n)
    stay = []
    for at in range(0, len(i), 10_000):
        p, q = i[at:at + 10_000], j[at:at + 10_000]
        total = x.size[p] + y.size[q]
        most = (total - np.bitwise_count(x.bits[p] ^ y.bits[q]).sum(axis=1, dtype=np.int64)) / 2
        most = np.minimum(most, np.minimum(x.size[p], y.size[q]))
        stay.append(at + np.flatnonzero(most >= min_sim * (total - most) - 1e-9))
    stay = np.concatenate(stay) if stay else np.zeros(0, np.int64)
    i, j = i[stay], j[stay]
    both = np.array([len(np.intersect1d(x.whole[a], y.whole[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.float64)
    sim = both / (x.size[i] + y.size[j] - both)
    keep = sim >= min_sim - 1e-9
    return i[keep], j[keep], sim[keep]


def _above(x: Tile, y: Tile, min_sim: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of all pairs that are similar enough."""
    n, m = x.size.astype(np.float32)[:, None], y.size.astype(np.float32)[None, :]
    for s, t, both in overlaps(x, y):
        i, j = np.divmod(np.flatnonzero(both >= np.float32(min_sim) * _BELOW * (n[s:t] + m - both)), both.shape[1])
        common = np.rint(both[i, j].astype(np.float64))
        sim = common / (x.size[s + i] + y.size[j] - common)
        keep = sim >= min_sim - 1e-9
        yield s + i[keep], j[keep], sim[keep]


def pairs_above(left: DataFrame, right: DataFrame | None, min_sim: float, likely: Callable | None = None, common: np.ndarray | None = None) -> DataFrame:
    """(q, r, sim): all pairs of sets with similarity ``min_sim`` (not 0) or more; unordered, q < r, if ``right`` is none.

    ``likely`` takes two tiles and yields the pairs (i, j) of their sets that may be found at all; it needs the ``common`` elements.
    """
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must lie in (0, 1]")
    alone = right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, x, b, y in _pairs(batches, alone, likely is None):
            if min(x.size.max(), y.size.max()) < min_sim * max(x.size.min(), y.size.min()) - 1e-9:
                continue
            for i, j, sim in _above(x, y, min_sim) if likely is None else (_verified(x, y, i, j, min_sim, common) for i, j in likely(x, y)):
                q, r = x.ids[i], y.ids[j]
                keep = (q != NO_ID) & (r != NO_ID)
                if alone:
                    keep &= (q != r) & ((a != b) | (i < j))
                    q, r = np.minimum(q, r), np.maximum(q, r)
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(r[keep]), pa.array(sim[keep])], names=["q", "r", "sim"])

    return _product(left, right, run, "q bigint, r bigint, sim double")


def label_sums(table: DataFrame, labels: int) -> DataFrame:
    """(q, sums): total similarity of every set to all sets, itself included, by each of so many weights of theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def of(number: int, tile: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if number not in sums:
                weights = tile.weights.flatten().to_numpy().astype(np.float64).reshape(len(tile.ids), labels)
                sums[number] = tile.ids, weights, np.zeros((len(tile.ids), labels))
            return sums[number]

        for a, x, b, y in _pairs(batches, True):
            (_, wx, sx), (_, wy, sy) = of(a, x), of(b, y)
            for s, t, both in overlaps(x, y):
                both = both.astype(np.float64)
                sim = both / (x.size[s:t, None] + y.size[None, :] - both)
                sx[s:t] += sim @ wy
                if a != b:
                    sy += sim.T @ wx[s:t]
        for ids, _, total in sums.values():
            keep = ids != NO_ID
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(total[keep].tolist(), pa.list_(pa.float64()))], names=["q", "sums"])

    return _product(table, None, run, "q bigint, sums array<double>")
