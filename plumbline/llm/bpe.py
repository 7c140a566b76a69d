"""Byte-level BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its byte (none: a value above all ranks), an inner node
the smaller of its children. The root thus names the smallest rank, and walking down, left child first,
finds its leftmost place. A merge changes the ranks of two live neighbours and clears one leaf: three
point updates of logarithmic cost, so a match of n bytes takes O(n log n) however long it is.

Texts are cut by the pattern that belongs to the ranks and each match is encoded by itself. The new matches
of a batch of texts are merged in lockstep: one array of trees per size of tree, every round merges the root of
every tree that has a rank left. Matches repeat, so a task remembers the codes of two generations of bounded size.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.util import whole_text

REMEMBERED = 100_000  # matches of a generation whose codes a task keeps
REMEMBERED_CHARS = 64  # longer matches are rare and not kept
AT_ONCE = 1 << 19  # leaves of the trees merged in lockstep
CHARS_AT_ONCE = 2_000_000  # characters of the texts whose matches are encoded together
FEW = 16  # fewer trees of a size are merged one by one
NO_RANK = 1 << 30
_loaded: dict = {}


class Encoder:
    """Ranks and pattern of one vocabulary, with the codes of recent matches."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.bytes_of) + 1
        self.decimal = list(map(str, range(self.base)))
        # Every way to join two tokens to a third, as (left * base + right) in order.
        joins = [(self.ranks[t[:k]] * self.base + self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs, self.joined = np.array([*sorted(joins), (1 << 62, NO_RANK)], np.int64).T.copy()

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], NO_RANK)

    def merged_together(self, pieces: list[bytes], leaves: int) -> list[list[int]]:
        """Like ``merged`` for many matches of up to ``leaves`` bytes (a power of two), one round for a merge of each."""
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        text = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8)
        code = self.single[text]  # the token that starts at a byte; all arrays are flat, rows of ``leaves`` or twice as many
        place = np.tile(np.arange(leaves), m)
        alive = place < np.repeat(n, leaves)
        after, before = place + 1, place - 1
        tree = np.full((m, 2 * leaves), NO_RANK, np.int64)
        first = np.flatnonzero(place < np.repeat(n, leaves) - 1)
        tree[first // leaves, leaves + first % leaves] = self._joined(code[first], code[first + 1])
        for i in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        tree = tree.reshape(-1)
        rows = np.arange(m)
        while True:
            low = tree[rows * (2 * leaves) + 1]
            live = low < NO_RANK
            rows, low = rows[live], low[live]
            if not len(rows):
                break
            root, own = rows * (2 * leaves), rows * leaves
            i = np.ones(len(rows), np.int64)
            for _ in range(leaves.bit_length() - 1):
                i *= 2
                i += tree[root + i] != low
            i -= leaves
            gone = after[own + i]
            end = after[own + gone]
            code[own + i], after[own + i], alive[own + gone] = low, end, False
            inner = end < n[rows]
            before[own[inner] + end[inner]] = i[inner]
            at_right = np.full(len(rows), NO_RANK, np.int64)
            at_right[inner] = self._joined(low[inner], code[own[inner] + end[inner]])
            left = before[own + i]
            has = left >= 0
            at_left = self._joined(code[own[has] + left[has]], low[has])
            # Three points a row; their paths are walked level by level together.
            base = np.concatenate([root, root, root[has]])
            leaf = np.concatenate([gone, i, left[has]]) + leaves
            tree[base + leaf] = np.concatenate([np.full(len(rows), NO_RANK, np.int64), at_right, at_left])
            for _ in range(leaves.bit_length() - 1):
                leaf >>= 1
                tree[base + leaf] = np.minimum(tree[base + 2 * leaf], tree[base + 2 * leaf + 1])
        ids = code[alive].tolist()
        ends = np.cumsum(alive.reshape(m, leaves).sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merged(self, piece: bytes) -> list[int]:
        """Codes of one match: itself if it has a rank, else the result of merging smallest rank first, leftmost on ties."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        size = 1 << max(n - 2, 0).bit_length()
        tree = [NO_RANK] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i:i + 2], NO_RANK)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 2)), list(range(-1, n))  # live neighbours of each live start

        def put(i: int, rank: int) -> None:
            i += size
            tree[i] = rank
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        def pair(i: int) -> int:
            j = after[i]
            return ranks.get(piece[i:after[j]], NO_RANK) if j < n else NO_RANK

        while (low := tree[1]) < NO_RANK:
            i = 1
            while i < size:
                i = 2 * i if tree[2 * i] == low else 2 * i + 1
            i -= size
            gone = after[i]
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            if gone < n - 1:
                put(gone, NO_RANK)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def codes(self, matches: Iterable[str]) -> dict[str, list[int]]:
        """Codes of each distinct match."""
        found: dict[str, list[int]] = {}
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for m in matches:
            have = self.known.get(m) or self.before.get(m)
            if have:
                found[m] = have
                continue
            piece = m.encode("utf-8")
            rank = self.ranks.get(piece)
            if rank is None:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append((m, piece))
            else:
                found[m] = [rank]
        for leaves, group in classes.items():
            step = max(AT_ONCE // leaves, 1)
            for at in range(0, len(group), step):
                part = group[at:at + step]
                pieces = [p for _, p in part]
                merged = self.merged_together(pieces, leaves) if len(part) >= FEW else map(self.merged, pieces)
                found.update(zip([m for m, _ in part], merged))
        for m, have in found.items():
            if len(m) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known, self.before = {}, self.known
                self.known[m] = have
        return found

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[list[int], str]]:
        """For each whole text its codes, and the same as decimal numbers joined by commas."""
        cut = [self.matches(t) for t in texts]
        found = self.codes(set().union(*cut))
        for matches in cut:
            ids = list(chain.from_iterable(map(found.__getitem__, matches)))
            yield ids, ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(rank_file).digest(), pattern
    if key not in _loaded:
        _loaded[key] = Encoder(rank_file, pattern)
    return _loaded[key]


def tokenized(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """All columns of ``docs`` but the text, then n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    Every whole text is encoded and its codes are decoded again; null counts as empty (no codes, digests
    of nothing). Rows are independent: order, repeats and null identifiers change nothing. A clash with
    one of the new names replaces the old column. The rank file (under a megabyte) is read once by the
    driver from ``rank_path`` and travels with the tasks.
    """
    spark = docs.sparkSession
    with open(rank_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kept = [c for c in docs.columns if c not in {*new, text}]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], whole_text(F.col(f"`{text}`")).alias("_text"))
    fields = [f for f in source.schema if f.name != "_text"]
    types = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]
    out = T.StructType([*fields, *[T.StructField(n, t) for n, t in zip(new, types)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value, pattern)
        for batch in batches:
            carried, texts = batch.select(kept), batch.column("_text")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // CHARS_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):  # texts that are encoded together, and output batches, of bounded size
                n_tokens, written_as, decoded, arrays = [], [], [], []
                for ids, written in enc.encode(texts.slice(a, b - a).to_pylist()):
                    n_tokens.append(len(ids))
                    written_as.append(hashlib.sha256(written.encode()).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    if with_ids:
                        arrays.append(pa.array(ids, pa.int32()))
                cols = [pa.array(n_tokens, pa.int64()), pa.array(written_as, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    offsets = pa.array([0, *accumulate(n_tokens)], pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays([pa.array([], pa.int32()), *arrays])))
                yield pa.RecordBatch.from_arrays([*carried.slice(a, b - a).columns, *cols], names=[*kept, *new])

    return source.mapInArrow(run, out)
