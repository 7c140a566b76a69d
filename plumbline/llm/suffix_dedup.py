"""Substring dedup by a distributed difference-cover suffix sort of packed suffixes.

Every byte covered by a string of ``width`` bytes that also starts earlier (in a document before, or earlier in
the same one) is removed. A string of ``width`` bytes selects the least ``K``-byte hash inside (winnowing), so equal
strings select equal ones at the same place. Neighbouring starts that select the same place travel as one row, a
bundle: its class is that hash, its bytes are those of all its strings.

1. Classes that come once in the whole corpus are set aside; that test lets every repeat through. Of bundles with
   the same bytes in a batch of texts the earliest goes on, the strings of the others start earlier there.
2. One exchange brings the bundles of a class together. Of equal ones again the earliest stays; the suffixes of
   those that differ are sorted as in the difference-cover algorithm modulo 3:

   - triples of symbols at places 1 and 2 modulo 3 are sorted and named by their rank;
   - the names, class 1 before class 2, are a string of two thirds the length, which is sorted the same way;
   - suffixes at places 0 modulo 3 are keyed by (symbol, rank of the next suffix) against class 1 and by (two
     symbols, rank of the suffix after) against class 2; counts of smaller sampled suffixes merge them;
   - neighbours in suffix order are compared: those whose first ``width`` bytes agree form a run, and all
     suffixes of a run but the earliest mark their bytes.

A symbol is eight bytes: a text is read as eight strings, one for each place modulo 8, so their suffixes are all
suffixes of the text. Names of level l stand for 3^l symbols, and the recursion ends as soon as they cover
``width`` bytes; suffixes that agree in them share a rank, and no order beyond is needed.

A class with more than ``HOT`` different bundles (a short passage in many surroundings) would be one large task:
its bundles are cut into single strings, each a class of its own, so only equal strings meet, at most one a batch.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.util import bitmap, hash_filter, holds, stored, whole_text

WIDTH, K = 100, 24
SYMBOL = 8  # bytes of a symbol
PIECE = 1 << 20  # bytes of text that are looked at together
PLACE_BITS = 24  # low bits of a hash that give way to the place: those of two pieces and more
SORTED = 1 << 19  # bytes of bundles that are sorted together, or more to keep a class whole
HOT = 5_000  # different bundles of a class that are sorted together
ODD = 0x9E3779B97F4A7C15
_U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# ---------------------------------------------------------------- bundles
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        up, down = np.full(n, ODD, _U), np.full(n, pow(ODD, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS[0] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


class Strings:
    """Hashes of all parts of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, down = _powers(len(data) + 1)
        self.sums = np.append(_U(0), np.cumsum((data + _U(1)) * down[:len(data)], dtype=_U))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._spread((self.sums[end] - self.sums[start]) * self.up[start])

    def of_length(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return self._spread((self.sums[k:] - self.sums[:n]) * self.up[:n])

    @staticmethod
    def _spread(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(29))


def bundles(data: bytes, lengths: list[int], width: int, k: int) -> tuple[Strings, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text, start, n, h) of the bundles of texts joined to ``data``: their text's number, place in ``data``, number of strings, class."""
    none = np.zeros(0, np.int64)
    strings = Strings(np.frombuffer(data, np.uint8))
    if len(data) < width:
        return strings, none, none, none, none.astype(_U)
    h, span = strings.of_length(k), width - k + 1
    low, reach = (h >> _U(PLACE_BITS) << _U(PLACE_BITS)) | np.arange(len(h), dtype=_U), 1
    while 2 * reach <= span:  # least of windows by doubling; the first of equal ones
        low = np.minimum(low[:len(low) - reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    place = (low & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    sizes = np.array(lengths, np.int64)
    ends = np.cumsum(sizes)
    at = np.arange(len(place))
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(place)]
    inside = at + width <= ends[text]
    at, text, place = at[inside], text[inside], place[inside]
    if not len(at):
        return strings, none, none, none, none.astype(_U)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    return strings, text[first], at[first], np.diff(np.append(first, len(at))), h[place[first]]


def pieces(texts: list[bytes], width: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """(bytes, lengths, text numbers, first places) of texts, joined or cut to ``PIECE`` bytes; cuts overlap so that no string is lost or comes twice."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - width + 1, 0), PIECE):
            part = t[at:at + PIECE + width - 1]
            for values, v in zip(held, (part, i, at)):
                values.append(v)
            size += len(part)
            if size >= PIECE:
                yield b"".join(held[0]), list(map(len, held[0])), held[1], held[2]
                held, size = ([], [], []), 0
    if size:
        yield b"".join(held[0]), list(map(len, held[0])), held[1], held[2]


# ---------------------------------------------------------------- suffix order
def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks (from 1) of rows of whole numbers from 0."""
    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) <= 64:
        key = np.zeros(len(keys[0]), _U)
        for k, b in zip(keys, bits):
            key = (key << _U(b) if b < 64 else key) | k.astype(_U)
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order) - 1, bool)
        for k in keys:
            k = k[order]
            new |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(True, new))
    return out


def _smaller(rows: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key of ``rows`` its dense rank among all, the number of smaller ``others`` and whether one is equal."""
    n = len(rows[0])
    rank = _dense(*[np.concatenate(pair) for pair in zip(rows, others)])
    hits = np.bincount(rank[n:], minlength=int(rank.max()) + 1)
    return rank[:n], (np.cumsum(hits) - hits)[rank[:n]], hits[rank[:n]] > 0


def suffix_ranks(names: np.ndarray, cover: int, need: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names (from 1).

    Ranks follow the order of the suffixes at least as far as ``need`` of the original symbols, of which each name
    stands for ``cover``; suffixes that agree so far may share a rank.
    """
    n = len(names)
    if n < 3:
        return _dense(names, np.append(names, 0)[1:])
    s, r = np.append(names, [0, 0, 0]), np.zeros(n + 3, np.int64)
    zero, one, two = (np.arange(kind, n, 3) for kind in range(3))
    some = np.concatenate([one, two])
    inner = _dense(s[some], s[some + 1], s[some + 2])
    if 3 * cover < need:
        inner = suffix_ranks(inner, 3 * cover, need)
    r[some] = inner
    own, below_one, is_one = _smaller([s[zero], r[zero + 1]], [s[one], r[one + 1]])
    _, below_two, is_two = _smaller([s[zero], s[zero + 1], r[zero + 2]], [s[two], s[two + 1], r[two + 2]])
    hits = np.bincount(inner)
    # Between two sampled suffixes those of class 0 keep their own order; one that agrees with a sampled suffix joins it.
    equal = is_one | is_two
    whole = _dense(
        np.concatenate([below_one + below_two, (np.cumsum(hits) - hits)[inner]]),
        np.concatenate([equal, np.ones(len(some), bool)]).astype(np.int64),
        np.concatenate([np.where(equal, 0, own), np.zeros(len(some), np.int64)]))
    out = np.empty(n, np.int64)
    out[zero], out[some] = whole[:len(zero)], whole[len(zero):]
    return out


def repeated_places(data: bytes, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of the places ``starts`` (ascending) hold ``width`` bytes that are also at one of them before."""
    if not len(starts):
        return np.zeros(0, bool)
    n = len(data)
    padded = np.frombuffer(data + b"\0" * SYMBOL, np.uint8)
    symbol = np.zeros(n, _U)
    for b in range(SYMBOL):
        symbol = (symbol << _U(8)) | padded[b:b + n]
    by_residue = np.concatenate([np.arange(r, n, SYMBOL) for r in range(SYMBOL)])
    rank = np.empty(n, np.int64)
    rank[by_residue] = suffix_ranks(_dense(symbol)[by_residue], 1, -(-width // SYMBOL))
    order = starts[np.argsort(rank[starts], kind="stable")]
    same = np.ones(len(order) - 1, bool)
    here, before = order[1:], order[:-1]
    for at in [*range(0, width - SYMBOL, SYMBOL), width - SYMBOL] if width >= SYMBOL else ():
        left = np.flatnonzero(same)
        same[left] = symbol[here[left] + at] == symbol[before[left] + at]
    if width < SYMBOL:
        shift = _U(8 * (SYMBOL - width))
        same = symbol[here] >> shift == symbol[before] >> shift
    run = np.flatnonzero(np.append(True, ~same))
    first = np.repeat(np.minimum.reduceat(order, run), np.diff(np.append(run, len(order))))
    hit = np.zeros(n, bool)
    hit[order[order > first]] = True
    return hit[starts]


def _marks(rows: list[tuple[int, int, int, bytes]], width: int) -> Iterator[tuple[int, int, int]]:
    """(uid, start, end) of bytes to remove, of rows (key, uid, start, bundle) of whole classes, earliest first."""
    seen, left = set(), []
    for key, uid, start, data in rows:
        if data in seen:  # equal bytes hold equal strings
            yield uid, start, start + len(data)
        else:
            seen.add(data)
            left.append((key, uid, start, data))
    classes = Counter(r[0] for r in left)
    left = [r for r in left if classes[r[0]] > 1]
    if not left:
        return
    sizes = np.array([len(r[3]) for r in left])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(left)), sizes - width + 1)
    own = np.arange(len(owner)) - (np.cumsum(sizes - width + 1) - (sizes - width + 1))[owner]
    hit = np.flatnonzero(repeated_places(b"".join(r[3] for r in left), begin[owner] + own, width))
    owner, own = owner[hit], own[hit]
    if len(hit):
        new = np.append(True, (owner[1:] != owner[:-1]) | (own[1:] != own[:-1] + 1))
        last = np.append(new[1:], True)
        for i, a, b in zip(owner[new].tolist(), own[new].tolist(), own[last].tolist()):
            yield left[i][1], left[i][2] + a, left[i][2] + b + width


# ---------------------------------------------------------------- documents
def _early_first(doc_ids: list, uids: list) -> list[int]:
    """Order of documents by id, null ids last, then by number."""
    return sorted(range(len(uids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, uids[i]))


def substring_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per input row; ``kept`` is what is left, as bytes.

    Null counts as empty. Documents are ordered by id, null ids last; rows with the same id are documents of
    their own in an arbitrary order, so of repeated rows one keeps its text. Strings never cross documents and
    are judged on the input, overlaps count. Texts shorter than ``width`` bytes lose nothing. Other columns are
    ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "suffix-texts")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, lengths, _, _ in pieces(b.column(0).to_pylist(), width):
                strings, _, start, n, h = bundles(data, lengths, width, k)
                whole = strings.hashes(start, start + n + width - 1)
                order = np.lexsort((whole, h))
                h, whole = h[order], whole[order]
                other = np.append(True, h[1:] != h[:-1])[:len(h)]
                first = np.flatnonzero(other)
                if len(first):
                    kinds = np.add.reduceat((other | np.append(True, whole[1:] != whole[:-1])).astype(np.int64), first)
                    times = np.diff(np.append(first, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(kinds.astype(np.int32)), pa.array(times.astype(np.int32))], names=["h", "kinds", "times"])

    found = rows.select("text").mapInArrow(classes, "h bigint, kinds int, times int")
    found = found.groupBy("h").agg(F.sum("kinds").alias("kinds"), F.sum("times").alias("times")).where("times > 1")
    again = stored(found.select("h", (F.col("kinds") > HOT).alias("hot")), "suffix-classes")
    sent = bitmap(again, "h")
    hot_sent = bitmap(again.where("hot"), "h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, uids, texts = (b.column(c).to_pylist() for c in ("doc_id", "uid", "text"))
            order, seen = _early_first(ids, uids), set()
            for data, lengths, numbers, firsts in pieces([texts[i] for i in order], width):
                strings, owner, start, n, h = bundles(data, lengths, width, k)
                may = holds(*sent, h)
                owner, start, n, h = owner[may], start[may], n[may], h[may]
                hot = holds(*hot_sent, h)
                if hot.any():  # single strings of these, whole bundles of the others
                    one = np.repeat(np.flatnonzero(hot), n[hot])
                    at = start[one] + np.arange(len(one)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                    owner, start, h = (np.concatenate([v[~hot], w]) for v, w in ((owner, owner[one]), (start, at), (h, strings.hashes(at, at + width))))
                    n = np.concatenate([n[~hot], np.ones(len(one), np.int64)])
                    by = np.argsort(start, kind="stable")
                    owner, start, n, h = owner[by], start[by], n[by], h[by]
                begin = np.cumsum(lengths) - lengths
                cut = [data[a:e] for a, e in zip(start.tolist(), (start + n + width - 1).tolist())]
                new = [not (c in seen or seen.add(c)) for c in cut]
                of = [order[numbers[i]] for i in owner.tolist()]
                place = start - begin[owner] + np.array(firsts, np.int64)[owner]
                key = np.where(new, h.view(np.int64), np.array([uids[i] for i in of], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array([ids[i] for i in of], pa.int64()), pa.array([uids[i] for i in of], pa.int64()), pa.array(place.astype(np.int32)),
                     pa.array((place + n + width - 1).astype(np.int32)), pa.array([c if f else None for c, f in zip(cut, new)], pa.binary())],
                    names=["key", "doc_id", "uid", "start", "end", "data"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(held: list) -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
            return batch(list(_marks([(r[0], r[2], r[3], r[4]) for r in rows], width)))

        def batch(marks: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*marks) if marks else ((), (), ()), (pa.int64(), pa.int32(), pa.int32()))], names=["uid", "start", "end"])

        held, size = [], 0
        for b in batches:
            done = b.filter(b.column("data").is_null())
            if done.num_rows:
                yield done.select(["uid", "start", "end"])
            b = b.filter(b.column("data").is_valid())
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "uid", "start", "data"))):
                if size >= SORTED and row[0] != held[-1][0]:
                    yield marked(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield marked(held)

    packed = rows.mapInArrow(pack, "key bigint, doc_id bigint, uid bigint, start int, end int, data binary")
    marks = packed.repartition("key").sortWithinPartitions("key").mapInArrow(settle, "uid bigint, start int, end int")
    marks = stored(marks.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("marks")), "suffix-marks")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for b in batches:
            out = []
            for doc_id, data, marks in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("marks")):
                left, spans, end = [], 0, 0
                if marks.is_valid:
                    for s, e in zip(*(marks.values.field(c).to_pylist() for c in (0, 1))):
                        if s > end or not spans:
                            left.append(data[end:s])
                            spans += 1
                        end = max(end, e)
                kept = b"".join([*left, data[end:]]) if spans else data
                out.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    # Texts that lose nothing are not shuffled.
    number = F.xxhash64("uid")
    may = hash_filter(marks.select(number.alias("h")), "h")
    rows = rows.withColumn("hit", may(number))
    hit = rows.where("hit").join(marks, "uid", "left").select("doc_id", "text", "marks")
    free = rows.where("not hit").select("doc_id", "text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    return hit.unionByName(free).mapInArrow(strip, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


ORACLE = None
