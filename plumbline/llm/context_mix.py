"""Language-model scoring by online logistic context mixing over bits.

The model reads a text as bytes (A-Z in lower case) with one end byte, each byte as eight bits from the top.
Predictors look up the hash of a context and of the bits so far in a table of fixed size and give the log-odds
of the next bit from the counts they find; contexts are the last 2 to 4 bytes and the word so far. A weight
set, gated by the longest context that is known, by how often it was seen and by the bit's place, adds them
up. Weights are learned online, one mini-batch of text after the other, each event seen without its own
count; the mixed probability is then refined by an adaptive table over (bits so far, quantised log-odds).
The sum over bits is the text's probability; a text of n bytes costs so many bits per byte.

Distribution: bit counts come from all training texts and are added up over tasks, table chunk by chunk. The
weights (some thousand numbers) are fitted on all training texts, online in every task over mini-batches that
grow, and averaged by the bits each task has seen. The tables have a fixed size
(``TABLE_BITS``) however large the corpus, so they can be broadcast. What a byte costs depends on the word so
far and the last five bytes only, so a task sorts the contexts of a few megabytes and computes each once.

The unigram base counts words of the training texts per block of documents, adds the counts up by word and
sends each block the counts of its own words back, so no task holds the corpus vocabulary.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.util import stored, whole_text

TABLE_BITS = (18, 19, 20, 21)  # slots of the tables for 2..4 bytes and for the word so far
TABLES = len(TABLE_BITS)
SIZES = tuple(1 << b for b in TABLE_BITS)
STARTS = tuple(np.cumsum([0, *SIZES]).tolist())
GATED = (1, 3, 2)  # tables whose known contexts decide the gate; the last one wins
LEVELS = 4  # a gate tells contexts seen once, twice, four and eight times or more apart
GATES = (1 + len(GATED) * LEVELS) * 8
BACK = 4  # bytes of left context
LEFT = 256  # bytes of a cut text that its next part sees
PIECE = 5 << 19  # bytes whose contexts are sorted together
NEAR = 1 << 16  # bytes whose contexts are made together: the arrays stay in the cache
BATCH, LAST_BATCH = 1 << 16, 1 << 20  # bytes of the first and of the last online mini-batches
DELTA, RATE, CALM, LIMIT = 0.4, 0.2, 20.0, 8.0
APM_STEPS, APM_RATE = 33, 0.02
BLOCK_BYTES = 40_000_000  # text of a block of documents
CHUNK = 1 << 16  # numbers of a table that travel as one row
ODD = 0x9E3779B97F4A7C15
_U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# ---------------------------------------------------------------- contexts and their bits
def parts_of(texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """(text number, left context, bytes to predict) with the end byte; long texts in several parts."""
    for i, t in enumerate(texts):
        t += b"\xff"  # a byte that UTF-8 never holds
        for at in range(0, len(t), PIECE):
            yield i, t[max(0, at - LEFT):at], t[at:at + PIECE]


def grouped_parts(texts: list[bytes], limit: int = PIECE) -> Iterator[list[tuple[int, bytes, bytes]]]:
    held, size = [], 0
    for p in parts_of(texts):
        held.append(p)
        size += len(p[2])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        up, down = np.full(n, ODD, _U), np.full(n, pow(ODD, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS[0] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def contexts(parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte to predict: the last five bytes as a number, the hash of its word so far, its text's number."""
    groups, size = [[]], 0
    for p in parts:
        if size >= NEAR:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += len(p[2])
    got = [_contexts(g) for g in groups]
    return got[0] if len(got) == 1 else tuple(map(np.concatenate, zip(*got)))


def _contexts(parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pieces = [b"\0" * BACK + left + body for _, left, body in parts]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    wide = data.astype(_U)
    grams = wide.copy()
    for back in range(1, BACK + 1):
        grams[back:] |= wide[:n - back] << _U(8 * back)
    space = ((data >= 9) & (data <= 13)) | (data == 32) | (data == 0)
    at = np.arange(n, dtype=np.int32)
    start = np.maximum.accumulate(np.where(space, at + 1, np.int32(0)))
    start = np.append(np.int32(0), start[:-1])  # where the word of the byte before began
    up, down = _powers(n + 1)
    sums = np.append(_U(0), np.cumsum((wide + _U(1)) * down[:n], dtype=_U))
    words = (sums[:n] - sums[start]) * up[:n]
    lengths = np.fromiter((len(body) for _, _, body in parts), np.int64, len(parts))
    whole = np.fromiter(map(len, pieces), np.int64, len(parts))
    begin = np.cumsum(whole) - lengths
    here = np.repeat((begin - (np.cumsum(lengths) - lengths)).astype(np.int32), lengths) + np.arange(lengths.sum(), dtype=np.int32)
    owner = np.repeat(np.fromiter((i for i, _, _ in parts), np.int32, len(parts)), lengths)
    return grams[here], words[here], owner


def distinct(grams: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, times): an order that brings equal contexts together, where each begins, how often it comes.

    What comes before a byte leads the order, the last two bytes first, so bytes after the same context are neighbours.
    Places are sorted as the low bits of the keys, which is faster than an argsort; contexts that agree in all other
    bits may begin more than once, each time with their own number.
    """
    rest = (grams >> _U(24)) * _U(0xC2B2AE3D27D4EB4F) ^ words * _U(0xD6E8FEB86659FD93)
    rest = (rest ^ (rest >> _U(32))) * _U(ODD)
    low = len(grams).bit_length()
    lead = (grams & _U(0xFF00)) << _U(48) | (grams & _U(0xFF0000)) << _U(32) | (rest >> _U(24 + low)) << _U(8 + low)
    order = np.sort(lead | (grams & _U(0xFF)) << _U(low) | np.arange(len(grams), dtype=_U)) & _U((1 << low) - 1)
    order = order.astype(np.int64)
    g, w = grams[order], words[order]
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))) if len(g) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(g)))


def shared_bits(grams: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """For each bit where a run of neighbours begins that agree in all before it and in the bit itself."""
    if not len(grams):
        return
    last = np.zeros(len(grams), np.uint8)  # the number of bits in which a byte agrees with its neighbour's, 8 and more for all
    differ = (grams[1:] ^ grams[:-1])
    other = (differ > _U(0xFF)) | (words[1:] != words[:-1])
    last[1:] = np.where(other, 0, 8 - np.frexp((differ & _U(0xFF)).astype(np.float32))[1])
    for bit in range(8):
        yield np.flatnonzero(last <= bit)


def _hashes(grams: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """32 bits of each context, one array per table."""
    out = []
    for table in range(TABLES):
        context = words if table == TABLES - 1 else (grams >> _U(8)) & _U((1 << (8 * (table + 2))) - 1)
        h = context * _U(ODD)
        out.append((((h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32))
    return out


def _node(grams: np.ndarray, bit: int) -> np.ndarray:
    """A one, then the bits so far."""
    return ((grams.astype(np.uint32) & np.uint32(0xFF)) | np.uint32(0x100)) >> np.uint32(8 - bit)


def _slots(hashes: list[np.ndarray], node: np.ndarray, table: int) -> np.ndarray:
    """Slot of each context's next bit in one table, offset included."""
    return ((hashes[table] ^ (node * np.uint32(0x9E3779B1))) & np.uint32(SIZES[table] - 1)) + np.uint32(STARTS[table])


def _target(grams: np.ndarray, bit: int) -> np.ndarray:
    return ((grams >> _U(7 - bit)) & _U(1)).astype(np.int64)


def count_bits(grams: np.ndarray, words: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
    """Add the bits of distinct contexts, each seen ``times``, to ``counts`` (2 x slots)."""
    times, flat = times.astype(np.float32), counts.reshape(-1)
    hashes = _hashes(grams, words)
    for bit in range(8):
        node, upper = _node(grams, bit), _target(grams, bit) * STARTS[-1]
        for table in range(TABLES):
            np.add.at(flat, _slots(hashes, node, table) + upper, times)


# ---------------------------------------------------------------- mixing
#: The gate of the levels of the tables in ``GATED``, as digits to the base LEVELS + 1: the last known context wins.
_GATE_OF = np.array([
    next((place * LEVELS + level for place, level in reversed(list(enumerate(digits))) if level), 0) * 8
    for digits in np.ndindex(*[LEVELS + 1] * len(GATED))])


class Mixer:
    """Gated weights and the adaptive refinement, over log-odds and levels of all slots.

    From bit counts (2 x slots), or with what ``without_own`` makes of them, a mixer learns: it holds both twice, for
    events that are a zero and then for those that are a one.
    """

    def __init__(self, counts: np.ndarray | None, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.weights = np.full((GATES, TABLES), 0.2) if weights is None else weights
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, APM_STEPS)))
        self.refined = np.tile(centre, (256, 1)) if refined is None else refined
        self.seen = 0.0
        self.slots = None if counts is None else side_by_side(*without_own(counts))

    @classmethod
    def frozen(cls, odds: np.ndarray, level: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None) -> Mixer:
        """A mixer from log-odds and levels: of all slots it only scores, from those of ``without_own`` it learns."""
        return cls.of_slots(side_by_side(odds, level), weights, refined)

    @classmethod
    def of_slots(cls, slots: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None) -> Mixer:
        """``frozen`` from what ``side_by_side`` made of log-odds and levels."""
        out = cls(None, weights, refined)
        out.slots = slots
        return out

    def _inputs(self, grams: np.ndarray, hashes: list[np.ndarray], bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds by table, gate and the bit. While learning, every event is seen without its own count."""
        one = _target(grams, bit)
        x = np.empty((TABLES, len(grams)), np.float32)
        own = one.astype(np.uint32) * np.uint32(STARTS[-1]) if len(self.slots) > STARTS[-1] else None
        size = self.slots.itemsize // 2
        levels, node = {}, _node(grams, bit)
        for table in range(TABLES):
            slot = _slots(hashes, node, table)
            both = self.slots.take((slot if own is None else slot + own).astype(np.intp))
            x[table] = both.astype(f"u{size}").view(f"f{size}")
            if table in GATED:
                levels[table] = (both >> both.dtype.type(8 * size)).astype(np.uint8)
        digits = np.zeros(len(grams), np.uint8)
        for table in GATED:
            digits = digits * np.uint8(LEVELS + 1) + levels[table]
        return x, (_GATE_OF + bit).take(digits), one

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        total = np.zeros(len(gate), np.float32)
        weights = self.weights.T.astype(np.float32)
        for table in range(TABLES):
            total += x[table] * weights[table].take(gate)
        return np.clip(total, -12, 12).astype(np.float64)

    def _cells(self, grams: np.ndarray, bit: int, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower cell of the refinement table and the share of the upper one."""
        node = _node(grams, bit).astype(np.int64)
        place = (np.clip(odds, -7.999, 7.999) + 8) * ((APM_STEPS - 1) / 16)
        low = place.astype(np.int64)
        return node * APM_STEPS + low, place - low

    def learn(self, grams: np.ndarray, words: np.ndarray, times: np.ndarray) -> None:
        """One online step over the distinct contexts of a mini-batch; steps get shorter."""
        whole, rate = _hashes(grams, words), RATE / (1 + self.seen / (8 * BATCH)) ** 0.5
        seen = times.astype(np.float64)
        for bit, at in enumerate(shared_bits(grams, words)):
            some, hashes, n = grams[at], [h[at] for h in whole], np.add.reduceat(seen, at)
            x, gate, one = self._inputs(some, hashes, bit)
            odds = self._mixed(x, gate)
            p = 1 / (1 + np.exp(-odds))
            miss, bend = (one - p) * n, p * (1 - p) * n
            for table in range(TABLES):
                slope = np.bincount(gate, weights=miss * x[table], minlength=GATES)
                curve = np.bincount(gate, weights=bend * x[table] ** 2, minlength=GATES)
                self.weights[:, table] += rate * slope / (curve + CALM)
            cell, share = self._cells(some, bit, odds)
            begin = size = APM_STEPS << bit  # the cells of this bit's nodes
            flat, cell = self.refined.reshape(-1)[begin:begin + size], 2 * (cell - begin) + one
            for step, w in ((0, n * (1 - share)), (1, n * share)):
                zeros, hit = np.roll(np.bincount(cell, weights=w, minlength=2 * size).reshape(-1, 2), step, axis=0).T
                met = zeros + hit
                gain = 1 - (1 - APM_RATE) ** np.minimum(met, 50)
                flat += np.where(met > 0, gain * (hit / np.maximum(met, 1e-9) - flat), 0)
        self.seen += float(times.sum())

    def cost(self, grams: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 probability of each context's byte."""
        out, flat, whole = np.zeros(len(grams)), self.refined.reshape(-1), _hashes(grams, words)
        for bit, at in enumerate(shared_bits(grams, words)):
            some = grams[at]
            x, gate, one = self._inputs(some, [h[at] for h in whole], bit)
            odds = self._mixed(x, gate)
            cell, share = self._cells(some, bit, odds)
            p = 0.5 / (1 + np.exp(-odds)) + 0.5 * (flat.take(cell) * (1 - share) + flat.take(cell + 1) * share)
            value = np.log10(np.clip(np.where(one == 1, p, 1 - p), 1e-6, 1.0))
            out += np.repeat(value, np.diff(np.append(at, len(grams))))
        return out


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and levels of all slots, once and for all."""
    odds, level = _odds(*counts)
    return odds.astype(np.float16), level


def without_own(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and levels of all slots as an event that is counted there sees them: first a zero, then a one."""
    size = counts.shape[1]
    odds, level = np.empty(2 * size, np.float32), np.empty(2 * size, np.int8)
    for at in range(0, size, CHUNK):
        n0, n1 = counts[:, at:at + CHUNK].astype(np.float64)
        for start, left in ((at, (np.maximum(n0 - 1, 0), n1)), (size + at, (n0, np.maximum(n1 - 1, 0)))):
            odds[start:start + len(n0)], level[start:start + len(n0)] = _odds(*left)
    return odds, level


def side_by_side(odds: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Log-odds (low half) and level (high half) of each slot as one number, so that both come with one look into memory."""
    low = odds.view(f"u{odds.itemsize}").astype(f"u{2 * odds.itemsize}")
    return low | level.astype(low.dtype) << low.dtype.type(8 * odds.itemsize)


def _odds(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.clip(np.log((n1 + DELTA) / (n0 + DELTA)), -LIMIT, LIMIT), _level(n0 + n1)


def _level(n: np.ndarray) -> np.ndarray:
    """0 unknown, then 1..LEVELS for counts of 1, 2, 4, 8 or more."""
    return sum((n >= 1 << k).astype(np.int8) for k in range(LEVELS))


def score_texts(texts: list[bytes], mixer: Mixer) -> np.ndarray:
    """log10 probability of each text with its end."""
    out = np.zeros(len(texts))
    for parts in grouped_parts(texts):
        grams, words, owner = contexts(parts)
        order, first, times = distinct(grams, words)
        value = np.repeat(mixer.cost(grams[order[first]], words[order[first]]), times)
        out += np.bincount(owner[order], weights=value, minlength=len(texts))
    return out


# ---------------------------------------------------------------- distributed steps
def _texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes with A-Z in lower case (of bytes, so other letters stay)."""
    return [t.lower() for t in column.cast(pa.binary()).to_pylist()]


def _batches_of(texts: Iterator[bytes], limit: int, most: int = 0) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Parts of texts in lists of about ``limit`` bytes, which grows by an eighth from list to list up to ``most``."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield from grouped_parts(held, limit)
            held, size, limit = [], 0, max(limit, min(limit * 9 // 8, most))
    yield from grouped_parts(held, limit)


def _chunk_rows(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array as rows (chunk, data) of ``CHUNK`` numbers each; chunks of zeros are left out."""
    parts = {k: values[at:at + CHUNK] for k, at in enumerate(range(0, len(values), CHUNK))}
    keep = [k for k, p in parts.items() if p.any()]
    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([_packed(parts[k]) for k in keep], pa.binary())], names=["chunk", "data"])


def _packed(values: np.ndarray) -> bytes:
    raw = values.astype(np.float32).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd"), np.float32)


def _collected(rows: DataFrame, size: int) -> np.ndarray:
    """Rows of chunks added up to one array, whose size the model's parameters fix.

    Chunks are added in 4 groups first and then over the groups, so no task adds up the rows of all tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist()):
                v = _unpacked(data).astype(np.float64)
                total[chunk] = total[chunk] + v if chunk in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(v) for v in total.values()], pa.binary())], names=["chunk", "data"])

    parts = rows.withColumn("g", F.pmod(F.xxhash64("data"), F.lit(4))).repartition("chunk", "g").select("chunk", "data")
    some = parts.mapInArrow(add, "chunk int, data binary").repartition("chunk").mapInArrow(add, "chunk int, data binary")
    out = np.zeros(size, np.float32)
    for r in some.collect():
        v = _unpacked(r.data)
        out[r.chunk * CHUNK:r.chunk * CHUNK + len(v)] = v
    return out


def train_counts(texts: DataFrame) -> np.ndarray:
    """Bit counts (2 x slots) over all rows of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STARTS[-1]), np.float32)
        for parts in _batches_of((t for b in batches for t in _texts(b.column(0))), PIECE):
            grams, words, _ = contexts(parts)
            order, first, times = distinct(grams, words)
            count_bits(grams[order[first]], words[order[first]], times, counts)
        yield from _chunk_rows(counts.ravel())

    return _collected(texts.select("text").mapInArrow(count, "chunk int, data binary"), 2 * STARTS[-1]).reshape(2, -1)


def train_mixer(texts: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refinement: online in every task, averaged by the bytes each task has seen."""
    n_w, n_r = GATES * TABLES, 256 * APM_STEPS
    seen = texts.sparkSession.sparkContext.broadcast(side_by_side(*without_own(counts)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer.of_slots(seen.value)
        for parts in _batches_of((t for b in batches for t in _texts(b.column(0))), BATCH, LAST_BATCH):
            grams, words, _ = contexts(parts)
            order, first, times = distinct(grams, words)
            mixer.learn(grams[order[first]], words[order[first]], times)
        if mixer.seen:
            yield from _chunk_rows(np.append(mixer.seen * np.append(mixer.weights.ravel(), mixer.refined.ravel()), mixer.seen))

    got = _collected(texts.select("text").mapInArrow(learn, "chunk int, data binary"), n_w + n_r + 1).astype(np.float64)
    seen.unpersist()
    start = Mixer(None)
    if not got[-1]:
        return start.weights, start.refined
    mean = got[:-1] / got[-1]
    return mean[:n_w].reshape(start.weights.shape), mean[n_w:].reshape(start.refined.shape)


def block_words(docs: DataFrame) -> DataFrame:
    """(block, word, n): words of each block's texts, and how often its training texts hold them. Rows come by block."""

    def rows(block: int, counts: Counter) -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        for at in range(0, len(items), 50_000):
            part = items[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["block", "word", "n"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, Counter()
        for b in batches:
            for this, train, text in zip(b.column("block").to_pylist(), b.column("train").to_pylist(), _texts(b.column("text"))):
                if this != block:
                    yield from rows(block, counts)
                    block, counts = this, Counter()
                if train:
                    counts.update(text.split())
                else:
                    counts.update(dict.fromkeys(text.split(), 0))
        yield from rows(block, counts)

    return docs.select("block", "train", "text").mapInArrow(words, "block bigint, word binary, n bigint")


def scored(docs: DataFrame, ident: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte): one row per input row.

    Rows whose crc32 of the id, modulo ``folds``, is ``held_fold`` are held out; a null id has no crc and
    trains. A null text is empty: its only token is the end. Repeated rows count and are scored as often as
    they come; other columns are ignored; an empty table gives an empty table. Learning ends with the
    training rows: all rows, the training rows too, are scored by the state after it.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col(ident).cast("string").cast("binary")), F.lit(folds))
    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.coalesce(fold != held_fold, F.lit(True)).alias("train"), whole_text(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if("train").alias("n")).first()
    n_bytes, ends = size.b or 0, size.n
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    drawn = F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64))
    rows = rows.withColumn("block", F.pmod(drawn, F.lit(blocks)))

    train = rows.where("train")
    table = train_counts(train)
    model = spark.sparkContext.broadcast(train_mixer(train, table))
    frozen = spark.sparkContext.broadcast(side_by_side(*log_odds(table)))

    words = block_words(rows.repartition("block").sortWithinPartitions("block"))
    # A word has at most one row per block, and there is a block for every BLOCK_BYTES of text.
    words = stored(words.groupBy("word").agg(F.sum("n").alias("c"), F.collect_set("block").alias("blocks")), "mix-words")
    total = words.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_tokens = (total.c or 0) + ends
    floor = -float(np.log10(n_tokens + (total.v or 0) + (ends > 0) + 1))
    end_value = float(np.log10(ends + 1)) + floor

    null = lambda kind: F.lit(None).cast(kind)
    known = words.where("c > 0").select(F.explode("blocks").alias("block"), F.lit(0).alias("kind"), F.col("word").alias("data"), "c", null("bigint").alias("doc_id"), null("boolean").alias("train"))
    texts = rows.select("block", F.lit(1).alias("kind"), F.col("text").cast("binary").alias("data"), null("bigint").alias("c"), "doc_id", "train")
    both = known.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer.of_slots(frozen.value, *model.value)
        block, log_count, held, waiting = None, {}, [], 0

        def flush() -> pa.RecordBatch:
            out = []
            for (doc, trains, low), s in zip(held, score_texts([h[2] for h in held], mixer)):
                ws = low.split()
                values = list(filter(None, map(log_count.get, ws)))  # a known word's value is above zero
                out.append((doc, not trains, len(ws) + 1, len(values) + (ends > 0), sum(values) + floor * len(ws) + end_value, float(s), len(low)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
            for start, end in zip(edges[:-1], edges[1:]):
                if start == end:
                    continue
                if blocks[start] != block:
                    if held:
                        yield flush()
                        waiting = 0
                    block, log_count = blocks[start], {}
                some = b.slice(start, end - start)
                if kinds[start] == 0:
                    log_count.update(zip(some.column("data").to_pylist(), np.log10(some.column("c").to_numpy() + 1).tolist()))
                    continue
                for data, doc, trains in zip(*(some.column(n).to_pylist() for n in ("data", "doc_id", "train"))):
                    held.append((doc, trains, data.lower()))
                    waiting += len(data)
                    if waiting >= PIECE:
                        yield flush()
                        waiting = 0
        if held:
            yield flush()

    out = both.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint")
    bits = F.col("score") * -float(np.log2(10))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))
