"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in the corpus.

A token of A and a token of B are linked where their byte ranges overlap. Between two neighbouring token ends,
of either side, lies one token of A and one of B, and every overlap is one such stretch; so the links are the
distinct ends, and places where both sides end cut a text into groups.

Both tokenizers are run in Arrow batches. A text is split at its spaces, and a space is a *cut* where no token
of either side can reach across it (``Pair.cuts`` verifies that from the vocabularies; otherwise the whole text is
one piece). Pieces repeat, so each distinct piece of a block of documents is encoded and aligned once, as a document of
its own: its id lists are flattened, parent indices carry the piece, segmented cumulative sums of the token lengths
give the ends, and a full outer hash join of both sides on (piece, end) gives the stretches in order. What
a document needs is the sum over its pieces.

``Table.group_by`` counts the id pairs of a block, weighed by how often each piece occurs; Spark adds the partial counts
over all blocks, finds the highest of every id of B, and hands each block the counts of its own pairs. A pair thus
travels once per block that holds it, not once per link, and nothing is broadcast but the two vocabulary files.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.util import stored

BLOCK_BYTES = 8 << 20  # text of a block; a longer text is a block of its own
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
MARK = "▁"
_loaded: dict = {}


def byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Tokenizer A (byte-level BPE) and B (pieces with byte fallback), with the bytes of every token."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        of, vocabulary = byte_level(), self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.cuts = self._cuts_hold(json.loads(a_file), pieces)
        # Decimal ids with what may follow them: A ',' or '|', then B ',' or ';'.
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        self.written = pa.array([f"{i}{s}" for n, seps in ((self.n_a, ",|"), (self.n_b, ",;")) for s in seps for i in range(n)], pa.binary())

    @staticmethod
    def _cuts_hold(a: dict, pieces: list[str]) -> bool:
        """True if no token crosses a space between a character and a character that is not white space.

        A splits by the byte-level pattern, in which such a space starts a match. B merges whatever its vocabulary
        holds, so no piece may hold its space mark behind another character.
        """
        first = a.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not a.get("normalizer")
        return bool(plain) and not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


def _pair(a_file: bytes, b_file: bytes) -> Pair:
    key = hashlib.sha256(a_file).digest(), hashlib.sha256(b_file).digest()
    if key not in _loaded:
        _loaded[key] = Pair(a_file, b_file)
    return _loaded[key]


def _all_in(words: pa.Array, place: int, good) -> np.ndarray:
    """Whether a word has a first or last character (``place``: 0 or -1) that is ``good``."""
    coded = pc.dictionary_encode(pc.utf8_slice_codeunits(words, place, 1 if place == 0 else None))
    return np.array([c != "" and good(c) for c in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]


def pieces_of(texts: pa.Array, cuts: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the piece of every place, and the first place of every text (with the end): texts are not empty."""
    if not cuts:
        coded = pc.dictionary_encode(texts)
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.arange(len(texts) + 1)
    split = pc.split_pattern(texts, " ")
    parent = pc.list_parent_indices(split).to_numpy()
    coded = pc.dictionary_encode(pc.list_flatten(split))
    words, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    opens, closes = _all_in(coded.dictionary, 0, lambda c: c != MARK and not c.isspace()), _all_in(coded.dictionary, -1, lambda c: c != MARK)
    cut = np.ones(len(of), bool)
    cut[1:] = (parent[1:] != parent[:-1]) | (opens[of[1:]] & closes[of[:-1]])
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(of))
    pieces = of[at].astype(np.int64)
    seen: dict[str, int] = {}
    for k in np.flatnonzero(ends - at > 1):  # words around spaces that are no cuts stay together
        joined = " ".join(words[w] for w in of[at[k]:ends[k]])
        pieces[k] = len(words) + seen.setdefault(joined, len(seen))
    used, pieces = np.unique(pieces, return_inverse=True)
    every = [*words, *seen]
    return [every[k] for k in used], pieces, np.searchsorted(parent[at], np.arange(len(texts) + 1))


def _flat(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))))


def _intact(ids: pa.ListArray, token_bytes: pa.Array, texts: list[bytes]) -> np.ndarray:
    """For every piece, whether the bytes of its tokens are those of the text."""
    joined = token_bytes.take(pc.list_flatten(ids))
    start = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[ids.offsets.to_numpy()]
    data = joined.buffers()[2].to_pybytes() if texts else b""
    at = start.tolist()
    return np.fromiter((data[a:b] == t for a, b, t in zip(at, at[1:], texts)), bool, len(texts))


def _ends(ids: pa.ListArray, lengths: pa.Array) -> pa.Array:
    """(piece, end in the piece) of every token as one number, by a segmented cumulative sum."""
    parent = pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(lengths.take(pc.list_flatten(ids)))
    before = np.concatenate([[0], upto.to_numpy()])[ids.offsets.to_numpy()[:-1]]
    inside = pc.subtract(upto, pa.array(before).take(parent))
    return pc.add(pc.shift_left(parent.cast(pa.int64()), 32), inside)


class Aligned:
    """The alignment of distinct pieces: per piece its counts, written groups and links (as pairs a << 32 | b)."""

    def __init__(self, pair: Pair, pieces: list[str]):
        a, b = _flat(pair.encode_a(pieces)), _flat(pair.encode_b(pieces))
        texts = [b" " + p.encode() for p in pieces]
        self.intact = _intact(a, pair.a_bytes, texts) & _intact(b, pair.b_bytes, texts)
        if not self.intact.all():
            whole = pa.array(self.intact)
            none = pa.scalar([], a.type)
            a, b = pc.if_else(whole, a, none), pc.if_else(whole, b, none)
            a, b = pa.ListArray.from_arrays(a.offsets, a.values), pa.ListArray.from_arrays(b.offsets, b.values)
        n = len(pieces)
        ids_a, ids_b = pc.list_flatten(a), pc.list_flatten(b)
        ends_a, ends_b = _ends(a, pc.binary_length(pair.a_bytes).cast(pa.int64())), _ends(b, pc.binary_length(pair.b_bytes).cast(pa.int64()))
        left = pa.table({"end": ends_a, "a": ids_a, "at_a": pa.array(np.arange(len(ids_a)))})
        right = pa.table({"end": ends_b, "b": ids_b, "at_b": pa.array(np.arange(len(ids_b)))})
        met = left.join(right, "end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
        both = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"])).to_numpy()
        piece = np.right_shift(met["end"].to_numpy(), 32)
        # The token that covers a stretch is the next that ends; the last stretch of a piece ends both.
        link_a, link_b = (pc.fill_null_backward(met[c]).to_numpy().astype(np.int64) for c in "ab")
        self.links = (link_a << 32) | link_b
        self.n_a, self.n_b = np.diff(a.offsets.to_numpy()).astype(np.int64), np.diff(b.offsets.to_numpy()).astype(np.int64)
        self.n_links = np.bincount(piece, minlength=n)
        self.n_groups = np.bincount(piece[both], minlength=n)
        self.written = self._write(pair, a, b, ids_a.to_numpy(), ids_b.to_numpy(), met["at_a"].to_numpy()[both].astype(np.int64), met["at_b"].to_numpy()[both].astype(np.int64))

    @staticmethod
    def _write(pair: Pair, a: pa.ListArray, b: pa.ListArray, ids_a: np.ndarray, ids_b: np.ndarray, common_a: np.ndarray, common_b: np.ndarray) -> pa.Array:
        """Per piece its groups, each ended by a semicolon. A group's tokens of A stand before its tokens of B."""
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[common_a] = 1
        last_b[common_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate([[0], common_b + 1])[group_a]] = ids_a + pair.n_a * last_a
        order[np.arange(len(ids_b)) + common_a[group_b] + 1] = 2 * pair.n_a + ids_b + pair.n_b * last_b
        text = pair.written.take(pa.array(order))
        offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)[a.offsets.to_numpy().astype(np.int64) + b.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), text.buffers()[2] or pa.py_buffer(b"")])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs between ``starts`` (the last one is the end)."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[starts[1:]] - upto[starts[:-1]]


def _list(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


BLOCK_TYPE = pa.struct([("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("links", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32()))])
DOC_TYPE = pa.struct([*[(c, pa.int64()) for c in RESULTS[:4]], (RESULTS[-1], pa.string()), ("pieces", pa.list_(pa.int32()))])


def align_block(pair: Pair, texts: pa.Array) -> tuple[pa.StructArray, pa.StructArray]:
    """A row per text (``DOC_TYPE``) and one row (``BLOCK_TYPE``) with the counted pairs of all texts that have tokens."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    full = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    pieces, of, starts = pieces_of(texts.take(pa.array(full)), pair.cuts) if len(full) else ([], np.zeros(0, np.int64), np.zeros(1, np.int64))
    found = Aligned(pair, pieces)
    broken = _sums(~found.intact[of], starts) > 0
    keep = np.repeat(~broken, np.diff(starts))
    of, starts = of[keep], np.concatenate([[0], np.cumsum(np.where(broken, 0, np.diff(starts)))])
    occurs = np.bincount(of, minlength=len(pieces))
    whole = np.zeros((n, 4), np.int64)
    for k, each in enumerate((found.n_a, found.n_b, found.n_groups, found.n_links)):
        whole[full, k] = _sums(each[of], starts)
    digests = [""] * n
    lists = np.zeros(n + 1, np.int64)
    lists[full + 1] = np.diff(starts)
    for lo in range(0, len(full), 64):  # what is written at once stays small
        hi = min(lo + 64, len(full))
        text = found.written.take(pa.array(of[starts[lo]:starts[hi]]))
        at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1) if len(text) else np.zeros(1, np.int32)
        data = memoryview(text.buffers()[2] or b"")
        for k in range(lo, hi):
            if not broken[k]:
                digests[full[k]] = hashlib.sha256(data[at[starts[k] - starts[lo]]:at[starts[k + 1] - starts[lo]] - 1]).hexdigest()
    counts = pa.table({"pair": found.links, "n": np.repeat(occurs, found.n_links)}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    local = pc.index_in(pa.array(found.links), value_set=counts["pair"].combine_chunks())
    docs = pa.StructArray.from_arrays(
        [*[pa.array(whole[:, k]) for k in range(4)], pa.array(digests, pa.string()),
         pa.ListArray.from_arrays(pa.array(np.cumsum(lists), pa.int32()), pa.array(of, pa.int32()))], fields=list(DOC_TYPE))
    block = pa.StructArray.from_arrays(
        [_list(counts["pair"].to_numpy(), pa.int64()), _list(counts["n_sum"].to_numpy(), pa.int64()), _list(local.to_numpy(), pa.int32()),
         _list(np.concatenate([[0], np.cumsum(found.n_links)]), pa.int32())], fields=list(BLOCK_TYPE))
    return docs, block


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows in blocks of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        lo = 0
        for i, n in enumerate(lengths.tolist()):
            size += n + 16
            if size >= limit:
                yield pa.Table.from_batches([*held, batch.slice(lo, i + 1 - lo)])
                held, size, lo = [], 0, i + 1
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def _weigh(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of a block's documents with n_best and count_sum, from the corpus counts of the block's pairs."""
    block = rows.filter(pc.is_valid(rows["block"]))["block"].combine_chunks()
    docs = rows.filter(pc.is_valid(rows["doc"]))
    links, starts = (pc.list_flatten(pc.struct_field(block, f)).to_numpy() for f in ("links", "starts"))
    n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    n[counts["at"].to_numpy()], best[counts["at"].to_numpy()] = counts["n"].to_numpy(), counts["best"].to_numpy()
    doc = docs["doc"].combine_chunks()
    lists = doc.field("pieces")
    ends = lists.offsets.to_numpy()
    of = lists.values.to_numpy()[ends[0]:ends[-1]]
    each = {name: _sums(_sums(v[links], starts)[of], ends - ends[0]) for name, v in (("n_best", best), ("count_sum", n))}
    cols = {c: doc.field(c) for c in (*RESULTS[:4], RESULTS[-1])} | {c: pa.array(v) for c, v in each.items()}
    return pa.table([docs["row"].combine_chunks(), *[cols[c] for c in RESULTS]], names=["row", *RESULTS])


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` but the text, then n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers encode a space and the whole text without special tokens. A text that is null or empty, or that
    the tokens of one side do not give back byte for byte (such as one with the space mark U+2581), has no
    tokens: zeros, an empty digest, and no part in any count. Rows are taken one by one, so repeated rows, ties and
    null ids change nothing but the counts; an empty table gives an empty table. Old columns with the names of the
    results are replaced. A very long text is a block of its own, and a task holds some forty times its bytes.
    """
    spark = docs.sparkSession
    files = []
    for p in (a_path, b_path):
        with open(p, "rb") as f:
            files.append(spark.sparkContext.broadcast(f.read()))  # vocabularies, a few megabytes
    kept = [c for c in docs.columns if c not in {*RESULTS, text}]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    doc_type = T.StructType([*longs(*RESULTS[:4]), T.StructField(RESULTS[-1], T.StringType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    block_type = T.StructType([T.StructField(c, T.ArrayType(t)) for c, t in (("pairs", T.LongType()), ("n", T.LongType()), ("links", T.IntegerType()), ("starts", T.IntegerType()))])
    row_field = T.StructField("row", source.schema["row"].dataType)
    out = T.StructType([*longs("at"), row_field, T.StructField("doc", doc_type), T.StructField("block", block_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*[f.value for f in files])
        for k, rows in enumerate(_blocks(batches, block_bytes)):
            at = (TaskContext.get().partitionId() << 32) + k
            doc, block = align_block(pair, rows["text"].combine_chunks())
            row = rows["row"].combine_chunks()
            names = ["at", "row", "doc", "block"]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.nulls(1, row.type), pa.nulls(1, DOC_TYPE), block], names=names)
            for lo in range(0, len(doc), 2000):
                part = doc[lo:lo + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at)), row[lo:lo + 2000], part, pa.nulls(len(part), BLOCK_TYPE)], names=names)

    rows = stored(source.mapInArrow(run, out), "token-blocks")
    blocks = rows.where(F.col("block").isNotNull())
    counted = blocks.select(F.explode(F.arrays_zip("block.pairs", "block.n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n").alias("n"))
    counted = counted.where("n > 0").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = counted.groupBy("b").agg(F.max("n").alias("most"))
    corpus = counted.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    asked = blocks.select("at", F.posexplode("block.pairs").alias("place", "pair"))
    given = asked.join(corpus, "pair", "left").select(
        F.col("at").alias("of"), F.col("place").cast("bigint").alias("at"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(0)).alias("best"))
    slim = rows.select("at", "row", "doc", F.when(F.col("block").isNotNull(), F.struct("block.links", "block.starts")).alias("block"))
    result = T.StructType([row_field, *longs(*RESULTS[:-1]), T.StructField(RESULTS[-1], T.StringType())])
    done = slim.groupBy("at").cogroup(given.groupBy("of")).applyInArrow(_weigh, result)
    return done.select("row.*", *RESULTS)
