"""Ranked lexical search by MaxScore with bounds on pairs of terms.

Index: documents are dealt into blocks of bounded size, each with its postings of every term (document, frequency).
For the terms of a query set, ``prepared`` turns frequencies into impacts (a posting's exact part of the score) and
precomputes, for pairs of terms that stand together in a query, the list of documents that hold both and the greatest
impact that the two have jointly in one of them. That joint maximum, or the maximum of one of the terms where it
is greater, bounds what any document can gain from the pair, and is mostly well below the sum of the two maxima.

Query: a query's terms are taken pair by pair. Pairs whose bounds together stay below the threshold (the score of the
k-th best so far) cannot bring in a document by themselves, so only the postings of the others are walked. What
they reach is a candidate as long as its score so far and the bounds of what is left reach the threshold. Before the
postings of a left pair are looked at, its list tells which candidates hold both terms; the others can gain no more than
the greater maximum of one, which drops many of them. Thresholds are kept from block to block within a task, every
task returns its best, and Spark ranks those of all tasks. Skipping is strict, so results are exact, ties included.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.util import stored

BLOCK_BYTES = 8 << 20  # text of a block of the index
CHUNK_TERMS = 100_000  # terms of the queries that are answered in one pass over the index
K = 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id, last among equal scores
#: Separators become spaces, A-Z lower-case; bytes above 0x7F stay.
_FOLD = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()  # bytes.lower() is ASCII only


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters above 0x7F, A-Z lower-cased."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


# ---------------------------------------------------------------- index
INDEX = "ids array<bigint>, n array<bigint>, n_docs bigint, n_terms bigint, terms array<binary>, df array<int>, docs array<int>, tf array<int>"


def _index_block(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
    n = np.array([len(t) for t in texts], np.int64)
    coded = pc.dictionary_encode(pa.array([w for t in texts for w in t], pa.binary()))
    key = coded.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), n)
    key, tf = np.unique(key, return_counts=True)
    of, doc = np.divmod(key, max(len(texts), 1))
    one = lambda v, t: pa.array([v], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [one(pa.array(ids, pa.int64()), pa.int64()), one(n, pa.int64()), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
         one(coded.dictionary, pa.binary()), one(np.bincount(of, minlength=len(coded.dictionary)), pa.int32()), one(doc, pa.int32()), one(tf, pa.int32())],
        names=["ids", "n", "n_docs", "n_terms", "terms", "df", "docs", "tf"])


def build_index(docs: DataFrame, ident: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents, with the postings of all its terms, stored. Every row of ``docs`` is indexed.

    A very long text is a block of its own. Null texts have no terms; null ids are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                s = t.as_py()
                ids.append(i)
                texts.append(terms_of(s))
                size += len(s or "") + 16
                if size >= block_bytes:
                    yield _index_block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _index_block(ids, texts)

    source = docs.select(F.col(f"`{ident}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    return stored(source.mapInArrow(run, INDEX), "search-index", rows_per_file=1)


# ---------------------------------------------------------------- queries
@dataclass
class Queries:
    """Queries that are answered together. A query term is a term with its number of repeats in the query."""

    items: list[int | None]
    terms: list[tuple[bytes, int]]
    units: list[list[tuple[int, ...]]]  # per query: pairs of query terms (or one alone), by numbers in ``terms``
    pairs: list[tuple[int, int]]
    weights: np.ndarray | None = None


def _chunks(rows: Iterable, limit: int) -> Iterator[list[tuple[int | None, Counter]]]:
    held, size = [], 0
    for r in rows:
        terms = Counter(terms_of(r.text))
        held.append((r.item, terms))
        size += len(terms)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _weighed(chunk: list[tuple[int | None, Counter]], df: dict[bytes, int], n_docs: int) -> Queries:
    """Weights of the terms that occur, and the pairs: neighbours in the order of weight, so heavy terms meet heavy ones."""
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    number: dict[tuple[bytes, int], int] = {}
    units = []
    for _, terms in chunk:
        known = sorted(((t, r) for t, r in terms.items() if weight.get(t, 0) > 0), key=lambda x: (-weight[x[0]] * x[1], x))
        ids = [number.setdefault(x, len(number)) for x in known]
        units.append([tuple(sorted(ids[i:i + 2])) for i in range(0, len(ids), 2)])
    return Queries([i for i, _ in chunk], list(number), units, sorted({u for q in units for u in q if len(u) == 2}), np.array([weight[t] * r for t, r in number], np.int64))


def document_frequencies(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Documents of the whole index that hold each of the ``terms`` (as many as a chunk of queries has at most)."""
    wanted = index.sparkSession.sparkContext.broadcast(pa.array(sorted(terms), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            at = pc.index_in(pc.list_flatten(batch.column("terms")), value_set=wanted.value)
            here = pc.is_valid(at).to_numpy(zero_copy_only=False)
            np.add.at(total, at.drop_null().to_numpy(), pc.list_flatten(batch.column("df")).to_numpy()[here])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([wanted.value.take(pa.array(some)), pa.array(total[some])], names=["term", "df"])

    counted = index.select("terms", "df").mapInArrow(run, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in counted.collect()}


# ---------------------------------------------------------------- impacts and pair lists
PREPARED = "ids array<bigint>, terms array<int>, ends array<int>, docs array<int>, impacts array<bigint>, pairs array<int>, pair_ends array<int>, pair_docs array<int>, joint array<bigint>"


def _prepare(row: dict, q: Queries, vocabulary: pa.Array, of_term: list[list[int]], n_docs: int, n_terms: int) -> pa.RecordBatch:
    ids, n, df, docs, tf = (row[c].values for c in ("ids", "n", "df", "docs", "tf"))
    ends = np.cumsum(df.to_numpy())
    m = 75 + 25 * n.to_numpy() * n_docs // n_terms
    at = pc.index_in(vocabulary, value_set=row["terms"].values).to_pylist()
    docs, tf = docs.to_numpy(), tf.to_numpy().astype(np.int64)
    postings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for v, k in enumerate(at):
        if k is not None:
            hit = slice(ends[k - 1] if k else 0, ends[k])
            d, f = docs[hit], tf[hit]
            each = 1_000_000_000 * f // (1000 * f + 12 * m[d])
            for t in of_term[v]:
                postings[t] = d, q.weights[t] * each
    terms = sorted(postings)
    pairs, lists, joint = [], [], []
    for p, (a, b) in enumerate(q.pairs):
        if a in postings and b in postings:
            both, i, j = np.intersect1d(postings[a][0], postings[b][0], assume_unique=True, return_indices=True)
            if len(both):
                pairs.append(p)
                lists.append(both)
                joint.append(int((postings[a][1][i] + postings[b][1][j]).max()))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    one = lambda v, t: pa.array([v], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [one(ids, pa.int64()), one(terms, pa.int32()), one(np.cumsum([len(postings[t][0]) for t in terms], dtype=np.int64), pa.int32()),
         one(join([postings[t][0] for t in terms], np.int32), pa.int32()), one(join([postings[t][1] for t in terms], np.int64), pa.int64()),
         one(pairs, pa.int32()), one(np.cumsum([len(x) for x in lists], dtype=np.int64), pa.int32()), one(join(lists, np.int32), pa.int32()), one(joint, pa.int64())],
        names=[f.split()[0] for f in PREPARED.split(", ")])


def prepared(index: DataFrame, q: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """Per block the impacts of the query terms, and the precomputed pair lists with their joint maxima, stored."""
    sent = index.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        vocabulary = sorted({t for t, _ in q.terms})
        of_term: dict[bytes, list[int]] = {t: [] for t in vocabulary}
        for i, (t, _) in enumerate(q.terms):
            of_term[t].append(i)
        words = pa.array(vocabulary, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                yield _prepare({c: batch.column(c)[k] for c in batch.schema.names}, q, words, [of_term[t] for t in vocabulary], n_docs, n_terms)

    return stored(index.select("ids", "n", "terms", "df", "docs", "tf").mapInArrow(run, PREPARED), "search-impacts", rows_per_file=1)


# ---------------------------------------------------------------- search
class Block:
    """A block with its lists by number."""

    def __init__(self, row: dict):
        get = lambda c: row[c].values.to_numpy()
        self.ids = pc.fill_null(row["ids"].values, NO_ID).to_numpy()
        docs, impacts, pair_docs = get("docs"), get("impacts"), get("pair_docs")
        cut = lambda ends: zip([0, *ends[:-1].tolist()], ends.tolist()) if len(ends) else ()
        self.postings = {t: (docs[a:b], impacts[a:b]) for t, (a, b) in zip(get("terms").tolist(), cut(get("ends")))}
        self.highest = {t: int(s.max()) for t, (_, s) in self.postings.items()}
        self.lists = {p: (pair_docs[a:b], j) for p, (a, b), j in zip(get("pairs").tolist(), cut(get("pair_ends")), get("joint").tolist())}
        self.score = np.zeros(len(self.ids), np.int64)


@dataclass
class Best:
    """The k best of a query so far."""

    scores: np.ndarray
    ids: np.ndarray

    def add(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:k]
        self.scores, self.ids = scores[order], ids[order]

    def threshold(self, k: int) -> int:
        return int(self.scores[-1]) if len(self.scores) == k else 1


def search_block(block: Block, units: list[tuple[int, ...]], number: dict[tuple[int, ...], int], best: Best, k: int) -> tuple[int, int]:
    """Bring ``best`` up to date with the block; returns how many postings were walked, and how many there are."""
    bounded = []
    for unit in units:
        here = [t for t in unit if t in block.postings]
        if here:
            single = max(block.highest[t] for t in here)
            docs, joint = block.lists.get(number.get(unit, -1), (None, 0)) if len(here) == 2 else (None, 0)
            bounded.append((max(single, joint), single, here, docs))
    bounded.sort(key=lambda b: -b[0])
    left = np.cumsum([b[0] for b in bounded][::-1])[::-1].tolist() + [0]  # bound of unit i and all behind it
    least, walked, total = best.threshold(k), 0, sum(len(block.postings[t][0]) for b in bounded for t in b[2])
    score, i = block.score, 0
    while i < len(bounded) and left[i] >= least:  # a document outside the units so far may still qualify
        for t in bounded[i][2]:
            d, s = block.postings[t]
            score[d] += s
            walked += len(d)
        i += 1
    at = np.flatnonzero(score)
    found = score[at]
    score[at] = 0
    for j in range(i, len(bounded)):
        bound, single, here, docs = bounded[j]
        limit = np.full(len(at), left[j])
        if len(here) == 2:  # without both terms a document gains at most one term's maximum
            limit[~np.isin(at, docs, assume_unique=True) if docs is not None else slice(None)] += single - bound
        stay = found + limit >= least
        at, found = at[stay], found[stay]
        if not len(at):
            return walked, total
        for t in here:
            d, s = block.postings[t]
            place = np.minimum(np.searchsorted(d, at), len(d) - 1)
            found = found + np.where(d[place] == at, s[place], 0)
            walked += len(at)
    good = found >= least
    best.add(found[good], block.ids[at[good]], k)
    return walked, total


def _answers(ready: DataFrame, q: Queries, k: int) -> DataFrame:
    """(query, doc_id, score): the best of every task."""
    sent = ready.sparkSession.sparkContext.broadcast((q.units, q.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, pairs = sent.value
        number = {p: i for i, p in enumerate(pairs)}
        best = [Best(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in units]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({c: batch.column(c)[i] for c in batch.schema.names})
                for u, b in zip(units, best):
                    search_block(block, u, number, b, k)
        of = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        if len(of):
            ids = np.concatenate([b.ids for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([b.scores for b in best]))], names=["query", "doc_id", "score"])

    return ready.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, queries: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of ``docs`` for each query, scores above 0 only.

    Equal scores rank by ascending id (an integer), null ids last; repeated rows are documents of their own. A repeated query row
    is one query; queries with one id and different texts each have their list. Null and empty texts have no terms,
    as documents and as queries, and an empty table on either side gives an empty table. Other columns are ignored.
    The index covers every row. Queries are taken in chunks of ``chunk_terms`` terms, a pass over the index for each;
    only a chunk is ever held by the driver or sent to the tasks.
    """
    spark = docs.sparkSession
    index = build_index(docs, ident, text, block_bytes)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    asked = queries.select(F.col(f"`{item}`").cast("bigint").alias("item"), F.col(f"`{item_text}`").alias("text")).distinct()
    for chunk in _chunks(asked.toLocalIterator(), chunk_terms) if n_terms else ():
        q = _weighed(chunk, document_frequencies(index, {t for _, c in chunk for t in c}), n_docs)
        found = _answers(prepared(index, q, n_docs, n_terms), q, k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        items = spark.createDataFrame(list(enumerate(q.items)), "query bigint, item_id bigint")
        best = found.withColumn("rank", place).where(F.col("rank") <= k).join(items, "query")
        out = out.unionByName(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


_SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" + "')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY item_id, term),
x AS (
    SELECT item_id, p.doc_id, sum(r * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN f USING (term) JOIN p USING (term) JOIN d ON p.doc_id = d.doc_id, s GROUP BY item_id, p.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
