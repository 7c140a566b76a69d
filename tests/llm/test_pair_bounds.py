"""Ranked search with pair bounds against the scoring of every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import pair_bounds as P

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, k=20):
    """{(item row): [(rank, doc_id, score)]} by scoring every document."""
    terms = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, c in terms:
            if c:
                m = 75 + 25 * c.total() * n_docs // n_terms
                s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in Counter(split(text)).items() if c[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0, i))
        out.update((item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1))
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("un", "DE", "é", "x1", "日") for b in range(30)]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(vocabulary[int(len(vocabulary) * r.random() ** 3)] for _ in range(n))
    docs = [(i, text(r.randrange(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # ties beyond the list's end
    docs += [(2000, None), (2001, ""), (2002, " .,! "), (None, docs[3][1]), (None, "un1 un2"), (5, docs[5][1]), (5, docs[5][1]), (3000, "un0 " * 5000)]
    items = [(i, docs[r.randrange(400)][1]) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere to be found"), (33, docs[3][1]), (33, docs[3][1]), (34, "un0"), (34, "DE1 de1 un0"), (35, "..."), (None, "x11 x12")]
    return docs, items


@pytest.mark.parametrize("block_bytes, chunk_terms", [(500, 60), (8 << 20, 100_000)])
def test_search_equals_brute(spark, tables, block_bytes, chunk_terms):
    docs, items = tables
    d = spark.createDataFrame([(i, t, 9, "c") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = P.ranked_search(d, q, block_bytes=block_bytes, chunk_terms=chunk_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(docs, items)


def test_empty_tables(spark, tables):
    d = spark.createDataFrame(tables[0], "doc_id long, text string")
    q = spark.createDataFrame(tables[1], "item_id long, text string")
    none_d, none_q = d.where(F.lit(False)), q.where(F.lit(False))
    assert P.ranked_search(none_d, q).count() == 0
    assert P.ranked_search(d, none_q).count() == 0
    assert P.ranked_search(d.select("doc_id", F.lit(None).cast("string").alias("text")), q).count() == 0


def block_of(postings, pairs, n):
    """A block from {term: {doc: impact}}."""
    b = P.Block.__new__(P.Block)
    b.ids, b.score = np.arange(n), np.zeros(n, np.int64)
    b.postings = {t: (np.array(sorted(p)), np.array([p[d] for d in sorted(p)])) for t, p in postings.items()}
    b.highest = {t: max(p.values()) for t, p in postings.items()}
    b.lists = {}
    for i, (x, y) in enumerate(pairs):
        both = sorted(set(postings[x]) & set(postings[y]))
        if both:
            b.lists[i] = np.array(both), max(postings[x][d] + postings[y][d] for d in both)
    return b


def test_joint_maxima_skip_what_single_maxima_cannot():
    """Two terms whose maxima lie in different documents: their postings are not walked, with sums of maxima they are."""
    postings = {0: {0: 100, 1: 90, 2: 80}, 1: {0: 100, 1: 90, 2: 80}, 2: {d: 70 if d == 3 else 1 for d in range(3, 900)}, 3: {d: 70 if d == 4 else 1 for d in range(3, 900)}}
    pairs = [(0, 1), (2, 3)]
    number = {p: i for i, p in enumerate(pairs)}
    block = block_of(postings, pairs, 900)
    best = P.Best(np.array([100]), np.array([5000]))
    walked, total = P.search_block(block, pairs, number, best, 1)
    assert best.scores.tolist() == [200] and best.ids.tolist() == [0]
    assert block.lists[1][1] == 71 and walked < 20 < total
    block.lists[1] = block.lists[1][0], 140  # the sum of both maxima
    best = P.Best(np.array([100]), np.array([5000]))
    walked, _ = P.search_block(block, pairs, number, best, 1)
    assert best.scores.tolist() == [200] and walked > 1500


def test_random_blocks_keep_every_best():
    r = random.Random(2)
    for trial in range(300):
        n = 60
        postings = {t: {d: r.randrange(1, 50) for d in r.sample(range(n), r.randrange(1, n))} for t in range(6)}
        units = [(0, 1), (2, 3), (4, 5)] if trial % 2 else [(0, 1), (2,), (3,), (4, 5)]
        pairs = [u for u in units if len(u) == 2]
        block = block_of(postings, pairs, n)
        best = P.Best(np.zeros(0, np.int64), np.zeros(0, np.int64))
        best.add(np.array([r.randrange(50, 250) for _ in range(4)]), np.arange(900, 904), 4)
        held = list(zip(best.scores.tolist(), best.ids.tolist()))
        P.search_block(block, units, {p: i for i, p in enumerate(pairs)}, best, 4)
        every = [(sum(p.get(d, 0) for p in postings.values()), d) for d in range(n)] + held
        assert list(zip(best.scores.tolist(), best.ids.tolist())) == sorted(every, key=lambda x: (-x[0], x[1]))[:4]
        assert not block.score.any()


def test_a_file_of_the_index_holds_one_block(spark):
    """All rows of a file are in memory at once; a large split gave many blocks."""
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i}") for i in range(60)], "doc_id long, text string").coalesce(1)
    index = P.build_index(docs, block_bytes=200)
    n = index.count()
    assert n > 5 and len(index.inputFiles()) == n and index.agg({"n_docs": "sum"}).first()[0] == 60
