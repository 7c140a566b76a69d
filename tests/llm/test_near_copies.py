"""Near copies of the pipeline against brute force."""
import random

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm import near_copies, util


def brute_shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (ident, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), 10**9), ident)
    return sorted(best.values())


def planted():
    """Texts with one copy each in which some words differ, so that similarities lie around 0.8, and a common line."""
    r = random.Random(7)
    rows, line = [], " ".join(f"common{i}" for i in range(12))
    for d in range(120):
        w = [f"v{r.randrange(5000)}" for _ in range(r.randrange(6, 300))]
        rows.append((2 * d, " ".join(w) + ("\n" + line if d % 3 == 0 else "")))
        copy = w[:]
        for at in r.sample(range(len(w)), r.randrange(0, 1 + len(w) // 25)):
            copy[at] = f"new{r.randrange(5000)}"
        rows.append((2 * d + 1, " ".join(copy).upper() + ("\n" + line if d % 3 == 0 else "")))
    return [*rows, (1000, None), (1001, " \n"), (1002, "one two"), (1003, "one  Two"), (1004, rows[0][1]), (1005, "é ü")]


def test_near_dedup_links_every_pair_from_four_fifths_on(spark, monkeypatch):
    rows = planted()
    sets = {i: brute_shingles(t) for i, t in rows}
    share = [len(sets[2 * d] & sets[2 * d + 1]) / len(sets[2 * d] | sets[2 * d + 1]) for d in range(120)]
    assert sum(0.8 <= s < 0.9 for s in share) >= 15 and sum(0.6 < s < 0.8 for s in share) >= 15
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    monkeypatch.setattr(near_copies, "CELL", 3)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """Copies of one text, each with a word of its own: cells of two blocks link them all."""
    monkeypatch.setattr(near_copies, "CELL", 20)
    w = [f"x{i}" for i in range(150)]
    rows = [(i, " ".join([*w[:i], f"own{i}", *w[i + 1:]])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == brute_kept(rows) == [0]
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_hash_filter_misses_none(spark, monkeypatch):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    for bits in (29, 12):  # the second one is far too full
        monkeypatch.setattr(util, "FILTER_BITS", bits)
        may = util.hash_filter(rows.where("id % 10 = 0").select("h"), "h")
        got = {r.id for r in rows.where(may("h")).collect()}
        assert set(range(0, 3000, 10)) <= got and len(got) < (400 if bits == 29 else 3000)
    none = util.hash_filter(rows.where("id < 0").select("h"), "h")
    assert rows.where(none("h")).count() == 0


def test_near_dedup_links_near_fingerprints_too(spark):
    from plumbline.llm.simhash import _fingerprint

    line = " ".join(f"w{i}" for i in range(7))
    rows = [(i, " ".join([line] * 60) + " " + " ".join(f"{tail}{j}" for j in range(9)), "en") for i, tail in enumerate("abc")]
    rows += [(7, "some other words that nothing else here has", "en"), (8, None, "en"), (9, " ", "en")]
    near = lambda a, b: (_fingerprint(rows[a][1], 3) ^ _fingerprint(rows[b][1], 3)).bit_count() <= corpus_pipeline.NEAR_BITS
    sets = [brute_shingles(t) for _, t, _ in rows[:3]]
    assert near(0, 1) and near(0, 2) and all(5 * len(a & b) < 4 * len(a | b) for a in sets for b in sets if a is not b)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 7, 8]
