"""Threshold joins by prefixes and by MinHash bands against all pairs, with hot elements and groups of copies."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.core import settle
from plumbline.operators import minhash as M
from plumbline.operators import prefix_join as P
from plumbline.operators import similarity as J


def tan(a, b):
    return len(a & b) / len(a | b) if a & b else 0.0


def families(n, seed, vocabulary=400):
    """Sets around common ancestors, so that similarities of every size occur."""
    rng = random.Random(seed)
    roots = [set(rng.sample(range(vocabulary), rng.randint(3, 40))) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        s = set(rng.choice(roots))
        for _ in range(rng.randint(0, 12)):
            s ^= {rng.randrange(vocabulary)}
        out.append(s | {7})  # an element that all sets share
    return out + [set(), {1}, {7}]


def table(spark, sets, name="els"):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], f"rid bigint, {name} array<bigint>")


@pytest.mark.parametrize("min_sim, rows_per_key", [(0.3, 2000), (0.5, 7), (0.8, 7), (1.0, 2000)])
def test_prefix_self_join(spark, min_sim, rows_per_key):
    sets = families(150, 1)
    got = {(r.q, r.r): r.sim for r in P.similar_pairs(table(spark, sets), None, min_sim, rows_per_key=rows_per_key).collect()}
    exp = {(i, j): tan(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and tan(a, b) >= min_sim - 1e-12}
    assert got.keys() == exp.keys() and all(got[k] == pytest.approx(exp[k]) for k in exp)


@pytest.mark.parametrize("more", [0, 1, 5])
def test_prefix_join_of_two_tables(spark, more):
    a, b = families(90, 2), families(90, 3) + families(40, 2)
    got = [(r.q, r.r) for r in P.similar_pairs(table(spark, a), table(spark, b), 0.45, more=more, rows_per_key=11).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and tan(x, y) >= 0.45 - 1e-12}


def test_bounds_drop_candidates(spark):
    """Sets that share one frequent element and little else are never verified."""
    rng = random.Random(4)
    sets = [{0, *rng.sample(range(1, 5000), 30)} for _ in range(300)]
    assert P.candidate_pairs(settle(table(spark, sets)), None, 0.6).count() < 5


def test_prefix_join_limits(spark):
    empty = table(spark, []).where(F.lit(False))
    assert P.similar_pairs(empty, None, 0.5).count() == 0
    assert P.similar_pairs(table(spark, [{1}, {1, 2}]), empty, 0.5).count() == 0
    with pytest.raises(ValueError):
        P.similar_pairs(empty, None, 0.0)


def test_plan_bands():
    for s in (0.2, 0.4, 0.6, 0.8, 0.95, 1.0):
        bands, rows = M.plan_bands(s, 0.95)
        assert bands * rows <= M.MAX_HASHES and 1 - (1 - s**rows) ** bands >= 0.95 - 1e-12
    with pytest.raises(ValueError):
        M.plan_bands(0.001, 0.99)


@pytest.mark.parametrize("min_sim", [0.4, 0.6])
def test_minhash_recall(spark, min_sim):
    sets = families(400, 8)
    sets += [sets[5]] * 30  # copies: one representative
    df = table(spark, sets).withColumnRenamed("rid", "id")
    got = {(r.id_a, r.id_b): r for r in M.minhash_join(df, None, "id", "els", min_sim).collect()}
    exact = {(r.id_a, r.id_b): r for r in J.tanimoto_join(df, None, "id", "els", min_sim).collect()}
    assert len(exact) > 200 and got.keys() <= exact.keys()  # nothing below the bound, no pair twice
    assert len(got) >= 0.9 * len(exact)
    assert all(got[k] == exact[k] for k in got)


def test_minhash_hot_band(spark):
    """One band value in all sets: split over sub-keys, still every pair once."""
    sets = [set(range(50)) | {100 + i} for i in range(120)]
    pairs = [(r.q, r.r) for r in M.likely_pairs(table(spark, sets), None, 0.9, 4, 1, rows_per_key=10).collect()]
    assert len(pairs) == len(set(pairs)) and len(pairs) >= 0.98 * (120 * 119 // 2)
    assert all(q < r for q, r in pairs)


def test_minhash_of_two_tables(spark):
    a, b = families(120, 5), families(120, 5)[::-1] + families(30, 6)
    left, right = table(spark, a).withColumnRenamed("rid", "id"), table(spark, b).withColumnRenamed("rid", "id")
    got = {(r.id_a, r.id_b) for r in M.minhash_join(left, right, "id", "els", 0.5).collect()}
    exact = {(r.id_a, r.id_b) for r in J.tanimoto_join(left, right, "id", "els", 0.5).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact) > 100


def test_minhash_knn(spark):
    sets = families(200, 9) + [{1, 2, 3}] * 9
    got = {}
    for r in M.minhash_knn(table(spark, sets).withColumnRenamed("rid", "id"), "id", "els", 4, 0.4).collect():
        got.setdefault(r.id, {})[r.rank] = (r.nbr, r.sim)
    found = total = 0
    for i, s in enumerate(sets):
        best = sorted((-tan(s, t), j) for j, t in enumerate(sets) if j != i and s and tan(s, t) >= 0.4)[:4]
        mine = [got.get(i, {}).get(k + 1) for k in range(4)]
        assert all(m is None or m[1] == pytest.approx(tan(s, sets[m[0]])) for m in mine)
        total += len(best)
        found += len({j for _, j in best} & {m[0] for m in mine if m})
    assert total > 300 and found >= 0.9 * total


def test_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 1 << 62, n).tolist()) for n in (0, 1, 3, 40, 40, 700)]
    sets += [set(list(sets[3])[:35]) | {1, 2}, set(list(sets[5])[:690])]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "rid bigint, els array<bigint>")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(len(sets))], "q bigint, r bigint")
    for r in P.sketched(pairs, df, df).collect():
        real = len(sets[r.q] ^ sets[r.r])
        assert (r.n, r.m) == (len(sets[r.q]), len(sets[r.r])) and r.apart <= real and (r.apart - real) % 2 == 0
        assert 2 * min(r.n, r.m) < max(r.n, r.m) or r.apart >= 0.3 * real


def test_whole_sets_travel_only_for_pairs_that_can_match(spark, monkeypatch):
    """300 sets of 40 elements, two of which are similar: all 44,850 pairs are asked for, hardly more than one is verified whole."""
    sets = [list(range(1000 * i, 1000 * i + 40)) for i in range(299)]
    sets.append(sets[0][:39] + [7])
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "rid bigint, els array<bigint>")
    pairs = spark.createDataFrame([(i, j) for i in range(300) for j in range(i)], "q bigint, r bigint")
    asked = []
    whole = P.sketched
    monkeypatch.setattr(P, "sketched", lambda *a: asked.append(whole(*a)) or asked[-1])
    got = P.verified(pairs, df, df, 0.4).collect()
    assert [(r.q, r.r) for r in got] == [(299, 0)]
    most = (F.col("n") + F.col("m") - F.col("apart")) / 2
    assert asked[0].where(most >= 0.4 * (F.col("n") + F.col("m") - most)).count() < 50


@pytest.mark.parametrize("few", [0, 50_000])
def test_few_queries_find_the_nearest_sets_of_all(spark, monkeypatch, few):
    monkeypatch.setattr(J, "FEW_ELEMENTS", few)
    sets = families(150, 5)
    refs, asked = sets[:120], sets[120:] + [{10_001}, sets[3]]
    rows = lambda ss: spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(ss)], "id bigint, els array<bigint>")
    got = {r.id: (r.nn_sim, r.nn_id) for r in J.nn_similarity(rows(asked), rows(refs), "id", "els").collect()}
    for i, a in enumerate(asked):
        sim, j = max(((tan(a, b), -j) for j, b in enumerate(refs)))
        assert got[i] == (pytest.approx(sim), -j if sim else None)
    only = J._frequency(rows(refs), rows([{7, 10_001}]).select(F.explode("els").alias("el"))).collect()
    assert [(r.el, r.df) for r in only] == [(7, sum(7 in s for s in refs))]
