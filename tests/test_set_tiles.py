"""Pairs of sets, tile against tile, against brute force; and that no set is sent once per tile."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import set_tiles as T
from plumbline.operators import similarity as J
from plumbline.plans import fixtures as X


def draw(n, seed, label="abc"):
    r = random.Random(seed)
    rows = [(i, sorted(set(r.choices(range(30), k=r.randint(0, 6)) + r.choices(range(100, 10_000), k=r.randint(0, 5)))), r.choice(label)) for i in range(n)]
    return rows + [(n, [1, 2, 3], "a"), (n + 1, [1, 2, 3], "b"), (n + 2, [], "a")]


def tan(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a & b else 0.0


@pytest.fixture
def small(monkeypatch):
    """Many tiles, groups of several tiles, and common elements in a small table."""
    for name, value in (("SAMPLE", 1), ("COMMON_FROM", 2), ("ELEMENTS_PER_TASK", 150)):
        monkeypatch.setattr(T, name, value)
    monkeypatch.setattr(J, "ELEMENTS_PER_BLOCK", 12)


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, els array<bigint>, label string")


def test_neighbours_in_many_tiles(spark, small):
    rows = draw(150, 1)
    got = {}
    for r in J.knn_sets(table(spark, rows), "id", "els", 3).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.nbr, r.sim)
    for i, s, _ in rows:
        want = sorted((-tan(s, t), j) for j, t, _ in rows if j != i)[:3]
        assert got[i] == {k + 1: (j, pytest.approx(-v)) for k, (v, j) in enumerate(want)}
    assert len(J.tiled(J.set_table(table(spark, rows), "id", "els"))[0].collect()) > 10


def test_nearest_of_two_tables_in_many_tiles(spark, small, monkeypatch):
    monkeypatch.setattr(J, "FEW_ELEMENTS", 0)
    test, train = draw(60, 2), draw(130, 3)
    words = lambda rows: table(spark, rows).withColumn("els", F.transform("els", lambda e: F.concat(F.lit("w"), e.cast("string"))))
    got = {r.id: (r.nn_sim, r.nn_id) for r in J.nn_similarity(words(test), words(train), "id", "els").collect()}
    for i, s, _ in test:
        sim, j = max((tan(s, t), -j) for j, t, _ in train)
        assert got[i] == (pytest.approx(sim), -j if sim else None)


def test_label_sums_in_many_tiles(spark, small):
    rows = draw(90, 4)
    df = table(spark, rows)
    got = J.label_similarity(df, "id", "els", "label").collect()
    apart = J.label_similarity(df.drop("label"), "id", "els", "label", df.drop("els")).collect()
    same = lambda found: sorted((r.id, r.own, r.label, r.n_label, round(r.sum_sim, 9)) for r in found)
    assert same(got) == same(apart)
    for r in got:
        mine = next(s for i, s, _ in rows if i == r.id)
        theirs = [t for _, t, x in rows if x == r.label]
        assert r.n_label == len(theirs) and r.sum_sim == pytest.approx(sum(tan(mine, t) for t in theirs))


def test_rows_without_a_label_are_only_compared_with(spark):
    rows = [(1, [1, 2], "a"), (2, [2, 3], "b"), (3, [1, 2, 3], None)]
    got = {(r.id, r.own, r.label): (r.n_label, round(r.sum_sim, 6)) for r in J.label_similarity(table(spark, rows), "id", "els", "label").collect()}
    assert got == {(1, "a", "a"): (1, 1.0), (1, "a", "b"): (1, 0.333333), (1, "a", "None"): (1, 0.666667),
                   (2, "b", "a"): (1, 0.333333), (2, "b", "b"): (1, 1.0), (2, "b", "None"): (1, 0.666667)}


def test_tiles_meet_without_a_shuffle(spark, small):
    """The pairs read both sides from the scratch folder; before, a set was shuffled once for every tile that it met."""
    own = J.tiled(J.set_table(table(spark, draw(90, 5)), "id", "els"))[0]
    for df in (T.nearest_in_tiles(own, None, 2), T.nearest_in_tiles(own, own, 1), T.label_sums(own, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
    assert max(len(r.rid) for r in own.collect()) <= 60 and T.distinct_sets(own).count() == len({tuple(s) for _, s, _ in draw(90, 5) if s})


def test_overlaps_of_two_tiles(monkeypatch):
    monkeypatch.setattr(T, "DENSE", 3)
    monkeypatch.setattr(T, "PAIRS_AT_ONCE", 40)
    r = random.Random(3)
    sets = [(sorted(r.sample(range(12), r.randint(0, 8))), sorted(r.sample(range(10**12, 10**12 + 9), r.randint(1, 6)))) for _ in range(30)]

    def tile(part):
        return T.Tile({"rid": pa.array(range(len(part))), "n": pa.array([len(c) + len(o) for c, o in part]), "weights": None,
                       "n_codes": pa.array([len(c) for c, _ in part]), "n_others": pa.array([len(o) for _, o in part]),
                       "codes": np.array([x for c, _ in part for x in c], np.uint16).tobytes(), "others": np.array([x for _, o in part for x in o], np.int64).tobytes()})

    left, right = tile(sets[:17]), tile(sets[17:])
    got = np.concatenate([out.copy() for _, _, out in T.overlaps(left, right)])
    assert got.tolist() == [[len(set(a) & set(c)) + len(set(b) & set(d)) for c, d in sets[17:]] for a, b in sets[:17]]


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("ab cd ef gh ij kl mn op".split(), k=r.randint(1, 9))), r.choice(["en", "de"]), f"s{i % 12}", r.randint(5, 90)) for i in range(60)]
    rows += [rows[4], rows[4], rows[17], rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_slices_without_similarities_have_the_same_rows(spark, folder, monkeypatch):
    asked = []
    nearest = X.nn_similarity
    monkeypatch.setattr(X, "nn_similarity", lambda *a: asked.append(1) or nearest(*a))
    plain = X.slice_plain(spark, folder)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert not asked
    assert rows(plain) == rows(X.slice_scores(spark, folder).drop("nn_sim")) and len(asked) == 1


def test_held_sets_are_not_shuffled(spark, folder):
    for split in ("stratified", "source"):
        p = X.primary(spark, folder).where(F.col("split") == split)
        for role in ("train", "test"):
            df = X._held(spark, folder, split, role)
            want = X.sets(spark, folder).join(p.where(F.col("role") == role), "id", "left_semi")
            assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
            assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_threshold_joins_in_many_tiles(spark, small):
    """Exact and by bands; the pairs of the bands are those of the index as a table."""
    from plumbline.operators import minhash as M

    rows = draw(150, 6)
    df = table(spark, rows)
    first = {}
    for i, s, _ in rows:
        first.setdefault(tuple(s), i)
    want = {(a, b): tan(s, t) for s, a in first.items() for t, b in first.items() if a < b and tan(s, t) >= 0.2}
    exact = {(r.id_a, r.id_b): r.sim for r in J.tanimoto_join(df, None, "id", "els", 0.2).collect()}
    assert exact.keys() == want.keys() and all(exact[k] == pytest.approx(v) for k, v in want.items())
    sets = J.set_table(df, "id", "els")
    reps = J.representatives(sets)
    asked = {(r.q, r.r) for r in M.likely_pairs(reps, None, 0.2, 3, 2).collect()}
    got = {(r.q, r.r): r.sim for r in M.verified_in_tiles(sets, None, 0.2, 3, 2, M.SEED).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if k in asked} and 0 < len(got) < len(want)
    other = draw(40, 7)
    found = {(r.id_a, r.id_b) for r in J.tanimoto_join(df, table(spark, other), "id", "els", 0.2).collect()}
    second = {}
    for i, s, _ in other:
        second.setdefault(tuple(s), i)
    assert found == {(a, b) for s, a in first.items() for t, b in second.items() if tan(s, t) >= 0.2}
