"""Set similarity, neighbours and clusters against brute force on small tables with groups of copies."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators import similarity as J
from plumbline.operators import splits as S
from plumbline.operators import vectors as V


def make(n, seed, copies=True):
    rng = random.Random(seed)
    sets = []
    for i in range(n):
        if copies and i % 3 == 0:
            sets.append({1, 2, 3, 4, 5})  # a third of the rows are the same
        elif i % 11 == 5:
            sets.append(set())
        else:
            base = set(rng.sample(range(60), rng.randint(1, 9)))
            sets.append(base | ({0} if rng.random() < 0.8 else set()))
    return sets


def tan(a, b):
    return len(a & b) / len(a | b) if a & b else 0.0


@pytest.fixture(scope="module", params=[400_000, 60])
def table(spark, request):
    """The second parameter forces many small blocks, so that routing is exercised."""
    old = J.ELEMENTS_PER_BLOCK, J.QUERIES_PER_CHUNK, J.BLOCKS_PER_RARE_ELEMENT
    J.ELEMENTS_PER_BLOCK = request.param
    J.QUERIES_PER_CHUNK, J.BLOCKS_PER_RARE_ELEMENT = (2000, 4) if request.param > 1000 else (13, 1)
    sets = make(120, 5)
    yield sets, spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, els array<bigint>")
    J.ELEMENTS_PER_BLOCK, J.QUERIES_PER_CHUNK, J.BLOCKS_PER_RARE_ELEMENT = old


def test_nn(table):
    sets, df = table
    got = {r["id"]: r for r in J.nn_similarity(df.where("id < 40"), df.where("id >= 40"), "id", "els").collect()}
    assert len(got) == 40
    for i in range(40):
        best = max((tan(sets[i], sets[j]), -j) for j in range(40, 120))
        assert got[i]["nn_sim"] == pytest.approx(best[0])
        assert got[i]["nn_id"] == (-best[1] if best[0] > 0 else None)


def test_self_nn_and_knn(table):
    sets, df = table
    got = {r["id"]: r for r in J.self_nn_similarity(df, "id", "els").collect()}
    knn = {}
    for r in J.knn_sets(df, "id", "els", 4).collect():
        knn.setdefault(r["id"], {})[r["rank"]] = r["nbr"]
    for i in range(120):
        order = sorted((-tan(sets[i], sets[j]), j) for j in range(120) if j != i)
        assert got[i]["nn_sim"] == pytest.approx(-order[0][0])
        assert got[i]["nn_id"] == (order[0][1] if order[0][0] < 0 else None)
        assert knn[i] == {k + 1: j for k, (_, j) in enumerate(order[:4])}


def test_knn_of_few_rows(spark):
    df = spark.createDataFrame([(1, [5]), (2, [5]), (3, []), (9, [6])], "id bigint, els array<bigint>")
    got = {(r.id, r["rank"]): (r.nbr, r.sim) for r in J.knn_sets(df, "id", "els", 5).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.0), (1, 3): (9, 0.0), (2, 1): (1, 1.0), (2, 2): (3, 0.0), (2, 3): (9, 0.0),
                   (3, 1): (1, 0.0), (3, 2): (2, 0.0), (3, 3): (9, 0.0), (9, 1): (1, 0.0), (9, 2): (2, 0.0), (9, 3): (3, 0.0)}


def test_neighbours_kept(spark):
    from plumbline.operators.geometry import neighbours_kept

    a = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1)], "id long, rank long, nbr long")
    b = spark.createDataFrame([(11, 1, 13), (11, 2, 14), (12, 1, 11), (12, 2, 13), (13, 1, 12)], "id long, rank long, nbr long")
    ids = spark.createDataFrame([(i, i + 10) for i in range(1, 4)], "a_id long, b_id long")
    assert tuple(neighbours_kept(a, b, 2, ids).first()) == (3, 3, 0.5)
    assert tuple(neighbours_kept(a, b, 1, ids).first()) == (3, 1, pytest.approx(1 / 3))


def test_threshold_join(table):
    sets, df = table
    got = {(r["id_a"], r["id_b"]): r for r in J.tanimoto_join(df, None, "id", "els", 0.3).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    reps = sorted(first.values())
    exp = {(a, b): tan(sets[a], sets[b]) for a in reps for b in reps if a < b and tan(sets[a], sets[b]) >= 0.3}
    assert set(got) == set(exp)
    for k, v in exp.items():
        assert got[k]["sim"] == pytest.approx(v)
        assert got[k]["copies_a"] == sum(s == sets[k[0]] for s in sets)


def test_butina(table):
    sets, df = table
    got = {r["id"]: r["cluster"] for r in G.butina(df, "id", "els", 0.4).collect()}
    n = len(sets)
    nb = [{j for j in range(n) if j != i and tan(sets[i], sets[j]) >= 0.4 - 1e-12} for i in range(n)]
    exp = {}
    for i in sorted(range(n), key=lambda i: (-len(nb[i]), i)):
        if i not in exp:
            exp[i] = i
            for j in nb[i]:
                exp.setdefault(j, i)
    assert got == exp


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(900, i) for i in range(901, 960)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    nodes = spark.range(1100)
    got = {r["id"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), nodes).collect()}
    assert len(got) == 1100 and all(got[i] == (find(i) if i in parent else i) for i in got)


def test_knn_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5))
    x[::3] = x[0]
    old = V.VECTORS_PER_BLOCK
    V.VECTORS_PER_BLOCK = 20
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {(r["id"], r["rank"]): r["nbr"] for r in V.knn_vectors(df, "id", "v", 4).collect()}
    V.VECTORS_PER_BLOCK = old
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    for i in range(150):
        order = sorted((d[i, j], j) for j in range(150) if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in order]


def test_water_fill_equals_one_by_one():
    rng = random.Random(0)
    for _ in range(300):
        levels, size, m = [rng.randrange(50) for _ in range(rng.randint(1, 8))], rng.randint(1, 9), rng.randint(1, 60)
        got = S._water_fill(list(levels), size, m, random.Random(1))
        one = list(levels)
        for _ in range(m):
            one[one.index(min(one))] += size
        assert sorted(x + c * size for x, c in zip(levels, got)) == sorted(one)


def test_group_split_rules(spark):
    data = [(i, "big" if i < 60 else f"g{i // 3}") for i in range(120)]
    df = spark.createDataFrame(data, "id bigint, g string")
    parts = S.group_disjoint_split(df, "id", "g", 1, 0.1)
    assert parts.where("role = 'test'").count() == 12
    assert S.shared_groups(parts.withColumn("p", F.lit(0)), df.withColumnRenamed("g", "grp"), ["p"]).count() == 0
    only = S.group_disjoint_split(df.where("g = 'big'"), "id", "g", 1, 0.1)
    assert only.where("role = 'test'").count() == 60  # the first group is taken even if it is too large
    folds = S.balanced_group_folds(df, "id", "g", 4, 3)
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sum(sizes.values()) == 120 and sorted(sizes.values()) == [18, 21, 21, 60]
    assert folds.join(df, "id").groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_a_set_travels_once_per_tile(spark, monkeypatch):
    """Many small blocks in one tile: a query goes there once, and not once per block that it visits."""
    monkeypatch.setattr(J, "ELEMENTS_PER_BLOCK", 60)
    sets = make(120, 8)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "rid bigint, els array<bigint>").withColumn("n", F.size("els")).where("n > 0")
    blocks = J._Blocks(df)
    assert blocks.total > 10
    every = df.select(F.col("rid").alias("q"), F.inline(blocks.classes()))
    visits = every.select("q", "cls", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("blk"))
    assert visits.count() == df.count() * blocks.total
    placed = J._placed(visits, blocks).collect()
    assert len(placed) == df.count() and all(sorted(r.nos) == list(range(blocks.total)) for r in placed)
