"""Steps that must not grow faster than their input: vectors by blocks, packed shingles, medians sent to the rows."""
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions.features import shingle_bits
from plumbline.operators import attribution, vectors
from plumbline.operators.inference import levene


def _vectors(n, seed=5):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(size=(n, 6)), 1).astype(np.float32) + np.float32(50)
    v[1::7] = v[0]  # equal vectors
    return v


def test_nearest_in_blocks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS_PER_BLOCK", 40)
    monkeypatch.setattr(vectors, "PAIRS_AT_ONCE", 200)
    v = _vectors(150)
    df = spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "id bigint, vec array<float>, label string")
    d = np.round(np.sqrt(((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    want = {i: np.lexsort((np.arange(150), d[i]))[:4].tolist() for i in range(150)}
    got = {}
    for r in sorted(vectors.knn_vectors(df, "id", "vec", 4).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.nbr)
        assert r.dist == d[r.id, r.nbr]
    assert got == want
    np.fill_diagonal(d, 0)
    for r in vectors.label_distances(df, "id", "vec", "label").collect():
        assert abs(r.sum_dist - d[r.id, "ab".index(r.label)::2].sum()) < 1e-6 and r.n_label == 75


def test_cells_are_not_smaller_than_blocks(spark):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(_vectors(60))], "id bigint, vec array<double>")
    assert len(vectors._pivots(rows, 100_000)) <= 10


def test_shingles_travel_packed(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij kl".split(), k=rng.randint(0, 40)))) for i in range(30)] + [(3, "again x"), (50, None)]
    got = shingle_bits(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 2, 2048)
    want = {}
    for i, t in rows:
        w = (t or "").split()
        bits = want.setdefault(i, set())
        bits |= {int(hashlib.md5(s.encode()).hexdigest()[:15], 16) % 2048 for s in [*w, *(" ".join(p) for p in zip(w, w[1:]))]}
    assert {r.id: r.bits for r in got.collect()} == {i: sorted(b) for i, b in want.items()}
    assert "collect_set" not in got._jdf.queryExecution().toString()


def test_sides_of_levene_do_not_meet_in_one_task(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("side"), (F.col("id") % 37).cast("double").alias("x"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = levene(rows, "x", "side")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [side" not in plan


def test_units_of_the_draws_of_faithfulness_are_not_sorted_by_range(spark):
    units = spark.range(60).select((F.col("id") % 4).alias("id"), F.floor(F.col("id") / 4).alias("unit"))
    scores = units.withColumn("method", F.explode(F.array(F.lit("m"), F.lit("n")))).withColumn("score", F.when(F.col("method") == "m", F.col("unit")).otherwise(-F.col("unit")).cast("double"))
    weights = units.where("unit <> 0").withColumn("weight", (F.col("unit") - 7) / 10.0)
    out = attribution.top_unit_drops(scores, weights.unionByName(weights.where("id = 1")), draws=3)
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
    got = {(r.id, r.method): r for r in out.collect()}
    number = lambda i, b, u: int(hashlib.md5(f"0:{i}:{b}:{u}".encode()).hexdigest()[:8], 16) % 2**31
    for i in range(4):
        w = {u: (u - 7) / 10 * (2 if i == 1 else 1) for u in range(1, 15)}
        drawn = [abs(sum(w.get(u, 0) for u in sorted(range(15), key=lambda u: (number(i, b, u), u))[:3])) for b in range(3)]
        for method, top in (("m", (14, 13, 12)), ("n", (0, 1, 2))):
            assert abs(got[i, method].top_drop - abs(sum(w.get(u, 0) for u in top))) < 1e-9
            assert abs(got[i, method].random_drop - sum(drawn) / 3) < 1e-9
