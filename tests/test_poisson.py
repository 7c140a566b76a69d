"""Poisson bootstraps against the same weights in plain Python."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import poisson as Q


def weight(seed, key, b):
    m = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    h = [int(m[8 * i:8 * i + 8], 16) % Q.PRIME for i in range(3)]
    u = (h[2] + b * h[1] + b * b * h[0]) % Q.PRIME
    return sum(u >= t for t in Q.BOUNDS)


def test_weights_are_poisson():
    h = np.array([[int(hashlib.md5(f"{i}".encode()).hexdigest()[8 * j:8 * j + 8], 16) % Q.PRIME for j in range(3)] for i in range(1000)])
    w = Q.weights(h, 500)
    share = np.bincount(w.astype(int).ravel(), minlength=6)[:6] / w.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(6)], atol=0.004)
    assert abs(np.corrcoef(w[:, 3], w[:, 4])[0, 1]) < 0.1 and abs(np.corrcoef(w[5], w[6])[0, 1]) < 0.2
    assert abs(w.sum(axis=0).std() / math.sqrt(1000) - 1) < 0.15


@pytest.fixture(scope="module")
def preds():
    r = random.Random(1)
    rows = []
    for part in ("a", "b"):
        for i in range(70):
            y = r.choice([0.0, 1.0, 1.0, r.gauss(0, 1)])
            for m in ("m1", "m2"):
                rows.append((part, m, i, y, r.choice([y, 0.5, r.gauss(0, 1)]), y > 0.9))
    return rows


COLS = "part string, model string, id long, y double, pred double, act boolean"


def test_scores(spark, preds, monkeypatch):
    monkeypatch.setattr(Q, "_CELLS", 300)
    monkeypatch.setattr(Q, "_GROUPS", 1)
    df = spark.createDataFrame(preds, COLS).repartition(3)
    got = {(r.part, r.model, r.b): r for r in Q.poisson_scores(df, ["part"], 20, 5).collect()}
    assert len(got) == 2 * 2 * 20
    for part in ("a", "b"):
        for m in ("m1", "m2"):
            rows = [(i, y, p) for q, n, i, y, p, _ in preds if q == part and n == m]
            for b in range(20):
                w = np.array([weight(5, f"{part}:{i}", b) for i, _, _ in rows])
                y, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
                mean = (w * y).sum() / w.sum()
                r2 = 1 - (w * (y - p) ** 2).sum() / (w * (y - mean) ** 2).sum()
                r = got[part, m, b]
                assert (r.r2, r.rmse, r.mae) == pytest.approx((r2, math.sqrt((w * (y - p) ** 2).sum() / w.sum()), (w * abs(y - p)).sum() / w.sum()))


def test_no_weight_rows_in_the_plan(spark, preds):
    """Nothing is exploded or joined per row and resample: the only generator is the one over arrays of partial sums."""
    df = Q.poisson_scores(spark.createDataFrame(preds, COLS), ["part"], 2000, 5)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("MapInArrow")


@pytest.mark.parametrize("keys, cells, ranks", [(["part"], 1 << 21, 1 << 24), (["part"], 60, 900), ([], 60, 200)])
def test_rank(spark, preds, monkeypatch, keys, cells, ranks):
    """Mid ranks, top fractions and correlations of the resampled rows written out; small pieces, ties across pieces, many ranges."""
    monkeypatch.setattr(Q, "_CELLS", cells)
    monkeypatch.setattr(Q, "_RANKS_PER_RANGE", ranks)
    rows = [r for r in preds if r[1] == "m1" and (keys or r[0] == "a")]
    df = spark.createDataFrame(rows, COLS).repartition(3)
    got = {(*[r[k] for k in keys], r.b): r for r in Q.bootstrap_rank(df, keys, 12, 3, "act", 0.2).collect()}
    assert len(got) == 12 * (2 if keys else 1)
    for part in ("a", "b") if keys else ("a",):
        for b in range(12):
            sample = []
            for q, _, i, y, p, act in rows:
                if q == part:
                    sample += [(y, p, act, i)] * weight(3, f"{part}:{i}" if keys else f"{i}", b)
            rank = lambda v: np.array([sum(x < u for x in v) + (sum(x == u for x in v) + 1) / 2 for u in v])
            rho = np.corrcoef(rank([s[0] for s in sample]), rank([s[1] for s in sample]))[0, 1]
            k = max(1, int(np.rint(len(sample) * 0.2)))
            top = sorted(sample, key=lambda s: (-s[1], s[3]))[:k]
            rate, base = sum(s[2] for s in top) / k, sum(s[2] for s in sample) / len(sample)
            r = got[(part, b) if keys else (b,)]
            assert (r.spearman, r.hit_rate, r.ef) == pytest.approx((rho, 100 * rate, rate / base))


def test_rank_without_actives(spark):
    df = spark.createDataFrame([("x", "m", i, float(i), 1.0, False) for i in range(9)], COLS)
    for r in Q.bootstrap_rank(df, [], 5, 1, "act", 0.5).collect():
        assert r.ef is None and r.hit_rate is None and r.spearman is None
    assert Q.bootstrap_rank(df.where(F.lit(False)), [], 5, 1, "act", 0.5).count() == 0
