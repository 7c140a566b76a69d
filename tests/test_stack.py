"""Stacks of many partitions at once against refits that leave one row out."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import models

MEMBERS, ALPHAS = ["A", "B", "C"], [0.01, 1.0, 30.0, 1000.0]
SETS = {"full": [0, 1, 2], "without_b": [0, 2]}


def ridge(x, y, alpha):
    mx, my = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def brute(x, y):
    """The leave-one-out error keeps the axes and means of all rows, as the closed form does, and takes the row's own pull away."""
    n, best = len(y), None
    xc, yc = x - x.mean(axis=0), y - y.mean()
    for a in ALPHAS:
        hat = xc @ np.linalg.inv(xc.T @ xc + a * np.eye(x.shape[1])) @ xc.T + 1 / n
        e = (((yc - (hat - 1 / n) @ yc) / (1 - np.diag(hat))) ** 2).sum()
        if best is None or e < best[0]:
            best = e, a
    return best[1], *ridge(x, y, best[1])


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(4)
    rows = []
    for part, noise in (("p", 0.3), ("q", 5.0)):
        for i in range(60):
            y = float(r.normal())
            x = [y + float(r.normal()) * noise, 0.5 * y + float(r.normal()), float(r.normal())]
            x[2] = x[2] if part == "q" else x[0]  # a member that repeats another
            rows += [(part, i, "train" if i < 45 else "test", y, m, p) for m, p in zip(("a | 1", "b+c | 1", "c | 1"), x)]
    rows.append(("p", 99, "test", 0.0, "a | 1", 0.0))  # lacks two members
    preds = spark.createDataFrame(rows, "part string, id long, role string, y double, model string, pred double")
    chosen = spark.createDataFrame([(p, f, m, m.split(" | ")[0]) for p in "pq" for f, m in zip(MEMBERS, ("a | 1", "b+c | 1", "c | 1"))], "part string, member string, model string, rep string")
    return rows, preds, chosen


def test_stacks_of_all_partitions(table):
    rows, preds, chosen = table
    cols = models.prediction_columns(preds, chosen, ["part"], MEMBERS)
    sets = models.member_sets(chosen, ["part"], {"without_b": ["b"], "none": ["zzz"]})
    out, weights = models.stack(cols, sets, ["part"], MEMBERS, ALPHAS)
    wide = {}
    for part, i, role, y, m, p in rows:
        wide.setdefault((part, i, role, y), []).append(p)
    wide = {k: v for k, v in wide.items() if len(v) == 3}
    got = {(r.part, r.members): r for r in weights.collect()}
    assert set(got) == {(p, s) for p in "pq" for s in SETS}
    preds_of = {(r.part, r.members, r.id): r.pred for r in out.collect()}
    assert len(preds_of) == len(wide) * 2
    for part, name in got:
        keep = SETS[name]
        train = [(k, v) for k, v in wide.items() if k[0] == part and k[2] == "train"]
        alpha, w, b = brute(np.array([v for _, v in train])[:, keep], np.array([k[3] for k, _ in train]))
        r = got[part, name]
        assert r.alpha == alpha and r.n == 45
        full = np.zeros(3)
        full[keep] = w
        assert [r[m] for m in MEMBERS] == pytest.approx(full.tolist(), abs=1e-9)
        for k, v in wide.items():
            if k[0] == part:
                assert preds_of[part, name, k[1]] == pytest.approx(float(np.array(v) @ full + b))


def test_stack_without_rows(table):
    _, preds, chosen = table
    cols = models.prediction_columns(preds.where(F.lit(False)), chosen, ["part"], MEMBERS)
    out, weights = models.stack(cols, models.member_sets(chosen, ["part"], {}), ["part"], MEMBERS, ALPHAS)
    assert out.count() == 0 and weights.count() == 0
