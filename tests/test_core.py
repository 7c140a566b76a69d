"""Distributed ranking, quantiles, top-k and the statistics built on them, against plain Python."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.core import ranked, running_total, value_ranks
from plumbline.operators import inference as I
from plumbline.operators import metrics as M
from plumbline.operators import ranking as W


@pytest.fixture(scope="module")
def rows(spark):
    """A hot key with a third of the rows and a hot value inside it, plus a null key."""
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 17}"), i, 1.0 if i % 2 else round(rng.random(), 2)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, id bigint, v double").repartition(7)


def test_ranked_equals_row_number(rows):
    got = ranked(rows, ["k"], [F.col("v").desc(), F.col("id").asc()]).toPandas()
    exp = rows.toPandas().sort_values(["v", "id"], ascending=[False, True])
    exp["rn"] = exp.groupby("k", dropna=False).cumcount() + 1
    m = got.merge(exp[["id", "rn"]], on="id", suffixes=("", "_e"))
    assert len(m) == 3000 and (m.rn == m.rn_e).all()


def test_running_total_and_midranks(rows):
    cum = running_total(rows.withColumn("one", F.lit(2)), [], ["id"], "one", "upto").toPandas().sort_values("id")
    assert (cum.upto.to_numpy() == 2 * np.arange(1, 3001)).all()
    mid = rows.where("k = 'hot'").join(value_ranks(rows, ["k"], "v"), ["k", "v"]).toPandas()
    assert np.allclose(mid.midrank, mid.v.rank())


def test_quantiles(rows):
    pdf = rows.where("k is not null").toPandas()
    got = W.quantiles(rows.where("k is not null"), "v", [0.1, 0.5, 0.99], ["k"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k].to_numpy(float), np.quantile(g.v, [0.1, 0.5, 0.99]))
    hi = W.quantile_higher(rows, "v", [0.9]).first()["q0"]
    assert hi == np.quantile(rows.toPandas().v, 0.9, method="higher")


def test_top_fraction_half_even(spark):
    df = spark.range(170).withColumn("s", F.lit(1.0))
    got = [r["id"] for r in W.top_fraction(df, "s", 0.05, "id").collect()]
    assert sorted(got) == list(range(8))  # 8.5 rounds to 8, ties by id


def test_bh(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.04, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    got = W.bh_adjust(df, "p", "id").orderBy("id").toPandas().p_adj.to_numpy()
    o = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((np.array(p)[o] * 6 / np.arange(1, 7))[::-1])[::-1]
    exp = np.empty(6)
    exp[o] = np.minimum(adj, 1)
    assert np.allclose(got, exp)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("flat", 1.0, 2.0), ("flat", 1.0, 1.0), ("one", 3.0, 3.0)], "g string, y double, pred double")
    got = {r["g"]: r for r in M.regression_metrics(df, ["g"]).collect()}
    assert got["flat"]["r2"] is None and got["one"]["r2"] is None and got["flat"]["rmse"] == pytest.approx(0.5**0.5)


def test_spearman_weighted_by_ties(rows):
    pdf = rows.toPandas()
    pdf["w"] = (pdf.id * 37 % 11).astype(float)
    df = rows.withColumn("w", (F.col("id") * 37 % 11).cast("double"))
    assert M.spearman(df, "v", "w").first()["spearman"] == pytest.approx(pdf.v.rank().corr(pdf.w.rank()))
    const = rows.withColumn("w", F.lit(1.0))
    assert M.spearman(const, "v", "w").first()["spearman"] is None



def test_wilcoxon_and_ks(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    y = [1.0, 1.0, 5.0, 3.0, 1.0, 9.0]
    w = I.wilcoxon(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y").first()
    # differences 1, -2, 1, 4, -3 after the zero is dropped: ranks 1.5, 3, 1.5, 5, 4
    assert (w["n"], w["w_plus"], w["w_minus"]) == (5, 8.0, 7.0)
    ks = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "s string, v double")
    assert I.ks_2samp(ks, "v", "s", "a").first()["d"] == pytest.approx(0.5)


def test_bootstrap_matches_plain_resampling(spark):
    """The weight table scores exactly the resamples that its draws describe."""
    import hashlib

    rng = np.random.default_rng(1)
    y, p = rng.normal(size=30), rng.normal(size=30)
    df = spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "model string, id bigint, y double, pred double")
    got = {r["b"]: r["r2"] for r in I.bootstrap_scores(df, [], 5, 9).collect()}
    for b in range(5):
        idx = [int(hashlib.md5(f"9:{b}:{s}".encode()).hexdigest()[:8], 16) % 30 for s in range(30)]
        e, t = y[idx] - p[idx], y[idx] - y[idx].mean()
        assert got[b] == pytest.approx(1 - (e @ e) / (t @ t))


def test_friedman_golden(spark):
    data = [(b, t, s) for b, r in enumerate([[3, 2, 1], [3, 1, 2], [3, 2, 1]]) for t, s in zip("xyz", map(float, r))]
    f = I.friedman(spark.createDataFrame(data, "b int, t string, s double"), "b", "t", "s").first()
    # rank sums 9, 5, 4 over 3 blocks of 3
    assert f["chi2"] == pytest.approx(12 / 36 * (81 + 25 + 16) - 36) and f["kendall_w"] == pytest.approx(12 * (9 + 1 + 4) / (9 * 24))
