"""Resampling, rank tests, intervals and applicability domain.

Resamples come from hashed draws, so they are the same on any engine and any storage order. A
resample of clusters never moves rows: it is a table of weights per cluster, joined to the cluster's sums.
Rows are resampled with Poisson weights drawn inside the aggregation (``poisson``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.core import draw, ranked, running_total, settle, value_ranks, with_totals
from plumbline.functions import pvalues as P
from plumbline.operators.metrics import weighted_correlation
from plumbline.operators.ranking import quantiles


SIDES_SENT = 200_000  # medians of sides that may be sent to every task


# ---------------------------------------------------------------- draws and weights
def hashed_draws(spark: SparkSession, n: int, b: int, seed: int) -> DataFrame:
    """(b, slot, pos): b resamples of n positions out of n."""
    grid = spark.range(n * b).select((F.col("id") / n).cast("bigint").alias("b"), (F.col("id") % n).alias("slot"))
    return grid.withColumn("pos", draw(n, seed, F.col("b"), F.col("slot")))


def resample_weights(units: DataFrame, unit: str, b: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, unit, w): how often each unit is drawn when as many units are drawn as there are.

    Units are numbered in order of their id within ``keys``.
    """
    pos = settle(ranked(units.select(*keys, unit).distinct(), keys, [unit], "pos").withColumn("pos", F.col("pos") - 1))
    n = pos.groupBy(*keys).agg(F.count("*").alias("_n"))
    slots = with_totals(pos.select(*keys, F.col("pos").alias("_slot")), n, keys).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    )
    key_part = [F.col(k) for k in keys]
    drawn = slots.withColumn("pos", draw(F.col("_n"), seed, *key_part, F.col("b"), F.col("_slot")))
    w = drawn.groupBy(*keys, "b", "pos").agg(F.count("*").alias("w"))
    return w.join(pos, [*keys, "pos"]).drop("pos")


def _unit_sums(preds: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Sufficient sums of each (keys, model, unit); y is centred on the mean of the keys first."""
    centre = preds.groupBy(*keys).agg(F.avg("y").alias("_c"))
    rows = with_totals(preds, centre, keys)
    yc, e = F.col("y") - F.col("_c"), F.col("y") - F.col("pred")
    return rows.groupBy(*keys, "model", unit).agg(
        F.count("*").cast("double").alias("s0"), F.sum(yc).alias("sy"), F.sum(yc * yc).alias("syy"),
        F.sum(e * e).alias("see"), F.sum(F.abs(e)).alias("sae"),
    )


def bootstrap_scores(
    preds: DataFrame, keys: Sequence[str], b: int, seed: int, unit: str = "id",
    draw_keys: Sequence[str] | None = None, units: DataFrame | None = None,
) -> DataFrame:
    """(keys, model, b, r2, rmse, mae) on every resample.

    ``unit`` is what is resampled: rows, or a cluster column to keep clusters whole. Units are drawn
    within ``draw_keys`` (default: the keys); with ``[]`` one resample serves all partitions.
    """
    draw_keys = list(keys) if draw_keys is None else list(draw_keys)
    sums = _unit_sums(preds, keys, unit)
    w = resample_weights(preds if units is None else units, unit, b, seed, draw_keys)

    def ws(c: str):
        return F.sum(F.col("w") * F.col(c))

    tot = sums.join(w, [*draw_keys, unit]).groupBy(*keys, "model", "b").agg(
        ws("s0").alias("n"), ws("sy").alias("sy"), ws("syy").alias("syy"), ws("see").alias("see"), ws("sae").alias("sae")
    )
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return tot.select(
        *keys, "model", "b",
        F.when(sst > 1e-12, 1 - F.col("see") / sst).alias("r2"),
        F.sqrt(F.col("see") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
    )


def _ci(col: str, name: str):
    """2.5 and 97.5 percentiles over resamples (one value per resample, so a bounded group)."""
    p = F.percentile(col, F.array(F.lit(0.025), F.lit(0.975)))
    return [p[0].alias(f"{name}_lo"), p[1].alias(f"{name}_hi")]


def bootstrap_ci(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentile intervals of r2, rmse and mae from :func:`bootstrap_scores`."""
    return scores.groupBy(*keys, "model").agg(*_ci("r2", "r2"), *_ci("rmse", "rmse"), *_ci("mae", "mae"))


def _two_sided(d):
    return F.least(
        F.lit(1.0),
        2 * F.least(F.avg((d <= 0).cast("int")), F.avg((d >= 0).cast("int"))),
    )


def paired_bootstrap(scores: DataFrame, contrasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, model_a, model_b, lo, hi, p): interval and two-sided p of the difference in r2."""
    a = scores.select(*keys, "b", F.col("model").alias("model_a"), F.col("r2").alias("_a"))
    b = scores.select(*keys, "b", F.col("model").alias("model_b"), F.col("r2").alias("_b"))
    d = a.join(contrasts, "model_a").join(b, [*keys, "b", "model_b"]).withColumn("d", F.col("_a") - F.col("_b"))
    return d.groupBy(*keys, "model_a", "model_b").agg(*_ci("d", "delta"), _two_sided(F.col("d")).alias("p_boot"))


def joint_bootstrap(
    preds: DataFrame, part: str, clusters: DataFrame, cluster: str, b: int, seed: int
) -> DataFrame:
    """(model, b, mean_r2): one cluster resample applied to every partition, averaged over them."""
    scores = bootstrap_scores(preds, [part], b, seed, unit=cluster, draw_keys=[], units=clusters)
    return scores.groupBy("model", "b").agg(F.avg("r2").alias("mean_r2"))


def interaction(
    pooled: DataFrame, base: str, contrasts: DataFrame, cluster: str, b: int, seed: int, units: DataFrame | None = None
) -> DataFrame:
    """Change of a gap between two models from the base design to every other design.

    gap = (mean squared error of b - that of a) / population variance of y, on the rows the design
    held out. One resample of clusters is applied to both designs.
    """
    centre = pooled.agg(F.avg("y").alias("_c"))
    rows = with_totals(pooled, centre, [])
    yc, e = F.col("y") - F.col("_c"), F.col("y") - F.col("pred")
    sums = rows.groupBy("design", "model", cluster).agg(
        F.count("*").cast("double").alias("s0"), F.sum(yc).alias("sy"), F.sum(yc * yc).alias("syy"), F.sum(e * e).alias("see")
    )
    w = resample_weights(pooled if units is None else units, cluster, b, seed)
    whole = sums.select(cluster).distinct().select(F.lit(-1).alias("b"), cluster, F.lit(1).cast("bigint").alias("w"))
    w = w.select("b", cluster, "w").unionByName(whole)  # b = -1 is the table itself

    def ws(c: str):
        return F.sum(F.col("w") * F.col(c))

    t = sums.join(w, cluster).groupBy("design", "model", "b").agg(
        ws("s0").alias("n"), ws("sy").alias("sy"), ws("syy").alias("syy"), ws("see").alias("see")
    )
    mean = F.col("sy") / F.col("n")
    t = t.select("design", "model", "b", (F.col("see") / F.col("n")).alias("mse"), (F.col("syy") / F.col("n") - mean * mean).alias("var"))
    ta = t.select("design", "b", F.col("model").alias("model_a"), F.col("mse").alias("ma"), "var")
    tb = t.select("design", "b", F.col("model").alias("model_b"), F.col("mse").alias("mb"))
    gap = ta.join(contrasts, "model_a").join(tb, ["design", "b", "model_b"]).select(
        "design", "b", "model_a", "model_b", F.try_divide(F.col("mb") - F.col("ma"), F.col("var")).alias("gap")
    )
    ref = gap.where(F.col("design") == base).select("b", "model_a", "model_b", F.col("gap").alias("gap_base"))
    d = gap.where(F.col("design") != base).join(ref, ["b", "model_a", "model_b"]).withColumn("d", F.col("gap") - F.col("gap_base"))
    keys = ["design", "model_a", "model_b"]
    point = d.where("b = -1").select(*keys, "gap", "gap_base", F.col("d").alias("interaction"))
    spread = d.where("b >= 0").groupBy(*keys).agg(*_ci("d", "interaction"), _two_sided(F.col("d")).alias("p_boot"))
    return point.join(spread, keys)


def bootstrap_rank_ci(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count("ef").alias("n_boot_used"), *_ci("spearman", "spearman"), *_ci("hit_rate", "hit_rate"), *_ci("ef", "ef")
    )


# ---------------------------------------------------------------- rank tests
def wilcoxon(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), alternative: str = "two-sided") -> DataFrame:
    """Signed-rank test of x against y: (keys, n, w_plus, w_minus, statistic, z, p); zeros dropped."""
    d = df.select(*keys, (F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    vc = d.groupBy(*keys, F.abs("d").alias("m")).agg(
        F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up")
    )
    vc = settle(vc)
    ranks = value_ranks(vc, keys, "m", weight="c").select(*keys, "m", "midrank")
    c = F.col("c").cast("double")
    s = vc.join(ranks, [*keys, "m"]).groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.sum(F.col("midrank") * F.col("up")).alias("w_plus"),
        F.sum(F.col("midrank") * (F.col("c") - F.col("up"))).alias("w_minus"),
        F.sum(c * c * c - c).alias("ties"),
    )
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    stat = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    return s.select(
        *keys, "n", "w_plus", "w_minus", stat.alias("statistic"), z.alias("z"),
        P.p_wilcoxon("w_plus", "n", "ties", alternative).alias("p"),
    )


def _two_sided_counts(df: DataFrame, x: str, side: str, first: str, keys: Sequence[str]) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("v")).agg(
        F.count_if(F.col(side) == first).alias("a"), F.count_if(F.col(side) != first).alias("b"), F.count("*").alias("c")
    )


def mann_whitney(df: DataFrame, x: str, side: str, first: str, keys: Sequence[str] = ()) -> DataFrame:
    """Is x smaller on the ``first`` side? (keys, n_a, n_b, u, z, p_less), normal with tie and 0.5 correction."""
    vc = settle(_two_sided_counts(df, x, side, first, keys))
    ranks = value_ranks(vc, keys, "v", weight="c").select(*keys, "v", "midrank")
    c = F.col("c").cast("double")
    s = vc.join(ranks, [*keys, "v"]).groupBy(*keys).agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("midrank") * F.col("a")).alias("ra"),
        F.sum(c * c * c - c).alias("ties"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    s = s.withColumn("u", F.col("ra") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.col("u") - na * nb / 2 + 0.5, sd)
    return s.select(*keys, "n_a", "n_b", "u", z.alias("z"), P.p_normal_lower(z).alias("p_less"))


def seen_unseen_test(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Errors of rows another fit has seen against rows it has not: rmse on each side, ratio, rank test.

    ``df`` has y, pred and a boolean ``seen``.
    """
    rows = df.withColumn("ae", F.abs(F.col("y") - F.col("pred"))).withColumn(
        "side", F.when(F.col("seen"), F.lit("seen")).otherwise(F.lit("unseen"))
    )

    def rmse(flag: bool):
        return F.sqrt(F.avg(F.when(F.col("seen") == flag, F.col("ae") * F.col("ae"))))

    agg = rows.groupBy(*keys).agg(
        rmse(True).alias("rmse_seen"), rmse(False).alias("rmse_unseen"), F.try_divide(rmse(False), rmse(True)).alias("rmse_ratio")
    )
    med = quantiles(rows, "ae", [0.5], [*keys, "side"])
    med = med.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "seen", F.col("q0"))).alias("median_seen"),
        F.max(F.when(F.col("side") == "unseen", F.col("q0"))).alias("median_unseen"),
    )
    u = mann_whitney(rows, "ae", "side", "seen", keys)
    return with_totals(with_totals(u, agg, keys), med, keys)


def ks_2samp(df: DataFrame, x: str, side: str, first: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance: (keys, n_a, n_b, d, p)."""
    from plumbline.core import running_totals

    vc = settle(_two_sided_counts(df, x, side, first, keys))
    tot = vc.groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    cum = with_totals(running_totals(vc, keys, ["v"], {"a": "ca", "b": "cb"}), tot, keys)
    gap = F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))
    s = cum.groupBy(*keys).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max(gap).alias("d"))
    return s.withColumn("p", P.p_ks("d", "n_a", "n_b"))


def anova(df: DataFrame, y: str, cat: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, k, n, f, eta2, p): one-way analysis of variance from group sums."""
    g = df.where(F.col(y).isNotNull()).groupBy(*keys, cat).agg(
        F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    )
    tot = g.groupBy(*keys).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    g = with_totals(g, tot, keys)
    s = g.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
    )
    f = F.try_divide(F.col("ssb") * (F.col("n") - F.col("k")), F.col("ssw") * (F.col("k") - 1))
    return s.select(
        *keys, "k", "n", f.alias("f"), F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta2"),
        P.p_f(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("p"),
    )


def levene(df: DataFrame, x: str, side: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median-centred Levene test: analysis of variance of the distances to the median of each side."""
    # one row per side: sent to the rows, so that those of a side never meet in one task
    med = settle(quantiles(df, x, [0.5], [*keys, side]))
    dev = df.join(F.broadcast(med) if med.count() <= SIDES_SENT else med, [*keys, side]).withColumn("dev", F.abs(F.col(x) - F.col("q0")))
    return anova(dev, "dev", side, keys)


def sign_test(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement of signs; zeros of ``a`` count for the percentage but not for the test."""
    agree = F.signum(a) == F.signum(b)
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n"), (100.0 * F.avg(agree.cast("int"))).alias("sign_agreement_pct"),
        F.count_if(F.col(a) != 0).alias("n_tested"), F.count_if(agree & (F.col(a) != 0)).alias("n_agree"),
    )
    return s.withColumn("p_greater", P.p_binom_greater("n_agree", "n_tested"))


def t_interval(df: DataFrame, d: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, mean, sd, t, p, lo, hi): one-sample t test against 0 and the 95% interval."""
    s = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    half = P.t_quantile(F.col("n") - 1, 0.975) * se
    t = F.try_divide(F.col("mean"), se)
    return s.withColumn("t", t).withColumn("p", P.p_t_two_sided("t", F.col("n") - 1)).withColumn(
        "lo", F.col("mean") - half
    ).withColumn("hi", F.col("mean") + half)


def friedman(df: DataFrame, block: str, treat: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Friedman chi-square of treatments over blocks (tie-corrected) and Kendall's W of the ordinal ranks.

    A block holds one score per treatment, so its ranks come from a small window.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, block)
    asc = w.orderBy(score)
    tied = Window.partitionBy(*keys, block, score)
    r = df.withColumn("_mid", F.rank().over(asc) + (F.count("*").over(tied) - 1) / 2.0).withColumn(
        "_ord", F.row_number().over(w.orderBy(F.desc(score), F.asc(treat)))
    ).withColumn("_t", F.count("*").over(tied).cast("double"))
    dims = r.groupBy(*keys).agg(
        F.count_distinct(block).alias("n"), F.count_distinct(treat).alias("k"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"),  # each of t tied rows adds t^2 - 1, so t^3 - t per tie
    )
    sums = with_totals(
        r.groupBy(*keys, treat).agg(F.sum("_mid").alias("rs"), F.sum("_ord").alias("os")), dims, keys
    )
    n, k = F.col("n"), F.col("k")
    s = sums.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("k").alias("k"), F.first("ties").alias("ties"),
        F.sum(F.col("rs") * F.col("rs")).alias("rss"), F.sum(F.pow(F.col("os") - n * (k + 1) / 2, 2)).alias("s"),
    )
    raw = 12.0 / (n * k * (k + 1)) * F.col("rss") - 3 * n * (k + 1)
    chi2 = F.try_divide(raw, 1 - F.try_divide(F.col("ties"), n * (k * k * k - k)))
    return s.select(
        *keys, "n", "k", chi2.alias("chi2"), P.p_chi2(chi2, k - 1).alias("p"),
        F.try_divide(12 * F.col("s"), n * n * (k * k * k - k)).alias("kendall_w"),
    )


# ---------------------------------------------------------------- conformal intervals
def conformal(cal: DataFrame, test: DataFrame, alphas: Sequence[float] = (0.1, 0.2), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, target, half_width, coverage): widths from calibration residuals, coverage on the test rows."""
    qs = [1 - a for a in alphas]
    res = cal.select(*keys, F.abs(F.col("y") - F.col("pred")).alias("s"))
    widths = quantiles(res, "s", qs, keys, method="higher")
    rows = with_totals(test.select(*keys, F.abs(F.col("y") - F.col("pred")).alias("e")), widths, keys)
    return _coverage(rows, qs, keys, F.lit(1.0))


def conformal_normalised(
    cal: DataFrame, test: DataFrame, alphas: Sequence[float] = (0.1, 0.2), keys: Sequence[str] = ()
) -> DataFrame:
    """The same with residuals divided by the novelty 1 - nn_sim (at least 0.001); widths grow with novelty."""
    qs = [1 - a for a in alphas]
    novelty = F.greatest(1 - F.col("nn_sim"), F.lit(1e-3))
    res = cal.select(*keys, (F.abs(F.col("y") - F.col("pred")) / novelty).alias("s"))
    widths = quantiles(res, "s", qs, keys, method="higher")
    rows = with_totals(
        test.select(*keys, F.abs(F.col("y") - F.col("pred")).alias("e"), novelty.alias("nov")), widths, keys
    )
    return _coverage(rows, qs, keys, F.col("nov"))


def _coverage(rows: DataFrame, qs: Sequence[float], keys: Sequence[str], scale) -> DataFrame:
    out = F.explode(F.array(*[F.struct(F.lit(q).alias("target"), F.col(f"q{i}").alias("q")) for i, q in enumerate(qs)]))
    r = rows.withColumn("c", out).withColumn("w", F.col("c.q") * scale)
    return r.groupBy(*keys, F.col("c.target").alias("target")).agg(
        F.avg("w").alias("half_width"), F.avg((F.col("e") <= F.col("w")).cast("int")).alias("coverage")
    )


# ---------------------------------------------------------------- leverage domain
def williams_domain(train: DataFrame, test: DataFrame, k: int = 50, vec: str = "features") -> DataFrame:
    """(id, leverage, h_star, std_resid, inside): distance of test rows from the training descriptors.

    Principal components are fitted on the training rows only. Leverage is z' (Z'Z)^+ z with the
    k x k matrix inverted on the driver. ``train`` has id and the vector; ``test`` also y and pred.
    """
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def as_vector(df: DataFrame) -> DataFrame:
        clean = F.transform(F.col(vec).cast("array<double>"), lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
        return df.withColumn("_v", array_to_vector(clean))

    tr, te = as_vector(train), as_vector(test)
    model = PCA(k=k, inputCol="_v", outputCol="_z").fit(tr)
    # the fitted projection does not centre its input, so the training mean is taken off afterwards
    z = model.transform(tr).select(vector_to_array("_z").alias("z"))
    centre = [r["m"] for r in z.select(F.posexplode("z").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
    mean = F.array(*[F.lit(float(c)) for c in centre])
    zc = z.select(F.zip_with("z", mean, lambda a, b: a - b).alias("z"))
    gram = zc.select(
        *[F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], F.count("*").alias("n")
    ).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = gram[f"g{i}_{j}"]
    inv = np.linalg.pinv(g)
    h_star = 3.0 * (k + 1) / gram["n"]
    rows = [F.array(*[F.lit(float(v)) for v in r]) for r in inv]
    zt = model.transform(te).withColumn("_zc", F.zip_with(vector_to_array("_z"), mean, lambda a, b: a - b))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    lev = dot(F.col("_zc"), F.array(*[dot(F.col("_zc"), r) for r in rows]))
    scored = zt.select("id", "y", "pred", lev.alias("leverage"))
    sd = scored.agg(F.stddev_samp(F.col("y") - F.col("pred")).alias("sd")).scalar()
    out = scored.withColumn("h_star", F.lit(h_star)).withColumn("std_resid", (F.col("y") - F.col("pred")) / sd)
    return out.withColumn("inside", (F.col("leverage") <= F.col("h_star")) & (F.abs("std_resid") <= 3))
