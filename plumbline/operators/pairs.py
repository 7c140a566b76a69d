"""Matched-pair analysis and top-k triage."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.core import with_totals
from plumbline.functions import pvalues as P
from plumbline.operators.inference import sign_test, t_interval
from plumbline.operators.metrics import correlation, spearman
from plumbline.operators.ranking import quantiles, top_fraction


# ---------------------------------------------------------------- pairs
def pair_deltas(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Observed and predicted change from the row without the unit to the one with it.

    ``values`` has (id, y, pred); pairs with an unscored member are left out.
    """
    a = values.select(F.col("id").alias("id_without"), F.col("y").alias("_ya"), F.col("pred").alias("_pa"))
    b = values.select(F.col("id").alias("id_with"), F.col("y").alias("_yb"), F.col("pred").alias("_pb"))
    return (
        pairs.join(a, "id_without")
        .join(b, "id_with")
        .withColumn("observed", F.col("_yb") - F.col("_ya"))
        .withColumn("predicted", F.col("_pb") - F.col("_pa"))
        .drop("_ya", "_yb", "_pa", "_pb")
        .dropna(subset=["observed", "predicted"])
    )


def combined_predictions(entities: DataFrame, *sources: DataFrame) -> DataFrame:
    """One score per entity: the first source that has one (out-of-fold for training rows, hold-out
    for test rows); null where none has."""
    stacked = None
    for i, s in enumerate(sources):
        part = s.select("id", "pred", F.lit(i).alias("_s"))
        stacked = part if stacked is None else stacked.unionByName(part)
    one = stacked.where("pred is not null").groupBy("id").agg(F.min_by("pred", "_s").alias("pred"))
    return entities.join(one, "id", "left")


def pair_exposure(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Was the partner in the training rows of the model that scored each member?

    ``folds`` has (id, role, fold): a test row is scored by the fit on all training rows, a training
    row by the fit without its own fold.
    """
    a = folds.select(F.col("id").alias("id_without"), F.col("role").alias("_ra"), F.col("fold").alias("_fa"))
    b = folds.select(F.col("id").alias("id_with"), F.col("role").alias("_rb"), F.col("fold").alias("_fb"))

    def seen(tr: str, tf: str, pr: str, pf: str) -> Column:
        return (
            F.when(F.col(tr) == "test", F.col(pr) == "train")
            .when(F.col(pr) == "test", F.lit(False))
            .otherwise(F.col(tf) != F.col(pf))
            .cast("int")
        )

    n = pairs.join(a, "id_without").join(b, "id_with").withColumn(
        "seen", seen("_ra", "_fa", "_rb", "_fb") + seen("_rb", "_fb", "_ra", "_fa")
    )
    both, one = F.count_if(F.col("seen") == 2), F.count_if(F.col("seen") == 1)
    return n.agg(
        F.count("*").alias("n_pairs"), both.alias("both"), one.alias("one"), F.count_if(F.col("seen") == 0).alias("neither"),
        (100.0 * (both + one) / F.count("*")).alias("pct_pairs_exposed"),
        (100.0 * (2 * both + one) / (2 * F.count("*"))).alias("pct_predictions_exposed"),
    )


def pair_stats(deltas: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement of observed and predicted deltas (columns observed, predicted)."""
    base = deltas.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.avg("observed").alias("mean_observed"), F.stddev_samp("observed").alias("sd_observed"),
        F.avg("predicted").alias("mean_predicted"), F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("mae_of_delta"),
    )
    parts = [
        spearman(deltas, "observed", "predicted", keys),
        correlation(deltas, "observed", "predicted", keys),
        sign_test(deltas, "observed", "predicted", keys).select(
            *keys, "sign_agreement_pct", F.col("p_greater").alias("sign_p")
        ),
        t_interval(deltas, "predicted", keys).select(*keys, F.col("t").alias("t_predicted"), F.col("p").alias("p_t_predicted")),
    ]
    for p in parts:
        base = with_totals(base, p, keys)
    return base.withColumn("spearman_p", P.p_correlation("spearman", "n_pairs"))


def pair_protocols(pairs: DataFrame, values: dict[str, DataFrame], least: int = 8) -> DataFrame:
    """The same statistics under several scoring protocols, protocols with too few pairs left out.

    ``values`` maps a protocol name to (id, y, pred) and, optionally, restricts the pairs by a null pred.
    """
    rows = None
    for name, v in values.items():
        part = pair_deltas(pairs, v).withColumn("protocol", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return pair_stats(rows, ["protocol"]).where(F.col("n_pairs") >= least)


def pair_bootstrap(deltas: DataFrame, component: str, b: int, seed: int) -> DataFrame:
    """Interval of the mean predicted delta and the sign agreement, resampling whole components."""
    from plumbline.operators.inference import _ci, resample_weights

    agree = (F.signum("observed") == F.signum("predicted")).cast("int")
    sums = deltas.groupBy(component).agg(
        F.count("*").alias("s0"), F.sum("predicted").alias("sp"), F.sum(agree).alias("sa")
    )
    w = resample_weights(deltas, component, b, seed)
    per = sums.join(w, component).groupBy("b").agg(
        (F.sum(F.col("w") * F.col("sp")) / F.sum(F.col("w") * F.col("s0"))).alias("mean_predicted"),
        (100.0 * F.sum(F.col("w") * F.col("sa")) / F.sum(F.col("w") * F.col("s0"))).alias("sign_pct"),
    )
    return per.agg(*_ci("mean_predicted", "mean_predicted"), *_ci("sign_pct", "sign_pct"))


# ---------------------------------------------------------------- triage
def active_threshold(entities: DataFrame, y: str = "y", q: float = 0.9):
    """Scalar column: the q-quantile of the full table, above which a row is active."""
    return quantiles(entities, y, [q]).select("q0").scalar()


def enrichment(
    df: DataFrame, fracs: Sequence[float] = (0.05, 0.10, 0.20), keys: Sequence[str] = (), score: str = "pred"
) -> DataFrame:
    """(keys, frac, n, n_act, k, hits, hit_rate_pct, ef, ef_max, p): how well the top fraction finds actives.

    ``df`` has id, the score and a boolean ``active``. Without actives the rates are null.
    """
    tot = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("active").alias("n_act"))
    # one ranking serves all fractions, the largest of them decides which rows are kept
    top = top_fraction(df.select(*keys, "id", score, "active"), score, max(fracs), "id", keys)
    top = with_totals(top, tot, keys)
    each = F.explode(F.array(*[F.lit(float(f)) for f in fracs]))
    rows = top.drop("k").withColumn("frac", each)
    k = F.greatest(F.lit(1).cast("bigint"), F.rint(F.col("frac") * F.col("n")).cast("bigint"))
    rows = rows.withColumn("k", k).where("rn <= k")
    s = rows.groupBy(*keys, "frac").agg(
        F.first("n").alias("n"), F.first("n_act").alias("n_act"), F.first("k").alias("k"), F.count_if("active").alias("hits")
    )
    base, has = F.col("n_act") / F.col("n"), F.col("n_act") > 0
    return s.select(
        *keys, "frac", "n", "n_act", "k", "hits",
        F.when(has, 100.0 * F.col("hits") / F.col("k")).alias("hit_rate_pct"),
        F.when(has, F.col("hits") / F.col("k") / base).alias("ef"),
        F.when(has, F.least(F.lit(1.0), F.col("n_act") / F.col("k")) / base).alias("ef_max"),
        P.p_hypergeom("hits", "n", "n_act", "k").alias("p"),
    )


def enrichment_repeated(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys: mean, sd, extremes over folds and folds above 1, from a table of :func:`enrichment` per fold."""
    return folds.groupBy(*keys, "frac").agg(
        F.count("*").alias("n_folds"), F.avg("ef").alias("ef_mean"), F.stddev_samp("ef").alias("ef_sd"),
        F.min("ef").alias("ef_min"), F.max("ef").alias("ef_max_fold"), F.count_if(F.col("ef") > 1).alias("n_above_one"),
    )


def pooled_enrichment(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys: enrichment from the sums over folds whose hold-outs do not overlap."""
    s = folds.groupBy(*keys, "frac").agg(
        F.sum("k").alias("k"), F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.sum("n_act").alias("n_act")
    )
    rate, base = F.col("hits") / F.col("k"), F.col("n_act") / F.col("n")
    return s.select(
        *keys, "frac", "k", "hits", (100 * rate).alias("hit_rate_pct"), (100 * base).alias("base_rate_pct"),
        F.when(F.col("n_act") > 0, rate / base).alias("ef"),
    )
