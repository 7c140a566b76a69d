"""Scores of predictions and the tables made from them.

Input is a long table of predictions with columns ``y`` and ``pred``. Every metric comes from one
grouped pass of partial sums.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.core import value_ranks

# Edges of the similarity bins; the last bin is open upwards so that 1.0 belongs to it.
SIMILARITY_EDGES = (0.0, 0.4, 0.6, 0.8, 1.01)


def metric_columns(min_n: int = 1, min_n_r2: int = 1) -> list[Column]:
    """n, r2, rmse, mae; r2 is null where the scored values do not vary, metrics null below a count."""
    err = F.col("y") - F.col("pred")
    n = F.count("*")
    sst = n * F.var_pop("y")
    r2 = F.when((sst > 0) & (n >= min_n_r2), 1 - F.sum(err * err) / sst)
    return [
        n.alias("n"),
        r2.alias("r2"),
        F.when(n >= min_n, F.sqrt(F.sum(err * err) / n)).alias("rmse"),
        F.when(n >= min_n, F.sum(F.abs(err)) / n).alias("mae"),
    ]


def regression_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*metric_columns())


def pearson(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation, null where one side does not vary."""
    vary = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(vary, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), out: str = "pearson") -> DataFrame:
    return df.groupBy(*keys).agg(pearson(x, y).alias(out))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), out: str = "spearman") -> DataFrame:
    """Pearson correlation of mid-ranks within ``keys``; rows with a null on either side are dropped."""
    rows = df.select(*keys, x, y).dropna(subset=[x, y])
    # (x, y) combinations are counted first, so that repeated values are joined once
    combos = rows.groupBy(*keys, x, y).agg(F.count("*").alias("_c"))
    rx = value_ranks(combos, keys, x, weight="_c").select(*keys, x, F.col("midrank").alias("_rx"))
    ry = value_ranks(combos, keys, y, weight="_c").select(*keys, y, F.col("midrank").alias("_ry"))
    j = combos.join(rx, [*keys, x]).join(ry, [*keys, y])
    return weighted_correlation(j, "_rx", "_ry", "_c", keys, out)


def weighted_correlation(df: DataFrame, x: str, y: str, w: str, keys: Sequence[str], out: str) -> DataFrame:
    """Correlation with integer weights, from centred sums."""
    means = df.groupBy(*keys).agg(
        (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("_mx"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("_my")
    )
    from plumbline.core import with_totals

    d = with_totals(df, means, keys)
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sxx, syy = F.sum(F.col(w) * dx * dx), F.sum(F.col(w) * dy * dy)
    return d.groupBy(*keys).agg(
        F.when((sxx > 0) & (syy > 0), F.sum(F.col(w) * dx * dy) / F.sqrt(sxx * syy)).alias(out)
    )


def classwise_metrics(df: DataFrame, cat: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per class: rmse and mae from 3 rows on, r2 from 6."""
    return df.groupBy(*keys, cat).agg(F.avg("y").alias("mean_y"), *metric_columns(3, 6))


def similarity_bin(sim: Column, edges: Sequence[float] = SIMILARITY_EDGES) -> Column:
    """Label of the [lo, hi) bin, the top one shown as ending at 1.0; missing values give '?'."""
    out = F.when(sim.isNull() | F.isnan(sim), F.lit("?"))
    for lo, hi in zip(edges[:-1], edges[1:]):
        label = f"[{lo:.1f}, {min(hi, 1.0):.1f})"
        out = out.when((sim >= lo) & (sim < hi), F.lit(label))
    return out.otherwise(F.lit("?"))


def binned_metrics(df: DataFrame, sim: str, keys: Sequence[str] = (), edges=SIMILARITY_EDGES) -> DataFrame:
    """Metrics per similarity bin; bins below 3 rows are left out, r2 needs more than 5."""
    rows = df.withColumn("sim_bin", similarity_bin(F.col(sim), edges))
    return rows.groupBy(*keys, "sim_bin").agg(*metric_columns(3, 6)).where("n >= 3")


def null_model(df: DataFrame, split: Sequence[str], role: str = "role") -> DataFrame:
    """Per split: rmse of predicting the training mean on the test rows."""
    rows = df.select(*split, role, "id", "y").distinct()
    means = rows.where(F.col(role) == "train").groupBy(*split).agg(F.avg("y").alias("train_mean"))
    test = rows.where(F.col(role) == "test").join(means, list(split))
    return test.groupBy(*split).agg(
        F.first("train_mean").alias("train_mean"),
        F.sqrt(F.avg(F.pow(F.col("y") - F.col("train_mean"), 2))).alias("null_rmse"),
    )


def worse_than_null(scores: DataFrame, null: DataFrame, split: Sequence[str]) -> DataFrame:
    """Per split: how many models score a negative R2 and how many lose to the null model."""
    return scores.join(null, list(split)).groupBy(*split).agg(
        F.count("*").alias("n_models"),
        F.count_if(F.col("r2") < 0).alias("n_negative"),
        F.count_if(F.col("rmse") > F.col("null_rmse")).alias("n_worse_than_null"),
    )


def learner_spread(cells: DataFrame, part: Sequence[str], rep: str, learner: str, score: str, least: int = 3) -> DataFrame:
    """Range of the score over learners for every representation scored by at least ``least`` of them."""
    return (
        cells.groupBy(*part, rep)
        .agg(
            F.count_distinct(learner).alias("n_learners"),
            F.min(score).alias("lo"),
            F.max(score).alias("hi"),
            F.max_by(learner, F.struct(F.col(score), F.col(learner))).alias("best_learner"),
        )
        .where(F.col("n_learners") >= least)
        .withColumn("spread", F.col("hi") - F.col("lo"))
    )


def spread_summary(spread: DataFrame, part: Sequence[str], rep: str) -> DataFrame:
    """Median range and the representation with the widest one; one row per representation comes in."""
    return spread.groupBy(*part).agg(
        F.percentile("spread", F.lit(0.5)).alias("median_spread"),
        F.max("spread").alias("widest"),
        F.max_by(rep, F.struct(F.col("spread"), F.col(rep))).alias("widest_rep"),
    )


def family_best(cells: DataFrame, part: Sequence[str], family: str, score: str) -> DataFrame:
    return cells.groupBy(*part, family).agg(F.max(score).alias("best"))


def family_spread(best: DataFrame, part: Sequence[str]) -> DataFrame:
    return best.groupBy(*part).agg((F.max("best") - F.min("best")).alias("family_spread"))


def pivot_cells(df: DataFrame, row: Sequence[str], col: str, values: Sequence[str], score: str) -> DataFrame:
    """Rows x given columns, highest score in each cell."""
    return df.groupBy(*row).pivot(col, list(values)).agg(F.max(score))


def grid_coverage(cells: DataFrame, part: Sequence[str], rep: str, learner: str) -> DataFrame:
    """Inputs per learner and whether the grid is a full product of inputs and learners."""
    per = cells.groupBy(*part, learner).agg(F.count_distinct(rep).alias("n_inputs"))
    allreps = cells.groupBy(*part).agg(F.count_distinct(rep).alias("n_reps"))
    return per.join(allreps, list(part)).withColumn("covers_all", F.col("n_inputs") == F.col("n_reps"))


def ensemble_mean(preds: DataFrame, members: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Mean prediction of the member models per row; rows that lack a member are left out.

    ``members`` holds the model names (a handful), one row each.
    """
    names = [r[0] for r in members.select(model).distinct().collect()]
    # a flag per member takes one aggregation, distinct names would take two and a row per name
    found = sum((F.max((F.col(model) == m).cast("bigint")) for m in names if m is not None), F.lit(0).cast("bigint"))
    return (
        preds.where(F.col(model).isin([m for m in names if m is not None]))
        .groupBy(*keys)
        .agg(F.avg("pred").alias("pred"), found.alias("n_members"), F.first("y").alias("y"))
        .where(F.col("n_members") == len(names))
    )


def seed_stats(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Mean, sd (0 for a single seed), min and max over seeds."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_seeds"),
        F.avg(score).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    )


def threshold_contrast(df: DataFrame, col: str, t: float, keys: Sequence[str] = ()) -> DataFrame:
    """Count and rmse of the rows at or above a threshold and of those below it."""
    side = F.when(F.col(col) >= t, F.lit("above")).otherwise(F.lit("below"))
    return df.withColumn("side", side).groupBy(*keys, "side").agg(*metric_columns())


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")
    )


def length_stats(df: DataFrame, length: str, limit: int, keys: Sequence[str] = ()) -> DataFrame:
    """Median, 99th percentile and maximum of a length and how many rows reach the limit."""
    from plumbline.core import with_totals
    from plumbline.operators.ranking import quantiles

    q = quantiles(df, length, [0.5, 0.99], keys)
    tot = df.groupBy(*keys).agg(F.max(length).alias("max_len"), F.count_if(F.col(length) >= limit).alias("n_at_limit"))
    return with_totals(q, tot, keys).withColumnsRenamed({"q0": "median", "q1": "p99"})


def matrix_agreement(a: DataFrame, b: DataFrame, ident: str = "id", vec: str = "features") -> DataFrame:
    """Agreement of two vector tables over their common width: per-row and per-column correlation.

    One row: median and minimum of the per-row Pearson correlation, mean of the per-column one
    (undefined ones skipped) and the largest absolute difference.
    """
    from plumbline.operators.ranking import quantiles

    pa = a.select(ident, F.posexplode(vec).alias("pos", "va"))
    pb = b.select(ident, F.posexplode(vec).alias("pos", "vb"))
    j = pa.join(pb, [ident, "pos"]).select(ident, "pos", F.col("va").cast("double"), F.col("vb").cast("double"))

    per_row = j.groupBy(ident).agg(pearson("va", "vb").alias("r"))
    per_col = j.groupBy("pos").agg(pearson("va", "vb").alias("r")).agg(F.avg("r").alias("mean_col_r"))
    worst = j.agg(F.max(F.abs(F.col("va") - F.col("vb"))).alias("max_abs_diff"))
    low = per_row.agg(F.min("r").alias("min_row_r"))
    return quantiles(per_row, "r", [0.5]).select(
        F.col("q0").alias("median_row_r"),
        low.scalar().alias("min_row_r"),
        per_col.scalar().alias("mean_col_r"),
        worst.scalar().alias("max_abs_diff"),
    )


def pool_vectors(df: DataFrame, how: str, ident: str = "id") -> DataFrame:
    """Pool a sequence of vectors (id, layer, pos, mask, vec) into one vector per id.

    ``mean``: masked mean over positions of the last layer; ``first``: the vector of the first
    position; ``mean_last4``: masked mean over the positions of the last four layers.
    """
    top = df.groupBy(ident).agg(F.max("layer").alias("_top"))
    rows = df.join(top, ident)
    if how == "first":
        rows = rows.where(F.col("layer") == F.col("_top"))
        return rows.groupBy(ident).agg(F.min_by("vec", "pos").alias("features"))
    depth = {"mean": 1, "mean_last4": 4}[how]
    rows = rows.where((F.col("mask") == 1) & (F.col("layer") > F.col("_top") - depth))
    each = rows.select(ident, F.posexplode("vec").alias("dim", "v")).groupBy(ident, "dim").agg(F.avg("v").alias("v"))
    return each.groupBy(ident).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("features")
    )


def histogram(df: DataFrame, col: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, lo, hi, n): equal-width bins from 1 over the range of all rows, the last one closed."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    rows = df.select(*keys, F.col(col).alias("_v")).where("_v is not null").withColumn("_lo", lo).withColumn("_hi", hi)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col("_v") - F.col("_lo")) / width) + 1, F.lit(bins)).cast("bigint")
    rows = rows.withColumn("bin", F.when(width == 0, F.lit(1).cast("bigint")).otherwise(b))
    return rows.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"),
        (F.first("_lo") + (F.first("bin") - 1) * F.first(width)).alias("lo"),
        (F.first("_lo") + F.first("bin") * F.first(width)).alias("hi"),
    )
