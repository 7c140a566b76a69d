"""Ranks, quantiles, top-k and other order-based operators."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.core import half_even, ranked, running_total, value_ranks, with_totals


def avg_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """Mid-ranks (ties share their mean rank) of ``value`` within ``keys``, joined to the rows."""
    ranks = value_ranks(df, keys, value).select(*keys, value, F.col("midrank").alias(out))
    return df.join(ranks, [*keys, value])


def quantiles(
    df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = (), method: str = "linear",
    weight: str | None = None,
) -> DataFrame:
    """(keys, q0, q1, …): exact quantiles by position.

    Works on counts of distinct values and a distributed running total, so a group of any size
    never has to sit in one aggregation buffer. ``linear`` interpolates, ``higher`` takes the next
    order statistic.
    """
    cnt = F.count("*") if weight is None else F.sum(weight)
    vc = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(cnt.alias("cnt"))
    totals = vc.groupBy(*keys).agg(F.sum("cnt").alias("tot"))
    cum = with_totals(running_total(vc, keys, [value], "cnt", "upto"), totals, keys)

    def at(pos: Column) -> Column:
        here = (pos < F.col("upto")) & (pos >= F.col("upto") - F.col("cnt"))
        return F.max(F.when(here, F.col(value).cast("double")))

    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("tot") - 1) * F.lit(float(q))
        lo = F.floor(pos) if method == "linear" else F.ceil(pos - 1e-9)
        aggs.append(at(lo).alias(f"lo{i}"))
        if method == "linear":
            aggs.append(at(F.ceil(pos)).alias(f"hi{i}"))
            aggs.append(F.max(pos - F.floor(pos)).alias(f"fr{i}"))
    found = cum.groupBy(*keys).agg(*aggs)
    if method == "linear":
        cols = [(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"fr{i}")).alias(f"q{i}") for i in range(len(qs))]
    else:
        cols = [F.col(f"lo{i}").alias(f"q{i}") for i in range(len(qs))]
    return found.select(*keys, *cols)


def quantile_higher(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Order statistic at ``ceil((n - 1) q)`` from zero."""
    return quantiles(df, value, qs, keys, method="higher")


def top_fraction(
    df: DataFrame, score: str, frac: float, ident: str, keys: Sequence[str] = (), lowest: bool = False
) -> DataFrame:
    """The max(1, half-even(frac * n)) best rows by score, ties by id; adds ``rn`` and ``k``."""
    order = [F.col(score).asc() if lowest else F.col(score).desc(), F.col(ident).asc()]
    totals = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = with_totals(ranked(df, keys, order), totals, keys)
    k = F.greatest(F.lit(1).cast("bigint"), half_even(F.col("_n") * F.lit(float(frac))))
    return rows.withColumn("k", k).where(F.col("rn") <= F.col("k")).drop("_n")


def select_best(cells: DataFrame, by: Sequence[str], score: str, key: str, place: int = 1) -> DataFrame:
    """The row with the ``place``-th highest score in each group, ties by key.

    The constant limit lets Spark cut each group before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), F.asc(key))
    return (
        cells.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= place)
        .where(F.col("_rn") == place)
        .drop("_rn")
    )


def runner_up(cells: DataFrame, by: Sequence[str], score: str, key: str) -> DataFrame:
    return select_best(cells, by, score, key, place=2)


def rank_families(df: DataFrame, part: Sequence[str], score: str, family: str, out: str = "rank") -> DataFrame:
    """Ordinal rank of each family in its partition, 1 = highest score; a partition has few families."""
    w = Window.partitionBy(*part).orderBy(F.desc(score), F.asc(family))
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def rank_of_mean(df: DataFrame, design: Sequence[str], family: str, score: str, rank: str) -> DataFrame:
    """Position of each family by its mean score and by its mean rank."""
    means = df.groupBy(*design, family).agg(F.avg(score).alias("mean_score"), F.avg(rank).alias("mean_rank"))
    by_score = Window.partitionBy(*design).orderBy(F.desc("mean_score"), F.asc(family))
    by_rank = Window.partitionBy(*design).orderBy(F.asc("mean_rank"), F.asc(family))
    return means.withColumn("rank_of_mean_score", F.row_number().over(by_score).cast("bigint")).withColumn(
        "rank_of_mean_rank", F.row_number().over(by_rank).cast("bigint")
    )


def rank_counts(df: DataFrame, design: Sequence[str], family: str, rank: str, n_families: int) -> DataFrame:
    """How often each family comes first, in the top three and last; mean and median rank."""
    return df.groupBy(*design, family).agg(
        F.count_if(F.col(rank) == 1).alias("n_first"),
        F.count_if(F.col(rank) <= 3).alias("n_top3"),
        F.count_if(F.col(rank) == n_families).alias("n_last"),
        F.avg(rank).alias("rank_mean"),
        F.percentile(rank, F.lit(0.5)).alias("rank_median"),  # one value per partition of the design
    )


def bh_adjust(df: DataFrame, p: str, key: str, keys: Sequence[str] = (), out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg: running minimum of p * m / rank from the largest p down, at most 1.

    The running minimum is taken inside the ranges of a distributed sort and then carried across.
    """
    totals = df.groupBy(*keys).agg(F.count("*").alias("_m"))
    rows = with_totals(ranked(df, keys, [F.col(p).asc(), F.col(key).asc()], "_rk"), totals, keys)
    rows = rows.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rk"))
    # blocks of consecutive ranks: the minimum over later blocks plus the minimum inside the own one
    rows = rows.withColumn("_blk", F.floor((F.col("_rk") - 1) / BH_BLOCK))
    inside = Window.partitionBy(*keys, "_blk").orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.min("_raw").over(inside))
    heads = rows.groupBy(*keys, "_blk").agg(F.min("_raw").alias("_b"))
    after = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_later", F.min("_b").over(after)).drop("_b")
    return (
        rows.join(heads, [*keys, "_blk"])
        .withColumn(out, F.least(F.col("_in"), F.col("_later"), F.lit(1.0)))
        .drop("_m", "_rk", "_raw", "_blk", "_in", "_later")
    )


BH_BLOCK = 100_000


def largest_errors(df: DataFrame, n: int, ident: str, y: str, pred: str, text: str, width: int = 46) -> DataFrame:
    """The n largest absolute residuals; long texts end in three dots after ``width - 2`` characters."""
    short = F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 2), F.lit("..."))
    ).otherwise(F.col(text))
    return (
        df.withColumn("abs_err", F.abs(F.col(y) - F.col(pred)))
        .orderBy(F.desc("abs_err"), F.asc(ident))
        .limit(n)
        .withColumn(text, short)
    )


def merge_cells(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """One row per key, the last part winning."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return last.select(*key, "_r.*").select(*df.columns)


def distinct_ordered(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct keys with the position of their first appearance."""
    return df.groupBy(key).agg(F.min(seq).alias(seq))
