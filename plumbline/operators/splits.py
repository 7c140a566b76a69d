"""Partition builders and the checks that go with them.

A partition is a long table (…, id, role) with role in {train, test}; folds are (id, fold).
Pseudo-random order is the md5 of seed and id, so it does not depend on how the rows are stored.
"""
from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.core import half_even, hash_key, ranked, running_total, settle, with_totals
from plumbline.operators.ranking import quantiles, top_fraction

NO_GROUP = "<null>"


def _seeds(seeds: Iterable[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(s)) for s in seeds]))


def _role(test: Column) -> Column:
    return F.when(test, F.lit("test")).otherwise(F.lit("train")).alias("role")


# ---------------------------------------------------------------- stratified
def repeated_splits(df: DataFrame, ident: str, strata: str, seeds: Sequence[int], frac: float = 0.1) -> DataFrame:
    """(seed, id, role): stratified shuffle splits, one per seed.

    The hold-out has ceil(frac * n) rows, shared out over the strata by largest remainder.
    """
    rows = df.select(F.col(ident).alias("id"), F.coalesce(F.col(strata).cast("string"), F.lit(NO_GROUP)).alias("s"))
    # one row per stratum from here on
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    total = F.ceil(F.sum("n").over(everything) * F.lit(float(frac)) - F.lit(1e-9))
    sizes = sizes.withColumn("ideal", F.col("n") * total / F.sum("n").over(everything))
    sizes = sizes.withColumn("base", F.floor("ideal")).withColumn("left", total - F.sum("base").over(everything))
    order = Window.orderBy(F.desc(F.round(F.col("ideal") - F.col("base"), 9)), F.asc("s"))
    quota = F.col("base") + F.when(F.row_number().over(order) <= F.col("left"), 1).otherwise(0)
    quotas = sizes.select("s", quota.alias("quota"))
    drawn = rows.withColumn("seed", _seeds(seeds)).withColumn("h", hash_key(F.col("seed"), F.col("id")))
    return ranked(drawn, ["seed", "s"], ["h", "id"]).join(quotas, "s").select(
        "seed", "id", _role(F.col("rn") <= F.col("quota"))
    )


def stratified_split(df: DataFrame, ident: str, strata: str, seed: int = 42, frac: float = 0.1) -> DataFrame:
    """(id, role): one stratified shuffle split."""
    return repeated_splits(df, ident, strata, [seed], frac).drop("seed")


def stratified_kfold(df: DataFrame, ident: str, strata: str, k: int, seed: int) -> DataFrame:
    """(id, fold): folds dealt out within each stratum, each stratum going on where the last one stopped."""
    rows = df.select(
        F.col(ident).alias("id"), F.coalesce(F.col(strata).cast("string"), F.lit(NO_GROUP)).alias("s"),
        hash_key(seed, F.col(ident)).alias("h"),
    )
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("s").agg(F.count("*").alias("n")).select(
        "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    return ranked(rows, ["s"], ["h", "id"]).join(starts, "s").select(
        "id", ((F.col("rn") - 1 + F.col("start")) % k).alias("fold")
    )


def kfold(df: DataFrame, ident: str, k: int, seed: int) -> DataFrame:
    """(id, fold): folds of equal size (within one row) in hashed order."""
    rows = df.select(F.col(ident).alias("id"), hash_key(seed, F.col(ident)).alias("h"))
    return ranked(rows, [], ["h", "id"]).select("id", ((F.col("rn") - 1) % k).alias("fold"))


# ---------------------------------------------------------------- group-disjoint
def replicate_splits(df: DataFrame, ident: str, group: str, seeds: Sequence[int], frac: float = 0.1) -> DataFrame:
    """(seed, id, role): whole groups go to the hold-out, smallest first, until half-even(frac * n) rows.

    Sizes ascend, so leaving out every group that would overflow is the same as stopping there. The
    first group is always taken, even if it is larger than the target.
    """
    rows = df.select(F.col(ident).alias("id"), F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP)).alias("g"))
    sizes = settle(rows.groupBy("g").agg(F.count("*").alias("n")))
    target = sizes.agg(half_even(F.sum("n") * F.lit(float(frac)))).scalar()
    drawn = sizes.withColumn("seed", _seeds(seeds)).withColumn("h", hash_key(F.col("seed"), F.col("g")))
    cum = running_total(drawn, ["seed"], ["n", "h", "g"], "n", "upto")
    picked = cum.select("seed", "g", ((F.col("upto") <= target) | (F.col("upto") == F.col("n"))).alias("held"))
    return rows.join(picked, "g").select("seed", "id", _role(F.col("held")))


def group_disjoint_split(df: DataFrame, ident: str, group: str, seed: int = 42, frac: float = 0.1) -> DataFrame:
    """(id, role): one group-disjoint split, smallest groups held out first."""
    return replicate_splits(df, ident, group, [seed], frac).drop("seed")


def _water_fill(levels: list[int], size: int, m: int, rng: random.Random) -> list[int]:
    """How many of m equal groups each fold gets when every group goes to the smallest fold."""
    def given(level: int) -> list[int]:
        return [max(0, -(-(level - x) // size)) for x in levels]

    lo, hi = min(levels), min(levels) + size * m
    while lo < hi:  # highest level that m groups can fill up to
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(given(mid)) <= m else (lo, mid - 1)
    counts = given(lo)
    for _ in range(m - sum(counts)):
        now = [x + c * size for x, c in zip(levels, counts)]
        low = min(now)
        counts[rng.choice([j for j, x in enumerate(now) if x == low])] += 1
    return counts


def balanced_group_folds(df: DataFrame, ident: str, group: str, k: int, seed: int) -> DataFrame:
    """(id, fold): whole groups, largest first, each to the fold that is smallest at that point.

    Groups of one size are interchangeable and come in hashed order, so only the distinct sizes (at
    most about sqrt(2 n)) are placed one after another; the driver keeps k counters.
    """
    rows = df.select(F.col(ident).alias("id"), F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP)).alias("g"))
    sizes = settle(rows.groupBy("g").agg(F.count("*").alias("n")))
    rng = random.Random(seed)
    levels, ranges = [0] * k, []
    for r in sizes.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).toLocalIterator():
        start = 1
        for fold, c in enumerate(_water_fill(levels, r["n"], r["m"], rng)):
            if c:
                ranges.append((r["n"], start, start + c, fold))
                levels[fold] += c * r["n"]
                start += c
    table = df.sparkSession.createDataFrame(ranges, "n bigint, lo bigint, hi bigint, fold bigint")
    order = ranked(sizes.withColumn("h", hash_key(seed, F.col("g"))), ["n"], ["h", "g"])
    placed = order.join(table, "n").where("rn >= lo and rn < hi").select("g", "fold")
    return rows.join(placed, "g").select("id", "fold")


def component_folds(nodes: DataFrame, ident: str, edges: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, component, fold): balanced folds that keep every connected component whole."""
    from plumbline.operators.graph import connected_components

    comp = settle(connected_components(edges, nodes.select(F.col(ident).alias("id"))))
    folds = balanced_group_folds(comp, "id", "component", k, seed)
    return comp.join(folds, "id")


# ---------------------------------------------------------------- most isolated rows
def dissimilarity_split(nn: DataFrame, frac: float = 0.1) -> DataFrame:
    """(id, role) from a table (id, nn_sim): the half-even(frac * n) rows with the lowest similarity are held out."""
    held = top_fraction(nn.select("id", "nn_sim"), "nn_sim", frac, "id", lowest=True).select("id", F.lit(True).alias("h"))
    return nn.select("id").join(held, "id", "left").select("id", _role(F.col("h").isNotNull()))


# ---------------------------------------------------------------- folds as partitions, set checks
def folds_to_parts(folds: DataFrame, design: str, k: int) -> DataFrame:
    """(design, part, fold, id, role): every fold held out once, the others being its training rows."""
    rows = folds.withColumnRenamed("fold", "_f").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.select(
        F.lit(design).alias("design"),
        F.format_string(f"{design}_f%02d", F.col("fold").cast("int")).alias("part"),
        F.col("fold").cast("bigint").alias("fold"),
        "id",
        _role(F.col("_f") == F.col("fold")),
    )


def complement(all_ids: DataFrame, test: DataFrame) -> DataFrame:
    return all_ids.join(test.select("id"), "id", "left_anti")


def shared_groups(parts: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that occur on both sides of a partition; empty for a group-disjoint one."""
    return (
        parts.join(groups, "id")
        .groupBy(*keys, "grp")
        .agg(F.max((F.col("role") == "test").cast("int")).alias("_t"), F.max((F.col("role") == "train").cast("int")).alias("_r"))
        .where("_t = 1 and _r = 1")
        .select(*keys, "grp")
    )


def coverage_check(parts: DataFrame, design: str = "design") -> DataFrame:
    """Ids that are not held out exactly once by a design; empty for a set of folds."""
    return (
        parts.groupBy(design, "id")
        .agg(F.sum((F.col("role") == "test").cast("bigint")).alias("times_held_out"))
        .where("times_held_out <> 1")
    )


def partition_overlap(parts: DataFrame, design: str, part: str) -> DataFrame:
    """(design, part_a, part_b, n_a, n_shared, pct_shared) for the hold-outs of a design, a < b.

    Per id the parts that hold it out are combined, which is one row per pair of parts and id.
    """
    held = parts.where("role = 'test'").select(design, part, "id").distinct()
    sizes = held.groupBy(design, part).agg(F.count("*").alias("n_a"))
    a = held.withColumnRenamed(part, "part_a")
    b = held.withColumnRenamed(part, "part_b")
    shared = a.join(b, [design, "id"]).where("part_a < part_b").groupBy(design, "part_a", "part_b").agg(
        F.count("*").alias("n_shared")
    )
    # parts are few (one per seed or fold)
    names = sizes.select(design, F.col(part).alias("part_a"), "n_a")
    every = names.join(sizes.select(design, F.col(part).alias("part_b")), design).where("part_a < part_b")
    return every.join(shared, [design, "part_a", "part_b"], "left").fillna(0, ["n_shared"]).withColumn(
        "pct_shared", 100.0 * F.col("n_shared") / F.col("n_a")
    )


def overlap_with_primary(parts: DataFrame, primary: DataFrame, design: str, part: str) -> DataFrame:
    """Share of every hold-out that the primary hold-out (id, role) has as well."""
    base = primary.where("role = 'test'").select("id", F.lit(1).alias("_p"))
    return (
        parts.where("role = 'test'")
        .join(base, "id", "left")
        .groupBy(design, part)
        .agg(F.count("*").alias("n_test"), (100.0 * F.count("_p") / F.count("*")).alias("pct_shared_with_primary"))
    )


def ever_held_out(parts: DataFrame, design: str) -> DataFrame:
    return parts.where("role = 'test'").groupBy(design).agg(F.count_distinct("id").alias("n_ever_held_out"))


# ---------------------------------------------------------------- characterisation
def characterise(parts: DataFrame, nn: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per partition: sizes, similarity of the hold-out to training, group overlap, y on both sides.

    ``parts`` (keys, id, role); ``nn`` (keys, id, nn_sim) for test rows; ``entities`` (id, y, grp, cat).
    """
    keys = list(keys)
    rows = parts.join(entities, "id")
    sizes = rows.groupBy(*keys).agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "test").alias("n_test"),
        F.avg(F.when(F.col("role") == "test", F.col("y"))).alias("test_mean_y"),
        F.stddev_samp(F.when(F.col("role") == "test", F.col("y"))).alias("test_sd_y"),
        F.avg(F.when(F.col("role") == "train", F.col("y"))).alias("train_mean_y"),
        F.stddev_samp(F.when(F.col("role") == "train", F.col("y"))).alias("train_sd_y"),
    )
    per_group = rows.groupBy(*keys, "grp").agg(
        F.count_if(F.col("role") == "test").alias("t"), F.count_if(F.col("role") == "train").alias("r")
    ).where("t > 0")
    groups = per_group.groupBy(*keys).agg(
        F.count("*").alias("n_test_groups"),
        (100.0 * F.sum(F.when(F.col("r") > 0, F.col("t")).otherwise(0)) / F.sum("t")).alias("pct_group_seen"),
        F.max("t").alias("largest_test_group"),
    )
    sims = nn.groupBy(*keys).agg(
        F.avg("nn_sim").alias("nn_mean"),
        (100.0 * F.avg((F.col("nn_sim") >= 0.7).cast("int"))).alias("pct_nn_ge_07"),
        (100.0 * F.avg((F.col("nn_sim") >= 0.4).cast("int"))).alias("pct_nn_ge_04"),
    )
    q = quantiles(nn, "nn_sim", [0.5, 0.1, 0.9], keys).withColumnsRenamed({"q0": "nn_median", "q1": "nn_p10", "q2": "nn_p90"})
    return sizes.join(groups, keys).join(sims, keys).join(q, keys)


def category_counts(parts: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One map per partition: test rows by category (few categories)."""
    per = parts.where("role = 'test'").join(entities, "id").groupBy(*keys, "cat").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cat", "n")))).alias("test_categories"))


def design_summary(chars: DataFrame, design: str, cols: Sequence[str]) -> DataFrame:
    """Min, max and mean of each characteristic over the partitions of a design."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return chars.groupBy(design).agg(F.count("*").alias("n_parts"), *aggs)
