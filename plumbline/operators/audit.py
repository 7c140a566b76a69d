"""Provenance, duplicates, endpoint distribution, categories, groups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.features import SPACES, token_set
from plumbline.operators.ranking import quantiles


def norm_keys(df: DataFrame, text: str) -> DataFrame:
    """Four key levels of a text: as is, case and spaces folded, hash of the token set, first block of that hash."""
    folded = F.trim(F.regexp_replace(F.lower(F.col(text)), SPACES, " "))
    h = F.md5(F.array_join(token_set(F.col(text)), " "))
    dashed = F.concat_ws("-", F.substring(h, 1, 14), F.substring(h, 15, 10), F.substring(h, 25, 8))
    return (
        df.withColumn("key_raw", F.col(text))
        .withColumn("key_folded", folded)
        .withColumn("key_hash", dashed)
        .withColumn("key_block", F.substring_index("key_hash", "-", 1))
    )


KEY_LEVELS = ("key_raw", "key_folded", "key_hash", "key_block")


def contains_share(df: DataFrame, col: str, terms: Sequence[str]) -> DataFrame:
    """(term, n, share): rows whose text contains the term, case aside."""
    low = F.lower(F.col(col))
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), low.contains(t.lower()).cast("int").alias("hit")) for t in terms
    ])).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.hit").alias("n"), F.avg("x.hit").alias("share"))


# The units a time window is given in.
TIME_UNITS = ("min", "mins", "minute", "minutes", "hr", "hrs", "hour", "hours")


def window_wording(col: Column) -> Column:
    """Does the text give a range of times ("5 to 10 mins", "up to 2 hours")? A range without a time unit is none."""
    unit = r"\s*(?:" + "|".join(TIME_UNITS) + r")\b"
    return col.rlike(r"(?i)\b\d+\s*to\s*\d+" + unit + r"|\bup to\s*\d+" + unit)


def cascade(col: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str = "Other") -> Column:
    """First category one of whose patterns occurs in the text."""
    out = None
    for name, patterns in rules:
        hit = col.rlike(patterns[0])
        for p in patterns[1:]:
            hit = hit | col.rlike(p)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def qc_flags(df: DataFrame, text: str, alphabet: str = r"[a-z]") -> DataFrame:
    """Record checks: usable text, several parts, symbol runs, letters outside the alphabet, digits."""
    t = F.col(text)
    letters = F.array_distinct(F.filter(F.split(F.lower(t), ""), lambda c: (c != "") & c.rlike(r"\p{L}")))
    allowed = F.filter(letters, lambda c: c.rlike(alphabet))
    return (
        df.withColumn("usable", F.coalesce(F.length(F.trim(t)) > 0, F.lit(False)))
        .withColumn("multi_part", F.coalesce(t.contains("\n"), F.lit(False)))
        .withColumn("symbol_run", F.coalesce(t.rlike(r"[#$%&*]{3,}"), F.lit(False)))
        .withColumn("outside_alphabet", F.coalesce(F.size(F.array_except(letters, allowed)) > 0, F.lit(False)))
        .withColumn("has_digits", F.coalesce(t.rlike(r"[0-9]"), F.lit(False)))
    )


QC_COLUMNS = ("usable", "multi_part", "symbol_run", "outside_alphabet", "has_digits")


def qc_report(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count("*").alias("n_records"), *[F.count_if(c).alias(f"n_{c}") for c in QC_COLUMNS])


def sensitivity_subset(parts: DataFrame, flags: DataFrame) -> DataFrame:
    """Partition rows that do not carry the flag (``flags``: id, flag)."""
    return parts.join(flags.where("flag"), "id", "left_anti")


def subset_counts(parts: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = parts.groupBy(*keys, "role").agg(F.count("*").alias("n_full"))
    b = kept.groupBy(*keys, "role").agg(F.count("*").alias("n_kept"))
    return a.join(b, [*keys, "role"], "left").fillna(0, ["n_kept"])


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    out = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))
    return out if n is None else out.limit(n)


def provenance(df: DataFrame, source: str, ident: str, text: str, top: int = 10) -> DataFrame:
    """One row: records, sources, ids, records per source, concentration, singletons, distinct texts."""
    sizes = df.groupBy(source).agg(F.count("*").alias("n"))
    q = quantiles(sizes, "n", [0.5, 0.25, 0.75])
    biggest = sizes.orderBy(F.desc("n"), F.asc(source)).limit(top).agg(F.sum("n").alias("t"))
    s = sizes.agg(
        F.sum("n").alias("n_records"), F.count("*").alias("n_sources"), F.max("n").alias("max_per_source"),
        F.min("n").alias("min_per_source"), (100.0 * F.max("n") / F.sum("n")).alias("pct_largest"),
        F.count_if(F.col("n") == 1).alias("n_single_record"),
    )
    # texts are counted by their hash, so the shuffle does not carry them
    d = df.agg(F.count_distinct(ident).alias("n_ids"), F.count_distinct(F.md5(text)).alias("n_texts"))
    return s.select(
        "*", (100.0 * biggest.scalar() / F.col("n_records")).alias("pct_top"), d.select("n_ids").scalar().alias("n_ids"),
        d.select("n_texts").scalar().alias("n_texts"), q.select("q0").scalar().alias("median_per_source"),
        q.select("q1").scalar().alias("q25_per_source"), q.select("q2").scalar().alias("q75_per_source"),
    )


def duplicate_report(df: DataFrame, levels: Sequence[str], y: str) -> DataFrame:
    """Per key level: distinct keys, duplicate groups, records in them and the spread of y within them."""
    # the levels are unpivoted as hashes, so a long key is not shuffled once per level
    each = df.select(F.col(y).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("level"), F.md5(F.col(c)).alias("k")) for c in levels
    ])).alias("x")).select("y", "x.level", "x.k").where("k is not null")
    groups = each.groupBy("level", "k").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("spread"))
    dup = F.col("n") > 1
    s = groups.groupBy("level").agg(
        F.count("*").alias("n_unique"), F.count_if(dup).alias("n_groups"), F.sum(F.when(dup, F.col("n")).otherwise(0)).alias("n_records"),
        F.coalesce(F.max(F.when(dup, F.col("spread"))), F.lit(0.0)).alias("max_spread"),
        F.count_if(dup & (F.col("spread") > 1)).alias("n_spread_gt_1"),
    )
    med = quantiles(groups.where(dup), "spread", [0.5], ["level"])
    return s.join(med, "level", "left").select("*", F.coalesce("q0", F.lit(0.0)).alias("median_spread")).drop("q0")


def endpoint_summary(df: DataFrame, y: str) -> DataFrame:
    """One row: mean, sd, median, range, quartiles, orders of magnitude and skewness of y and of 10^-y."""
    lin = F.pow(F.lit(10.0), -F.col(y))
    q = quantiles(df, y, [0.5, 0.25, 0.75])
    rows = df.where(F.col(y).isNotNull()).withColumn("_lin", lin)
    ends = rows.agg(F.min("_lin").alias("a"), F.max("_lin").alias("b"))
    return rows.agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.skewness(y).alias("skew"), F.skewness("_lin").alias("skew_linear"),
    ).select(
        "*", q.select("q0").scalar().alias("median"), q.select("q1").scalar().alias("q25"), q.select("q2").scalar().alias("q75"),
        F.log10(ends.select("b").scalar() / ends.select("a").scalar()).alias("orders_of_magnitude"),
    )


def category_table(df: DataFrame, cat: str, source: str, y: str = "y", role: str = "role") -> DataFrame:
    """Per category: size, share, rows on both sides, mean, sd (0 for one row), range and sources."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy(cat).agg(
        F.count("*").alias("n"), F.count_if(F.col(role) == "train").alias("n_train"), F.count_if(F.col(role) == "test").alias("n_test"),
        F.avg(y).alias("mean_y"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("sd_y"), F.min(y).alias("min_y"), F.max(y).alias("max_y"),
        F.count_distinct(source).alias("n_sources"),
    ).withColumn("pct", 100.0 * F.col("n") / total)


def group_inventory(df: DataFrame, key: str, special: str) -> DataFrame:
    """One row: number of groups, singletons, the largest one and the size of a special key."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.max("n").alias("largest"),
        F.coalesce(F.max(F.when(F.col(key) == special, F.col("n"))), F.lit(0).cast("bigint")).alias("n_special"),
    )


def box_stats(df: DataFrame, y: str, cat: str) -> DataFrame:
    """Quartiles per category, ordered by mean."""
    q = quantiles(df, y, [0.25, 0.5, 0.75], [cat]).withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})
    m = df.groupBy(cat).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.min(y).alias("min"), F.max(y).alias("max"))
    order = Window.orderBy(F.asc("mean"), F.asc(cat))  # one row per category
    return m.join(q, cat).withColumn("position", F.row_number().over(order).cast("bigint"))
