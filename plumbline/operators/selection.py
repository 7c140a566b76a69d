"""Model selection without the hold-out, and how stable the resulting ranking is.

The cell table has one row per (part, rep, learner): key, fam (family key), q2 (out-of-fold score on
training rows), inner (inner cross-validation score) and test_r2. A partition has a bounded number
of cells, so windows within a partition are small.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import pvalues as P
from plumbline.operators.inference import sign_test, t_interval, wilcoxon
from plumbline.operators.ranking import rank_counts, rank_families, rank_of_mean, select_best

# Row family -> family key, the mixed one being split by what the representation holds.
FAMILY_KEYS = {
    "Fingerprint baseline": "Fp",
    "Descriptor baseline": "Desc",
    "Frozen chemical language model": "Frozen",
    "Fine-tuned chemical language model": "Ft",
    "Graph neural network": "Gnn",
}
MIXED_FAMILY = "Hybrid"
ENCODER_TOKENS = ("ChemBERTa", "MoLFormer")
KEY_JOINER = " | "


def family_key(family: Column, rep: Column) -> Column:
    """Family key of a cell; null for rows outside the seven families."""
    out = None
    for name, key in FAMILY_KEYS.items():
        out = F.when(family == name, F.lit(key)) if out is None else out.when(family == name, F.lit(key))
    mixed = F.when(rep.rlike("|".join(ENCODER_TOKENS)), F.lit("HybClm")).otherwise(F.lit("Hyb"))
    return out.when(family == MIXED_FAMILY, mixed)


def cell_key(rep: Column, learner: Column) -> Column:
    return F.concat(rep, F.lit(KEY_JOINER), learner)


def split_cell_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, r" \| ", 2)
    return parts[0], parts[1]


def rename_keys(df: DataFrame, col: str, names: dict[str, str]) -> DataFrame:
    """Replace legacy names, all others stay (a literal map of a few entries)."""
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return df.withColumn(col, F.coalesce(F.element_at(table, F.col(col)), F.col(col)))


def with_predictions(cells: DataFrame, preds: DataFrame, on: Sequence[str]) -> DataFrame:
    return cells.join(preds, list(on), "left_semi")


def eligible(cells: DataFrame, words: Sequence[str], family: str = "family") -> DataFrame:
    """Cells whose family mentions none of the words, case aside; a missing family mentions nothing."""
    bad = F.lit(False)
    for w in words:
        bad = bad | F.lower(F.coalesce(F.col(family), F.lit(""))).contains(w.lower())
    return cells.where(~bad)


def union_parts(parts: Sequence[DataFrame | None]) -> DataFrame:
    """Union by name of the parts that are there."""
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def model_pairs(models: DataFrame, anchor: str | None = None, model: str = "model") -> DataFrame:
    """(model_a, model_b): every unordered pair of a short list of models, or the anchor against the rest."""
    names = [r[0] for r in models.select(model).distinct().orderBy(model).collect()]
    pairs = [(anchor, b) for b in names if b != anchor] if anchor else [
        (a, b) for i, a in enumerate(names) for b in names[i + 1 :]
    ]
    return models.sparkSession.createDataFrame(pairs, "model_a string, model_b string")


def paired_errors(preds: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute errors of both models of each pair on the same rows."""
    err = preds.select(*keys, "id", "model", "y", "pred", F.abs(F.col("y") - F.col("pred")).alias("ae"))
    a = err.select(*keys, "id", "y", F.col("model").alias("model_a"), F.col("ae").alias("err_a"), F.col("pred").alias("pred_a"))
    b = err.select(*keys, "id", F.col("model").alias("model_b"), F.col("ae").alias("err_b"), F.col("pred").alias("pred_b"))
    return a.join(pairs, "model_a").join(b, [*keys, "id", "model_b"])


# ---------------------------------------------------------------- representatives
def select_representatives(cells: DataFrame, part: Sequence[str], fam: str = "fam") -> DataFrame:
    """Per (part, family): the cell chosen by q2, by inner score and by the hold-out, and what the last one overstates."""
    by = [*part, fam]
    q2 = select_best(cells, by, "q2", "key").select(
        *by, F.col("key").alias("selected"), "q2", "inner", F.col("test_r2").alias("own_r2")
    )
    inner = select_best(cells, by, "inner", "key").select(*by, F.col("key").alias("selected_by_inner"))
    test = select_best(cells, by, "test_r2", "key").select(
        *by, F.col("key").alias("selected_by_test"), F.col("test_r2").alias("test_selected_r2")
    )
    n = cells.groupBy(*by).agg(F.count("*").alias("n_candidates"))
    out = q2.join(inner, by).join(test, by).join(n, by)
    out = (
        out.withColumn("same_under_both", F.col("selected") == F.col("selected_by_inner"))
        .withColumn("selection_changed", F.col("selected") != F.col("selected_by_test"))
        .withColumn("optimism", F.col("test_selected_r2") - F.col("own_r2"))
    )
    return rank_families(out, part, "own_r2", fam)


def selection_summary(reps: DataFrame) -> DataFrame:
    return reps.agg(
        F.count("*").alias("n_combinations"), F.count_if("selection_changed").alias("n_changed"),
        F.count_if("same_under_both").alias("n_agree"), F.max("optimism").alias("max_optimism"),
    )


def contrasts(preds: DataFrame, scores: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference in r2 between models with bootstrap interval and p, and the signed-rank test of their errors."""
    from plumbline.operators.inference import paired_bootstrap
    from plumbline.operators.metrics import regression_metrics

    r2 = regression_metrics(preds, [*keys, "model"]).select(*keys, "model", "r2")
    a = r2.withColumnsRenamed({"model": "model_a", "r2": "ra"})
    b = r2.withColumnsRenamed({"model": "model_b", "r2": "rb"})
    by = [*keys, "model_a", "model_b"]
    point = a.join(pairs, "model_a").join(b, [*keys, "model_b"]).select(*by, (F.col("ra") - F.col("rb")).alias("delta_r2"))
    test = wilcoxon(paired_errors(preds, pairs, keys), "err_a", "err_b", by).select(
        *by, F.col("statistic").alias("wilcoxon_w"), F.col("p").alias("wilcoxon_p")
    )
    return point.join(paired_bootstrap(scores, pairs, keys), by).join(test, by)


def retention(reps: DataFrame, part: str, base: str, fam: str = "fam", score: str = "own_r2") -> DataFrame:
    """Score as a percentage of the same family's score on the base partition."""
    ref = reps.where(F.col(part) == base).select(fam, F.col(score).alias("_base"))
    return reps.where(F.col(part) != base).join(ref, fam).select(
        part, fam, F.when(F.col("_base") != 0, 100.0 * F.col(score) / F.col("_base")).alias("retention_pct")
    )


# ---------------------------------------------------------------- repeated partitions
def complete_partitions(cells: DataFrame, part: Sequence[str], needed: DataFrame, key: str = "key") -> DataFrame:
    """Partitions that have every needed cell."""
    need = needed.select(key).distinct()
    n = need.agg(F.count("*").alias("n")).scalar()
    return (
        cells.join(need, key, "left_semi").groupBy(*part).agg(F.count_distinct(key).alias("n_cells")).where(F.col("n_cells") == n)
    )


def usable_designs(complete: DataFrame, design: str, least: int = 3) -> DataFrame:
    """Designs with enough complete partitions to be analysed."""
    return complete.groupBy(design).agg(F.count("*").alias("n_complete")).where(F.col("n_complete") >= least)


def nested_selection(cells: DataFrame, part: Sequence[str], fam: str = "fam") -> DataFrame:
    """The cell with the best inner score of each family, chosen anew in every partition."""
    return select_best(cells, [*part, fam], "inner", "key").withColumn("rule", F.lit("nested"))


def fixed_selection(cells: DataFrame, fixed: DataFrame, fam: str = "fam") -> DataFrame:
    """The same cell of each family in every partition; ``fixed`` has (fam, key)."""
    return cells.join(fixed.select(fam, "key"), [fam, "key"], "left_semi").withColumn("rule", F.lit("fixed"))


def nested_vs_fixed(chosen: DataFrame, part: Sequence[str], fam: str = "fam") -> DataFrame:
    """Per family: partitions where both rules apply and where they choose the same cell."""
    both = chosen.groupBy(*part, fam).pivot("rule", ["nested", "fixed"]).agg(F.first("key")).dropna(subset=["nested", "fixed"])
    return both.groupBy(fam).agg(F.count("*").alias("n"), F.count_if(F.col("nested") == F.col("fixed")).alias("n_same"))


def paired_over_partitions(df: DataFrame, pairs: DataFrame, part: str, keys: Sequence[str], fam: str = "fam", score: str = "r2") -> DataFrame:
    """Family a minus family b over partitions: wins, mean, sd, t interval, sign test, signed-rank test."""
    a = df.select(*keys, part, F.col(fam).alias("fam_a"), F.col(score).alias("_a"))
    b = df.select(*keys, part, F.col(fam).alias("fam_b"), F.col(score).alias("_b"))
    d = a.join(pairs, "fam_a").join(b, [*keys, part, "fam_b"]).withColumn("d", F.col("_a") - F.col("_b")).withColumn("zero", F.lit(0.0))
    by = [*keys, "fam_a", "fam_b"]
    wins = d.groupBy(*by).agg(
        F.count_if(F.col("d") > 0).alias("n_a_better"), F.count_if(F.col("d") != 0).alias("n_nonzero"),
        F.min("d").alias("min_delta"), F.max("d").alias("max_delta"),
    ).withColumn("p_sign", P.p_binom_two_sided("n_a_better", "n_nonzero"))
    t = t_interval(d, "d", by).select(
        *by, F.col("n").alias("n_parts"), F.col("mean").alias("mean_delta"), F.col("sd").alias("sd_delta"), "lo", "hi"
    )
    w = wilcoxon(d, "d", "zero", by).select(*by, F.col("p").alias("p_wilcoxon"))
    return t.join(wins, by).join(w, by, "left")


def stability(df: DataFrame, design: Sequence[str], part: str, fam: str = "fam", score: str = "r2") -> DataFrame:
    """One row per (design, family): spread of the score, ranks, and how often each cell was chosen.

    ``df`` has one row per partition and family with the score, ``key`` and ``optimism``.
    """
    n_fam = df.select(fam).distinct().count()
    ranked = rank_families(df, [*design, part], score, fam)
    base = ranked.groupBy(*design, fam).agg(
        F.avg(score).alias("r2_mean"), F.stddev_samp(score).alias("r2_sd"), F.percentile(score, F.lit(0.5)).alias("r2_median"),
        F.min(score).alias("r2_min"), F.max(score).alias("r2_max"), F.avg("optimism").alias("mean_optimism"),
    )
    counts = ranked.groupBy(*design, fam, "key").agg(F.count("*").alias("c")).groupBy(*design, fam).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "c")))).alias("selected")
    )
    ranks = rank_counts(ranked, design, fam, "rank", n_fam)
    pos = rank_of_mean(ranked, design, fam, score, "rank").select(*design, fam, "rank_of_mean_score", "rank_of_mean_rank")
    by = [*design, fam]
    return base.join(ranks, by).join(pos, by).join(counts, by)


def late_cell_wins(cells: DataFrame, late: DataFrame, part: Sequence[str], fam: str = "fam") -> DataFrame:
    """Partitions in which a cell added later would have had the best inner score of its family."""
    by = [*part, fam]
    is_late = cells.join(late.select("key").withColumn("_l", F.lit(True)), "key", "left").withColumn("_l", F.coalesce("_l", F.lit(False)))
    s = is_late.groupBy(*by).agg(
        F.max(F.when(F.col("_l"), F.col("inner"))).alias("late"), F.max(F.when(~F.col("_l"), F.col("inner"))).alias("early")
    )
    return s.where("late is not null").groupBy(fam).agg(
        F.count("*").alias("n_checked"), F.count_if(F.col("late") > F.col("early")).alias("n_late_wins")
    )


def same_input_contrast(cells: DataFrame, part: Sequence[str], tuned: str, frozen: Sequence[str]) -> DataFrame:
    """(part, tuned_r2, frozen_key, frozen_r2, delta): a model against the best frozen cell of the same input."""
    best = select_best(cells.where(F.col("key").isin(*frozen)), part, "inner", "key").select(
        *part, F.col("key").alias("frozen_key"), F.col("test_r2").alias("frozen_r2")
    )
    t = cells.where(F.col("key") == tuned).select(*part, F.col("test_r2").alias("tuned_r2"))
    return t.join(best, list(part)).withColumn("delta", F.col("tuned_r2") - F.col("frozen_r2"))


def reproduction_diff(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Re-run value against stored value with the absolute difference."""
    return a.select(*on, F.col(value).alias("stored")).join(b.select(*on, F.col(value).alias("rerun")), list(on)).withColumn(
        "abs_diff", F.abs(F.col("stored") - F.col("rerun"))
    )


def main_table(cells: DataFrame, roles: DataFrame, part: str, primary: str) -> DataFrame:
    """Models that have a role, in order of their training score; the first role of a model counts.

    ``roles`` has (key, role, seq) and a handful of rows.
    """
    first = roles.groupBy("key").agg(F.min_by("role", "seq").alias("role"))
    return cells.where(F.col(part) == primary).join(first, "key").select("key", "role", "q2", "test_r2", "test_rmse", "test_mae").orderBy(
        F.desc("q2"), F.asc("key")
    )


def negative_counts(df: DataFrame, design: Sequence[str], part: str, score: str = "r2") -> DataFrame:
    """Scored cells below zero and partitions in which every family is below zero."""
    per = df.groupBy(*design, part).agg(
        F.count_if(F.col(score) < 0).alias("neg"), F.count("*").alias("n"), F.bool_and(F.col(score) < 0).alias("every")
    )
    return per.groupBy(*design).agg(
        F.sum("neg").alias("n_negative"), F.sum("n").alias("n_scored"), F.count_if("every").alias("n_parts_all_negative")
    )
